"""What the operators need of a session: a folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` where it is set, else a folder of the warehouse; never a machine's own folder.

    A warehouse under `file:` is one machine's unless the master is local, so on a cluster it is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if house.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {house} is on one machine")
    return house + "/_scratch"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint() in the shared folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many partitions as a shuffle has: rows that are few but costly are not put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffles alone, whatever size Spark takes either side for.

    Rows unfolded from arrays or spans are many times what Spark expects, and a side taken for small would go whole through the driver.
    """
    return df.hint("merge")


def byte_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the Arrow batches that Python gets by their bytes, unless the user has set a smaller bound: a row is a block of samples."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-"))
    if given > most or given <= 0:
        spark.conf.set(key, str(most))
