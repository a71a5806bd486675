"""Labelled example sets: a grid of classes by level, written once as Parquet, read by filter, split exactly.

Examples are (modulation, snr_db, example, i, q) with arrays i and q.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED, SHARES = 26147, (0.70, 0.15, 0.15)
NAMES = ("train", "validation", "test")


def gaps(rows: DataFrame, a: str = "modulation", b: str = "snr_db") -> DataFrame:
    """(a, b) pairs of the full grid of values of a and b that no row has. Both are classes, so few."""
    seen = rows.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    return seen.select(a).distinct().crossJoin(F.broadcast(seen.select(b).distinct())).join(seen, [a, b], "left_anti")


def convert(rows: DataFrame, path: str, size: int | None = None) -> None:
    """Write examples to path, a folder for each modulation, in order of level and example; what is there already stays.

    A grid with gaps or, with `size`, examples of another length are refused before anything is written.
    """
    missing = gaps(rows).limit(5).collect()
    if missing:
        raise ValueError(f"the grid has gaps, as {[tuple(r) for r in missing]}")
    if size is not None and not rows.where((F.size("i") != size) | (F.size("q") != size)).isEmpty():
        raise ValueError(f"not all examples have {size} samples")
    ordered = rows.repartition("modulation").sortWithinPartitions("modulation", "snr_db", "example")
    ordered.write.mode("ignore").partitionBy("modulation").parquet(path)


def load(spark: SparkSession, path: str, modulation: str | None = None, snr_db: float | None = None) -> DataFrame:
    """Examples of a set; the filters prune folders and row groups."""
    rows = spark.read.parquet(path)
    if modulation is not None:
        rows = rows.where(F.col("modulation") == modulation)
    return rows if snr_db is None else rows.where(F.col("snr_db") == snr_db)


def complex_iq() -> Column:
    """Samples as an array of (i, q)."""
    return F.arrays_zip("i", "q")


def split(rows: DataFrame, key: str, *strata: str, seed: int = SEED, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """rows with `split`: exact shares of each stratum, by rank of a seeded hash of the key; every row with a key is in one.

    Membership is by hash, so it does not follow any particular generator's permutation.
    """
    own = Window.partitionBy(*strata)
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    ranked = rows.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(own))
    cut, out = 0.0, None
    for name, share in zip(NAMES[:-1], shares, strict=False):
        cut += share
        inside = F.col("_k") <= F.round(F.col("_n") * round(cut, 9))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return ranked.withColumn("split", out.otherwise(NAMES[-1])).drop("_k", "_n")
