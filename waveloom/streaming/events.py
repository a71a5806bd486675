"""Event streams: sessions and hopping windows with a watermark, and block streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, names: str = "*.parquet") -> DataFrame:
    """Events as a stream of the Parquet files of a folder; `ts` becomes a timestamp that a watermark accepts."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _at(events: DataFrame):
    """The event time; a cast would lose a stream's watermark."""
    return F.col("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")


def session_totals(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user; events later than `late` are dropped."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("user_id", F.session_window(_at(own), gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.unix_timestamp("s.start").alias("t0"), "n", "total")


def hop_totals(events: DataFrame, length: str = "2 hours", hop: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Hopping windows per event type."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("event_type", F.window(_at(own), length, hop).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("w.start").alias("t0"), "n")


def drained(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now and write its rows to `path`."""
    q = result.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
