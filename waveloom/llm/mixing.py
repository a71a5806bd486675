"""Mixing sources to target weights.

Tokens are added up per source, targets follow from the weights with a cap on repetition, and
each document is taken floor(rate) times plus once more with probability equal to the fraction,
drawn from a hash of its id, so that reruns and retries agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, sized, written

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3, "mix"
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from sizes (source, source_size), one row per source.

    Weights repeat along the sources in code point order, null last. A source whose target would
    exceed `most` times its size stops there; the excess is shared again by weight until none
    is above; an empty table gives no rows, sources of no size have target 0, and other columns
    are left out. The level is found by rounds of one small aggregate each, so no source table is
    gathered; each round caps at least one more source.
    """
    spark = sizes.sparkSession
    ranked = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranked = ranked.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    ranked = written(ranked, "sources")
    counts = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, base = 0, []
    for part in sorted(counts):
        base.append((part, before))
        before += counts[part]
    if not base:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    base = spark.createDataFrame(base, "part int, base long")
    w = F.array(*[F.lit(float(x)) for x in weights])
    cap = F.col("source_size") * most
    weighed = ranked.join(F.broadcast(base), "part").select("source", "source_size", F.element_at(w, ((F.col("base") + F.col("at")) % len(weights) + 1).cast("int")).alias("w"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        held = cap <= F.col("w") * level if capped >= 0 else F.lit(False)
        row = weighed.agg(F.count_if(held), F.coalesce(F.sum(F.when(held, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("w"))), F.lit(0.0))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - row[1]) / row[2]
    return weighed.select("source", "source_size", F.least(cap.cast("double"), F.col("w") * level).alias("target"))


def _taken(docs: DataFrame, weights: tuple[float, ...], most: int, seed: str) -> DataFrame:
    """(row, size, source_size, target, copies): row holds the columns of docs, whatever their names."""
    own = docs.select(as_rows(docs), n_words(F.col("text")).alias("size"))
    sizes = docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    table = sized(written(targets(sizes, weights, most), "targets").withColumnRenamed("source", "of"))
    own = own.join(table, own["row.source"].eqNullSafe(table["of"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = (draw(F.col("row.doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return own.select("row", "size", "source_size", "target", F.when(F.col("size") > 0, F.floor(rate) + more).otherwise(F.lit(0)).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies, the number of times that the mix takes each row.

    Null texts have size 0 and a null source is a source; documents without words are not
    taken. Rows with the same id, or none, draw alike. An empty table gives no rows; texts of any
    length are counted whole. Columns of docs keep their names, dots included; size, source_size,
    target and copies replace any of that name, in whatever case.
    """
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    return _taken(docs, weights, most, seed).select(*kept, "size", "source_size", "target", "copies")


def emitted(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of the mix itself, a repeated document repeated, with the columns of docs as they are, of any names.

    As in `mixed`: null texts and such without words are not taken, a null source is a source,
    rows of one id draw alike, repeated rows count each, and an empty table gives no rows.
    """
    return _taken(docs, weights, most, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
