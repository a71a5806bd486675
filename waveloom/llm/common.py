"""Helpers that several operators share: scratch tables, text buffers, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.functions.session import shared_dir

#: Rows that Spark hands to Python at once; keeps a batch of long texts within a worker's memory.
ARROW_ROWS = 1000

#: Rows of a few numbers each that may be broadcast: some 64 MB.
BROADCAST_ROWS = 1_000_000

#: `[\x20\x09-\x0D]`, the white space of the word operators.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


_TABLES: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Within this scope results are read; when it ends, the scratch tables made in it are deleted."""
    begun = len(_TABLES)
    try:
        yield
    finally:
        for path in _TABLES[begun:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _TABLES[begun:]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here and a lost executor loses nothing of it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, written and narrow, marked for broadcast if it has at most `most` rows; beyond that it is joined by shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators unless the user has set a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def quoted(name: str):
    """The column of exactly this name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_rows(docs: DataFrame):
    """The columns of docs as one struct `row`, whatever their names; `row.*` gives them back."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("row")


def text_slices(batch, texts, limit: int = 1 << 20):
    """(slice of an Arrow batch, slice of its texts) with about `limit` bytes of text at most, one row at least."""
    _, offsets = text_buffer(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, nulls as empty, and the offsets of its rows in them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word `[^\\x20\\x09-\\x0D]+`; words never cross rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def min_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the pairs (a, b), on top of earlier labels."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        keep = x != y
        if not keep.any():
            break
        a, b, low, high = a[keep], b[keep], np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star: each round is two grouped minima and joins, written
    to the shared folder, and the number of rounds grows with the logarithm of the longest chain.
    Hubs are joined to one minimum, never gathered. Self-loops are ignored; no edges, no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").union(least.select(F.col("a").alias("b"), "m"))
        now = written(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def whole_groups(batches, keys: list[str]):
    """Arrow batches sorted by keys, cut so that no group of equal keys is divided between two of them."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        same_as_held = held and all(held[-1].column(k)[-1].as_py() == c[0].item() for k, c in zip(keys, cols, strict=True))
        if held and not same_as_held:
            yield pa.concat_tables(held)
            held = []
        if len(cuts):
            yield pa.concat_tables([*held, table.slice(0, cuts[-1] + 1)])
            held = [table.slice(cuts[-1] + 1)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)
