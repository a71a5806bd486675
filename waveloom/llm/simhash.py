"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed once per document and reduced to distinct values before any join.
Two fingerprints within `bits` differing bits agree exactly on at least one of `bits + 1`
blocks, so the trie is dealt out under those blocks: rotating a fingerprint brings one block to
the top, and each block value is the root of a subtrie. The traversal of a subtrie goes down in
pairs of nodes, adds up differing bits and prunes a pair as soon as the budget is exceeded.
A root with very many fingerprints is split again under the blocks of its remaining bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_rows, components, min_labels, partitions, sized, small_batches, whole_groups, written

WORDS, BITS, SEED = 4, 4, 42
#: Distinct fingerprints under one root beyond which it is split under a second block.
SPLIT = 20_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit majority of the XXH64 of word shingles; 0 for a text without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        hashes = [digest(b" ".join(w), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(w[k:] for k in range(words)), strict=False)]
    total = np.zeros(64, np.int64)
    h = np.array(hashes, ">u8")
    for k in range(0, len(h), 65536):
        part = h[k : k + 65536]
        total += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, values: np.ndarray, bits: int, top: int, leaf: int = 32):
    """Index pairs of equal keys whose values differ in at most `bits` bits, in chunks.

    keys and values must be sorted by (key, value); values of one key share their `top` highest bits.
    Node pairs of all roots go down together, a level of the trie at a time.
    """
    n = len(keys)
    if not n:
        return
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    alo, ahi = edge[:-1], edge[1:]
    keep = ahi - alo > 1
    alo, ahi = alo[keep], ahi[keep]
    blo, bhi, diff = alo.copy(), ahi.copy(), np.zeros(len(alo), np.int8)
    for depth in range(top, 65):
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (depth == 64)
        if small.any():
            for s in np.array_split(np.flatnonzero(small), max(1, int(small.sum()) // 200_000)):
                na, nb = (ahi - alo)[s], (bhi - blo)[s]
                each = na * nb
                which = np.repeat(np.arange(len(s)), each)
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                i, j = alo[s][which] + at // nb[which], blo[s][which] + at % nb[which]
                ok = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= bits)
                yield i[ok], j[ok]
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            return
        ones = np.r_[0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        am, bm = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = (alo == blo) & (ahi == bhi)
        nodes = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), tuple(x[~own] for x in (am, ahi, blo, bm, diff + 1))]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*nodes, strict=True))
        keep = (diff <= bits) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi == bhi) & (ahi - alo < 2))
        alo, ahi, blo, bhi, diff = (x[keep] for x in (alo, ahi, blo, bhi, diff))


def _forest(bits: int, top: int):
    """Arrow function: a spanning forest of the links under each root, as (a, b) of rep."""
    import pyarrow as pa

    def run(batches):
        for t in whole_groups(batches, ["root"]):
            root, rep = t.column("root").to_numpy(), t.column("rep").to_numpy()
            v = t.column("turned").to_numpy().view(np.uint64)
            order = np.lexsort((v, root))
            root, rep, v = root[order], rep[order], v[order]
            labels = np.arange(len(v))
            for i, j in trie_pairs(root, v, bits, top):
                labels = min_labels(len(v), i, j, labels)
            far = np.flatnonzero(labels != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[labels[far]])], ["a", "b"])

    return run


def _rotl(col, k: int):
    return F.shiftleft(col, k).bitwiseOR(F.shiftrightunsigned(col, 64 - k)) if k else col


def _blocks(size: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of disjoint blocks that cover `size` bits from the top, the wider ones first."""
    widths = [size // parts + (k < size % parts) for k in range(parts)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _top(col, width: int):
    return F.shiftrightunsigned(col, 64 - width) if width else F.lit(0).cast("long")


def linked(distinct: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) of rep that connect all of distinct (fp, rep) that reach each other within `bits` bits."""
    spark = distinct.sparkSession
    blocks = _blocks(64, bits + 1)
    narrow, wide = blocks[-1][1], blocks[0][1]
    root = lambda k, s, w: F.struct(F.lit(k).alias("k"), _rotl(F.col("fp"), s).alias("turned"), F.lit(k).cast("long").bitwiseOR(F.shiftleft(_top(_rotl(F.col("fp"), s), w), 8)).alias("root"))
    roots = distinct.select("rep", F.explode(F.array(*[root(k, s, w) for k, (s, w) in enumerate(blocks)])).alias("x")).select("rep", "x.*")
    run = _forest(bits, narrow)
    large = roots.groupBy("root").count().where(F.col("count") > split).select("root")
    n = partitions(spark)
    deal = lambda df: df.select("root", "turned", "rep").repartition(n, "root").sortWithinPartitions("root")
    if large.isEmpty():
        return deal(roots).mapInArrow(run, "a long, b long")
    small = roots.join(large, "root", "left_anti")
    # the first block is equal under the root, so the bits after it, which are as many as the block leaves, are cut once more
    under = lambda w: F.array(*[F.struct(F.lit(s).alias("at"), _top(F.shiftleft("turned", w + s), v).alias("block")) for s, v in _blocks(64 - w, bits + 1)])
    again = roots.join(large, "root", "left_semi").select("rep", "turned", "root", F.explode(F.when(F.col("k") < 64 % (bits + 1), under(wide)).otherwise(under(narrow))).alias("x"))
    again = again.select("rep", "turned", F.xxhash64("root", "x.at", "x.block").alias("root"))
    return deal(small).mapInArrow(run, "a long, b long").union(deal(again).mapInArrow(_forest(bits, 0), "a long, b long"))


def grouped(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root) for each distinct fp of the written table fps: root is the least fingerprint reachable within `bits` bits."""
    distinct = fps.select("fp").distinct()
    found = components(linked(distinct.select("fp", F.col("fp").alias("rep")), bits))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text, ...).

    Null and empty texts have fingerprint zero and are linked like any other; texts of any length
    are read whole. Repeated rows stay repeated; an empty table gives no rows; other columns are
    ignored. component_id is the smallest doc_id that is reachable over fingerprints within `bits`
    bits, the own one included. Rows without id link like any other; their component_id is null
    only where no row of the group has an id.
    """
    fps = written(fingerprints(docs, words, seed), "simhash")
    roots = grouped(fps, bits)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(roots, "fp")
    named = roots.join(least.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    named = sized(written(named.select("fp", "component_id"), "groups"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """The rows of docs, one of each group of near duplicates: that of the smallest doc_id, rows without id last.

    Of repeated rows one stays. All columns stay as they are. Rows get a number when they are
    written with their fingerprints; the numbers of those that go are what is joined, not texts.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in b.column("row").field("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("at"), pa.array(fp, pa.int64())], ["row", "at", "fp"])

    own = docs.select(as_rows(docs), F.monotonically_increasing_id().alias("at"))
    rows = written(own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("fp", T.LongType())])), "simhash")
    keys = rows.select("fp", "at", F.col("row.doc_id").cast("long").alias("id"))
    roots = sized(written(grouped(keys, bits), "groups"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    first = keys.groupBy("fp").agg(F.min(order).alias("o")).join(roots, "fp").groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.at").alias("first"), "root")
    first = sized(written(first.join(roots, "root").select("fp", "first"), "groups"))
    gone = sized(written(keys.join(first, "fp").where("at <> first").select("at"), "gone"))
    return rows.join(gone, "at", "left_anti").select("row.*")
