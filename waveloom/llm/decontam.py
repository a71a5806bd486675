"""Benchmark decontamination by template canonicalisation.

Words become lower case without marks at their ends; numbers, names and units become typed
placeholders whose values are kept aside as slots. Windows of `window` template words are
hash-joined between documents and benchmark items; along each alignment of a document with an
item, windows count whose slots map one to one, so a question asked again with other numbers or
names is caught, and a chance likeness of templates with unlike slots is not.

What is a name is told by the benchmark first, so that it does not hang on case or place: a word
that the items write as a name is one in any case and place, a word that they write otherwise is
none, and only words that no item has are names by their capital, at the start of a sentence too.

Windows with few plain words, and items shorter than a window as a whole, tell too little by their
template: they match on the words themselves.

Bitmaps of fixed size with the hashes of the items' words and windows go to the tasks, so that only
windows that may match leave them; the join that follows is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, small_batches, written
from .words import LOWER, MARK, mix, pieces, prefix_sums, slice_hash, trimmed, words_of

WINDOW, LITERAL, RUN, SHARE, LEAST = 8, 4, 6, 0.5, 5
#: Bits of a bitmap, whatever the size of the benchmark.
BITS = 1 << 24
#: Words for units, as they stand after a number.
UNITS = (
    "% percent mm cm m km mi inch inches ft foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces l ml litre litres liter liters gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "$ usd eur gbp dollar dollars euro euros cent cents pence hz khz mhz ghz v w kw j k c f degree degrees mph kmh km/h m/s b kb mb gb tb"
).split()
NUMBER, NAME, UNIT = 1, 2, 3


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end, _ = words_of(data, np.array([0, len(data)]))
    return np.sort(slice_hash(prefix_sums(data), start, end))


class Lexicon:
    """Bitmaps of the words that the items write as names, and of their other words."""

    def __init__(self, names: np.ndarray, plain: np.ndarray):
        self.names, self.plain = names, plain


def bitmap(hashes: np.ndarray) -> np.ndarray:
    out, bit = np.zeros(BITS // 8, np.uint8), hashes % np.uint64(BITS)
    np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(1, (bit & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(BITS)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def plain_words(data: np.ndarray, offsets: np.ndarray):
    """Per word: hash in lower case, row, span of its value, whether it begins with a capital, whether it opens a sentence."""
    start, end, row = words_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), row, start, end, np.zeros(0, bool), np.zeros(0, bool)
    s, e = trimmed(data, start, end)
    named = ~MARK[data[s]]  # marks alone, as between the cells of a table, are no words
    start, end, row, s, e = (x[named] for x in (start, end, row, s, e))
    h = slice_hash(prefix_sums(LOWER[data]), s, e)
    lines = np.r_[0, np.cumsum(data == 10)]
    opens = np.ones(len(s), bool)
    opens[1:] = (row[1:] != row[:-1]) | np.isin(data[end[:-1] - 1], np.frombuffer(b".!?:", np.uint8)) | (lines[start[1:]] != lines[end[:-1]])
    first, second = data[s], data[np.minimum(s + 1, len(data) - 1)]
    capital = (first >= 65) & (first <= 90) & (e - s > 1) & ~((second >= 65) & (second <= 90))  # words in capitals throughout stay plain
    capital |= (first == 0xC3) & (second < 0x9F) & (e - s > 2)
    return h, row, s, e, capital, opens


def lexicon(texts: DataFrame) -> Lexicon:
    """Words of the items: a name is a word that has a capital inside a sentence more often than none, or a capital at starts alone."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for _, _, data, offsets in pieces(b.column("text")):
                h, _, _, _, capital, opens = plain_words(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((capital & ~opens).astype(np.int64)), pa.array((~capital).astype(np.int64))], ["h", "inside", "lower"])

    counts = texts.mapInArrow(run, "h long, inside long, lower long").groupBy("h").agg((F.sum("inside") > F.sum("lower")).alias("more"), (F.sum("lower") == 0).alias("never"))
    bits = counts.select((F.col("more") | F.col("never")).alias("name"), _bit(F.col("h")).alias("b")).distinct().toArrow()  # at most 2 * BITS numbers
    b, name = bits.column("b").to_numpy().astype(np.uint64), bits.column("name").to_numpy()
    return Lexicon(bitmap(b[name]), bitmap(b[~name]))


def _bit(h):
    """The place of a hash, held as a signed long, in a bitmap."""
    return h.bitwiseAND(F.lit(BITS - 1))


def templates(data: np.ndarray, offsets: np.ndarray, words: Lexicon):
    """Per word: template hash, hash as it is, kind of slot (0 for none), row, and the span of its value."""
    h, row, s, e, capital, _ = plain_words(data, offsets)
    if not len(h):
        return h, h, np.zeros(0, np.int8), row, s, e
    digit = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    digits = digit[e] - digit[s]
    kind = np.zeros(len(s), np.int8)
    name = _has(words.names, h)
    kind[name | (capital & ~_has(words.plain, h))] = NAME
    kind[(digits > 0) & (2 * digits >= e - s)] = NUMBER
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h
    unit[1:] &= (kind[:-1] == NUMBER) & (row[1:] == row[:-1])
    unit[:1] = False
    kind[unit & (kind != NUMBER)] = UNIT
    return np.where(kind > 0, mix(kind.astype(np.uint64) + np.uint64(77)), h), h, kind, row, s, e


def _rolled(h: np.ndarray, window: int) -> np.ndarray:
    n = len(h) - window + 1
    own = np.zeros(n, np.uint64)
    for k in range(window):
        own = own * np.uint64(0x100000001B3) + h[k : k + n]
    return mix(own)


def windows(data: np.ndarray, offsets: np.ndarray, words: Lexicon, window: int, literal: int, lengths: tuple[int, ...] | None = None, least: int = LEAST):
    """First word, length, hash and whether by template of the windows of each row; and the words.

    A window with at least `literal` plain words is hashed by template, any other by its words. Rows
    with fewer words than a window, but `least` or more, have one window of all of them by its
    words; with `lengths` there are such windows of these lengths everywhere.
    """
    t, h, kind, row, s, e = templates(data, offsets, words)
    found = []
    n = len(h) - window + 1
    if n > 0:
        inside = np.flatnonzero(row[:n] == row[window - 1 :])
        plain = np.r_[0, np.cumsum(kind == 0)]
        by = (plain[window:] - plain[:-window])[inside] >= literal
        found.append((inside, np.full(len(inside), window), np.where(by, _rolled(t, window)[inside], mix(_rolled(h, window)[inside] ^ np.uint64(1))), by))
    if lengths is None:
        first, size = np.unique(row, return_index=True)[1], np.bincount(row)
        size = size[size > 0]
        short = [(first[size == k], k) for k in range(least, window)]
    else:
        short = [(np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :]), k) for k in lengths]
    for at, k in short:
        if len(at) and len(h) >= k:
            found.append((at, np.full(len(at), k), mix(_rolled(h, k)[at] ^ np.uint64(k)), np.zeros(len(at), bool)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), row, kind, s, e
    at, size, own, by = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, size, own, by, row, kind, s, e


def _rows(key: str, window: int, literal: int, words, lengths=None, bits=None):
    """Arrow function: a row for each window (that the bitmap has): id, word number, length, hash, slots, windows of the row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids = b.column(key)
            for lo, hi, data, offsets in pieces(b.column("text")):
                at, size, h, by, row, kind, s, e = windows(data, offsets, words.value, window, literal, lengths)
                of = np.bincount(row[at], minlength=hi - lo)
                if bits is not None:
                    hit = _has(bits.value, h)
                    at, size, h, by = at[hit], size[hit], h[hit], by[hit]
                if not len(at):
                    continue
                first = np.searchsorted(row, np.arange(hi - lo))
                lower = LOWER[data].tobytes()
                slots = [[lower[s[w] : e[w]].decode("utf-8", "replace") for w in range(a, a + window) if kind[w]] if t else [] for a, t in zip(at.tolist(), by.tolist(), strict=True)]
                r = row[at]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + lo)), pa.array(at - first[r]), pa.array(size), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.array(of[r])], ["id", "at", "size", "h", "slots", "n"])

    return run


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, literal: int = LITERAL, run: int = RUN, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, coverage, exact) for each document and item that it holds.

    docs is (doc_id, text, ...), items (item_id, text, ...). An item is held if at least
    min(run, share of its windows) windows match with slots that map one to one along an alignment;
    of slots that do not, the windows that have them drop out. coverage is the share of the item's
    windows that match, and exact tells whether all slots are equal. Windows with less than
    `literal` plain words match word for word, and so do items of `LEAST` words up to a window,
    as a whole; shorter ones tell nothing. Null texts count as empty, texts of any length are read
    whole, repeated items match each, rows without id are left out, other columns are ignored, and
    an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shape = "id long, at long, size long, h long, slots array<string>, n long"
    items = items.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null")
    words = spark.sparkContext.broadcast(lexicon(items))
    own = items.mapInArrow(_rows("id", window, literal, words), shape)
    own = written(own.toDF("item_id", "item_at", "size", "h", "item_slots", "n"), "templates")
    lengths = tuple(sorted(r["size"] for r in own.where(F.col("size") < window).select("size").distinct().collect()))  # less than a window each
    bits = own.select(_bit(F.col("h")).alias("b")).distinct().toArrow().column("b").to_numpy()  # at most BITS numbers
    shipped = spark.sparkContext.broadcast(bitmap(bits.astype(np.uint64)))
    seen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").mapInArrow(_rows("id", window, literal, words, lengths, shipped), shape)
    hits = seen.select(F.col("id").alias("doc_id"), "at", "size", "h", "slots").join(own, ["h", "size"])
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    lines = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("by")).agg(F.collect_set(F.struct("item_at", pairs.alias("pairs"))).alias("found"), F.max("n").alias("n"))
    lines = lines.withColumn("map", F.array_distinct(F.flatten("found.pairs")))
    lines = lines.withColumn("bad", F.filter("map", lambda p: F.exists("map", lambda q: (p["a"] == q["a"]) != (p["b"] == q["b"]))))
    lines = lines.withColumn("found", F.filter("found", lambda f: ~F.arrays_overlap(f["pairs"], F.col("bad"))))
    both = lines.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found.item_at")))).cast("long").alias("n_matched"), F.max("n").alias("n"), F.min(F.forall("found", lambda f: F.forall(f["pairs"], lambda p: p["a"] == p["b"]))).alias("exact"))
    return both.where((F.col("n_matched") > 0) & (F.col("n_matched") >= F.least(F.lit(run), F.ceil(F.col("n") * share)))).select("doc_id", "item_id", "n_matched", F.round(F.col("n_matched") / F.col("n"), 6).alias("coverage"), "exact")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose doc_id holds an item; columns and rows without id stay as they are."""
    held = sized(written(matches(docs, items, **options).select(F.col("doc_id").alias("_held")).distinct(), "held"))
    return docs.join(held, docs["doc_id"].cast("long") == held["_held"], "left_anti")
