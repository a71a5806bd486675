"""Repeated passages: prefix doubling over sampled suffixes, exact to the byte.

Sorting every suffix of a corpus for log(50) rounds moves many times its size, so suffixes are
sampled by content first, and the ranks grow from there:

* In each string of `length` bytes the position with the least hash of `GRAM` bytes is its anchor.
  Equal strings have their anchors at the same place, so suffixes at anchors stand for all.
* Round 1 ranks anchors by their first `GRAM` bytes. Those that stay unique are done.
* Round 2 ranks the pair (that rank, rank of the context): all strings of `length` bytes that
  have this anchor here, joined. Where the pair occurs in an earlier document, all of them repeat.
* Round 3 takes the pairs that are still unlike others of the same first rank and ranks their
  anchors by the bytes to the right and to the left, about twice `GRAM`: every string of `length`
  bytes holds one of the two whole. A half that one document alone has is done.
* Round 4 ranks the single strings of `length` bytes over the halves that are left, and finds for
  each the first document that has it. Strings are told apart by 128 bits, those of the pairs by
  two hashes of 64.

A rank is the place of a 64-bit hash among those sorted in one range; what is sorted travels as
packed columns, one row per group of documents and range, and equal entries of a group are one.
Groups are runs of ascending doc_id, so an entry's group tells which document is the earlier one
and no ids travel; of sorted hashes the upper bits travel as steps, and answers as bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_buffer
from .words import mix, powers, prefix_sums, slice_hash

LENGTH, GRAM = 50, 16
#: Bytes of text in a group of documents, about.
GROUP = 3 << 20
#: A group is cut to size by so many picks of its documents, about.
PICKS = 256


class Anchors:
    """Anchors of a group: entries are (rank of GRAM bytes, hash of context), numbered in sorted order."""

    def __init__(self, texts, doc_id: np.ndarray, length: int, gram: int):
        self.data, self.offsets = text_buffer(texts)
        self.length, self.doc_id = length, doc_id
        n = len(self.data) - length + 1
        self.sums = prefix_sums(self.data)
        starts = np.zeros(0, np.int64)
        if n > 0:
            inside = np.ones(n, bool)  # strings within one document
            for o in self.offsets[1:-1]:
                inside[max(0, o - length + 1) : o] = False
            starts = np.flatnonzero(inside)
        if not len(starts):
            self.first = self.last = self.doc = self.entry = self.anchor = self.holder = np.zeros(0, np.int64)
            self.keys = np.zeros((0, 2), np.uint64)
            return
        self.low = np.uint64(len(self.data).bit_length())
        least = self._least(length, gram)
        anchor = (least[starts] & ((np.uint64(1) << self.low) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        self.first, self.last = starts[head], starts[np.r_[head[1:], len(starts)] - 1]  # first and last string of each anchor
        self.anchor = anchor = anchor[head]
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        gramh = slice_hash(self.sums, anchor, anchor + gram)
        context = mix(slice_hash(self.sums, self.first, self.last + length) ^ mix((anchor - self.first).astype(np.uint64)))
        order = np.lexsort((doc_id[self.doc], context, gramh))
        a, b = gramh[order], context[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.keys = np.stack([a[fresh], b[fresh]], 1)
        self.holder = order[fresh]  # an anchor of each entry in its first document

    def _least(self, length: int, gram: int, block: int = 1 << 15) -> np.ndarray:
        """For each string the least of its grams: the hash above, the place below, so equal hashes give the first.

        Worked out block by block, so that what is read again is still in the cache.
        """
        _, down = powers(len(self.sums))
        span, n = length - gram + 1, len(self.data) - length + 1
        out = np.empty(n, np.uint64)
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            m = hi - lo + span - 1
            x = self.sums[lo + gram : lo + gram + m] - self.sums[lo : lo + m]
            x *= down[lo : lo + m]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x >>= self.low
            x <<= self.low
            x |= np.arange(lo, lo + m, dtype=np.uint64)
            reach = 1
            while reach < span:
                step = min(reach, span - reach)
                x = np.minimum(x[: len(x) - step], x[step:])
                reach += step
            out[lo:hi] = x
        return out

    def split(self, ranges: int) -> np.ndarray:
        """Where the entries of each range of ranks begin, with an end."""
        return _ranges(self.keys[:, 0], ranges)


def _stepped(h: np.ndarray) -> bytes:
    """Ascending 64-bit hashes: how many, six lower bytes of each, and the upper two as steps, a bit for each hash and step."""
    upper = (h >> np.uint64(48)).astype(np.int64)
    bits = np.zeros(upper[-1] - upper[0] + len(h), bool)
    bits[upper - upper[0] + np.arange(len(h))] = True
    return np.array([len(h), upper[0]], "<u4").tobytes() + np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + np.packbits(bits).tobytes()


def _unstepped(x: bytes) -> np.ndarray:
    n, first = np.frombuffer(x, "<u4", 2).tolist()
    lower = np.zeros((n, 8), np.uint8)
    lower[:, :6] = np.frombuffer(x, np.uint8, 6 * n, 8).reshape(n, 6)
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, -1, 8 + 6 * n))) - np.arange(n) + first
    return lower.view("<u8")[:, 0] | upper.astype(np.uint64) << np.uint64(48)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _several(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry of a group, by sorted grams, whether the entries of its gram are first held by more than one document."""
    if not len(gram):
        return np.zeros(0, bool)
    fresh = np.r_[True, gram[1:] != gram[:-1]]
    head = np.flatnonzero(fresh)
    return (np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head))[np.cumsum(fresh) - 1]


def _round2(t):
    """One range of ranks: entries whose pair an earlier document has (1), and those to look into further (2)."""
    groups = t.column("g").to_numpy()
    gram, context = [_unstepped(x) for x in t.column("gram").to_pylist()], [np.frombuffer(x, "<u8") for x in t.column("context").to_pylist()]
    size = np.array([len(x) for x in gram])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("several").to_pylist(), size.tolist(), strict=True)]).astype(bool)
    gram, context, group = np.concatenate(gram), np.concatenate(context), np.repeat(groups, size)
    order = np.lexsort((group, context, gram))
    a, b, d = gram[order], context[order], group[order]
    fresh_a = np.r_[True, a[1:] != a[:-1]]
    fresh = fresh_a | np.r_[True, b[1:] != b[:-1]]
    lead = np.flatnonzero(fresh)
    first = d[lead][np.cumsum(fresh) - 1]  # the first group of each pair, which has its first document
    pairs = np.bincount(np.cumsum(fresh_a) - 1, fresh)  # of each first rank
    head = np.flatnonzero(fresh_a)
    # pairs of one first rank begin in several documents if in several groups, or so within the one group
    apart = (np.minimum.reduceat(first, head) < np.maximum.reduceat(first, head)) | several[order][head]
    more = ((pairs > 1) & apart)[np.cumsum(fresh_a) - 1]
    state = np.where(d > first, 1, np.where(more & fresh, 2, 0)).astype(np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = state
    return _answers(t, size, back == 1, back == 2)


def _round3(t):
    """One range of halves: which of each group's halves another group has."""
    return _told(t, "half", lambda h, group, fresh: (np.diff(np.r_[np.flatnonzero(fresh), len(h)]) > 1)[np.cumsum(fresh) - 1])


def _round4(t):
    """One range of strings: which of each group's strings an earlier document has."""
    return _told(t, "string", lambda h, group, fresh: group > group[np.flatnonzero(fresh)][np.cumsum(fresh) - 1])


def _told(t, column: str, judge):
    """The entries of each group for which judge(hashes, groups, first of equals) holds, all sorted by hash and group."""
    groups = t.column("g").to_numpy()
    h = [_unstepped(x) for x in t.column(column).to_pylist()]
    size = np.array([len(x) for x in h])
    h, group = np.concatenate(h), np.repeat(groups, size)
    part = np.concatenate([np.frombuffer(x, "<u8") for x in t.column("part").to_pylist()]) if "part" in t.column_names else np.zeros(len(h), np.uint64)
    order = np.lexsort((group, part, h))
    s, p, d = h[order], part[order], group[order]
    again = np.zeros(len(s), bool)
    again[order] = judge(s, d, np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
    return _answers(t, size, again)


def _answers(t, size: np.ndarray, *marks: np.ndarray):
    """What each row's group is told: a bit for each mark and entry of the row; rows without a mark set are left out."""
    import pyarrow as pa

    begin = np.r_[0, np.cumsum(size)].tolist()
    some = [k for k in range(len(size)) if any(m[begin[k] : begin[k + 1]].any() for m in marks)]
    told = [b"".join(_bits(m[begin[k] : begin[k + 1]]) for m in marks) for k in some]
    return pa.table({"g": t.column("g").take(pa.array(some, pa.int64())), "k": t.column("k").take(pa.array(some, pa.int64())), "told": pa.array(told, pa.binary())}, schema=pa.schema([("g", pa.int64()), ("k", pa.int32()), ("told", pa.binary())]))


def _marks(told, begin: np.ndarray, kinds: int = 1):
    """(entries, marks of each kind) for each row of what a group has been told."""
    for k, x in zip(told.column("k").to_pylist(), told.column("told").to_pylist(), strict=True):
        yield slice(begin[k], begin[k + 1]), np.unpackbits(np.frombuffer(x, np.uint8).reshape(kinds, -1), axis=1, count=begin[k + 1] - begin[k]).astype(bool)


def _ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of sorted hashes begins, with an end."""
    width = -(-(1 << 64) // ranges)
    return np.r_[0, np.searchsorted(h, np.array([k * width for k in range(1, ranges)], np.uint64)), len(h)]


class Halves:
    """Right and left halves of the entries in state 2 of a group; equal ones are one, in sorted order."""

    def __init__(self, a: Anchors, state: np.ndarray, gram: int):
        self.of = a.holder[state == 2]
        self.middle = (a.length - gram) // 2
        p, sums = a.anchor[self.of], a.sums
        self.right, self.left = p - a.last[self.of] <= self.middle, p - a.first[self.of] >= self.middle
        r, q = p[self.right], p[self.left]
        h = np.r_[slice_hash(sums, r, r + a.length - self.middle), mix(slice_hash(sums, q - self.middle, q + gram) ^ np.uint64(1))]
        doc = a.doc_id[a.doc[np.r_[self.of[self.right], self.of[self.left]]]]
        order = np.lexsort((doc, h))
        sorted_h, doc = h[order], doc[order]
        fresh = np.r_[True, sorted_h[1:] != sorted_h[:-1]][: len(h)]
        self.rank = np.empty(len(h), np.int64)
        self.rank[order] = np.cumsum(fresh) - 1
        lead = np.flatnonzero(fresh)
        self.keys = sorted_h[lead]
        self.shared = doc[lead] != doc[np.r_[lead[1:], len(h)] - 1] if len(h) else np.zeros(0, bool)  # by two documents of this group

    def alive(self, told, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry whether its right and its left half occur in another document."""
        shared, begin = self.shared.copy(), _ranges(self.keys, ranges)
        for own, (again,) in _marks(told, begin):
            shared[own] |= again
        right, left, n = np.zeros(len(self.of), bool), np.zeros(len(self.of), bool), int(self.right.sum())
        right[self.right], left[self.left] = shared[self.rank[:n]], shared[self.rank[n:]]
        return right, left


def _states(anchors: Anchors, told, ranges: int) -> np.ndarray:
    """State of each entry from what round 2 has told the group."""
    state = np.zeros(len(anchors.keys), np.int64)
    for own, (earlier, further) in _marks(told, anchors.split(ranges), 2):
        state[own] = earlier + 2 * further
    return state


def _open_strings(a: Anchors, state: np.ndarray, gram: int, told, ranges: int):
    """Strings over the halves that are left, in sorted order: start, hash, document, first of equals, where ranges begin."""
    halves = Halves(a, state, gram)
    right, left = halves.alive(told, ranges)
    of = halves.of
    n = a.last[of] - a.first[of] + 1
    start = np.repeat(a.first[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    into = np.repeat(a.anchor[of], n) - start
    keep = (np.repeat(right, n) | (into > halves.middle)) & (np.repeat(left, n) | (into < halves.middle))
    start = start[keep]
    # hashes of the string and of its first half: equal only if both halves are, 128 bits together
    h, part = slice_hash(a.sums, start, start + a.length), slice_hash(a.sums, start, start + a.length // 2)
    doc = a.doc_id[np.searchsorted(a.offsets, start, "right") - 1] if len(start) else start
    order = np.lexsort((start, doc, part, h))
    h, part, start, doc = h[order], part[order], start[order], doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])] if len(h) else np.zeros(0, bool)
    return start, h, part, doc, fresh, _ranges(h[fresh], ranges)


def _cuts(rows: DataFrame, group: int, groups: int) -> list[int]:
    """The last doc_id of each group but the last, for groups of about `group` bytes; rows of one id stay together."""
    if groups < 2:
        return []
    step = max(1, group // PICKS)
    size = F.octet_length("text").cast("long")
    picks = F.floor(size / step) + F.when(F.pmod(F.xxhash64("doc_id"), F.lit(step)) < F.pmod(size, F.lit(step)), 1).otherwise(0)
    parts = F.expr(f"array({', '.join(f'{k / groups:.12f}D' for k in range(1, groups))})")
    at = rows.select("doc_id", F.explode(F.array_repeat(F.lit(0), picks.cast("int")))).agg(F.percentile_approx("doc_id", parts, 20 * groups)).first()[0]
    return sorted(set(at or []))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of docs (doc_id, text, ...).

    A byte is removed if a string of `length` bytes over it also starts in a row with a smaller
    doc_id; rows of one id never take from each other. spans are the removed runs as
    (start, end) in UTF-8 bytes. Null texts count as empty, other columns are ignored, an empty
    table gives no rows. Rows without doc_id come before and after none: they stay whole and take
    nothing from others. A text of any length is worked on whole, within one task.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    apart = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    rows = rows.where("doc_id is not null")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(1, -(-total // group))
    ranges = min(-(-groups // 4), max(128, -(-groups // 8)))  # each group sends a row to each, so fewer where groups are many
    cuts = _cuts(rows, group, groups)
    rows = rows.withColumn("g", F.udf(lambda i: bisect_left(cuts, i), "long")("doc_id"))

    def anchors_of(t):
        t = t.sort_by("doc_id")
        return t, Anchors(t.column("text"), t.column("doc_id").to_numpy(), length, gram)

    def round1(t):
        t, a = anchors_of(t)
        several = _several(a.keys[:, 0], a.doc_id[a.doc[a.holder]] if len(a.keys) else a.doc)
        return packed(t, a.split(ranges), gram=(a.keys[:, 0], _stepped), context=(a.keys[:, 1], np.ndarray.tobytes), several=(several, _bits))

    def of_kind(told, kind):
        return told.filter(pa.array(told.column("kind").to_numpy() == kind))

    def packed(t, begin, **columns):
        some = [k for k in range(ranges) if begin[k + 1] > begin[k]]
        cut = {c: pa.array([pack(x[begin[k] : begin[k + 1]]) for k in some], pa.binary()) for c, (x, pack) in columns.items()}
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * len(some), pa.int64()), "k": pa.array(some, pa.int32()), **cut})

    def none(*columns):
        return pa.table({"g": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in columns}})

    def round3(key, t, told):
        if not t.num_rows or not told.num_rows:
            return none("half")
        t, a = anchors_of(t)
        halves = Halves(a, _states(a, told, ranges), gram)
        return packed(t, _ranges(halves.keys, ranges), half=(halves.keys, _stepped))

    def round4(key, t, told):
        if not t.num_rows or not told.num_rows:
            return none("string", "part")
        t, a = anchors_of(t)
        _, h, part, _, fresh, begin = _open_strings(a, _states(a, of_kind(told, 2), ranges), gram, of_kind(told, 3), ranges)
        return packed(t, begin, string=(h[fresh], _stepped), part=(part[fresh], np.ndarray.tobytes))

    def marked(key, t, told):
        names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in names.items()})
        t, a = anchors_of(t)
        edge = np.zeros(len(a.data) + 1, np.int64)

        def cover(first, last):
            np.add.at(edge, first, 1)
            np.add.at(edge, last + length, -1)

        if told.num_rows and len(a.keys):
            state = _states(a, of_kind(told, 2), ranges)
            own = a.doc_id[a.doc]
            first = a.doc_id[a.doc[a.holder]]
            # an earlier document outside has the entry, or an earlier one of this group
            full = (state[a.entry] == 1) | (own > first[a.entry])
            cover(a.first[full], a.last[full])
            start, _, _, doc, fresh, begin = _open_strings(a, state, gram, of_kind(told, 3), ranges)
            again = np.zeros(int(fresh.sum()), bool)
            for own, (earlier,) in _marks(of_kind(told, 4), begin):
                again[own] = earlier
            which = np.cumsum(fresh) - 1
            lead = doc[np.flatnonzero(fresh)][which] if len(doc) else doc
            hit = again[which] | (doc > lead) if len(doc) else np.zeros(0, bool)
            # what holds of an entry's strings in its first document holds wherever that document has the entry again
            repeats = np.zeros(len(a.data), bool)
            repeats[start[hit]] = True
            for i in np.flatnonzero((state[a.entry] == 2) & ~full):
                of = a.holder[a.entry[i]]
                if of != i:
                    n = a.last[i] - a.first[i] + 1
                    repeats[a.first[i] : a.first[i] + n] |= repeats[a.first[of] : a.first[of] + n]
            s = np.flatnonzero(repeats)
            cover(s, s)
        elif len(a.keys):
            full = a.doc_id[a.doc] > a.doc_id[a.doc[a.holder]][a.entry]
            cover(a.first[full], a.last[full])
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, d in enumerate(t.column("doc_id").to_pylist()):
            lo, hi = a.offsets[i], a.offsets[i + 1]
            g = gone[lo:hi]
            turn = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
            out.append((d, int(hi - lo), int(g.sum()), len(turn) // 2, hashlib.sha256(a.data[lo:hi][~g].tobytes()).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]))
        return pa.table({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(names.items())})

    # one query, so that texts and entries are each dealt out once and every round reads them again
    entries = rows.groupBy("g").applyInArrow(round1, "g long, k int, gram binary, context binary, several binary")
    shape = "g long, k int, told binary"
    told2 = entries.groupBy("k").applyInArrow(_round2, shape).withColumn("kind", F.lit(2))
    halves = rows.groupBy("g").cogroup(told2.groupBy("g")).applyInArrow(round3, "g long, k int, half binary")
    told3 = told2.union(halves.groupBy("k").applyInArrow(_round3, shape).withColumn("kind", F.lit(3)))
    strings = rows.groupBy("g").cogroup(told3.groupBy("g")).applyInArrow(round4, "g long, k int, string binary, part binary")
    told = told3.union(strings.groupBy("k").applyInArrow(_round4, shape).withColumn("kind", F.lit(4)))
    found = rows.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(marked, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return found.union(apart)
