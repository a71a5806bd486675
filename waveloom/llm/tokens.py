"""Token ids as Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of ids: the selector says how many ids of how
many bits it packs. Selector 15 is an escape: the following word is one id of up to 64 bits. A
block holds up to `BLOCK` ids and begins at a word of its own; the offsets of the blocks let a
decoder unpack all of them at once. A document is a run of blocks with a small header; a dataset
is a Parquet table of such payloads in ascending doc_id order, part by part.
"""

from __future__ import annotations

import gc
import zlib
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch_path, small_batches, text_slices, written

#: Ids per word and bits per id of selectors 0 to 14 (0 and 1 are runs of zeros); 15 escapes.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30], np.int64)
ESCAPE, BLOCK = 15, 240
_BITS = np.array([k.bit_length() for k in range(65536)], np.int8)
#: Fixed value: where the byte-level pre-tokenizer cuts.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Versions of the tokenizer and of `regex` for which UNLIKE holds; with others all texts are encoded whole.
VERSIONS = {"tokenizers": "0.23.3", "regex": "2026.9.29"}
#: Fixed value: code points of which the tokenizer's own tables of letters and numbers and those of `regex` differ.
UNLIKE = (
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F"
    "\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    "\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    "\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81"
    "\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    "\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
#: Fixed value: white space as the pre-tokenizer knows it.
WHITE = "\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Pieces of text whose ids a worker remembers.
REMEMBER = 300_000
#: Bytes of text that are encoded at once, if a batch has more.
SLICE = 1 << 23


def _need(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    need = _BITS[np.minimum(ids, np.uint64(65535)).astype(np.int64)]
    large = np.flatnonzero(ids > np.uint64(65535))
    need[large] = [int(x).bit_length() for x in ids[large]]
    return need


def _fullest(need: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of at: the selector of the fullest word that may begin there, and how many ids it takes.

    left is the number of ids from the position to the end of its block; a word never crosses it.
    A word may be filled short at a block's end only by a selector whose count is what is left or
    more, so the last word is padded with zeros. Counts rise as widths fall, so once a count
    doesn't fit no greater one does.
    """
    selector, takes = np.full(len(at), ESCAPE, np.int64), np.ones(len(at), np.int64)
    k, top, reach = np.arange(len(at)), need[at], 1
    for s in range(len(COUNTS) - 1, -1, -1):
        for j in range(reach, min(int(COUNTS[s]), int(left.max()))):
            top = np.maximum(top, np.where(left > j, need[np.minimum(at + j, len(need) - 1)], 0))
        reach = int(COUNTS[s])
        fits = top <= WIDTHS[s]
        if not fits.all():
            k, top, at, left = k[fits], top[fits], at[fits], left[fits]
        if not len(k):
            break
        selector[k], takes[k] = s, np.minimum(reach, left)
    return selector, takes


def encode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many sequences at once; ids[bounds[k]:bounds[k + 1]] is sequence k.

    Gives the words, the first word of each block and the first block of each sequence (both
    with an end).
    """
    ids = ids.astype(np.uint64)
    lengths = np.diff(bounds)
    blocks = -(-lengths // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    inner = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    start = np.repeat(bounds[:-1], blocks) + inner * BLOCK
    end = np.minimum(start + BLOCK, np.repeat(bounds[1:], blocks))
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(len(start) + 1, np.int64), first
    need = _need(ids)
    at, live, found = start.copy(), np.arange(len(start)), []
    while len(live):  # the k-th word of every block together
        selector, takes = _fullest(need, at[live], end[live] - at[live])
        found.append((at[live], live, selector, takes))
        at[live] += takes
        live = live[at[live] < end[live]]
    heads, block, sel, take = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(heads, kind="stable")
    heads, block, sel, take = heads[order], block[order], sel[order], take[order]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    words[place[sel == ESCAPE] + 1] = ids[heads[sel == ESCAPE]]
    for s in range(2, len(COUNTS)):
        mine = sel == s
        if mine.any():
            h, p, t = heads[mine], place[mine], take[mine]
            for k in range(int(t.max())):
                more = k < t
                words[p[more]] |= ids[h[more] + k] << np.uint64(k * WIDTHS[s])
    return words, np.r_[place[np.searchsorted(block, np.arange(len(start)))], len(words)].astype(np.int64), first


def decode(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of the blocks whose first words are at offsets (with an end) and that hold lengths ids."""
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    while True:  # a word after an escape is an id; escapes may follow each other
        esc = head & (sel == ESCAPE)
        now = np.ones(len(words), bool)
        now[1:] = ~esc[:-1]
        if np.array_equal(now, head):
            break
        head = now
    place = np.flatnonzero(head)
    s = sel[place]
    block = np.searchsorted(offsets, place, "right") - 1
    full = np.where(s == ESCAPE, 1, np.r_[COUNTS, 1][s])
    before = np.cumsum(full) - full
    begun = before[np.searchsorted(block, np.arange(len(lengths)))]
    done = before - begun[block]
    take = np.minimum(full, lengths[block] - done)
    out = np.zeros(int(lengths.sum()), np.uint64)
    to = (np.cumsum(lengths) - lengths)[block] + done
    out[to[s == ESCAPE]] = words[place[s == ESCAPE] + 1]
    for k in range(2, len(COUNTS)):
        mine = s == k
        if mine.any():
            p, t, m = words[place[mine]], to[mine], take[mine]
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            for i in range(int(m.max())):
                more = i < m
                out[t[more] + i] = (p[more] >> np.uint64(i * WIDTHS[k])) & mask
    return out


class _Seen(dict):
    """Numbers of the strings seen so far, and the ids of each; new strings are noted until their ids are told."""

    def __init__(self):
        self.new: list[str] = []
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def __missing__(self, piece):
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def tell(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new strings, one after the other."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        begin = len(self) - len(self.new)
        self.start[begin : len(self)] = self.used + np.cumsum(sizes) - sizes
        self.size[begin : len(self)] = sizes
        self.used += len(flat)
        self.new = []

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered strings in a row, and how many each has."""
        size = self.size[numbers]
        return self.pool[np.repeat(self.start[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def halved(self) -> _Seen:
        """The older half, which holds the frequent strings."""
        out = _Seen()
        out.update(islice(self.items(), len(self) // 2))
        out.used = int(self.start[len(out)])
        out.pool, out.start, out.size = self.pool[: max(out.used, 1)].copy(), self.start[: len(out) + 1].copy(), self.size[: len(out) + 1].copy()
        return out


def _letter(byte: int) -> str:
    """The visible character by which byte-level vocabularies write a byte above 127."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return chr(256 + hidden.index(byte)) if byte in hidden else chr(byte)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of values, counts of them each."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class PieceEncoder:
    """The tokenizer over pieces that it never joins, each encoded once.

    A space between two characters that are not white space is where the byte-level
    pre-tokenizer cuts, and the next piece begins with that space, so such pieces encode on their
    own. Texts with a code point that is cut unlike and, if `special`, with an added token, which
    then is one id as in the library's own setting (else it is text like any other), are encoded
    whole, and so is every text if the file's tokenizer is no plain byte-level BPE or the libraries
    are other versions than the list of such code points was made for. What is
    remembered is bounded; past the bound the older half stays, which holds the frequent pieces.
    """

    def __init__(self, path: str, special: bool = False):
        import json
        from importlib.metadata import version

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        form = json.loads(self.tokenizer.to_str())
        cutter, model = form["pre_tokenizer"] or {}, form["model"]
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not form["normalizer"] and not form["truncation"] and not form["padding"]
        known = all(version(name) == own for name, own in VERSIONS.items())
        self.plain = known and plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if not self.plain:
            return
        self.cut, self.model = regex.compile(CUTS).findall, self.tokenizer.model.tokenize
        self.split = regex.compile(r"(?<=\S) (?=\S)").split
        byte = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {k: byte(chr(k))[-1][0][-1] for k in range(128)}
        self.letters |= {k: _letter(k) for k in range(128, 256)}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (special or not t.special)]
        self.after, self.parts = _Seen(), _Seen()

    def _part(self, part: str) -> list[int]:
        plain = part.replace(" ", "\u0120") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model(plain)]

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and how many each has."""
        numbers = self.parts.numbers(parts)
        if self.parts.new:
            gc.disable()  # many small objects that all stay: nothing to collect meanwhile
            try:
                ids = [self._part(p) for p in self.parts.new]
            finally:
                gc.enable()
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.parts.tell(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        return self.parts.ids(numbers)

    def _learn(self, alone: bool) -> None:
        """The ids of new pieces, each behind a space, which are cut one by one or all in one go: at each space between them."""
        new = self.after.new
        if not new:
            return
        if alone:
            cuts = [self.cut(" " + p) for p in new]
            parts, counts = list(chain.from_iterable(cuts)), np.fromiter(map(len, cuts), np.int64, len(cuts))
        else:
            parts = self.cut(" " + " ".join(new))
            head = np.fromiter((p[0] == " " for p in parts), bool, len(parts))
            counts = np.diff(np.r_[np.flatnonzero(head), len(parts)])
        ids, size = self._ids(parts)
        self.after.tell(ids, _sums(size, counts))

    def _pieces(self, flat, counts: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as pieces, counts of them each (one at least), and how many each text has."""
        coded = flat.dictionary_encode()
        coded = coded.combine_chunks() if hasattr(coded, "combine_chunks") else coded
        index, lead = coded.indices.to_numpy(), np.cumsum(counts) - counts
        rest = np.ones(len(index), bool)
        rest[lead] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[rest]] = True
        known = np.zeros(len(used), np.int64)
        words, where = coded.dictionary.take(_array(np.flatnonzero(used))).to_pylist(), np.flatnonzero(used)
        apart = np.fromiter((odd or w[-1:].isspace() for w in words), bool, len(words))  # these may be cut otherwise before another piece
        for alone in (False, True):
            if (apart == alone).any():
                known[where[apart == alone]] = self.after.numbers([w for w, x in zip(words, apart.tolist(), strict=True) if x == alone] if apart.any() else words)
                self._learn(alone)
        cuts = [self.cut(p) for p in flat.take(_array(lead)).to_pylist()]  # the first piece of a text has no space before it
        first, size = self._ids(list(chain.from_iterable(cuts)))
        begun = _sums(size, np.fromiter(map(len, cuts), np.int64, len(cuts)))
        ids, size = self.after.ids(known[index[rest]])
        per = _sums(size, counts - 1)
        out = np.empty(len(first) + len(ids), np.uint32)
        opens = np.zeros(len(out), bool)
        at = np.cumsum(begun + per) - begun - per
        opens[np.repeat(at - (np.cumsum(begun) - begun), begun) + np.arange(begun.sum())] = True
        out[opens], out[~opens] = first, ids
        return out, begun + per

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array or a list) in a row, each closed by `end`, and the bounds of the texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null((texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        n = len(column)
        empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
        whole, odd = ~empty, np.zeros(n, bool)
        if self.plain and n:
            if len(self.after) > REMEMBER:
                self.after = self.after.halved()
            if len(self.parts) > REMEMBER:
                self.parts = self.parts.halved()
            whole = pc.match_substring_regex(column, f"[{UNLIKE}]").to_numpy(zero_copy_only=False)
            for token in self.added:
                whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
            odd = pc.match_substring_regex(column, f"[{WHITE}] | [{WHITE}]|^ | $").to_numpy(zero_copy_only=False) & ~whole
        parts = []
        rows = np.flatnonzero(whole)
        if len(rows):
            got = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in column.take(_array(rows)).to_pylist()]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            parts.append((rows, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes))
        rows = np.flatnonzero(odd)
        if len(rows):
            got = [self.split(t) for t in column.take(_array(rows)).to_pylist()]
            parts.append((rows, *self._pieces(pa.array(list(chain.from_iterable(got)), pa.large_string()), np.fromiter(map(len, got), np.int64, len(got)), True)))
        rows = np.flatnonzero(~(whole | odd | empty))
        if len(rows):
            got = pc.split_pattern(column if len(rows) == n else column.take(_array(rows)), " ")
            parts.append((rows, *self._pieces(got.flatten(), np.diff(got.offsets.to_numpy()).astype(np.int64), False)))
        per = np.zeros(n, np.int64)
        for rows, _, sizes in parts:
            per[rows] = sizes
        bounds = np.r_[0, np.cumsum(per + (end is not None))]
        out = np.full(int(bounds[-1]), end or 0, np.uint32)
        for rows, ids, sizes in parts:
            out[np.repeat(bounds[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        return out, bounds


def _array(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values, pa.int64())


_KEPT: dict[tuple[str, bool], PieceEncoder] = {}


def _encoder(path: str, special: bool) -> PieceEncoder:
    """One encoder for each Python worker, kept from task to task."""
    if (path, special) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, special] = PieceEncoder(path, special)
    return _KEPT[path, special]


def pack(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A payload for each sequence: number of ids, of blocks, offsets of the blocks, words."""
    words, offsets, first = encode(ids, bounds)
    raw = words.astype("<u8")
    out = []
    for k in range(len(bounds) - 1):
        o = offsets[first[k] : first[k + 1] + 1]
        head = np.array([bounds[k + 1] - bounds[k], len(o) - 1], "<u4").tobytes()
        out.append(head + (o[1:] - o[0]).astype("<u4").tobytes() + raw[o[0] : o[-1]].tobytes())
    return out


def unpack(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all payloads in a row and the bounds of each; all blocks are decoded together."""
    lengths, ends, words, counts, base = [], [], [], [], 0
    for p in payloads:
        n, blocks = (int(x) for x in np.frombuffer(p, "<u4", 2))
        e = np.frombuffer(p, "<u4", blocks, 8).astype(np.int64)
        size = np.full(blocks, BLOCK, np.int64)
        if blocks:
            size[-1] = n - BLOCK * (blocks - 1)
        lengths.append(size)
        ends.append(base + e)
        words.append(np.frombuffer(p, "<u8", -1, 8 + 4 * blocks))
        counts.append(n)
        base += len(words[-1])
    if not payloads:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return decode(np.concatenate(words), np.r_[0, np.concatenate(ends)], np.concatenate(lengths)), np.r_[0, np.cumsum(counts)]


def encoded(docs: DataFrame, path: str, end: int = 0, special: bool = False) -> DataFrame:
    """(doc_id, n_tokens, payload) for each row of docs (doc_id, text, ...).

    Null texts count as empty; long texts are encoded whole, and a task works on at most SLICE bytes of
    text at once beside what it remembers. Null and repeated ids and repeated rows have a payload
    each; other columns are ignored, and an empty table gives no rows.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        encoder = _encoder(path, special)
        for b, texts in chain.from_iterable(text_slices(b, b.column("text"), SLICE) for b in batches):
            ids, bounds = encoder.encode(texts, end)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(pack(ids, bounds), pa.binary())], ["doc_id", "n_tokens", "payload"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, payload binary")


def write_ids(docs: DataFrame, tokenizer: str, out: str, end: int = 0, special: bool = False) -> None:
    """Write docs (doc_id, text) as Simple-8b payloads in ascending doc_id order to the dataset `out`.

    The part files ascend too: each has a `part` number and ids of a range of doc_id. Equal ids
    and null ids (first) stay, in any order among themselves. An empty table makes an empty dataset.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    # the ranges come from the ids alone, so that texts are encoded once and not for a sample as well
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    coded = encoded(docs, tokenizer, end, special).repartitionById(n, F.greatest(part, F.lit(0))).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    coded.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).write.parquet(out)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a dataset that write_ids wrote, all decoded from its payloads.

    start is the number of ids of all documents before; per-part totals alone pass the driver. Rows
    come as they were written: repeated and null ids each have theirs, in the order of the dataset,
    and an empty dataset gives no rows.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, bounds = unpack(b.column("payload").to_pylist())
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("at"), b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    table = spark.read.schema("doc_id long, n_tokens long, payload binary, part int, at long").parquet(path)
    got = written(table.select("part", "at", "doc_id", "payload").mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids_crc32 long"), "ids")
    totals, before, base = {r["part"]: r["n"] for r in got.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}, 0, []  # a row per part file
    for part in sorted(totals):
        base.append((part, before))
        before += totals[part]
    from pyspark.sql import Window

    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    base = spark.createDataFrame(base, "part int, base long")
    return got.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0, special: bool = False) -> DataFrame:
    """Write docs to a dataset in the shared folder and read the digest of its ids back."""
    out = scratch_path(docs.sparkSession, "simple8b")
    write_ids(docs, tokenizer, out, end, special)
    return read_ids(docs.sparkSession, out)
