"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors are folded into one row first, with their number. A vector is a member of the cell of
its nearest centre and a guest in further cells whose centre is nearly as close; members are
compared with each other and with the guests of their cell. Of two vectors v, u with nearest
centres c, d, v lags behind d by v(c - d) and u behind c by u(d - c), which add up to (v - u)(c - d).
Within the angle t of the threshold, one of them is therefore at most sin(t / 2) |c - d|: visiting
all cells up to that lag (`margin=None`) loses no link. In many dimensions that bound is far from
what occurs, so lags are also held to `margin`; README has the recall measured.

Cells are dealt out as pairs of bounded blocks, so a crowded cell is many tasks of bounded memory.
Links are counted in place and only a spanning forest of them leaves a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, min_labels, partitions, small_batches, written

THRESHOLD, MARGIN, CELL, BLOCK, TILE = 0.9, 0.2, 1024, 8192, 1024
#: The k-means fit sees at most so many vectors for each centre and has at most so many centres.
SAMPLE, CENTRES, ROUNDS, SEED = 16, 16_384, 6, 7


def fit_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: unit centres that maximise the cosine to their unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(x @ centres.T, 1) for x in np.array_split(sample, max(1, len(sample) * len(centres) >> 22))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def _usable():
    return F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")


def _unit(vecs: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision, scaled first so that no norm overflows."""
    vecs = vecs.astype(np.float64)
    vecs = vecs / np.abs(vecs).max(1, keepdims=True)
    return vecs / np.linalg.norm(vecs, axis=1, keepdims=True)


def _visits(vecs: np.ndarray, centres: np.ndarray, threshold: float, margin: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centre of each row, and (row, cell) of the further cells that it is a guest in."""
    home, rows, cells = np.empty(len(vecs), np.int64), [], []
    most = np.sin(np.arccos(np.clip(threshold, -1, 1)) / 2)
    step = max(1, (1 << 22) // len(centres))
    for lo in range(0, len(vecs), step):
        cos = vecs[lo : lo + step] @ centres.T
        home[lo : lo + step] = own = cos.argmax(1)
        lag = cos[np.arange(len(cos)), own][:, None] - cos
        near = lag <= most * np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0)) + 1e-9
        if margin is not None:
            near &= lag <= margin
        near[np.arange(len(cos)), own] = False
        r, c = np.nonzero(near)
        rows.append(r + lo)
        cells.append(c)
    return home, np.concatenate(rows) if rows else home, np.concatenate(cells) if cells else home


def _counts(centres, threshold: float, margin: float | None, kind: str):
    """Arrow function: members and guests per cell."""
    import pyarrow as pa

    def run(batches):
        k = len(centres.value)
        members, guests = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                home, _, cell = _visits(_unit(np.frombuffer(b"".join(b.column("v").to_pylist()), kind).reshape(b.num_rows, -1)), centres.value, threshold, margin)
                members += np.bincount(home, minlength=k)
                guests += np.bincount(cell, minlength=k)
        at = np.flatnonzero(members + guests)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(members[at]), pa.array(guests[at])], ["cell", "members", "guests"])

    return run


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number repeated by its count, and the place within the run."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _dealt(centres, threshold: float, margin: float | None, own_blocks: np.ndarray, guest_blocks: np.ndarray, kind: str):
    """Arrow function: a row for each cell and pair of its blocks that a vector takes part in.

    Blocks of guests are numbered behind those of members. Members are dealt to the pairs of their
    block with the other ones of members and with those of guests; the first of the latter, or a
    pair of the block with itself where a cell has no guests, compares the block within itself.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rep, n, raw = b.column("rep").to_numpy(), b.column("n").to_numpy(), b.column("v").to_pylist()
            home, row, cell = _visits(_unit(np.frombuffer(b"".join(raw), kind).reshape(len(rep), -1)), centres.value, threshold, margin)
            bound = np.searchsorted(row, np.arange(len(rep) + 1))
            seen = [cell[s:e].astype("<u2").tobytes() for s, e in zip(bound[:-1], bound[1:], strict=True)]
            spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            mine, theirs = own_blocks[home], guest_blocks[home]
            own = spread % mine
            i, j = _runs(mine)  # member pairs; with itself only where there are no guests
            keep = (j != own[i]) | (theirs[i] == 0)
            i, j = i[keep], j[keep]
            parts = [(i, home[i], np.minimum(own[i], j), np.maximum(own[i], j), own[i])]
            i, j = _runs(theirs)
            parts.append((i, home[i], own[i], mine[i] + j, own[i]))
            as_guest = own_blocks[cell] + spread[row] % np.maximum(guest_blocks[cell], 1)
            i, j = _runs(own_blocks[cell])
            parts.append((row[i], cell[i], j, as_guest[i], as_guest[i]))
            row, of, x, y, block = (np.concatenate(c) for c in zip(*parts, strict=True))
            for part in np.array_split(np.arange(len(row)), max(1, len(row) // 4096)):
                r = row[part]
                yield pa.RecordBatch.from_arrays([pa.array(of[part]), pa.array(x[part]), pa.array(y[part]), pa.array(block[part]), pa.array(rep[r]), pa.array(n[r]), pa.array(home[r]), pa.array([seen[i] for i in r], pa.binary()), pa.array([raw[i] for i in r], pa.binary())], ["cell", "x", "y", "block", "rep", "n", "home", "seen", "v"])

    return run


def _compare(threshold: float, own_blocks: np.ndarray, kind: str):
    """Grouped Arrow function over one pair of blocks of a cell: links counted per vector, and a forest of them."""
    import pyarrow as pa

    def run(t):
        cell, x, y = (t.column(c)[0].as_py() for c in ("cell", "x", "y"))
        block, rep, n, home = (t.column(c).to_numpy() for c in ("block", "rep", "n", "home"))
        v = _unit(np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(len(rep), -1))
        cells = [np.frombuffer(s, "<u2").astype(np.int64) for s in t.column("seen").to_pylist()]
        guest = np.sort(np.repeat(np.arange(len(rep)), [len(c) for c in cells]) * 65536 + (np.concatenate(cells) if cells else 0))
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        count, labels = np.zeros(len(rep), np.int64), np.arange(len(rep))
        within = x == y or y == own_blocks[cell]
        for p in np.array_split(left, max(1, -(-len(left) // TILE))):
            sides = [(q, True) for q in np.array_split(left, max(1, -(-len(left) // TILE))) if within and len(p) and len(q) and q[-1] > p[0]]
            sides += [(q, False) for q in np.array_split(right, max(1, -(-len(right) // TILE))) if x != y]
            for q, same in sides:
                i, j = np.nonzero(v[p] @ v[q].T >= threshold)
                i, j = p[i], q[j]
                # a pair whose members are guests of each other counts in the first of both cells
                code = i * 65536 + home[j]
                both = guest[np.minimum(np.searchsorted(guest, code), max(len(guest) - 1, 0))] == code if len(guest) and len(code) else np.zeros(len(i), bool)
                keep = i < j if same else (home[j] == cell) | ~both | (cell < home[j])
                i, j = i[keep], j[keep]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                labels = min_labels(len(rep), i, j, labels)
        hit = np.flatnonzero(count)
        return pa.table({"rep": pa.array(rep[hit]), "links": pa.array(count[hit]), "other": pa.array(rep[labels[hit]])})

    return run


def _bytes(kind: str):
    """Arrow function: vectors as the bytes of their components."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([np.array(x, kind).tobytes() for x in b.column("embedding").to_pylist()], pa.binary())], ["vec_id", "v"])

    return run


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, margin: float | None = MARGIN, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table (vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of unlike lengths never link. Repeated rows count as vectors of their own and other
    columns are ignored. An empty table gives no rows. Rows without vec_id link like any other;
    their component_id is null only where no vector of the group has an id, and then they are kept.
    `cell` is the number of vectors to a cell, about; `margin=None` loses no link whatever the data.
    """
    spark = table.sparkSession
    small_batches(spark)
    kind = "<f4" if dict(table.dtypes)["embedding"] == "array<float>" else "<f8"  # components travel as they are
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(_usable(), F.lit(False)))
    unit = rows.where("ok").select("vec_id", "embedding").mapInArrow(_bytes(kind), "vec_id long, v binary")
    unit = written(unit.withColumn("key", F.md5("v")), "vectors")
    distinct = unit.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    distinct = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")  # numbers that ids need not give
    sizes = [r["d"] for r in distinct.select(F.length("v").alias("d")).distinct().limit(65).collect()]
    if len(sizes) > 64:
        raise ValueError("vectors have more than 64 different lengths")
    links = None
    for d in sizes:
        own = distinct.where(F.length("v") == d).select("rep", "n", "v")
        k = int(min(CENTRES, max(1, own.count() // cell)))
        seen = own.orderBy(F.xxhash64("rep")).limit(sample * k + cell).select("v").toArrow().column("v").to_pylist()  # bounded by CENTRES
        centres = fit_centres(_unit(np.frombuffer(b"".join(seen), kind).reshape(len(seen), -1)), k)
        members, guests = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        shipped = spark.sparkContext.broadcast(centres)
        own = own.repartition(partitions(spark))
        for r in own.mapInArrow(_counts(shipped, threshold, margin, kind), "cell long, members long, guests long").groupBy("cell").agg(F.sum("members").alias("m"), F.sum("guests").alias("g")).collect():  # a row per cell, at most CENTRES
            members[r["cell"]], guests[r["cell"]] = r["m"], r["g"]
        # guests of a cell without members meet nobody
        own_blocks, guest_blocks = -(-members // block), np.where(members > 0, -(-guests // block), 0)
        dealt = own.mapInArrow(_dealt(shipped, threshold, margin, own_blocks, guest_blocks, kind), "cell long, x long, y long, block long, rep long, n long, home long, seen binary, v binary")
        found = dealt.groupBy("cell", "x", "y").applyInArrow(_compare(threshold, own_blocks, kind), "rep long, links long, other long")
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = written(links, "links")
    found = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.select("key", "rep", "n", "least").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    named = written(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"), "least"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = unit.select("vec_id", "key").join(named.join(least, "root").select("key", "n_links", "component_id"), "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
