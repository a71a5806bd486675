"""Time-frequency grids: noise floors, masks, islands, boxes and their algebra.

A grid is (f, t, s_db) under a capture key; a box is a rectangle with inclusive edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions.columns import cfar_threshold_db
from waveloom.functions.session import checkpointed, shuffled

THRESHOLD_DB = cfar_threshold_db(1e-2, 25.0)


def event_grid(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Power per event type and time bucket: (f, t, s_db)."""
    t = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds).cast("long")
    own = events.where("value is not null and event_type is not null and ts is not null").groupBy(F.col("event_type").alias("f"), t.alias("t")).agg(F.sum(F.abs("value")).alias("p"))
    return own.where("p > 0").select("f", "t", F.round(10 * F.log10("p"), 6).alias("s_db"))


def noise_floor(grid: DataFrame) -> DataFrame:
    """(f, bin_db, floor_db, sigma_db): 25th percentile over time, that over bins, and the scaled deviation about the floor."""
    bins = grid.groupBy("f").agg(F.percentile("s_db", F.lit(0.25)).alias("bin_db"))
    floor = bins.agg(F.percentile("bin_db", F.lit(0.25)).alias("floor_db"))
    both = bins.crossJoin(F.broadcast(floor))  # one row
    sigma = both.agg((F.median(F.abs(F.col("bin_db") - F.col("floor_db"))) * 1.4826).alias("sigma_db"))
    return both.crossJoin(F.broadcast(sigma))


def active(grid: DataFrame, margin_db: float, excess_db: float = 6.0) -> DataFrame:
    """Cells above the lower of their bin's floor and the floor plus `excess_db`, by more than `margin_db`."""
    bins = noise_floor(grid).select("f", F.least(F.col("bin_db"), F.col("floor_db") + excess_db).alias("base"))
    return grid.join(bins, "f").where(F.col("s_db") > F.col("base") + margin_db).select("f", "t", "s_db")


def islands(cells: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of cells at most `gap` steps apart in each bin: (f, t0, t1, npix, peak_db)."""
    w = Window.partitionBy("f").orderBy("t")
    own = cells.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return own.groupBy("f", "run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("npix"), F.max("s_db").alias("peak_db")).drop("run")


def dilate(cells: DataFrame, df: tuple[int, ...], dt: tuple[int, ...]) -> DataFrame:
    """Cells (fi, t) with their neighbours at the given offsets: the sparse form of a moving maximum."""
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in df for b in dt]))
    return cells.select("fi", "t", shift.alias("s")).select((F.col("fi") + F.col("s.a")).alias("fi"), (F.col("t") + F.col("s.b")).alias("t")).distinct()


def erode(cells: DataFrame, df: tuple[int, ...], dt: tuple[int, ...]) -> DataFrame:
    """Cells (fi, t) all of whose neighbours at the given offsets are there: the sparse form of a moving minimum."""
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in df for b in dt]))
    moved = cells.select("fi", "t", shift.alias("s")).select((F.col("fi") - F.col("s.a")).alias("fi"), (F.col("t") - F.col("s.b")).alias("t"))
    return moved.groupBy("fi", "t").count().where(F.col("count") == len(df) * len(dt)).select("fi", "t")


def closed_opened(cells: DataFrame) -> DataFrame:
    """Closing by 3 x 3, then opening by 2 x 2; what lies outside the grid is off."""
    three, back, on = (-1, 0, 1), (-1, 0), (0, 1)
    return dilate(erode(erode(dilate(cells, three, three), three, three), back, back), on, on)


def _bucketed_pairs(boxes: DataFrame, reach_f, reach_t: int, wide_f: int, wide_t: int, b_columns: list[str], test: Column) -> DataFrame:
    """Pairs (a_..., b_...) of boxes for which test holds, where b lies within reach of a on both axes.

    Boxes meet in buckets of wide_f by wide_t; a is enlarged by its reach. A pair counts in the first
    bucket that both are in, so no pair comes twice and nothing is shuffled after the join.
    """
    span = lambda lo, hi, wide: F.sequence(F.floor(lo / wide), F.floor(hi / wide))
    sides = []
    for side, columns, rf, rt in (("a", boxes.columns, reach_f, reach_t), ("b", b_columns, F.lit(0), 0)):
        f, t = span(F.col("f0") - rf, F.col("f1") + rf, wide_f), span(F.col("t0") - rt, F.col("t1") + rt, wide_t)
        own = boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in columns], f.alias("_f"), t.alias("_t")).withColumn(f"{side}_of", F.element_at("_f", 1)).withColumn(f"{side}_ot", F.element_at("_t", 1))
        sides.append(own.withColumn("bf", F.explode("_f")).withColumn("bt", F.explode("_t")).drop("_f", "_t"))
    first = (F.col("bf") == F.greatest("a_of", "b_of")) & (F.col("bt") == F.greatest("a_ot", "b_ot"))
    return shuffled(sides[0]).join(sides[1], ["bf", "bt"]).where(first & test)


def _gap(a0, a1, b0, b1):
    return F.greatest(F.lit(0), F.col(a0) - F.col(b1), F.col(b0) - F.col(a1))


def merge_links(boxes: DataFrame, gap: int = 3, wide_f: int = 16, wide_t: int = 16) -> DataFrame:
    """(a, b) ids of boxes (id, f0, f1, t0, t1) to merge: they overlap on one axis and lie less than `gap` apart on the other."""
    ft, ff = _gap("a_t0", "a_t1", "b_t0", "b_t1"), _gap("a_f0", "a_f1", "b_f0", "b_f1")
    near = ((ff == 0) & (ft < gap)) | ((ft == 0) & (ff < gap))
    own = boxes.select("id", "f0", "f1", "t0", "t1")
    pairs = _bucketed_pairs(own, F.lit(gap), gap, wide_f, wide_t, own.columns, (F.col("a_id") < F.col("b_id")) & near)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable over links (a, b); nodes without links are their own root.

    Rounds of large-star and small-star: every node hands its larger, then its smaller neighbours
    the least one it knows, so links shrink to stars in a number of rounds that grows with the
    logarithm of the longest chain. Each round is cut by a checkpoint in the shared folder, and
    the links are worked out once.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("b", "m").union(down.select(F.col("a").alias("b"), "m"))
        now = checkpointed(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    return nodes.select("id").join(now.select(F.col("a").alias("id"), F.col("b").alias("_r")), "id", "left").select("id", F.coalesce("_r", "id").alias("root"))


def merged(boxes: DataFrame, gap: int = 3) -> DataFrame:
    """Boxes joined into the rectangles around what merges: (root, f0, f1, t0, t1, npix, peak_db, n_boxes)."""
    roots = components(merge_links(boxes, gap), boxes)
    return shuffled(boxes).join(roots, "id").groupBy("root").agg(F.min("f0").alias("f0"), F.max("f1").alias("f1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("npix").alias("npix"), F.max("peak_db").alias("peak_db"), F.count("*").alias("n_boxes"))


def without_leakage(boxes: DataFrame, margin_db: float = 20.0, span: float = 2.0, wide_f: int = 16, wide_t: int = 16) -> DataFrame:
    """Boxes without those that a much stronger box beside them explains."""
    wide = F.col("a_f1") - F.col("a_f0") + 1
    stronger = (F.col("a_id") != F.col("b_id")) & (F.col("a_peak_db") - F.col("b_peak_db") > margin_db) & (F.col("a_t0") <= F.col("b_t1")) & (F.col("b_t0") <= F.col("a_t1"))
    beside = (_gap("a_f0", "a_f1", "b_f0", "b_f1") <= span * wide) & (F.col("b_f1") - F.col("b_f0") + 1 <= wide)
    own = boxes.select("id", "f0", "f1", "t0", "t1", "peak_db")
    gone = _bucketed_pairs(own, F.ceil(span * (F.col("f1") - F.col("f0") + 1)), 0, wide_f, wide_t, own.columns, stronger & beside)
    return boxes.join(gone.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")


def max_pool(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """Block maxima of a grid (fi, t, s_db)."""
    return cells.groupBy(F.floor(F.col("fi") / rows).alias("pf"), F.floor(F.col("t") / columns).alias("pt")).agg(F.max("s_db").alias("s_db"))


def ridge(grid: DataFrame) -> DataFrame:
    """Strongest bin of each column (fi, t, s_db), the first of equals."""
    return grid.groupBy("t").agg(F.max_by("fi", F.struct("s_db", -F.col("fi"))).alias("fi"))


def line_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Slope, intercept and R2 of y over x."""
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the largest value, the last bin closed, empty bins as 0."""
    edge = values.where(F.col(column).isNotNull()).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    own = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = own.groupBy(k.cast("long").alias("k")).agg(F.count("*").alias("n"))
    return values.sparkSession.range(bins).withColumnRenamed("id", "k").join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def sessions(events: DataFrame, gap_s: int) -> DataFrame:
    """Runs of a user's events at most gap_s seconds apart: (user_id, session, t0, t1, n)."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    own = events.where("ts is not null").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    own = own.withColumn("session", F.sum(F.when(F.col("at") - F.lag("at").over(w) <= gap_s, 0).otherwise(1)).over(w))
    return own.groupBy("user_id", "session").agg(F.min("at").alias("t0"), F.max("at").alias("t1"), F.count("*").alias("n"))


def hops(events: DataFrame, length_s: int, hop_s: int) -> DataFrame:
    """Overlapping windows of events: (event_type, w, n, total)."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    own = events.where("ts is not null").withColumn("w", F.explode(F.sequence(F.floor((at - length_s) / hop_s) + 1, F.floor(at / hop_s))))
    return own.groupBy("event_type", "w").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
