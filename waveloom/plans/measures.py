"""Queries of detection, evaluation and example sets, and the SQL that gives the same rows.

Cells are event types (captures) by user (bins) and six hours (columns); boxes are what is strong in blocks of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from waveloom.operators import detection, estimators, scoring
from waveloom.plans.catalogue import IQ, PRED, _iq, _predictions, _table, query, rounded
from waveloom.sources import examples

CELLS = """cells AS (SELECT event_type AS capture_id, user_id % 48 AS f, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS t, round(10 * log10(sum(abs(value))), 6) AS s_db FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL HAVING sum(abs(value)) > 0
), means AS (SELECT capture_id, round(avg(s_db), 6) AS m FROM cells GROUP BY capture_id), strong AS (SELECT c.* FROM cells c JOIN means USING (capture_id) WHERE s_db > m
), boxes AS (SELECT capture_id, capture_id || ':' || (f // 16) || ':' || (t // 24) AS id, min(f) AS f0, max(f) AS f1, min(t) AS t0, max(t) AS t1, count(*) AS npix, max(s_db) AS peak_db FROM strong GROUP BY capture_id, f // 16, t // 24)"""


def _cells(spark, d):
    own = _table(spark, d, "events").where("value is not null and event_type is not null and user_id is not null and ts is not null")
    t = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600).cast("long")
    power = own.groupBy(F.col("event_type").alias("capture_id"), (F.col("user_id") % 48).alias("f"), t.alias("t")).agg(F.sum(F.abs("value")).alias("p")).where("p > 0")
    return power.select("capture_id", "f", "t", F.round(10 * F.log10("p"), 6).alias("s_db"))


def _boxes(cells):
    strong = cells.join(F.broadcast(cells.groupBy("capture_id").agg(F.round(F.avg("s_db"), 6).alias("m"))), "capture_id").where("s_db > m")  # a row per capture
    name = F.concat_ws(":", "capture_id", F.floor(F.col("f") / 16).cast("string"), F.floor(F.col("t") / 24).cast("string"))
    return strong.groupBy("capture_id", name.alias("id")).agg(F.min("f").alias("f0"), F.max("f").alias("f1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("npix"), F.max("s_db").alias("peak_db"))


@query(f"WITH {CELLS} SELECT b.id, c.f, c.t, c.s_db FROM boxes b JOIN cells c ON b.capture_id = c.capture_id AND c.f BETWEEN b.f0 AND b.f1 AND c.t BETWEEN b.t0 AND b.t1")
def box_cells(spark, d):
    cells = _cells(spark, d)
    return detection.box_cells(_boxes(cells), cells)


@query(f"""WITH {CELLS}, p AS (SELECT capture_id, f, t, 10 ** (s_db / 10) AS p FROM cells), bins AS (SELECT capture_id, f, avg(p) AS mean FROM p GROUP BY ALL
), tot AS (SELECT id, sum(m) AS total, count(*) AS n FROM (SELECT id, p.f, avg(p) AS m FROM boxes b JOIN p ON b.capture_id = p.capture_id AND p.f BETWEEN f0 AND f1 AND p.t BETWEEN t0 AND t1 GROUP BY id, p.f) GROUP BY id
), out AS (SELECT id, mean, f < f0 - 0.5 * (f1 - f0) OR f > f1 + 0.5 * (f1 - f0) AS far FROM boxes JOIN bins USING (capture_id) WHERE NOT f BETWEEN f0 AND f1
), noise AS (SELECT id, CASE WHEN count(*) FILTER (far) >= 8 THEN median(mean) FILTER (far) ELSE median(mean) END AS density FROM out GROUP BY id
), x AS (SELECT id, total, density * n AS noise FROM tot LEFT JOIN noise USING (id)), s AS (SELECT *, CASE WHEN noise > 0 AND total > noise THEN 10 * log10((total - noise) / noise) END AS snr, coalesce(noise > 0 AND total <= noise, false) AS below FROM x)
SELECT id, round(snr, 4) + 0.0 AS snr_db, round(CASE WHEN below THEN 0.15 WHEN snr IS NULL THEN 0 ELSE least(greatest(0.35 + 0.055 * snr, 0.2), 0.9) END, 4)::DOUBLE AS confidence, round(10 * log10(total), 4) + 0.0 AS power_dbfs, round(CASE WHEN noise > 0 THEN 10 * log10(noise) END, 4) + 0.0 AS noise_dbfs, below AS below_floor FROM s""")
def box_snr(spark, d):
    cells = _cells(spark, d)
    return rounded(detection.box_snr(_boxes(cells), cells), 4)


@query(f"""WITH {CELLS}, size AS (SELECT capture_id, count(DISTINCT t) AS nt, count(DISTINCT f) AS nf FROM cells GROUP BY capture_id)
SELECT id, npix, (t1 - t0 + 1) / nt >= 0.9 AND (f1 - f0 + 1) / nf >= 0.6 AS wideband FROM boxes JOIN size USING (capture_id) WHERE npix >= 40 AND f1 > f0 AND t1 > t0""")
def sized_boxes(spark, d):
    cells = _cells(spark, d)
    size = cells.groupBy("capture_id").agg(F.count_distinct("t").alias("nt"), F.count_distinct("f").alias("nf"))
    return detection.sized(_boxes(cells).join(F.broadcast(size), "capture_id"), F.col("nt"), F.col("nf")).select("id", "npix", "wideband")  # a row per capture


@query(f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY (f1 - f0 + 1) * (t1 - t0 + 1) DESC, id) AS rank, greatest(count(*) OVER (PARTITION BY capture_id) - 10, 0) AS left_out FROM boxes)
SELECT capture_id, id, rank, left_out FROM r WHERE rank <= 10""")
def gated_detections(spark, d):
    """The largest boxes of each capture, of which a report holds so many at most."""
    return detection.gated(_boxes(_cells(spark, d)), 10).select("capture_id", "id", "rank", "left_out")


@query("SELECT doc_id, CAST(least(greatest(2 ** round_even(log2(greatest(4.0 * n_chars * 100 / 2000, 1)), 0), 256), 8192) AS BIGINT) AS nfft FROM documents WHERE n_chars IS NOT NULL")
def transform_sizes(spark, d):
    return _table(spark, d, "documents").where("n_chars is not null").select("doc_id", detection.transform_size(F.col("n_chars") * 100).alias("nfft"))


@query("SELECT event_id, CASE WHEN isfinite(value + user_id) THEN round(value + user_id, 6) + 0.0 END AS f_abs FROM events")
def absolute_frequencies(spark, d):
    return rounded(_table(spark, d, "events").select("event_id", detection.absolute_frequency(F.col("value"), F.col("user_id").cast("double")).alias("f_abs")))


@query("""SELECT doc_id, list_filter([lang || ' text', CASE WHEN n_chars % 2 = 0 THEN 'even' END, CASE WHEN n_chars < 256 THEN 'fewer than 256 samples: not analysed' END, CASE WHEN n_chars >= 67108864 THEN 'very long: analysed in blocks' END], lambda x: x IS NOT NULL) AS notes FROM documents""")
def capture_notes(spark, d):
    """Notes of captures, given and of their length, without repeats."""
    even = F.when(F.col("n_chars") % 2 == 0, "even")
    own = _table(spark, d, "documents")
    return own.select("doc_id", detection.capture_notes(F.col("n_chars"), F.array(F.concat("lang", F.lit(" text")), even), F.array(even)).alias("notes"))


ROWS = "cap AS (SELECT l_orderkey // 256 AS capture_id, row_number() OVER (PARTITION BY l_orderkey // 256 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, l_quantity::DOUBLE AS v FROM lineitem)"


@query(f"WITH {ROWS}, x AS (SELECT *, greatest((max(n) OVER (PARTITION BY capture_id) + 1 - 300) // 2, 0) AS first FROM cap) SELECT capture_id, n - first AS n, v FROM x WHERE n >= first AND n < first + 300")
def centre_slices(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("capture_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = _table(spark, d, "lineitem").withColumn("capture_id", F.floor(F.col("l_orderkey") / 256))
    own = own.select("capture_id", (F.row_number().over(order) - 1).cast("long").alias("n"), F.col("l_quantity").cast("double").alias("v"))
    return detection.centre_slice(own, 300)


@query(f"""WITH {IQ}, p AS (SELECT capture_id, n % 4 AS phase, round(avg(i * i + q * q), 12) AS power FROM iq GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY power DESC, phase) AS k FROM p)
SELECT capture_id, phase, round(power, 6) + 0.0 AS power FROM r WHERE k = 1""")
def timing_phases(spark, d):
    return rounded(detection.timing_phase(_iq(spark, d), 4))


@query(f"""WITH {IQ}, s AS (SELECT capture_id, count(*) AS n FROM iq GROUP BY ALL), b AS (SELECT capture_id, n, list_concat(range(0, greatest(n - 12, 0) + 1, 6), CASE WHEN greatest(n - 12, 0) // 6 * 6 + 12 < n THEN [n - 12] ELSE [] END) AS firsts FROM s
), w AS (SELECT capture_id, u.k - 1 AS w, firsts[u.k] AS first FROM b, unnest(range(1, len(firsts) + 1)) AS u(k))
SELECT w.capture_id, w.w, w.first, count(*) AS n, round(sum(i), 4) + 0.0 AS i, round(sum(q), 4) + 0.0 AS q FROM w JOIN iq ON iq.capture_id = w.capture_id AND iq.n >= w.first AND iq.n < w.first + 12 GROUP BY ALL""")
def tail_windows(spark, d):
    """Sums over windows of 12 samples, half of which overlap, with one for the tail."""
    own = detection.padded_windows(estimators.blocks(_iq(spark, d)), 12, 0.5)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(c)
    return rounded(own.select("capture_id", F.col("w").cast("long").alias("w"), F.col("first").cast("long").alias("first"), F.size("i").cast("long").alias("n"), total("i"), total("q")), 4)


def _robust(rounds: int = 3) -> str:
    parts = ["r0 AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, true AS inside, false AS done FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"]
    for n in range(rounds):
        a, f, g, h = f"r{n}", f"f{n}", f"g{n}", f"h{n}"
        parts += [
            f"{f} AS (SELECT k, regr_slope(y, x) FILTER (inside) AS slope, regr_intercept(y, x) FILTER (inside) AS base, count(*) FILTER (inside) < 8 AS few FROM {a} GROUP BY k)",
            f"{g} AS (SELECT {a}.*, few, y - slope * x - base AS rest, abs(y - slope * x - base - median(y - slope * x - base) OVER (PARTITION BY k)) AS off FROM {a} JOIN {f} USING (k))",
            f"{h} AS (SELECT *, round(1.4826 * median(off) OVER (PARTITION BY k), 12) AS spread, coalesce(abs(rest) <= 2.5 * round(1.4826 * median(off) OVER (PARTITION BY k), 12), false) AS near FROM {g})",
            f"s{n} AS (SELECT *, done OR few OR coalesce(spread <= 0, true) OR count(*) FILTER (near) OVER (PARTITION BY k) < 8 OR count(*) FILTER (near <> inside) OVER (PARTITION BY k) = 0 AS stop FROM {h})",
            f"r{n + 1} AS (SELECT k, x, y, CASE WHEN few AND NOT done THEN true WHEN stop THEN inside ELSE near END AS inside, stop AS done FROM s{n})",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT k AS l_suppkey, round(regr_slope(y, x), 4) + 0.0 AS slope, round(regr_intercept(y, x), 4) + 0.0 AS intercept, round(regr_r2(y, x), 6) + 0.0 AS r2, count(*) AS n FROM r{rounds} WHERE inside GROUP BY k"


@query(_robust())
def robust_lines(spark, d):
    own = detection.robust_line(_table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")
    return own.select("l_suppkey", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("slope", 4), ("intercept", 4), ("r2", 6))], "n")


@query(f"""WITH {PRED} SELECT count(*) FILTER (confidence > 0.8) AS high_confidence_count, round(avg((truth = predicted)::INT) FILTER (confidence > 0.8), 6)::DOUBLE AS high_confidence_accuracy, round(avg((predicted = 'unknown')::INT) FILTER (snr_db < 5 AND truth <> predicted), 6)::DOUBLE AS unknown_share_low_snr
FROM (SELECT truth, CASE WHEN predicted = 'odd' THEN 'unknown' ELSE predicted END AS predicted, confidence, snr_db FROM pred)""")
def confident_accuracy(spark, d):
    own = _predictions(spark, d).withColumn("predicted", F.when(F.col("predicted") == "odd", "unknown").otherwise(F.col("predicted")))
    return rounded(scoring.confident(own))


@query("SELECT count(*) FILTER (lang = 'en') AS ok, count(*) FILTER (lang IS DISTINCT FROM 'en') AS failed, CAST(coalesce(sum(n_chars % 7), 0) AS BIGINT) AS detections, round(coalesce(sum(octet_length(encode(text))), 0) / 1e6, 6) AS megabytes, round(coalesce(sum(octet_length(encode(text))), 0) / 1e6 / 4.0, 6) AS megabytes_per_second FROM documents")
def batch_summary(spark, d):
    own = _table(spark, d, "documents").select(F.when(F.col("lang") == "en", "ok").otherwise("failed").alias("status"), (F.col("n_chars") % 7).alias("n_detections"), F.octet_length("text").alias("bytes"))
    return rounded(scoring.batch_totals(own, 4.0))


TRIALS = "t AS (SELECT l_shipmode_ AS measure, CAST(l_linenumber AS BIGINT) * 5 AS level_db, CASE WHEN l_quantity % 10 > 0 THEN l_discount::DOUBLE END AS error, l_discount < 0.02 * l_linenumber + 0.02 AND l_quantity % 10 > 0 AS passed FROM (SELECT *, l_returnflag || l_linestatus || (l_suppkey % 20) AS l_shipmode_ FROM lineitem))"


@query(f"""WITH {TRIALS}, l AS (SELECT measure, level_db, median(error) AS median_error, avg(passed::INT) AS pass_rate, count(*) FILTER (error IS NULL) AS abstentions, min(passed::INT) AS ok FROM t GROUP BY ALL
), b AS (SELECT *, min(ok) OVER (PARTITION BY measure ORDER BY level_db DESC ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT measure, level_db, round(median_error, 6) + 0.0 AS median_error, round(pass_rate, 6)::DOUBLE AS pass_rate, abstentions, min(level_db) FILTER (run = 1) OVER (PARTITION BY measure) AS break_db FROM b""")
def accuracy_harness(spark, d):
    own = _table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 20).cast("string")).alias("measure"), (F.col("l_linenumber").cast("long") * 5).alias("level_db"), F.when(F.col("l_quantity") % 10 > 0, F.col("l_discount").cast("double")).alias("error"), ((F.col("l_discount") < 0.02 * F.col("l_linenumber") + 0.02) & (F.col("l_quantity") % 10 > 0)).alias("passed"))
    return rounded(scoring.harness(own))


@query("""WITH c AS (SELECT user_id AS id, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS w, event_type AS label, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL
), g AS (SELECT a.id, a.w, b.label FROM (SELECT DISTINCT id, w FROM c) a, (SELECT DISTINCT label FROM c) b), p AS (SELECT id, w, label, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY id, w) AS p FROM g LEFT JOIN c USING (id, w, label)
), o AS (SELECT id, w, abs(p - avg(p) OVER (PARTITION BY id, label)) AS off FROM p), e AS (SELECT id, w, sum(off) / 2 AS off FROM o GROUP BY ALL) SELECT id, round(avg(off), 6) + 0.0 AS spread FROM e GROUP BY id""")
def vote_spread(spark, d):
    """How much the shares of a user's event types differ from week to week."""
    own = _table(spark, d, "events").where("user_id is not null and ts is not null and event_type is not null").select(F.col("user_id").alias("id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 604800).cast("long").alias("w"), F.col("event_type").alias("label"))
    wide = own.groupBy("id", "w").agg(F.count("*").alias("total"))
    full = wide.crossJoin(F.broadcast(own.select("label").distinct())).join(own.groupBy("id", "w", "label").count(), ["id", "w", "label"], "left")  # labels are few
    return rounded(scoring.window_spread(full.select("id", "w", "label", (F.coalesce("count", F.lit(0)) / F.col("total")).alias("p"))))


@query(f"WITH {PRED}, r AS (SELECT truth AS label, avg((truth = predicted)::INT) AS recall, count(*) AS support FROM pred GROUP BY truth) SELECT label, round(recall, 6)::DOUBLE AS recall, support FROM r ORDER BY recall, label LIMIT 3")
def worst_recalls(spark, d):
    return rounded(scoring.worst_recalls(_predictions(spark, d)))


@query(f"""WITH {PRED}, c AS (SELECT truth, predicted, count(*) AS n FROM pred WHERE snr_db >= 15 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY truth) AS share FROM c)
SELECT truth, predicted, n, round(share, 6)::DOUBLE AS share FROM s WHERE truth <> predicted AND share >= 0.1 ORDER BY share DESC, truth, predicted LIMIT 5""")
def top_confusions(spark, d):
    return rounded(scoring.top_confusions(_predictions(spark, d)))


@query(f"WITH {PRED} SELECT truth AS label, round(avg((truth = predicted)::INT) FILTER (snr_db < 5), 6)::DOUBLE AS low, round(avg((truth = predicted)::INT) FILTER (snr_db >= 5 AND snr_db < 15), 6)::DOUBLE AS mid, round(avg((truth = predicted)::INT) FILTER (snr_db >= 15), 6)::DOUBLE AS high, round(avg((truth = predicted)::INT), 6)::DOUBLE AS \"all\" FROM pred GROUP BY truth")
def accuracy_by_label(spark, d):
    return rounded(scoring.accuracy_report(_predictions(spark, d)))


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_custkey FROM r WHERE k % greatest(n // 500, 1) = 0 AND k < greatest(n // 500, 1) * 500")
def every_nth_order(spark, d):
    """At most 500 orders at equal steps."""
    return scoring.every_nth(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 500)


@query("""WITH r AS (SELECT doc_id, lang, n_chars % 3 AS part, row_number() OVER (PARTITION BY lang, n_chars % 3 ORDER BY md5('26147:' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang, n_chars % 3) AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN k <= round(n * 0.7::DOUBLE) THEN 'train' WHEN k <= round(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, d):
    own = _table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 3).alias("part"))
    return examples.split(own, "doc_id", "lang", "part").select("doc_id", "split")


@query("SELECT a.lang AS modulation, b.source AS snr_db FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) a, (SELECT DISTINCT source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id % 10 > 0) b WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.lang = a.lang AND x.source = b.source AND doc_id % 10 > 0) AND EXISTS (SELECT 1 FROM documents y WHERE y.lang = a.lang AND y.source IS NOT NULL AND doc_id % 10 > 0)")
def grid_gaps(spark, d):
    """Languages by sources that no document outside every tenth has."""
    return examples.gaps(_table(spark, d, "documents").where("doc_id % 10 > 0").select(F.col("lang").alias("modulation"), F.col("source").alias("snr_db")))
