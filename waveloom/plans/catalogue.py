"""Registered queries over the given tables, and the SQL that gives the same rows.

`embeddings` serve as interleaved samples, `events` as a grid of types by hour, `documents` with
`labels` as truth and prediction, `lineitem` and `orders` as batches and file names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveloom.functions.columns import format_hz, snr_band
from waveloom.functions.session import shared_dir
from waveloom.operators import estimators, features, grids, reports, samples, scoring
from waveloom.sources import recordings

QUERIES: dict = {}
SQL: dict = {}
SIZE, MARGIN_DB = 32, 3.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _iq(spark: SparkSession, d: str) -> DataFrame:
    return samples.decode(_table(spark, d, "embeddings"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Every double rounded once, as a multiple of 10 ** -places like the SQL's; -0.0 becomes 0.0."""
    by = 10.0**places
    each = lambda c: F.when(F.abs(F.col(c) * by) < float("inf"), F.round(F.col(c) * by) / by).otherwise(F.col(c)) + 0.0
    return df.select(*[each(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


IQ = "iq AS (SELECT vec_id AS capture_id, n, embedding[2 * n + 1]::DOUBLE AS i, embedding[2 * n + 2]::DOUBLE AS q FROM embeddings, unnest(range(0, len(embedding) // 2)) AS u(n))"
INST = IQ + """, step AS (SELECT *, sqrt(i * i + q * q) AS a, atan2(q, i) AS phase, lag(i) OVER w AS pi, lag(q) OVER w AS pq FROM iq WINDOW w AS (PARTITION BY capture_id ORDER BY n)
), inst AS (SELECT capture_id, n, a, phase, atan2(q * pi - i * pq, i * pi + q * pq) / (2 * pi()) AS freq FROM step)"""


@query(f"WITH {IQ} SELECT capture_id, n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM iq")
def iq_decode(spark, d):
    return rounded(_iq(spark, d))


@query(f"""WITH {IQ}, c AS (SELECT capture_id, n, i - avg(i) OVER w AS i, q - avg(q) OVER w AS q FROM iq WINDOW w AS (PARTITION BY capture_id)),
s AS (SELECT *, sqrt(avg(i * i + q * q) OVER (PARTITION BY capture_id)) AS scale FROM c)
SELECT capture_id, n, round(i / scale, 6) + 0.0 AS i, round(q / scale, 6) + 0.0 AS q, round(20 * log10(scale), 6) + 0.0 AS dbfs FROM s""")
def iq_condition(spark, d):
    return rounded(samples.condition(_iq(spark, d)))


@query(f"""WITH {IQ}, s AS (SELECT capture_id, n - 4 AS n, i, q FROM iq WHERE n >= 4 AND n < 28)
SELECT capture_id, CAST(n / 4 AS BIGINT) AS n, round(i * cos(2 * pi() * 0.1 * n) + q * sin(2 * pi() * 0.1 * n), 6) + 0.0 AS i, round(q * cos(2 * pi() * 0.1 * n) - i * sin(2 * pi() * 0.1 * n), 6) + 0.0 AS q FROM s WHERE n % 4 = 0""")
def iq_mix_decimate(spark, d):
    return rounded(samples.mix_down(_iq(spark, d), 0.1, every=4, first=4, last=28))


@query(f"""WITH {INST}, u AS (SELECT capture_id, n, phase, freq, phase - lag(phase) OVER (PARTITION BY capture_id ORDER BY n) AS step FROM inst)
SELECT capture_id, n, round(phase, 6) + 0.0 AS phase, round(freq, 6) + 0.0 AS freq,
round(phase + sum(CASE WHEN step > pi() THEN -2 * pi() WHEN step < -pi() THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n), 6) + 0.0 AS unwrapped FROM u""")
def phase_unwrap(spark, d):
    return rounded(samples.instantaneous(_iq(spark, d)).select("capture_id", "n", "phase", "freq", "unwrapped"))


@query(f"""WITH {INST}, m AS (SELECT capture_id, quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi, quantile_cont(abs(freq), 0.99) AS fm_deviation, var_pop(a) / (avg(a) * avg(a)) AS envelope_var,
stddev_pop(freq) AS sigma_af, kurtosis_pop(a) AS kurtosis_a, 10 * log10(max(a * a) / avg(a * a)) AS papr_db FROM inst GROUP BY capture_id)
SELECT capture_id, round((hi - lo) / (hi + lo), 6) AS am_depth, CASE WHEN envelope_var < 0.005 THEN 0.3 ELSE 0.8 END::DOUBLE AS am_confidence, round(fm_deviation, 6) AS fm_deviation,
CASE WHEN envelope_var < 0.05 THEN 0.85 ELSE 0.45 END::DOUBLE AS fm_confidence, round(envelope_var, 6) AS envelope_var, round(sigma_af, 6) AS sigma_af, round(kurtosis_a, 6) + 0.0 AS kurtosis_a, round(papr_db, 6) AS papr_db FROM m""")
def envelope_measures(spark, d):
    return rounded(samples.envelope_measures(_iq(spark, d)))


MOMENTS = IQ + """, p AS (SELECT capture_id, i * i + q * q AS p, i * i - q * q AS sr, 2 * i * q AS si FROM iq
), m AS (SELECT capture_id, count(*) AS n, avg(p) AS m21, avg(sr) AS m20r, avg(si) AS m20i, avg(sr * sr - si * si) AS m40r, avg(2 * sr * si) AS m40i, avg(p * p) AS m42 FROM p GROUP BY capture_id
), c AS (SELECT capture_id, CASE WHEN n >= 16 AND m21 > 0 THEN sqrt((m40r - 3 * (m20r * m20r - m20i * m20i)) ** 2 + (m40i - 6 * m20r * m20i) ** 2) / (m21 * m21) END AS c40_ratio,
CASE WHEN n >= 16 AND m21 > 0 THEN abs(m42 - (m20r * m20r + m20i * m20i) - 2 * m21 * m21) / (m21 * m21) END AS c42_ratio FROM m)"""


@query(f"WITH {MOMENTS} SELECT capture_id, round(c40_ratio, 6) AS c40_ratio, round(c42_ratio, 6) AS c42_ratio FROM c")
def cumulants(spark, d):
    return rounded(samples.cumulants(_iq(spark, d)))


@query(f"""WITH {MOMENTS}, t(k, label, t40, t42) AS (VALUES (0, 'bpsk', 2.0, 2.0), (1, 'qpsk', 1.0, 1.0), (2, '8psk', 0.0, 1.0), (3, 'qam16', 0.68, 0.68), (4, 'qam64', 0.62, 0.62), (5, 'noise', 0.0, 0.0)),
far AS (SELECT capture_id, k, label, sqrt((c40_ratio - t40::DOUBLE) ** 2 + (c42_ratio - t42::DOUBLE) ** 2) AS distance FROM c, t)
SELECT capture_id, label, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY distance, k) AS r FROM far) WHERE r = 1""")
def nearest_constellation(spark, d):
    return rounded(samples.nearest_constellation(samples.cumulants(_iq(spark, d))))


@query(f"""WITH {IQ}, p AS (SELECT capture_id, sum(i * i + q * q) AS power FROM iq GROUP BY capture_id),
r AS (SELECT a.capture_id, a.n - b.n AS lag, sum(a.i * b.i + a.q * b.q) AS re, sum(a.q * b.i - a.i * b.q) AS im FROM iq a JOIN iq b ON a.capture_id = b.capture_id AND a.n - b.n BETWEEN 1 AND 8 GROUP BY ALL)
SELECT capture_id, CAST(lag AS BIGINT) AS lag, round(sqrt(re * re + im * im) / power, 6) AS r FROM r JOIN p USING (capture_id) WHERE power > 0""")
def autocorrelation_lags(spark, d):
    return rounded(samples.autocorrelation(_iq(spark, d), 8))


DFT = IQ + """, bins AS (SELECT capture_id, k, sum(i * cos(-2 * pi() / 32 * ((k * n) % 32)) - q * sin(-2 * pi() / 32 * ((k * n) % 32))) AS re, sum(i * sin(-2 * pi() / 32 * ((k * n) % 32)) + q * cos(-2 * pi() / 32 * ((k * n) % 32))) AS im
FROM iq, unnest(range(0, 32)) AS u(k) GROUP BY capture_id, k), power AS (SELECT capture_id, CAST(k AS BIGINT) AS k, re * re + im * im AS p FROM bins)"""


@query(f"WITH {DFT} SELECT capture_id, k, round(p, 4) AS p FROM power")
def dft_power(spark, d):
    return rounded(samples.dft_power(_iq(spark, d), SIZE), 4)


@query(f"WITH {DFT} SELECT capture_id, k, round(p, 4) AS p FROM power")
def fft_power(spark, d):
    return rounded(samples.fft_power(_table(spark, d, "embeddings")), 4)


@query(f"""WITH {DFT}, f AS (SELECT capture_id, p, CASE WHEN k >= 16 THEN k - 32 ELSE k END AS f FROM power),
c AS (SELECT *, sum(p) OVER (PARTITION BY capture_id ORDER BY f) / sum(p) OVER (PARTITION BY capture_id) AS cum FROM f)
SELECT capture_id, round(exp(avg(ln(greatest(p, 1e-30)))) / avg(p), 6) AS flatness, round(sum(p * f) / sum(p), 6) + 0.0 AS centroid,
round(10 * log10(sum(p) FILTER (f > 0)) - 10 * log10(sum(p) FILTER (f < 0)), 6) + 0.0 AS asymmetry_db,
CAST(min(f) FILTER (cum >= 0.995) - min(f) FILTER (cum >= 0.005) + 1 AS BIGINT) AS obw_bins, CAST(arg_max(f, p) AS BIGINT) AS peak_bin FROM c GROUP BY capture_id""")
def spectral_shape(spark, d):
    return rounded(samples.spectral_shape(samples.dft_power(_iq(spark, d), SIZE), SIZE))


@query(f"""WITH {IQ}, two AS (SELECT capture_id, n, i * i - q * q AS i2, 2 * i * q AS q2 FROM iq), four AS (SELECT *, i2 * i2 - q2 * q2 AS i4, 2 * i2 * q2 AS q4 FROM two
), x AS (SELECT capture_id, n, 2 AS m, i2 AS i, q2 AS q FROM four UNION ALL SELECT capture_id, n, 4, i4, q4 FROM four UNION ALL SELECT capture_id, n, 8, i4 * i4 - q4 * q4, 2 * i4 * q4 FROM four
), th AS (SELECT *, -2 * pi() / 32 * ((k * n) % 32) AS th FROM x, unnest(range(0, 32)) AS u(k)
), bins AS (SELECT capture_id, m, k, sum(i * cos(th) - q * sin(th)) ** 2 + sum(i * sin(th) + q * cos(th)) ** 2 AS p FROM th GROUP BY ALL
), line AS (SELECT capture_id, m, 10 * log10(max(p) / median(p)) AS d FROM bins GROUP BY ALL
), best AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY d DESC, m) AS r FROM line)
SELECT capture_id, CASE WHEN d >= 10 THEN CAST(m AS BIGINT) END AS psk_order, round(d, 4) AS sharpness_db FROM best WHERE r = 1""")
def mth_power_line(spark, d):
    return rounded(samples.mth_power_line(_iq(spark, d), SIZE), 4)


@query(f"""WITH {IQ}, w AS (SELECT capture_id, w, i * i + q * q AS p FROM iq, unnest(range(0, 3)) AS u(w) WHERE n >= 8 * w AND n < 8 * w + 16)
SELECT capture_id, CAST(w AS BIGINT) AS w, round(avg(p), 6) AS power FROM w GROUP BY ALL""")
def iq_sliding_windows(spark, d):
    return rounded(samples.windows(_iq(spark, d), 16, 8))


GRID = """cells AS (SELECT event_type AS f, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, sum(abs(value)) AS p FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
), grid AS (SELECT f, t, round(10 * log10(p), 6) AS s_db FROM cells WHERE p > 0)"""
FLOOR = GRID + """, bins AS (SELECT f, quantile_cont(s_db, 0.25) AS bin_db FROM grid GROUP BY f
), floors AS (SELECT *, (SELECT quantile_cont(bin_db, 0.25) FROM bins) AS floor_db FROM bins
), active AS (SELECT g.f, g.t, g.s_db FROM grid g JOIN floors b ON g.f = b.f WHERE g.s_db > least(b.bin_db, b.floor_db + 6.0) + 3.0)"""
ISLANDS = FLOOR + """, flagged AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY f ORDER BY t) <= 1 THEN 0 ELSE 1 END AS new FROM active
), runs AS (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY t) AS run FROM flagged
), islands AS (SELECT f, min(t) AS t0, max(t) AS t1, count(*) AS npix, max(s_db) AS peak_db FROM runs GROUP BY f, run)"""


def _grid(spark, d):
    return grids.event_grid(_table(spark, d, "events"))


@query(f"WITH {GRID} SELECT * FROM grid")
def grid_power(spark, d):
    return _grid(spark, d)


@query(f"WITH {FLOOR} SELECT f, round(bin_db, 4) AS bin_db, round(floor_db, 4) AS floor_db, round((SELECT median(abs(bin_db - floor_db)) FROM floors) * 1.4826, 4) AS sigma_db FROM floors")
def noise_floor(spark, d):
    return rounded(grids.noise_floor(_grid(spark, d)), 4)


@query(f"WITH {FLOOR} SELECT f, t, s_db FROM active")
def cfar_mask(spark, d):
    return grids.active(_grid(spark, d), MARGIN_DB)


@query(f"WITH {ISLANDS} SELECT f, t0, t1, npix, peak_db FROM islands")
def islands(spark, d):
    return grids.islands(grids.active(_grid(spark, d), MARGIN_DB))


def _numbered(spark, d):
    """Active cells with bins by number: users in place of event types make a wide grid."""
    own = _table(spark, d, "events").where("value is not null and user_id is not null and ts is not null")
    return own.select(F.col("user_id").alias("fi"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("t"), "value")


CELLS = "cells AS (SELECT user_id AS fi, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, sum(value) AS p, count(*) AS n FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL), active AS (SELECT fi, t FROM cells WHERE n >= 3)"


def _busy(spark, d):
    return _numbered(spark, d).groupBy("fi", "t").count().where("count >= 3").select("fi", "t")


@query(f"""WITH {CELLS}, three(a) AS (VALUES (-1), (0), (1)), d AS (SELECT DISTINCT fi + x.a AS fi, t + y.a AS t FROM active, three x, three y),
c AS (SELECT fi - x.a AS fi, t - y.a AS t FROM d, three x, three y GROUP BY ALL HAVING count(*) = 9),
e AS (SELECT fi - x.a AS fi, t - y.a AS t FROM c, (VALUES (-1), (0)) x(a), (VALUES (-1), (0)) y(a) GROUP BY ALL HAVING count(*) = 4)
SELECT DISTINCT fi + x.a AS fi, t + y.a AS t FROM e, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(a)""")
def morphology(spark, d):
    return grids.closed_opened(_busy(spark, d))


def _boxes(spark, d):
    """Days of the busiest hours per user as boxes with ids."""
    own = _numbered(spark, d).groupBy("fi", "t").agg(F.count("*").alias("npix"), F.sum(F.abs("value")).alias("p")).where("npix >= 3 and p > 0")
    return own.select((F.col("fi") * 100000 + F.col("t")).alias("id"), F.col("fi").alias("f0"), F.col("fi").alias("f1"), F.col("t").alias("t0"), F.col("t").alias("t1"), "npix", F.round(10 * F.log10("p"), 6).alias("peak_db"))


BOXES = "boxes AS (SELECT user_id * 100000 + CAST(floor(epoch(ts) / 86400) AS BIGINT) AS id, user_id AS f, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, count(*) AS npix, round(10 * log10(sum(abs(value))), 6) AS peak_db FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND sum(abs(value)) > 0)"


@query(f"""WITH {BOXES} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND ((a.f = b.f AND abs(a.t - b.t) < 3) OR (a.t = b.t AND abs(a.f - b.f) < 3))""")
def merge_links(spark, d):
    return grids.merge_links(_boxes(spark, d))


@query(f"""WITH RECURSIVE {BOXES}, links AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id <> b.id AND ((a.f = b.f AND abs(a.t - b.t) < 3) OR (a.t = b.t AND abs(a.f - b.f) < 3))),
reach(id, root) AS (SELECT id, id FROM boxes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT root, min(f) AS f0, max(f) AS f1, min(t) AS t0, max(t) AS t1, CAST(sum(npix) AS BIGINT) AS npix, max(peak_db) AS peak_db, count(*) AS n_boxes FROM boxes JOIN roots USING (id) GROUP BY root""")
def merged_boxes(spark, d):
    return grids.merged(_boxes(spark, d))


@query(f"""WITH {BOXES} SELECT id, npix, peak_db FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes a WHERE a.id <> b.id AND a.peak_db - b.peak_db > 6 AND a.t = b.t AND greatest(0, a.f - b.f, b.f - a.f) <= 2)""")
def suppress_leakage(spark, d):
    return grids.without_leakage(_boxes(spark, d), margin_db=6.0).select("id", "npix", "peak_db")


@query(f"""WITH {CELLS} SELECT floor(fi / 8)::BIGINT AS pf, floor(t / 4)::BIGINT AS pt, round(max(p), 6) AS s_db FROM (SELECT fi, t, p FROM cells) GROUP BY ALL""")
def maxpool_grid(spark, d):
    own = _numbered(spark, d).groupBy("fi", "t").agg(F.sum("value").alias("s_db"))
    return rounded(grids.max_pool(own, 8, 4))


@query(f"""WITH {CELLS}, r AS (SELECT fi, max(p) AS top FROM cells GROUP BY fi), x AS (SELECT c.fi, c.t, c.p FROM cells c)
SELECT fi, round(regr_slope(p, t), 6) + 0.0 AS slope, round(regr_r2(p, t), 6) + 0.0 AS r2, count(*) AS n FROM x GROUP BY fi HAVING count(*) >= 8""")
def ridge_fit(spark, d):
    own = _numbered(spark, d).groupBy("fi", "t").agg(F.sum("value").alias("p"))
    return rounded(grids.line_fit(own, "t", "p", "fi").where("n >= 8").select("fi", "slope", "r2", "n"))


@query("""WITH v AS (SELECT value FROM events WHERE value IS NOT NULL), e AS (SELECT min(value) AS lo, max(value) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS BIGINT) AS k, count(*) AS n FROM v, e GROUP BY ALL)
SELECT u.k, coalesce(n, 0) AS n FROM unnest(range(0, 40)) AS u(k) LEFT JOIN c ON u.k = c.k""")
def histogram(spark, d):
    return grids.histogram(_table(spark, d, "events"), "value", 40)


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE ts IS NOT NULL), l AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, min(sec) AS t0, max(sec) AS t1, count(*) AS n FROM s GROUP BY user_id, session""")
def sessionize(spark, d):
    return grids.sessions(_table(spark, d, "events"), 3600)


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value FROM events WHERE ts IS NOT NULL)
SELECT event_type, CAST(w AS BIGINT) AS w, count(*) AS n, round(sum(value), 4) AS total FROM e, unnest(range(CAST(floor((sec - 7200) / 1800) AS BIGINT) + 1, CAST(floor(sec / 1800) AS BIGINT) + 1)) AS u(w) GROUP BY ALL""")
def hopping_windows(spark, d):
    return rounded(grids.hops(_table(spark, d, "events"), 7200, 1800), 4)


@query(f"""WITH {ISLANDS}, a AS (SELECT row_number() OVER (ORDER BY f, t0) AS id, * FROM islands) SELECT f, count(*) AS truths, count(*) FILTER (EXISTS (SELECT 1 FROM islands o WHERE o.f <> a.f AND o.t0 <= a.t1 AND a.t0 <= o.t1)) AS found FROM a GROUP BY f""")
def truth_overlap(spark, d):
    own = grids.islands(grids.active(_grid(spark, d), MARGIN_DB))
    # an island is found if some hour of it is active in another bin: hours with two bins or more, at most one row each
    shared = own.select("f", F.explode(F.sequence("t0", "t1")).alias("at")).distinct().groupBy("at").count().where("count > 1").select("at")
    hours = own.select("f", "t0", "t1", F.explode(F.sequence("t0", "t1")).alias("at")).join(shared, "at", "left_semi")
    near = hours.select("f", "t0", "t1").distinct().withColumn("hit", F.lit(1))
    return own.join(near, ["f", "t0", "t1"], "left").groupBy("f").agg(F.count("*").alias("truths"), F.count("hit").alias("found"))


@query(f"""WITH {FLOOR}, p AS (SELECT f, t, 10 ** (s_db / 10) AS p FROM grid), noise AS (SELECT median(m) AS density FROM (SELECT f, avg(p) AS m FROM p GROUP BY f)), box AS (SELECT f, count(*) AS n, sum(p) AS total FROM p JOIN active USING (f, t) GROUP BY f)
SELECT f, n, round(CASE WHEN total - density * n > 0 THEN 10 * log10((total - density * n) / (density * n)) END, 4) + 0.0 AS snr_db, total - density * n <= 0 AS below_floor FROM box, noise""")
def snr_budget(spark, d):
    grid = _grid(spark, d)
    p = grid.withColumn("p", F.pow(F.lit(10.0), F.col("s_db") / 10))
    noise = p.groupBy("f").agg(F.avg("p").alias("m")).agg(F.median("m").alias("density"))
    box = p.join(grids.active(grid, MARGIN_DB).select("f", "t"), ["f", "t"]).groupBy("f").agg(F.count("*").alias("n"), F.sum("p").alias("total")).crossJoin(F.broadcast(noise))  # one row
    left = F.col("total") - F.col("density") * F.col("n")
    return rounded(box.select("f", "n", F.when(left > 0, 10 * F.log10(left / (F.col("density") * F.col("n")))).alias("snr_db"), (left <= 0).alias("below_floor")), 4)


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS area FROM lineitem ORDER BY l_quantity * l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 200")
def topk_area(spark, d):
    own = _table(spark, d, "lineitem").withColumn("area", F.col("l_quantity") * F.col("l_extendedprice"))
    return rounded(own.orderBy(F.desc("area"), "l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber", "area"), 4)


@query("""SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT l_shipmode_, '|' ORDER BY l_shipmode_) AS labels, arg_max(l_shipmode_, (l_extendedprice, -l_linenumber)) AS strongest, max(l_extendedprice) AS max_snr_db
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY l_orderkey""")
def batch_rollup(spark, d):
    own = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("capture_id"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("o")).alias("snr_db"))
    return reports.batch_rows(own).select(F.col("capture_id").alias("l_orderkey"), "n", "labels", "strongest", F.col("max_snr_db.l_extendedprice").alias("max_snr_db"))


def _predictions(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "n_chars")
    own = _table(spark, d, "labels").where("quality is not null").join(docs, "doc_id")
    return own.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("truth"), F.when(F.col("n_chars") % 7 == 0, "poor").when(F.col("n_chars") % 11 == 0, "odd").otherwise("good").alias("predicted"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"), ((F.col("n_chars") % 25) - 2).cast("double").alias("snr_db"))


PRED = "pred AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS truth, CASE WHEN n_chars % 7 = 0 THEN 'poor' WHEN n_chars % 11 = 0 THEN 'odd' ELSE 'good' END AS predicted, (n_chars % 100) / 100.0::DOUBLE AS confidence, ((n_chars % 25) - 2)::DOUBLE AS snr_db FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"WITH {PRED} SELECT CASE WHEN snr_db < 5 THEN 'low' WHEN snr_db < 15 THEN 'mid' ELSE 'high' END AS band, round(avg((truth = predicted)::INT), 6) AS accuracy, count(*) AS n FROM pred GROUP BY ALL")
def snr_band_accuracy(spark, d):
    return rounded(scoring.accuracy(_predictions(spark, d).withColumn("band", snr_band(F.col("snr_db"))), "band"))


@query(f"""WITH {PRED}, l AS (SELECT truth AS label FROM pred UNION SELECT predicted FROM pred), c AS (SELECT t.label AS truth, p.label AS predicted, (SELECT count(*) FROM pred x WHERE x.truth = t.label AND x.predicted = p.label) AS n FROM l t, l p)
SELECT truth, predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN n / sum(n) OVER (PARTITION BY truth) ELSE 0 END, 6)::DOUBLE AS share FROM c""")
def confusion(spark, d):
    return rounded(scoring.confusion(_predictions(spark, d)))


@query(f"""WITH {PRED}, l AS (SELECT truth AS label FROM pred UNION SELECT predicted FROM pred), c AS (SELECT label, (SELECT count(*) FROM pred WHERE truth = label) AS support, (SELECT count(*) FROM pred WHERE predicted = label) AS named, (SELECT count(*) FROM pred WHERE predicted = label AND truth = label) AS hit FROM l)
SELECT label, round(CASE WHEN named > 0 THEN hit / named ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 6)::DOUBLE AS recall, support FROM c""")
def precision_recall(spark, d):
    return rounded(scoring.precision_recall(_predictions(spark, d)))


@query(f"""WITH {PRED}, c AS (SELECT CAST(least(floor(confidence * 5), 4) AS BIGINT) AS bin, count(*) AS n, avg((truth = predicted)::INT) AS accuracy FROM pred GROUP BY ALL)
SELECT u.b AS bin, coalesce(n, 0) AS n, round(coalesce(accuracy, 0), 6)::DOUBLE AS accuracy FROM unnest(range(0, 5)) AS u(b) LEFT JOIN c ON c.bin = u.b""")
def calibration(spark, d):
    return rounded(scoring.calibration(_predictions(spark, d)))


@query("""WITH t AS (SELECT source AS measure, CAST(n_chars % 5 AS BIGINT) * 5 AS level_db, min((n_chars % 13 > 0)::INT) AS ok FROM documents WHERE source IS NOT NULL GROUP BY ALL), r AS (SELECT *, min(ok) OVER (PARTITION BY measure ORDER BY level_db DESC ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT measure, min(level_db) FILTER (run = 1) AS break_db FROM r GROUP BY measure""")
def break_point(spark, d):
    own = _table(spark, d, "documents").where("source is not null")
    return scoring.break_point(own.select(F.col("source").alias("measure"), ((F.col("n_chars") % 5) * 5).alias("level_db"), (F.col("n_chars") % 13 > 0).alias("passed")))


VOTES = """f AS (SELECT user_id AS id, event_type AS label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS pf FROM events WHERE user_id IS NOT NULL GROUP BY user_id, event_type),
w AS (SELECT user_id AS id, event_type AS label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS pw FROM events WHERE user_id IS NOT NULL AND event_id % 3 = 0 GROUP BY user_id, event_type)"""


@query(f"""WITH {VOTES}, b AS (SELECT id, label, coalesce(pf, 0) AS pf, coalesce(pw, 0) AS pw, CASE WHEN id % 20 < 5 THEN 0.35 WHEN id % 20 < 15 THEN 0.5 ELSE 0.65 END AS wf FROM f FULL JOIN w USING (id, label)),
p AS (SELECT *, (wf * pf + (1 - wf) * pw) / sum(wf * pf + (1 - wf) * pw) OVER (PARTITION BY id) AS p, first_value(label) OVER (PARTITION BY id ORDER BY pf DESC, label) = first_value(label) OVER (PARTITION BY id ORDER BY pw DESC, label) AS agree FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, label) AS rank FROM p),
t AS (SELECT id, max(label) FILTER (rank = 1) AS top, max(p) FILTER (rank = 1) AS p, max(label) FILTER (rank = 2) AS second, bool_and(agree) AS agree FROM r GROUP BY id),
s AS (SELECT *, CASE WHEN agree THEN p ELSE least(p, 0.6) END AS sure FROM t)
SELECT id, CASE WHEN sure < 0.45 THEN 'unknown' ELSE top END AS label, round(sure, 6)::DOUBLE AS confidence, CASE WHEN sure < 0.45 THEN top ELSE second END AS runner_up, agree FROM s""")
def referee_blend(spark, d):
    own = _table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), "event_id")
    share = lambda df: df.groupBy("id", "label").count().select("id", "label", (F.col("count") / F.sum("count").over(Window.partitionBy("id"))).alias("p"))
    snr = own.select("id").distinct().withColumn("snr_db", (F.col("id") % 20).cast("double"))
    return rounded(scoring.blend(share(own), share(own.where("event_id % 3 = 0")), snr))


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS snr FROM orders WHERE o_totalprice IS NOT NULL), x AS (SELECT id, (snr % 31)::DOUBLE AS snr, (id % 100) / 100.0::DOUBLE AS flat, (id % 13)::DOUBLE AS cp, (id % 10) / 10.0::DOUBLE AS r2, (id % 7)::DOUBLE AS dd, (id % 25)::DOUBLE AS asym, (id % 3) / 10.0::DOUBLE AS depth FROM o)
SELECT id, CASE WHEN snr < 3 AND flat > 0.9 THEN 'noise' WHEN cp >= 8 AND flat >= 0.5 THEN 'ofdm' WHEN r2 > 0.9 THEN 'chirp' WHEN dd BETWEEN 2.0 AND 4.5 THEN 'morse' WHEN abs(asym) > 10 AND depth > 0.1 THEN 'ssb' END AS label,
list_filter([CASE WHEN snr < 5 THEN 'low signal' END, CASE WHEN cp >= 8 THEN 'cyclic prefix' END, CASE WHEN abs(asym) > 10 THEN 'one sideband' END, CASE WHEN flat > 0.9 THEN 'flat spectrum' END], lambda x: x IS NOT NULL)[1:3] AS evidence FROM x""")
def rules_evidence(spark, d):
    x = _table(spark, d, "orders").where("o_totalprice is not null").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 31).alias("snr"))
    part = lambda n, by: (F.col("id") % n) / F.lit(float(by))
    flat, cp, asym = part(100, 100), part(13, 1), part(25, 1)
    label = scoring.rule_label(F.col("snr"), flat, cp, part(10, 10), part(7, 1), asym, part(3, 10))
    said = scoring.evidence(F.when(F.col("snr") < 5, "low signal"), F.when(cp >= 8, "cyclic prefix"), F.when(F.abs(asym) > 10, "one sideband"), F.when(flat > 0.9, "flat spectrum"), most=3)
    return x.select("id", label.alias("label"), said.alias("evidence"))


@query("""WITH r AS (SELECT user_id AS id, event_type AS method, avg(value) AS rate, (count(*) % 90) / 100.0::DOUBLE AS confidence FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL
), g AS (SELECT a.id, a.method, a.rate, a.confidence, count(*) AS n, sum(b.rate * greatest(b.confidence, 1e-3)) / sum(greatest(b.confidence, 1e-3)) AS mean, avg(b.confidence) AS sure FROM r a JOIN r b ON a.id = b.id AND abs(a.rate - b.rate) <= 0.05 * least(a.rate, b.rate) GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, method) AS k, count(*) OVER (PARTITION BY id) AS methods FROM g)
SELECT id, round(CASE WHEN n > 1 THEN mean ELSE rate END, 4) + 0.0 AS rate, round(CASE WHEN n > 1 THEN least(0.97, greatest(0.85, sure)) WHEN methods = 1 THEN least(confidence, 0.6) ELSE least(confidence, 0.4) END, 4)::DOUBLE AS confidence, n AS agreeing FROM k WHERE k = 1""")
def rate_reconcile(spark, d):
    own = _table(spark, d, "events").where("user_id is not null and value is not null").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("method")).agg(F.avg("value").alias("rate"), (F.count("*") % 90 / 100.0).alias("confidence"))
    return rounded(scoring.reconcile(own), 4)


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS median FROM lineitem GROUP BY l_suppkey), x AS (SELECT l_suppkey, l_extendedprice, median FROM lineitem JOIN m USING (l_suppkey)), s AS (SELECT l_suppkey, median(abs(l_extendedprice - median)) * 1.4826 AS mad FROM x GROUP BY l_suppkey)
SELECT l_suppkey, round(max(median), 4) AS median, round(max(mad), 4) AS mad, count(*) AS n, count(*) FILTER (abs(l_extendedprice - median) > 2.5 * mad) AS n_out FROM x JOIN s USING (l_suppkey) GROUP BY l_suppkey""")
def mad_outliers(spark, d):
    return rounded(scoring.robust_outliers(_table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice"), 4)


@query("""WITH n AS (SELECT o_orderkey, 'rec_' || strftime(o_orderdate, '%Y%m%d') || '_120000Z_fc' || (o_custkey % 900 + 1) || 'MHz_' || (o_orderkey % 50 + 1) || 'ksps.cs16' AS name FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL)
SELECT o_orderkey, (regexp_extract(name, '_(\\d+)ksps', 1)::DOUBLE) * 1000 AS sample_rate, (regexp_extract(name, 'fc(\\d+)MHz', 1)::DOUBLE) * 1000000 AS center_freq, substr(name, 5, 4) || '-' || substr(name, 9, 2) || '-' || substr(name, 11, 2) || 'T12:00:00Z' AS start_time FROM n""".replace("\\\\", "\\"))
def filename_parse(spark, d):
    own = _table(spark, d, "orders").where("o_orderdate is not null and o_custkey is not null")
    name = F.concat(F.lit("rec_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_120000Z_fc"), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit("MHz_"), (F.col("o_orderkey") % 50 + 1).cast("string"), F.lit("ksps.cs16"))
    return own.select("o_orderkey", name.alias("name")).select("o_orderkey", recordings.name_hints(F.col("name")).alias("h")).select("o_orderkey", "h.sample_rate", "h.center_freq", "h.start_time")


@query("""WITH l AS (SELECT DISTINCT 'x' || (page_id // 2) || CASE WHEN page_id % 2 = 0 THEN '.sigmf-meta' WHEN page_id % 3 = 0 THEN '.sigmf-data' ELSE '.png' END AS path FROM pages)
SELECT path FROM l WHERE path NOT LIKE '%.png' AND NOT EXISTS (SELECT 1 FROM l o WHERE o.path LIKE '%.sigmf-data' AND replace(o.path, '-data', '-meta') = l.path)""")
def catalogue_pairing(spark, d):
    end = F.when(F.col("page_id") % 2 == 0, ".sigmf-meta").when(F.col("page_id") % 3 == 0, ".sigmf-data").otherwise(".png")
    own = _table(spark, d, "pages").select(F.concat(F.lit("x"), F.floor(F.col("page_id") / 2).cast("string"), end).alias("path")).distinct()
    return recordings.catalogue(own).select("path")


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def sha_identity(spark, d):
    return recordings.identity(_table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))


@query("""WITH m AS (SELECT o_custkey AS id, o_orderkey % 17 + 1 + CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 0 END AS length FROM orders), e AS (SELECT *, sqrt((min(length) OVER (PARTITION BY id) * max(length) OVER (PARTITION BY id))::DOUBLE) AS edge FROM m),
k AS (SELECT id, count(*) AS marks, median(length) FILTER (length <= edge) AS dot, median(length) FILTER (length > edge) AS dash FROM e GROUP BY id)
SELECT id, marks, CASE WHEN marks >= 6 THEN dot END AS dot, round(CASE WHEN marks >= 6 THEN dash / dot END, 6) AS ratio, CASE WHEN marks >= 6 THEN coalesce(dash / dot BETWEEN 2.0 AND 4.5, false) END AS morse FROM k""")
def keying(spark, d):
    own = _table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 17 + 1 + F.when(F.col("o_orderkey") % 2 == 0, 40).otherwise(0)).alias("length"))
    return rounded(scoring.keying(own))


@query("""SELECT p_partkey, CASE WHEN p_retailprice * p_size * 1e4 >= 1e9 THEN printf('%.3f GHz', p_retailprice * p_size * 1e4 / 1e9) WHEN p_retailprice * p_size * 1e4 >= 1e6 THEN printf('%.3f MHz', p_retailprice * p_size * 1e4 / 1e6) WHEN p_retailprice * p_size * 1e4 >= 1e3 THEN printf('%.3f kHz', p_retailprice * p_size * 1e4 / 1e3) ELSE printf('%.3f Hz', p_retailprice * p_size * 1e4) END AS shown FROM part WHERE p_retailprice * p_size IS NOT NULL""")
def format_frequency(spark, d):
    own = _table(spark, d, "part").where("p_retailprice * p_size is not null")
    return own.select("p_partkey", format_hz(F.col("p_retailprice") * F.col("p_size") * F.lit(1e4)).alias("shown"))


@query("""SELECT event_type AS key, 'events only' AS side FROM (SELECT DISTINCT event_type FROM events EXCEPT SELECT DISTINCT l_returnflag FROM lineitem) UNION ALL SELECT l_returnflag, 'lineitem only' FROM (SELECT DISTINCT l_returnflag FROM lineitem EXCEPT SELECT DISTINCT event_type FROM events)""")
def schema_diff(spark, d):
    a, b = _table(spark, d, "events").select(F.col("event_type").alias("key")).distinct(), _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key")).distinct()
    return a.subtract(b).withColumn("side", F.lit("events only")).union(b.subtract(a).withColumn("side", F.lit("lineitem only")))


@query("SELECT doc_id, CASE WHEN m < 70 THEN 'train' WHEN m < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('26147:' || doc_id::VARCHAR), 1, 8) AS BIGINT) % 100 AS m FROM documents WHERE doc_id IS NOT NULL)")
def split_70_15_15(spark, d):
    m = F.conv(F.substring(F.md5(F.concat(F.lit("26147:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 100
    return _table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.when(m < 70, "train").when(m < 85, "validation").otherwise("test").alias("split"))


@query()
def report_json(spark, d):
    own = grids.islands(grids.active(_grid(spark, d), MARGIN_DB)).withColumnRenamed("f", "capture_id")
    return reports.report_rows(own.withColumn("f_lo", F.lit(0.0)).withColumn("confidence", scoring.snr_confidence(F.col("peak_db"))))


@query("SELECT f AS capture_id, CAST(t0 * 10 AS BIGINT) AS sample_start, CAST(greatest(1, (t1 - t0) * 10) AS BIGINT) AS sample_count FROM (WITH " + ISLANDS + " SELECT * FROM islands)")
def annotations(spark, d):
    own = grids.islands(grids.active(_grid(spark, d), MARGIN_DB)).select(F.col("f").alias("capture_id"), "t0", "t1", F.lit(0.0).alias("f_lo"), F.lit(1.0).alias("f_hi"))
    return reports.annotations(own, 10.0).select("capture_id", "sample_start", "sample_count")


@query("""WITH e AS (SELECT user_id, ts, value, epoch(ts) AS sec FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), l AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) < 1800 THEN 0 ELSE 1 END AS new FROM e
), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec) AS run FROM l)
SELECT user_id, CAST(floor(min(sec)) AS BIGINT) AS t0, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM r GROUP BY user_id, run""")
def session_windows(spark, d):
    from waveloom.streaming.events import session_totals

    return rounded(session_totals(_table(spark, d, "events").where("ts is not null and user_id is not null")), 4)


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE ts IS NOT NULL) SELECT event_type, CAST(w AS BIGINT) * 1800 AS t0, count(*) AS n FROM e, unnest(range(CAST(floor((sec - 7200) / 1800) AS BIGINT) + 1, CAST(floor(sec / 1800) AS BIGINT) + 1)) AS u(w) GROUP BY ALL""")
def hop_windows(spark, d):
    from waveloom.streaming.events import hop_totals

    return hop_totals(_table(spark, d, "events").where("ts is not null"))


@query("""WITH e AS (SELECT user_id, value, epoch(ts) AS sec FROM events WHERE ts IS NOT NULL), l AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) < 1800 THEN 0 ELSE 1 END AS new FROM e
), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec) AS run FROM l)
SELECT user_id, CAST(floor(min(sec)) AS BIGINT) AS t0, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM r GROUP BY user_id, run HAVING max(sec) + 1800 <= (SELECT max(sec) FROM e) - 3600""")
def stream_sessions(spark, d):
    """The session query as a stream over the files of events, run to what is there; sessions that the watermark has not passed stay open."""
    import uuid

    from waveloom.streaming.events import drained, session_totals, stream

    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    own = _table(spark, d, "events")
    single = own.inputFiles()[0].endswith("/events.parquet")  # one file, or a folder of part files
    result = session_totals(stream(spark, d if single else f"{d}/events.parquet", own.schema, "events.parquet" if single else "*.parquet"))
    drained(result, out, out + "-state")
    return rounded(spark.read.schema(result.schema).parquet(out), 4)


def _captures(spark, d):
    """Blocks of 256 orders as captures of at most a few thousand samples: price and quantity, at unit power."""
    order = Window.partitionBy("capture_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = _table(spark, d, "lineitem").withColumn("capture_id", F.floor(F.col("l_orderkey") / 256))
    own = own.select("capture_id", (F.row_number().over(order) - 1).cast("long").alias("n"), (F.col("l_extendedprice").cast("double") / 1000).alias("i"), F.col("l_quantity").cast("double").alias("q"))
    return estimators.blocks(samples.condition(own))


CAPTURES = """cap AS (SELECT l_orderkey // 256 AS capture_id, row_number() OVER (PARTITION BY l_orderkey // 256 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, l_extendedprice::DOUBLE / 1000 AS i, l_quantity::DOUBLE AS q FROM lineitem
), c AS (SELECT capture_id, n, i - avg(i) OVER w AS i, q - avg(q) OVER w AS q, count(*) OVER w AS total FROM cap WINDOW w AS (PARTITION BY capture_id)
), s AS (SELECT *, sqrt(avg(i * i + q * q) OVER (PARTITION BY capture_id)) AS scale FROM c)"""
WELCH = CAPTURES + """, fr AS (SELECT capture_id, t, n - 16 * t AS m, i / scale * (0.5 - 0.5 * cos(2 * pi() * (n - 16 * t) / 32)) AS i, q / scale * (0.5 - 0.5 * cos(2 * pi() * (n - 16 * t) / 32)) AS q FROM s, unnest(range(greatest(0, n // 16 - 1), n // 16 + 1)) AS u(t) WHERE 16 * t + 32 <= total
), th AS (SELECT *, 2 * pi() / 32 * ((f * m) % 32) AS th FROM fr, unnest(range(-16, 16)) AS v(f)
), frames AS (SELECT capture_id, t, f, (sum(i * cos(th) + q * sin(th)) ** 2 + sum(q * cos(th) - i * sin(th)) ** 2) / 12 AS p FROM th GROUP BY ALL
), psd AS (SELECT capture_id, f, avg(p) AS p FROM frames GROUP BY ALL)"""


@query(f"WITH {WELCH} SELECT capture_id, f, round(p, 6) + 0.0 AS p FROM psd")
def welch_density(spark, d):
    return rounded(estimators.welch(_captures(spark, d), SIZE))


@query(f"""WITH {WELCH}, h AS (SELECT *, 10 * log10(greatest(p, 1e-30)) AS d FROM psd), n AS (SELECT *, lag(d) OVER w AS a, lead(d) OVER w AS b FROM h WINDOW w AS (PARTITION BY capture_id ORDER BY f)
), o AS (SELECT *, coalesce(CASE WHEN a - 2 * d + b <> 0 THEN least(greatest(0.5 * (a - b) / (a - 2 * d + b), -1), 1) END, 0) AS step FROM n)
SELECT capture_id, round(sum(p * f) / sum(p) / 32, 6) + 0.0 AS centroid, round(arg_max(f + step, p) / 32, 6) + 0.0 AS peak FROM o GROUP BY capture_id""")
def center_frequency(spark, d):
    return rounded(estimators.center_frequency(estimators.welch(_captures(spark, d), SIZE), SIZE).select("capture_id", "centroid", "peak"))


@query(f"""WITH RECURSIVE {WELCH}, h AS MATERIALIZED (SELECT capture_id, f, 10 * log10(greatest(p, 1e-30)) AS d FROM psd
), walk AS (SELECT capture_id, -17 AS f, false AS up, d AS edge, 0 AS n FROM h WHERE f = -16
UNION ALL SELECT h.capture_id, h.f, CASE WHEN up THEN greatest(edge, d) - d < 6 ELSE d - least(edge, d) >= 6 END, CASE WHEN up AND edge - d < 6 THEN greatest(edge, d) WHEN NOT up AND d - edge < 6 THEN least(edge, d) ELSE d END, n + (up AND edge - d >= 6)::INT FROM walk JOIN h ON h.capture_id = walk.capture_id AND h.f = walk.f + 1)
SELECT capture_id, n::BIGINT AS humps, CASE n WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM walk WHERE f = 15""")
def density_humps(spark, d):
    return estimators.center_frequency(estimators.welch(_captures(spark, d), SIZE), SIZE).select("capture_id", "humps", "confidence")


@query(f"""WITH {WELCH}, b AS (SELECT capture_id, quantile_cont(p, 0.1) AS base FROM psd GROUP BY capture_id), x AS (SELECT capture_id, f, greatest(p - base, 0) AS s FROM psd JOIN b USING (capture_id)
), y AS (SELECT *, sum(s) OVER (PARTITION BY capture_id ORDER BY f) / sum(s) OVER (PARTITION BY capture_id) AS cum, max(s) OVER (PARTITION BY capture_id) AS top FROM x
), w AS (SELECT capture_id, (min(f) FILTER (cum >= 0.995) - min(f) FILTER (cum >= 0.005) + 1) / 32 AS obw, greatest(max(f) FILTER (s >= top * 10 ** -0.3) - min(f) FILTER (s >= top * 10 ** -0.3) + 1, 2) / 32 AS width_3db,
greatest(max(f) FILTER (s >= top * 10 ** -2.0) - min(f) FILTER (s >= top * 10 ** -2.0) + 1, 2) / 32 AS width_20db FROM y GROUP BY capture_id)
SELECT capture_id, round(obw, 6) AS obw, round(width_3db, 6) AS width_3db, round(width_20db, 6) AS width_20db, CASE WHEN obw > 0.9 THEN 0.35 WHEN obw > 0.75 THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence FROM w""")
def occupied_widths(spark, d):
    return rounded(estimators.bandwidths(estimators.welch(_captures(spark, d), SIZE), SIZE))


@query(f"""WITH {WELCH}, r AS (SELECT capture_id, t, arg_max(f, p)::DOUBLE AS y, 10 * log10(max(p)) - median(10 * log10(greatest(p, 1e-30))) AS rise FROM frames GROUP BY ALL)
SELECT capture_id, count(*) AS columns, round(regr_r2(y, t), 6) + 0.0 AS r2 FROM r WHERE rise > 6 GROUP BY capture_id""")
def ridge_sweep(spark, d):
    return rounded(estimators.sweep(estimators.frame_power(_captures(spark, d), SIZE, SIZE // 2), SIZE, SIZE // 2).select("capture_id", "columns", "r2"))


@query()
def symbol_rate(spark, d):
    """Three methods, their harmonics resolved, and what they agree on."""
    own = _captures(spark, d)
    series = estimators.with_series(own)
    part = lambda df, name: df.select(F.col("capture_id").alias("id"), F.lit(name).alias("method"), "rate", "confidence")
    rates = part(estimators.line_rate(estimators.lines(series, "power")), "a").union(part(estimators.line_rate(estimators.lines(series, "jumps")), "b")).union(part(estimators.envelope_lag_rate(own), "c"))
    return rounded(scoring.reconcile(rates))


@query(f"""WITH {CAPTURES}, z AS (SELECT capture_id, n, i / scale AS i, q / scale AS q, total FROM s WHERE total >= 256
), r AS (SELECT a.capture_id, a.n - b.n AS lag, a.total, sum(a.i * b.i + a.q * b.q) AS re, sum(a.q * b.i - a.i * b.q) AS im FROM z a JOIN z b ON a.capture_id = b.capture_id AND a.n - b.n BETWEEN 0 AND a.total // 4 + 1 GROUP BY ALL
), v AS (SELECT capture_id, lag, total, sqrt(re * re + im * im) / max(re) FILTER (lag = 0) OVER (PARTITION BY capture_id) AS v FROM r
), x AS (SELECT *, lead(v) OVER (PARTITION BY capture_id ORDER BY lag) AS next FROM v
), b AS (SELECT capture_id, greatest(8, coalesce(min(lag) FILTER (lag >= 1 AND next > v), total) + 1) AS first, least(4096, total // 4) AS last FROM x GROUP BY capture_id, total
), t AS (SELECT capture_id, max(v) AS top, arg_max(lag, (v, -lag)) AS lag, max(v) / median(v) AS ratio FROM x JOIN b USING (capture_id) WHERE first < last AND lag BETWEEN first AND last GROUP BY capture_id
), o AS (SELECT *, ratio >= 8 AND top BETWEEN 0.03 AND 0.35 AS ok FROM t)
SELECT capture_id, CASE WHEN ok THEN lag END AS useful_length, round(CASE WHEN ok THEN top * lag / (1 - top) END, 6) AS cp_length, round(ratio, 6) AS ratio, round(CASE WHEN ok THEN greatest(0.5, least(0.95, 0.5 + 0.012 * (ratio - 8))) ELSE 0 END, 6)::DOUBLE AS confidence FROM o""")
def cyclic_prefix(spark, d):
    return rounded(estimators.cyclic_prefix(_captures(spark, d)))


@query(f"""WITH {CAPTURES}, z AS (SELECT capture_id, i / scale AS i, q / scale AS q, lag(i / scale) OVER w AS pi, lag(q / scale) OVER w AS pq FROM s WINDOW w AS (PARTITION BY capture_id ORDER BY n)
), x AS (SELECT capture_id, atan2(q * pi - i * pq, i * pi + q * pq) / (2 * pi()) AS x FROM z WHERE pi IS NOT NULL
), e AS (SELECT capture_id, min(x) AS lo, (max(x) - min(x)) / 200 AS width FROM x GROUP BY capture_id HAVING max(x) > min(x)
), h AS (SELECT capture_id, CAST(least(floor((x - lo) / width), 199) AS BIGINT) AS k, count(*) AS c FROM x JOIN e USING (capture_id) GROUP BY ALL
), g AS (SELECT e.capture_id, width, u.k, coalesce(sum(c), 0) AS s FROM e CROSS JOIN unnest(range(-1, 201)) AS u(k) LEFT JOIN h ON h.capture_id = e.capture_id AND h.k BETWEEN u.k - 2 AND u.k + 2 GROUP BY ALL
), n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b, max(s) OVER (PARTITION BY capture_id) AS top FROM g WINDOW w AS (PARTITION BY capture_id ORDER BY k)
), p AS (SELECT capture_id, (k - lag(k) OVER (PARTITION BY capture_id ORDER BY k)) * width AS gap FROM n WHERE k BETWEEN 0 AND 199 AND s >= 0.15 * top AND s > a AND s >= b
), t AS (SELECT capture_id, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS spread FROM p GROUP BY capture_id HAVING count(*) BETWEEN 2 AND 8)
SELECT e.capture_id, n AS n_tones, round(mean * (n - 1) / 2, 6) AS deviation, round(mean, 6) AS spacing, round(CASE WHEN n IS NULL THEN 0 ELSE greatest(0.2, least(0.9, 0.9 - 2 * spread / mean)) END, 6)::DOUBLE AS confidence FROM e LEFT JOIN t ON t.capture_id = e.capture_id""")
def tone_spacing(spark, d):
    return rounded(estimators.tones(_captures(spark, d)))


@query(f"""WITH {CAPTURES}, z AS (SELECT capture_id, n, i / scale AS i, q / scale AS q, total FROM s
), m AS (SELECT DISTINCT capture_id, greatest(1, least(101, CASE WHEN total > 2 THEN total - 1 - total % 2 ELSE 1 END)) AS m FROM s
), low AS (SELECT capture_id, 'low_passed' AS name, k, CASE WHEN k = 0 THEN 1 ELSE sin(0.2 * pi() * k) / (0.2 * pi() * k) END * (0.54 + 0.46 * cos(2 * pi() * k / greatest(m - 1, 1))) AS h FROM m, unnest(range(-50, 51)) AS u(k) WHERE abs(k) <= m // 2
), root AS (SELECT k, CASE WHEN k = 0 THEN 0.65 + 1.4 / pi() ELSE (sin(pi() * k / 4 * 0.65) + 0.35 * k * cos(pi() * k / 4 * 1.35)) / (pi() * k / 4 * (1 - (0.35 * k) ** 2)) END AS h FROM unnest(range(-16, 17)) AS u(k)
), taps AS (SELECT capture_id, name, k, h / sum(h) OVER (PARTITION BY capture_id) AS h FROM low UNION ALL SELECT capture_id, 'matched', k, h / (SELECT sqrt(sum(h * h)) FROM root) FROM m, root
), y AS (SELECT z.capture_id, name, n + k AS n, sum(i * h) AS i, sum(q * h) AS q, any_value(total) AS total FROM z JOIN taps ON z.capture_id = taps.capture_id WHERE n + k BETWEEN 0 AND total - 1 GROUP BY ALL)
SELECT capture_id, round(avg(i * i + q * q) FILTER (name = 'low_passed'), 6) AS low_passed, round(avg(i * i + q * q) FILTER (name = 'matched'), 6) AS matched FROM y GROUP BY capture_id""")
def filtered_power(spark, d):
    """Mean power of the captures behind the low-pass and behind the matched filter."""
    own = _captures(spark, d)
    power = lambda df, name: df.select("capture_id", F.expr("aggregate(zip_with(i, q, (a, b) -> a * a + b * b), 0D, (s, x) -> s + x) / size(i)").alias(name))
    return rounded(power(estimators.low_passed(own, 0.1), "low_passed").join(power(estimators.matched(own, 4), "matched"), "capture_id"))


@query(f"""WITH {CAPTURES}, e AS (SELECT capture_id, n, sqrt(i * i + q * q) / scale AS a, total FROM s WHERE total >= 256
), k AS (SELECT capture_id, quantile_cont(a, 0.1) AS lo, quantile_cont(a, 0.9) AS hi FROM e GROUP BY capture_id
), o AS (SELECT capture_id AS id, n - row_number() OVER (PARTITION BY capture_id ORDER BY n) AS run FROM e JOIN k USING (capture_id) WHERE hi > 1.5 * lo AND a > (lo + hi) / 2
), m AS (SELECT id, run, count(*) AS length FROM o GROUP BY ALL), g AS (SELECT *, sqrt((min(length) OVER (PARTITION BY id) * max(length) OVER (PARTITION BY id))::DOUBLE) AS edge FROM m
), d AS (SELECT id, count(*) AS marks, median(length) FILTER (length <= edge) AS dot, median(length) FILTER (length > edge) AS dash FROM g GROUP BY id)
SELECT id, marks, CASE WHEN marks >= 6 THEN dot END AS dot, round(CASE WHEN marks >= 6 THEN dash / dot END, 6) AS ratio, CASE WHEN marks >= 6 THEN coalesce(dash / dot BETWEEN 2.0 AND 4.5, false) END AS morse FROM d""")
def keyed_captures(spark, d):
    """Marks of the captures, whose envelopes of under 2000 samples need no smoothing."""
    return rounded(scoring.keying(features.keyed_marks(_captures(spark, d))))


def _vectors(spark, d):
    return features.feature_vector(estimators.blocks(_iq(spark, d)))


@query()
def feature_vector(spark, d):
    return rounded(_vectors(spark, d), 4)


@query(f"""WITH {IQ}, u AS (SELECT capture_id, i / sqrt(avg(i * i + q * q) OVER w) AS i, q / sqrt(avg(i * i + q * q) OVER w) AS q FROM iq WINDOW w AS (PARTITION BY capture_id)
), p AS (SELECT *, i * i + q * q AS p, i * i - q * q AS r, 2 * i * q AS x FROM u
), m AS (SELECT capture_id, avg(p) AS m21, avg(r) AS r20, avg(x) AS x20, avg(r * r - x * x) AS r40, avg(2 * r * x) AS x40, avg(r * p) AS r41, avg(x * p) AS x41, avg(p * p) AS m42, avg(p * p * p) AS m63, stddev_pop(abs(sqrt(p))) / avg(sqrt(p)) AS spread, 10 * log10(max(p)) AS papr_db FROM p GROUP BY capture_id
), c AS (SELECT *, m42 - r20 * r20 - x20 * x20 - 2 * m21 * m21 AS c42 FROM m)
SELECT capture_id, round(sqrt(r20 * r20 + x20 * x20), 4) AS c20_abs, round(sqrt((r40 - 3 * (r20 * r20 - x20 * x20)) ** 2 + (x40 - 6 * r20 * x20) ** 2), 4) AS c40_abs, round(sqrt((r41 - 3 * r20 * m21) ** 2 + (x41 - 3 * x20 * m21) ** 2), 4) AS c41_abs,
round(abs(c42), 4) AS c42_abs, round(abs(m63 - 9 * c42 * m21 - 6 * m21 ** 3), 4) AS c63_abs, round(spread * spread, 4) AS amplitude_variance, round(papr_db, 4) + 0.0 AS papr_db FROM c""")
def sample_features(spark, d):
    own = features.sample_features(estimators.blocks(_iq(spark, d)))
    return rounded(own.select("capture_id", "c20_abs", "c40_abs", "c41_abs", "c42_abs", "c63_abs", "amplitude_variance", "papr_db"), 4)


@query()
def feature_classifier(spark, d):
    """Classes of the vectors by boosted trees, a few rounds of them, fitted on four fifths of the labels; the rest shows what that is worth."""
    truth = _table(spark, d, "embeddings").select(F.col("vec_id").alias("capture_id"), F.col("label").cast("string").alias("truth"))
    own = _vectors(spark, d).join(truth, "capture_id").withColumn("held_out", F.crc32(F.col("capture_id").cast("string").cast("binary")) % 5 == 0)
    model = features.fitted(own.withColumn("label", F.when(~F.col("held_out"), F.col("truth"))), rounds=2, depth=3)
    return rounded(features.classified(model, own).join(own.select("capture_id", "truth", "held_out"), "capture_id"))


@query()
def isolated_bursts(spark, d):
    """Two boxes of every capture, cut out, turned down, filtered and thinned."""
    own = _captures(spark, d)
    boxes = own.select("capture_id", F.explode(F.expr("array(named_struct('box_id', 1L, 'first', 0L, 'last', 512L, 'f_lo', 0.05D, 'f_hi', 0.15D), named_struct('box_id', 2L, 'first', 256L, 'last', 4096L, 'f_lo', -0.3D, 'f_hi', -0.25D))")).alias("b")).select("capture_id", "b.*")
    power = F.expr("aggregate(zip_with(i, q, (a, b) -> a * a + b * b), 0D, (s, x) -> s + x) / size(i)")
    return rounded(features.isolated(own, boxes).select("capture_id", "box_id", "every", F.size("i").alias("n"), power.alias("power")))


@query()
def audible_captures(spark, d):
    """Length and mean size of the captures' envelopes as sound."""
    sound = features.audible(_captures(spark, d), 24_000.0, kind="am")
    return rounded(sound.select("capture_id", F.size("audio").alias("n"), F.expr("aggregate(audio, 0D, (s, x) -> s + abs(x)) / size(audio)").alias("size")))


def flagship(spark, d):
    return islands(spark, d)


from waveloom.plans import checked, conditioned, measures, recorded  # noqa: E402, F401  (registers their queries)
