"""Ties and edges of the blend and of the rates that agree."""

from pyspark.sql import functions as F

from waveloom.operators import scoring
from waveloom.plans.catalogue import rounded


def test_equal_shares_choose_by_name(spark):
    # votes of a and b whose weighed shares are equal as fractions, and whose last bits put b first
    found = [(x / 12, y / 12, u / 4, v / 4) for x in range(6) for y in range(6) for u in range(3) for v in range(3) if x + 3 * u == y + 3 * v and x != y]
    found += [(x / 30, y / 30, u / 10, v / 10) for x in range(15) for y in range(15) for u in range(5) for v in range(5) if x + 3 * u == y + 3 * v and x != y]
    found = [f for f in found if 0.5 * f[0] + 0.5 * f[2] < 0.5 * f[1] + 0.5 * f[3]]
    assert found
    votes = lambda i, j: spark.createDataFrame([(k, x, float(p)) for k, f in enumerate(found) for x, p in (("a", f[i]), ("b", f[j]), ("c", 0.001))], "id int, label string, p double")
    snr = spark.range(len(found)).select(F.col("id").cast("int").alias("id"), F.lit(10.0).alias("snr_db"))
    assert {(r["label"] if r["label"] != "unknown" else r["runner_up"]) for r in scoring.blend(votes(0, 1), votes(2, 3), snr).collect()} == {"a"}


def test_rates_at_the_very_tolerance_agree(spark):
    rows = [(k, "a", 0.2 * k, 0.5) for k in range(1, 400)] + [(k, "b", 0.21 * k, 0.4) for k in range(1, 400)]
    rows += [(1000, "a", 0.0, 0.5), (1001, "a", -1.0, 0.5), (1002, "a", None, 0.5), (1003, "a", 20.0, 0.5), (1003, "b", 21.0, None)]
    got = {r["id"]: r for r in scoring.reconcile(spark.createDataFrame(rows, "id int, method string, rate double, confidence double")).collect()}
    for k in range(1, 400):
        a, b = 0.2 * k, 0.21 * k
        assert got[k]["agreeing"] == (2 if abs(a - b) <= 0.05 * min(a, b) else 1), k
    assert got[1000]["rate"] == 0.0 and 1001 not in got and 1002 not in got
    assert got[1003]["agreeing"] == 2 and abs(got[1003]["rate"] - (20 * 0.5 + 21 * 0.001) / 0.501) < 1e-9


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    x = [k / 1e5 + 1e-5 / 2 for k in range(2000)] + [-51.06375, 1e306, -0.0, 0.1 + 0.2]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 5) + 0.0", [v]).fetchone()[0] for v in x]
    got = rounded(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double"), 5).orderBy("k").collect()
    assert [r["v"] for r in got] == want
