"""What must not grow with the rows: plans, batches."""

import resource

import numpy as np
from pyspark.sql import functions as F

from waveloom.operators import analysis, detection, estimators, features, grids


def test_the_plan_of_an_analysis_stays_small(spark):
    still = F.array_repeat(F.lit(0.0), 2000)
    noise = lambda k: F.transform(F.concat(still, F.array_repeat(F.lit(0.7), 4000), still), lambda v, n: v + (F.pmod(F.xxhash64("id", n, F.lit(k)), F.lit(2001)) - 1000) / 12_000.0)
    found = analysis.analysed(spark.range(1).select(F.col("id").alias("capture_id"), noise(1).alias("i"), noise(2).alias("q")), 256)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_memory_of_a_worker_does_not_grow_with_a_partitions_rows(spark):
    def each(x):
        return np.full(1 << 17, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)  # a megabyte

    own = spark.range(600).coalesce(1).select(F.col("id").alias("capture_id"), F.array(F.lit(1.0)).alias("x"))
    used = estimators._arrays(own, "capture_id long", ["x"], each).select("capture_id", F.get("v", F.lit(0)).alias("mb")).collect()
    assert len({r["capture_id"] for r in used}) == 600
    assert max(r["mb"] for r in used) - min(r["mb"] for r in used) < 200


def test_reports_are_read_once_for_their_check(spark):
    from waveloom.operators import reports

    own = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":2}]},"d":null}'), (2, "no")], "capture_id long, report string")
    assert sorted(r["place"] for r in reports.nodes(own).where("capture_id = 1").collect()) == ["report", "report.a", "report.a.b", "report.a.b[0]", "report.a.b[1]", "report.a.b[1].c", "report.d"]
    plan = reports.report_faults(own)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_small_files_share_tasks(spark, tmp_path):
    from waveloom.sources import byteranges

    for k in range(600):
        np.full(40, k, "<f4").tofile(tmp_path / f"a{k}.cf32")
    byteranges.register(spark)
    own = spark.read.format("captures").option("size", 15).option("partitionBytes", 100).load(str(tmp_path))
    assert own.rdd.getNumPartitions() <= 2 * byteranges.TASKS
    got = own.select("path", "block", F.get("i", F.lit(0)).alias("v")).collect()
    assert len(got) == 1200 and len({(r["path"], r["block"]) for r in got}) == 1200 and {r["v"] for r in got} == set(map(float, range(600)))


def _unfolded(spark):
    """262,144 cells of two captures, 32 MB in a broadcast, which Spark takes for a few bytes: a block of 41 bins by 201 frames in each stands out."""
    steps = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    cells = spark.range(2).select(F.col("id").alias("capture_id"), steps(0, 511).alias("t")).select("capture_id", "t", steps(-128, 127).alias("f"))
    block = F.col("f").between(20, 60) & F.col("t").between(100, 300)
    return cells.withColumn("s_db", F.when(block, 30.0).otherwise(0.0) + F.pmod(F.xxhash64("capture_id", "t", "f"), F.lit(1000)) / 1000.0)


def test_rows_unfolded_from_arrays_are_joined_by_shuffles(spark):
    cells, at = _unfolded(spark), F.col("id")
    boxes = spark.range(60).select((at % 2).alias("capture_id"), "id", (at * 4 - 128).alias("f0"), (at * 4 - 126).alias("f1"), (at * 8).alias("t0"), (at * 8 + 30).alias("t1"))
    captures = spark.range(2).select(at.alias("capture_id"), F.array_repeat(F.rand(1), 1000).alias("i"), F.array_repeat(F.rand(2), 1000).alias("q"))
    edge = boxes.select("capture_id", at.alias("box_id"), F.col("t0").alias("first"), F.col("t1").alias("last"), F.lit(-0.1).alias("f_lo"), F.lit(0.1).alias("f_hi"))
    for df in (detection.box_cells(boxes, cells), grids.merge_links(boxes), analysis.floors(cells), features.isolated(captures, edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_do_not_go_whole_through_the_driver(spark):
    cells, key = _unfolded(spark), "spark.sql.maxBroadcastTableSize"
    kept = spark.conf.get(key, None)
    spark.conf.set(key, "20m")  # what Spark rightly takes for small is 10 MB at most
    try:
        boxes = analysis.detected(cells, 256)
        found = [tuple(r) for r in boxes.selectExpr("capture_id", "f1 - f0 + 1", "t1 - t0 + 1").collect()]
        assert detection.box_snr(boxes, cells).where("snr_db > 20").count() == 2
    finally:
        spark.conf.unset(key) if kept is None else spark.conf.set(key, kept)
    assert sorted(found) == [(0, 41, 201), (1, 41, 201)]
