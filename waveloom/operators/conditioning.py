"""Conditioning of long captures: the mean, a DC block where a spike is left at frequency 0, and unit power.

The DC block is the recurrence y[n] = x[n] - x[n-1] + a y[n-1]. It runs over blocks of samples that
Spark deals out apart: each block gives its own response from rest and the share a ** length of
what it is handed, block after block those are chained into the state that enters each, and a
state adds a ** (k + 1) of itself to sample k of its block. No task meets all samples of a capture;
the chain meets a row for each block, in runs of `FAN` and then a row for each run.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.operators import estimators

POLE, RATIO, PROBE = 0.9995, 20.0, 1 << 16
#: Least power of the pole within a block, so that its inverse loses few digits, and most samples and blocks that are chained at once.
WITHIN, LONGEST, FAN = 1e-3, 4096, 4096


def block_length(pole: float) -> int:
    """Samples of a block, for which the pole's powers stay above WITHIN."""
    return LONGEST if pole >= 1 else max(1, min(LONGEST, int(math.log(WITHIN) / math.log(pole)))) if pole > 0 else 1


def _fold(parts: Column) -> Column:
    """(wi, wq, w) of an array of blocks in order: what they leave behind from rest, and their share of what they are handed."""
    rest = F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("q"), F.lit(1.0).alias("w"))
    return F.aggregate(parts, rest, lambda s, x: F.struct((x["i"] + x["w"] * s["i"]).alias("i"), (x["q"] + x["w"] * s["q"]).alias("q"), (s["w"] * x["w"]).alias("w")))


def _entering(parts: Column, i: Column, q: Column) -> Column:
    """The state that enters each of an array of blocks, handed (i, q) at first, with its number."""
    none = F.array().cast("array<struct<b:bigint,i:double,q:double>>")
    start = F.struct(i.alias("i"), q.alias("q"), none.alias("out"))

    def step(s, x):
        return F.struct((x["i"] + x["w"] * s["i"]).alias("i"), (x["q"] + x["w"] * s["q"]).alias("q"), F.concat(s["out"], F.array(F.struct(x["b"].alias("b"), s["i"].alias("i"), s["q"].alias("q")))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def chained(ends: DataFrame, fan: int = FAN) -> DataFrame:
    """(capture_id, b, si, sq): the state that enters each block, over (capture_id, b, i, q, w) of what blocks leave behind.

    Runs of `fan` blocks are folded to one row each, the runs of a capture chained, and each run's
    entering state handed to its blocks.
    """
    runs = ends.groupBy("capture_id", F.floor(F.col("b") / fan).cast("long").alias("run")).agg(F.sort_array(F.collect_list(F.struct("b", "i", "q", "w"))).alias("parts"))
    heads = runs.select("capture_id", "run", _fold(F.col("parts")).alias("x")).select("capture_id", F.struct(F.col("run").alias("b"), "x.i", "x.q", "x.w").alias("p"))
    heads = heads.groupBy("capture_id").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    heads = heads.select("capture_id", F.explode(_entering(F.col("parts"), F.lit(0.0), F.lit(0.0))).alias("h")).select("capture_id", F.col("h.b").alias("run"), F.col("h.i").alias("hi"), F.col("h.q").alias("hq"))
    out = runs.join(heads, ["capture_id", "run"]).select("capture_id", F.explode(_entering(F.col("parts"), F.col("hi"), F.col("hq"))).alias("s"))
    return out.select("capture_id", F.col("s.b").alias("b"), F.col("s.i").alias("si"), F.col("s.q").alias("sq"))


def dc_blocked(iq: DataFrame, pole: float = POLE, length: int | None = None, fan: int = FAN) -> DataFrame:
    """(capture_id, n, i, q) behind the DC block, from rest; n runs from 0 without gaps."""
    length = length or block_length(pole)
    own = iq.select("capture_id", "n", "i", "q", F.floor(F.col("n") / length).cast("long").alias("b"), (F.col("n") % length).alias("k"))
    # the sample before a block is the last one of the block before
    before = own.where(F.col("k") == length - 1).select("capture_id", (F.col("b") + 1).alias("b"), F.col("i").alias("bi"), F.col("q").alias("bq"))
    own = own.join(before, ["capture_id", "b"], "left")
    w = Window.partitionBy("capture_id", "b").orderBy("k")
    up = F.pow(F.lit(float(pole)), F.col("k").cast("double"))
    for c in "iq":
        own = own.withColumn(f"d{c}", F.col(c) - F.coalesce(F.lag(c).over(w), F.col(f"b{c}"), F.lit(0.0)))
    # from rest: the sum of the steps before, each with its power of the pole
    own = own.select("capture_id", "b", "k", "n", *[(up * F.sum(F.col(f"d{c}") / up).over(w)).alias(c) for c in "iq"])
    ends = own.groupBy("capture_id", "b").agg(F.max_by("i", "k").alias("i"), F.max_by("q", "k").alias("q"), F.pow(F.lit(float(pole)), (F.max("k") + 1).cast("double")).alias("w"))
    state = chained(ends, fan)
    more = F.pow(F.lit(float(pole)), (F.col("k") + 1).cast("double"))
    return own.join(state, ["capture_id", "b"]).select("capture_id", "n", (F.col("i") + more * F.col("si")).alias("i"), (F.col("q") + more * F.col("sq")).alias("q"))


def spiked(iq: DataFrame, probe: int = PROBE, ratio: float = RATIO) -> DataFrame:
    """(capture_id, notched): whether frequency 0 of the first `probe` samples stands `ratio` times over the median of their spectrum."""
    own = estimators._arrays(estimators.blocks(iq.where(F.col("n") < probe)), "capture_id long", ["i", "q"], lambda i, q: np.array([abs(i.sum() + 1j * q.sum()), np.median(np.abs(np.fft.fft(i + 1j * q)))]))
    return own.select("capture_id", (F.get("v", F.lit(0)) > ratio * (F.get("v", F.lit(1)) + 1e-12)).alias("notched"))


def conditioned(iq: DataFrame, pole: float = POLE, ratio: float = RATIO, probe: int = PROBE, length: int | None = None, fan: int = FAN) -> DataFrame:
    """(capture_id, n, i, q, scale, notched): samples without their mean, behind the DC block where a spike is left, at unit power.

    scale is the root of the mean power that was taken out; captures without power keep zeros.
    iq has n from 0 on without gaps; an empty table gives no rows.
    """
    means = iq.groupBy("capture_id").agg(F.avg("i").alias("mi"), F.avg("q").alias("mq"))
    own = iq.join(means, "capture_id").select("capture_id", "n", (F.col("i") - F.col("mi")).alias("i"), (F.col("q") - F.col("mq")).alias("q"))
    marked = own.join(spiked(own, probe, ratio), "capture_id")
    blocked = dc_blocked(marked.where("notched").drop("notched"), pole, length, fan).withColumn("notched", F.lit(True))
    own = marked.where("not notched").select("capture_id", "n", "i", "q", "notched").union(blocked.select("capture_id", "n", "i", "q", "notched"))
    power = own.groupBy("capture_id").agg(F.sqrt(F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q"))).alias("scale"))
    by = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    return own.join(power, "capture_id").select("capture_id", "n", (F.col("i") / by).alias("i"), (F.col("q") / by).alias("q"), "scale", "notched")
