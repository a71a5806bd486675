"""Column expressions for complex samples, decibels and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db(power: Column) -> Column:
    """10 log10 of a power; NULL where it isn't positive."""
    return F.when(power > 0, 10 * F.log10(power))


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def times(ai: Column, aq: Column, bi: Column, bq: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a product."""
    return ai * bi - aq * bq, ai * bq + aq * bi


def logistic(x: Column, slope: float, midpoint: float) -> Column:
    return 1 / (1 + F.exp(-F.lit(slope) * (x - F.lit(midpoint))))


def refine(before: Column, peak: Column, after: Column) -> Column:
    """Offset of a parabola's vertex from its middle point, within one step; 0 where it is flat."""
    bend = before - 2 * peak + after
    return F.when(bend != 0, clip(0.5 * (before - after) / bend, -1.0, 1.0)).otherwise(F.lit(0.0))


def snr_band(snr: Column) -> Column:
    """low below 5 dB, mid below 15 dB, high above; mid where it is not known."""
    return F.when(snr.isNull() | F.isnan(snr), "mid").when(snr < 5, "low").when(snr < 15, "mid").otherwise("high")


def format_hz(hz: Column, digits: int = 3) -> Column:
    """A frequency with the unit that suits its size."""
    size = F.abs(hz)
    said = lambda by, unit: F.concat(F.format_string(f"%.{digits}f", hz / by), F.lit(f" {unit}"))
    return F.when(size >= 1e9, said(1e9, "GHz")).when(size >= 1e6, said(1e6, "MHz")).when(size >= 1e3, said(1e3, "kHz")).otherwise(said(1.0, "Hz"))


def cfar_threshold_db(false_alarm_rate: float, percentile: float) -> float:
    """Decibels over a percentile of exponential noise power that noise exceeds at the given rate."""
    import math

    if not 0 < false_alarm_rate < 1 or not 0 < percentile < 100:
        raise ValueError("the rate must lie in (0, 1) and the percentile in (0, 100)")
    return 10 * math.log10(math.log(false_alarm_rate) / math.log(1 - percentile / 100))
