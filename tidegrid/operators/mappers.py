"""One sample in, one sample out; and the dense fills."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, nan


def absolute(f: SeriesFrame) -> SeriesFrame:
    return f.with_values(F.abs("value"))


def scale(f: SeriesFrame, factor: float) -> SeriesFrame:
    return f.with_values(F.col("value") * F.lit(float(factor)))


def scale_to_seconds(f: SeriesFrame, seconds: float) -> SeriesFrame:
    """value * seconds over the step in seconds."""
    if seconds <= 0:
        raise ValueError("scaleToSeconds needs a positive number of seconds")
    if f.step is not None:
        return f.with_values(F.col("value") * F.lit(seconds / (f.step / 1000.0)))
    joined = f.points.join(f.meta.select("sid", "g_step"), "sid")
    return replace(f, points=joined.select("sid", "ts", (F.col("value") * seconds / (F.col("g_step") / 1000.0)).alias("value")))


def offset(f: SeriesFrame, c: float) -> SeriesFrame:
    return f.with_values(F.col("value") + F.lit(float(c)))


def divide_scalar(f: SeriesFrame, d: float) -> SeriesFrame:
    if d == 0 or d != d:
        raise ValueError("divideScalar: the divisor must not be 0 or NaN")
    return f.with_values(F.col("value") / F.lit(float(d)))


def round_values(f: SeriesFrame, precision: int = 0) -> SeriesFrame:
    """Half up, towards +infinity; a negative precision leaves values as they are; NaN becomes 0 and what is beyond a long saturates, as rounding yields a long."""
    if precision < 0:
        return f
    p = 10.0**precision
    top = 9223372036854775807.0
    x = F.floor(F.col("value") * p + 0.5)
    x = F.when(F.isnan("value"), 0.0).when(F.col("value") * p >= top, top).when(F.col("value") * p <= -top, -top).otherwise(x.cast("double"))
    return f.with_values(x / p)


def square_root(f: SeriesFrame) -> SeriesFrame:
    return f.with_values(F.sqrt("value"))


def logarithm(f: SeriesFrame) -> SeriesFrame:
    """Base 10; 0 gives -infinity, a negative value NaN."""
    return f.with_values(F.when(F.isnan("value") | (F.col("value") < 0), nan()).when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.log10("value")))


def timeshift(f: SeriesFrame, ms: int) -> SeriesFrame:
    """Samples and grid move forward by |ms|; the planner fetches that much earlier."""
    d = abs(ms)
    meta = f.meta.withColumns({"g_min": F.col("g_min") + d, "g_max": F.col("g_max") + d})
    return replace(f, points=f.points.select("sid", (F.col("ts") + d).alias("ts"), "value"), meta=meta)


def transform_null(f: SeriesFrame, fill: float = 0.0) -> SeriesFrame:
    """Every grid point, with fill where a sample is missing or NaN."""
    return f.with_points(f.dense().withColumn("value", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(float(fill)))))


def is_non_null(f: SeriesFrame) -> SeriesFrame:
    """1 where a sample is stored, NaN included, else 0, at every grid point."""
    return f.with_points(f.dense().withColumn("value", F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)))


def truncate(f: SeriesFrame, start: int, end: int) -> SeriesFrame:
    """Only samples in [start, end); the grid is cut to it and stays aligned."""
    points = f.points.where((F.col("ts") >= start) & (F.col("ts") < end))
    low = F.when(F.col("g_min") >= start, F.col("g_min")).otherwise(F.col("g_min") + F.ceil((F.lit(start) - F.col("g_min")) / F.col("g_step")) * F.col("g_step"))
    meta = f.alive().meta.withColumn("g_min", low.cast("long"))
    high = F.least(F.col("g_max"), F.col("g_min") + F.floor((F.lit(end - 1) - F.col("g_min")) / F.col("g_step")) * F.col("g_step"))
    return replace(f, points=points, meta=meta.withColumn("g_max", high.cast("long")).where("g_min <= g_max"), live=True)
