"""Windows and sequences along each series."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, by_series, clean

#: Windows of more points than this are combined from block prefixes and suffixes instead of being summed anew at each point.
SLIDING_POINTS = 16
#: Medians over windows of more points than this run in Python over blocks of so many points or a window, if that is longer; shorter ones sort each window.
MEDIAN_POINTS, MEDIAN_BLOCK = 32, 8192
MOVING = ("sum", "avg", "min", "max", "median")
#: Start of year 1 in ms since 1970, to which summarize aligns unless told otherwise.
YEAR_ONE = -62_135_596_800_000


def _by_step(f: SeriesFrame, run) -> SeriesFrame:
    """run over the series of each step, which gives a frame of them; a window of so many ms has another number of points for each."""
    if f.step is not None:
        return run(f)
    f = f.alive()
    points = [run(f.of_step(s)).points for s in sorted(f.steps)]
    return f.with_points(reduce(DataFrame.unionByName, points))


def moving(f: SeriesFrame, ms: int, how: str) -> SeriesFrame:
    """how over the ms before each grid point, itself excluded, in steps of the series' own grid; missing and NaN are skipped, an empty window gives no sample. median is the lower one."""
    if how not in MOVING:
        raise ValueError(f"moving: unknown function {how}")
    if f.step is None:
        return _by_step(f, lambda g: moving(g, ms, how))
    step = f.step
    if ms < step:
        raise ValueError("moving: the window is shorter than the step")
    n = ms // step
    if how == "median" and n > MEDIAN_POINTS:
        return f.with_points(_medians(f, n))
    dense = f.dense().withColumn("v", clean())
    if how == "median":
        held = F.array_sort(F.collect_list("v").over(by_series().rowsBetween(-n, -1)))
        out = dense.withColumn("held", held).withColumn("value", F.when(F.size("held") > 0, F.element_at("held", F.expr("cast((size(held) + 1) div 2 as int)"))))
    elif n <= SLIDING_POINTS:
        fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how]
        out = dense.withColumn("value", fn("v").over(by_series().rowsBetween(-n, -1)))
    else:
        out = _blocks(dense, n, how)
    return f.with_points(out.where("value is not null"))


def _medians(f: SeriesFrame, n: int) -> DataFrame:
    """sid, ts, value: the lower median of the n grid points before each one. Each series is cut into blocks of grid points, and a block also gets the n points before it; within one, the window is kept in order while it moves, so a point costs two binary searches, however long the window is."""
    step, size = f.step, max(n, MEDIAN_BLOCK)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        g_min, g_max, block = (int(batch[c].iloc[0]) for c in ("g_min", "g_max", "block"))
        order = np.argsort(batch["ts"].to_numpy())
        at = ((batch["ts"].to_numpy()[order] - g_min) // step).tolist()
        value = batch["value"].to_numpy(dtype=float)[order].tolist()
        first, last = block * size, min((block + 1) * size - 1, (g_max - g_min) // step)
        window: list[float] = []
        into = out = 0
        found, place = [], []
        for i in range(first, last + 1):
            while into < len(at) and at[into] < i:
                insort(window, value[into])
                into += 1
            while out < into and at[out] < i - n:
                del window[bisect_left(window, value[out])]
                out += 1
            if window:
                found.append(window[(len(window) - 1) // 2])
                place.append(g_min + i * step)
        return pd.DataFrame({"sid": batch["sid"].iloc[0], "ts": np.array(place, dtype=np.int64), "value": np.array(found, dtype=float)})

    p = f.points.where(~F.isnan("value")).join(f.alive().meta.select("sid", "g_min", "g_max"), "sid")
    i = F.floor((F.col("ts") - F.col("g_min")) / step)
    # a point lies in the windows of the n points after it: in its own block, unless it is the last, and in the next
    p = p.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((i + 1) / size), F.floor((i + n) / size)))))
    p = p.where(F.col("block") * size <= F.floor((F.col("g_max") - F.col("g_min")) / step))
    return p.groupBy("sid", "block").applyInPandas(run, "sid string, ts long, value double")


def _blocks(dense: DataFrame, n: int, how: str) -> DataFrame:
    """Each window of n points is a suffix of one block of n points and a prefix of the next: two running aggregates and two lags, whatever n is, and nothing is ever subtracted."""
    d = dense.withColumn("i", F.row_number().over(by_series()) - 1).withColumn("b", F.floor(F.col("i") / n))
    up = Window.partitionBy("sid", "b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("sid", "b").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    parts = {"sum": [("s", F.sum)], "avg": [("s", F.sum), ("c", F.count)], "min": [("m", F.min)], "max": [("m", F.max)]}[how]
    for name, fn in parts:
        d = d.withColumns({f"{name}_pre": fn("v").over(up), f"{name}_suf": fn("v").over(down)})
    split = F.pmod(F.col("i"), F.lit(n)) != 0

    def both(name: str, join) -> Column:
        # Rows before the first point count as none: the first block's prefix covers what there is.
        suffix = F.lag(f"{name}_suf", n).over(by_series())
        prefix = F.when(split, F.lag(f"{name}_pre", 1).over(by_series()))
        return F.when(suffix.isNull(), prefix).when(prefix.isNull(), suffix).otherwise(join(suffix, prefix))

    add = lambda a, b: a + b
    if how == "sum":
        return d.withColumn("value", both("s", add))
    if how == "avg":
        return d.withColumn("value", both("s", add) / F.nullif(both("c", add), F.lit(0)))
    return d.withColumn("value", both("m", F.least if how == "min" else F.greatest))


def keep_last_value(f: SeriesFrame, ms: int | None = None) -> SeriesFrame:
    """Each missing grid point takes the last stored value, NaN included, not older than ms."""
    w = by_series().rowsBetween(Window.unboundedPreceding, 0)
    d = f.dense()
    d = d.withColumns({"last": F.last("value", ignorenulls=True).over(w), "at": F.last(F.when(F.col("value").isNotNull(), F.col("ts")), ignorenulls=True).over(w)})
    fresh = F.lit(True) if ms is None else F.col("ts") - F.col("at") <= ms
    return f.with_points(d.withColumn("value", F.when(fresh, F.col("last"))).where("value is not null"))


def derivative(f: SeriesFrame) -> SeriesFrame:
    """Difference to the sample exactly one step before, where both are there and not NaN."""
    p = f.points if f.step is not None else f.points.join(f.meta.select("sid", "g_step"), "sid")
    step = F.lit(f.step) if f.step is not None else F.col("g_step")
    d = p.withColumns({"pv": F.lag("value").over(by_series()), "pt": F.lag("ts").over(by_series())})
    ok = (F.col("ts") - F.col("pt") == step) & ~F.isnan("value") & ~F.isnan("pv")
    return f.with_points(d.where(ok).withColumn("value", F.col("value") - F.col("pv")))


def per_second(f: SeriesFrame) -> SeriesFrame:
    """Growth per second since the stored sample before; falls give no sample."""
    d = f.points.withColumns({"pv": F.lag("value").over(by_series()), "pt": F.lag("ts").over(by_series())})
    diff = F.col("value") - F.col("pv")
    return f.with_points(d.where((diff >= 0) & ~F.isnan(diff)).withColumn("value", diff / ((F.col("ts") - F.col("pt")) / 1000.0)))


def per_second_rate(f: SeriesFrame, ms: int, unit: float = 1000.0) -> SeriesFrame:
    """Counter rate: growth since the sample before (the value itself after a reset), spread back over the gap if that is at most ms, then averaged over the ms before each point where all its slots have a rate. NaN counts as missing."""
    if f.step is None:
        return _by_step(f, lambda g: per_second_rate(g, ms, unit))
    step = f.step
    if ms <= 0 or ms % step:
        raise ValueError("perSecondRate: the duration must be a multiple of the step")
    n = ms // step
    before = by_series().rowsBetween(Window.unboundedPreceding, -1)
    d = f.dense().withColumn("v", clean())
    d = d.withColumns({"pv": F.last("v", ignorenulls=True).over(before), "pt": F.last(F.when(F.col("v").isNotNull(), F.col("ts")), ignorenulls=True).over(before)})
    gap, diff = F.col("ts") - F.col("pt"), F.col("v") - F.col("pv")
    rate = F.when(F.col("v").isNotNull(), F.struct(F.when(gap <= ms, F.when(diff < 0, F.col("v")).otherwise(diff) * unit / gap).alias("rate")))
    d = d.withColumn("own", rate)
    # The next stored sample at or after a slot: the last one met when going back in time, a running frame.
    back = Window.partitionBy("sid").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("rate", F.last("own", ignorenulls=True).over(back)["rate"])
    if n <= SLIDING_POINTS:
        w = by_series().rowsBetween(-n, -1)
        d = d.withColumns({"value": F.avg("rate").over(w), "full": F.count("rate").over(w)}).where(F.col("full") == n)
    else:
        base = d.select("sid", "ts", F.col("rate").alias("v"))
        ones = _blocks(base.withColumn("v", F.col("v").isNotNull().cast("double")), n, "sum").select("sid", "ts", F.col("value").alias("full"))
        d = _blocks(base, n, "avg").select("sid", "ts", "value").join(ones, ["sid", "ts"]).where(F.col("full") == n)
    return f.with_points(d)


def integral(f: SeriesFrame, reset_on_null: bool = False) -> SeriesFrame:
    """Running sum; NaN is skipped. With reset_on_null it starts anew after a gap of more than a step or a NaN."""
    w = by_series().rowsBetween(Window.unboundedPreceding, 0)
    if not reset_on_null:
        return f.with_points(f.points.where(~F.isnan("value")).withColumn("value", F.sum("value").over(w)))
    p = f.points if f.step is not None else f.points.join(f.meta.select("sid", "g_step"), "sid")
    step = F.lit(f.step) if f.step is not None else F.col("g_step")
    gap = F.isnan("value") | F.coalesce(F.col("ts") - F.lag("ts").over(by_series()) > step, F.lit(False))
    p = p.withColumn("part", F.sum(gap.cast("int")).over(w))
    inside = Window.partitionBy("sid", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return f.with_points(p.withColumn("total", F.sum(clean()).over(inside)).where(~F.isnan("value")).withColumn("value", F.col("total")))


def changed(f: SeriesFrame) -> SeriesFrame:
    """At every grid point: 1 where the value differs from the last one before it, else 0; missing and NaN give 0."""
    d = f.dense().withColumn("v", clean())
    last = F.last("v", ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("last", last)
    return f.with_points(d.withColumn("value", F.when(F.col("v").isNotNull() & F.col("last").isNotNull() & (F.col("v") != F.col("last")), 1.0).otherwise(0.0)))


def bucket_start(ts, interval: int, reference: int):
    """Start of the bucket of ts, with division that truncates; ts is a number or the name of a column."""
    if isinstance(ts, str):
        return F.expr(f"{reference} + (({ts} - {reference}) div {interval}) * {interval}")
    q = abs(ts - reference) // interval
    return reference + (q if ts >= reference else -q) * interval


def summarize(f: SeriesFrame, ms: int, how: str = "sum", start: int | None = None) -> SeriesFrame:
    """Buckets of ms, aligned to start or, without one, to the year 1; time is the bucket's start, an empty bucket gives no sample. how: sum, avg, min, max, last, stddev (of a sample; 0 for one value) or pNN (nearest rank)."""
    if ms < (f.step if f.step is not None else max(f.steps, default=0)):
        raise ValueError("summarize: the interval is shorter than the step")
    ref = YEAR_ONE if start is None else start
    p = f.points.where(~F.isnan("value")).withColumn("b", bucket_start("ts", ms, ref))
    if how[:1] == "p" and how[1:].replace(".", "", 1).isdigit():
        q = float(how[1:])
        if not 0 <= q <= 100:
            raise ValueError(f"summarize: unknown function {how}")
        w = Window.partitionBy("sid", "b")
        p = p.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("value"))})
        p = p.where(F.col("r") == F.greatest(F.ceil(F.lit(q / 100.0) * F.col("n")), F.lit(1))).select("sid", F.col("b").alias("ts"), "value")
    else:
        fns = {"sum": lambda: F.sum("value"), "avg": lambda: F.avg("value"), "min": lambda: F.min("value"), "max": lambda: F.max("value"), "last": lambda: F.max_by("value", "ts"), "stddev": lambda: F.coalesce(F.stddev_samp("value"), F.lit(0.0))}
        if how not in fns:
            raise ValueError(f"summarize: unknown function {how}")
        p = p.groupBy("sid", F.col("b").alias("ts")).agg(fns[how]().alias("value"))
    meta = f.meta.withColumns({"g_min": bucket_start("g_min", ms, ref), "g_max": bucket_start("g_max", ms, ref), "g_step": F.lit(ms).cast("long")})
    return replace(f.with_points(p, step=ms, steps=frozenset()), meta=meta if f.live else meta.join(f.alive().meta.select("sid"), "sid", "left_semi"))
