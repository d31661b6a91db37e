"""Sorting whole series and taking some of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, clean
from tidegrid.session import checkpointed

#: Spellings of sort keys.
KEYS = {"avg": "avg", "average": "avg", "current": "current", "max": "max", "maximum": "max", "min": "min", "minimum": "min", "stddev": "stddev", "sum": "sum", "name": "name"}


def sort_series(f: SeriesFrame, by: str = "current", direction: str = "desc") -> SeriesFrame:
    """Series in order of avg, current (the last value that is not NaN), max, min, stddev (of a sample) or sum of their values, or of their alias. A key without a value comes first ascending and last descending; equal keys stay in order of their ids. Only one key per series is moved."""
    if by not in KEYS:
        raise ValueError(f"sort: unknown key {by}")
    ways = {"asc": True, "ascending": True, "desc": False, "descending": False}
    if direction not in ways:
        raise ValueError(f"sort: unknown direction {direction}")
    up, by = ways[direction], KEYS[by]
    f = f.alive()
    meta = f.meta.drop("o_none", "o_key")
    if by == "name":
        meta = meta.withColumns({"o_none": F.lit(0), "o_key": F.coalesce("alias", F.lit(""))})
    else:
        v = clean()
        key = {"avg": F.avg(v), "max": F.max(v), "min": F.min(v), "sum": F.sum(v), "stddev": F.stddev_samp(v), "current": F.max_by(v, F.when(v.isNotNull(), F.col("ts")))}[by]
        keys = f.points.groupBy("sid").agg(key.alias("o_key"))
        meta = meta.join(keys, "sid", "left")
        meta = meta.withColumn("o_none", F.when(F.col("o_key").isNull() | F.isnan("o_key"), 0 if up else 1).otherwise(1 if up else 0))
    return replace(f, meta=meta, order=(("o_none", True), ("o_key", up), ("sid", True)))


def _ordering(f: SeriesFrame, reverse: bool = False):
    order = f.order or (("sid", True),)
    return [F.col(c).asc_nulls_first() if up != reverse else F.col(c).desc_nulls_last() for c, up in order]


def _take(f: SeriesFrame, n: int, reverse: bool) -> SeriesFrame:
    f = f.alive()
    chosen = f.meta.orderBy(*_ordering(f, reverse)).limit(n)
    return replace(f, meta=chosen, points=f.points.join(chosen.select("sid"), "sid", "left_semi"))


def head(f: SeriesFrame, n: int = 10) -> SeriesFrame:
    """The first n series of the order; of their ids, if they are not sorted."""
    return _take(f, n, reverse=False)


def tail(f: SeriesFrame, n: int = 10) -> SeriesFrame:
    """The last n series, which stay in their order."""
    return _take(f, n, reverse=True)


def top_k(f: SeriesFrame, k: int = 10, by: str = "current", direction: str = "desc") -> SeriesFrame:
    """The first k series of sort_series(by, direction); a task sends no more than k keys on."""
    return head(sort_series(f, by, direction), k)


def ranked(f: SeriesFrame) -> DataFrame:
    """meta with `ord` from 1: the place of each series. The series are sorted by range over all tasks and written once; each task's rows are numbered from the number of rows before it, so no task sees all series."""
    m = checkpointed(f.alive().meta.orderBy(*_ordering(f)).withColumn("_m", F.monotonically_increasing_id()))
    m = m.withColumn("_part", F.shiftright("_m", 33))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    counts = m.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return m.join(counts, "_part").withColumn("ord", place.cast("int")).drop("_m", "_part", "_before")
