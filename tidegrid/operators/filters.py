"""Filters on samples and on series."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, by_series

_OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b}
#: Fixed value: the pattern of a semantic version, with an optional leading v.
SEMVER = r"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def value_filter(f: SeriesFrame, op: str, x: float) -> SeriesFrame:
    """Samples that compare true with x; NaN goes, the series stays even if it ends up empty."""
    return f.with_points(f.points.where(~F.isnan("value") & _OPS[op](F.col("value"), F.lit(float(x)))))


def remove_empty(f: SeriesFrame) -> SeriesFrame:
    """Only series with a sample that is not NaN."""
    some = f.points.where(~F.isnan("value")).select("sid").distinct()
    return f.with_meta(f.meta.join(some, "sid", "left_semi"), live=True).with_points(f.points.join(some, "sid", "left_semi"))


def _where(f: SeriesFrame, keep: Column) -> SeriesFrame:
    chosen = f.meta.where(keep)
    return replace(f, points=f.points.join(chosen.select("sid"), "sid", "left_semi"), meta=chosen)


def exclude_by_tag(f: SeriesFrame, tag: str, patterns: list[str]) -> SeriesFrame:
    """Without series in whose tag one of the patterns is found; a series without the tag stays."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col("labels")[tag].rlike(p), F.lit(False))
    return _where(f, ~hit)


def where_tags(f: SeriesFrame, op: str, a: str, b: str) -> SeriesFrame:
    """Series that have both tags, with equal (eq) or different (neq) values."""
    if op not in ("eq", "neq"):
        raise ValueError(f"where: unknown operator {op}")
    x, y = F.col("labels")[a], F.col("labels")[b]
    return _where(f, F.coalesce((x == y) if op == "eq" else (x != y), F.lit(False)))


def _semver(c: Column) -> Column:
    """A value that sorts as versions do. A release follows its pre-releases; of pre-release parts, numbers come before words and compare as numbers, and fewer parts come first."""
    nums = [F.regexp_extract(c, SEMVER, i).cast("decimal(38,0)") for i in (1, 2, 3)]
    pre = F.regexp_extract(c, SEMVER, 4)
    parts = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 40, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.struct(*nums, (pre == "").cast("int").alias("release"), parts.alias("parts"))


def tag_compare(f: SeriesFrame, op: str, tag: str, value: str) -> SeriesFrame:
    """Series whose tag compares true with value: as versions if value is one (other series go), else as text. A series without the tag goes."""
    names = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "==": "eq", "!=": "ne"}
    if op not in names:
        raise ValueError(f"tagCompare: unknown operator {op}")
    c = F.col("labels")[tag]
    if re.match(SEMVER, value):
        usable = c.rlike(SEMVER)
        safe = F.when(usable, c).otherwise(F.lit("0.0.0"))
        keep = F.coalesce(usable & _OPS[names[op]](_semver(safe), _semver(F.lit(value))), F.lit(False))
    else:
        keep = F.coalesce(_OPS[names[op]](c, F.lit(value)), F.lit(False))
    return _where(f, keep)


def sustain(f: SeriesFrame, ms: int) -> SeriesFrame:
    """Samples that end at least ms / step consecutive stored samples without a NaN; gaps between stored samples don't count, 0 changes nothing."""
    if ms < 0:
        raise ValueError("sustain: the duration must not be negative")
    if ms == 0:
        return f
    p = f.points if f.step is not None else f.points.join(f.meta.select("sid", "g_step"), "sid")
    need = F.lit(ms // f.step) if f.step is not None else F.floor(F.lit(ms) / F.col("g_step"))
    w = by_series().rowsBetween(-(2**31), 0)
    bad = F.isnan("value")
    p = p.withColumn("_n", F.row_number().over(by_series())).withColumn("_last", F.max(F.when(bad, F.col("_n"))).over(w))
    return f.with_points(p.where(~bad & (F.col("_n") - F.coalesce("_last", F.lit(0)) >= need)))
