"""Joins and set operations between two sets of series."""

from __future__ import annotations

import math
from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, clean, label_key, labels_id, nan, set_label


def _common(left: SeriesFrame, right: SeriesFrame) -> list[str]:
    """Label names that all series of both sides have; looked up in the data only if the plan doesn't tell. One row per label name comes to the driver."""
    names = []
    for f in (left, right):
        if f.tags is not None:
            names.append(set(f.tags))
            continue
        meta = f.alive().meta
        rows = meta.select(F.explode(F.map_keys("labels")).alias("k")).groupBy("k").count().collect()
        total = meta.count()
        names.append({r["k"] for r in rows if r["count"] == total})
    return sorted(names[0] & names[1])


def _keyed(left: SeriesFrame, right: SeriesFrame, tags: list[str], unique: bool) -> tuple[DataFrame, DataFrame]:
    """meta sid -> key of both sides. A right side of one series, or of one group, matches every left series."""
    if right.single:
        return left.meta.select("sid", F.lit("g").alias("key")), right.meta.select("sid", F.lit("g").alias("key"))
    tags = list(dict.fromkeys(tags))
    rm = right.alive().meta
    if not tags:
        if len(rm.select("sid").limit(2).collect()) < 2:
            return left.meta.select("sid", F.lit("g").alias("key")), rm.select("sid", F.lit("g").alias("key"))
        tags = _common(left, right)
    rk = rm.select("sid", label_key(tags).alias("key"))
    # One row on how the right side falls into groups decides the form of the join.
    sizes = rk.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("series"), F.count("key").alias("groups"), F.max(F.when(F.col("key").isNotNull(), F.col("n"))).alias("most")).head()
    if sizes["series"] < 2:
        return left.meta.select("sid", F.lit("g").alias("key")), rk.select("sid", F.lit("g").alias("key"))
    if unique and (sizes["most"] or 0) > 1:
        raise ValueError("several right series match one left series; name labels that tell them apart")
    rk = rk.where("key is not null")
    if sizes["groups"] < 2:
        return left.meta.select("sid", F.lit("g").alias("key")), rk.select("sid", F.lit("g").alias("key"))
    return left.meta.select("sid", label_key(tags).alias("key")).where("key is not null"), rk


def _possible(*frames: SeriesFrame) -> frozenset[int]:
    """Steps that series of the frames may have."""
    return frozenset().union(*[{f.step} if f.step is not None else f.steps for f in frames])


def _lcm(steps: Column) -> Column:
    """Least common multiple of an array of steps, by Euclid's algorithm; 90 rounds do for any two longs."""

    def gcd(a: Column, b: Column) -> Column:
        turn = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.greatest(s["y"], F.lit(1))).alias("y")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("x"), b.alias("y")), turn)["x"]

    return F.aggregate(steps, F.lit(1).cast("long"), lambda acc, s: (acc / gcd(acc, s)).cast("long") * s)


def _normalised(left: SeriesFrame, right: SeriesFrame, lk: DataFrame, rk: DataFrame, pairwise: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left points (sid, key, ts, l), right points (key, ts, r) and the left grids (sid, g_min, g_max, g_step) brought to common steps: the LCM of the steps of a key's series, on cells from their earliest start; pairwise, of each left series and its right one. Samples of a cell are averaged, NaN being skipped, unless the series is on that grid already. The key of the result is the key and its grid, so that a right series is put on each grid once."""
    grid = ("g_min", "g_max", "g_step")
    left, right = left.alive(), right.alive()
    lm = left.meta.select("sid", *grid).join(lk, "sid")
    rm = right.meta.select(F.col("sid").alias("rsid"), *[F.col(c).alias(f"r_{c}") for c in grid]).join(rk.withColumnRenamed("sid", "rsid"), "rsid")
    both = lm.join(rm, "key")
    if not pairwise:
        scope = both.groupBy("key").agg(F.min("g_min").alias("a"), F.max("g_max").alias("b"), F.collect_set("g_step").alias("s"))
        both = both.join(scope, "key")
        base, top, steps = F.least("a", "r_g_min"), F.greatest("b", "r_g_max"), F.array_union("s", F.array("r_g_step"))
    else:
        base, top, steps = F.least("g_min", "r_g_min"), F.greatest("g_max", "r_g_max"), F.array("g_step", "r_g_step")
    both = both.withColumns({"base": base, "step": _lcm(steps), "top": top}).withColumn("top", F.col("top") - F.pmod(F.col("top") - F.col("base"), F.col("step")))
    both = both.withColumn("cell", F.concat_ws("\u0004", "key", "base", "step", "top"))

    def regridded(points: DataFrame, sid: str, mine: list[str], name: str) -> DataFrame:
        on = (F.col(mine[0]) == F.col("base")) & (F.col(mine[1]) == F.col("top")) & (F.col(mine[2]) == F.col("step"))
        to = both.select(F.col(sid).alias("sid"), "cell", "base", "step", on.alias("on")).distinct()
        ts = F.col("base") + F.floor((F.col("ts") - F.col("base")) / F.col("step")).cast("long") * F.col("step")
        p = points.join(to, "sid").groupBy("sid", "cell", ts.alias("ts")).agg(F.avg(clean()).alias(name), F.max("on").alias("on"))
        return p.where(F.col(name).isNotNull() | F.col("on")).select("sid", F.col("cell").alias("key"), "ts", F.coalesce(name, nan()).alias(name))

    l = regridded(left.points, "sid", list(grid), "l")
    r = regridded(right.points, "rsid", [f"r_{c}" for c in grid], "r").drop("sid")
    return l, r, both.select("sid", F.col("base").alias("g_min"), F.col("top").alias("g_max"), F.col("step").alias("g_step"))


def _ratio(left: SeriesFrame, right: SeriesFrame, tags: list[str], value, pairwise: bool) -> SeriesFrame:
    """value of l and r at the times where both have a sample; series without such a time are dropped."""
    lk, rk = _keyed(left, right, tags, unique=True)
    meta = left.meta.withColumn("labels", set_label(F.col("labels"), "type", F.lit("ratios")))
    names = None if left.tags is None else tuple(sorted({*left.tags, "type"}))
    steps = _possible(left, right)
    if len(steps) == 1:
        l = left.points.withColumnRenamed("value", "l").join(lk, "sid")
        r = right.points.join(rk, "sid").select("key", "ts", F.col("value").alias("r"))
    else:
        l, r, grids = _normalised(left, right, lk, rk, pairwise)
        meta = meta.drop("g_min", "g_max", "g_step").join(grids, "sid").select(*meta.columns)
        parts = sorted(steps)
        steps = frozenset(math.lcm(*c) for n in range(1, len(parts) + 1) for c in combinations(parts, n))
    joined = l.join(r, ["key", "ts"])
    return replace(left, points=joined.select("sid", "ts", value.alias("value")), meta=meta, tags=names, live=False, step=next(iter(steps)) if len(steps) == 1 else None, steps=steps if len(steps) > 1 else frozenset())


def as_percent(left: SeriesFrame, right: SeriesFrame, tags: list[str] = ()) -> SeriesFrame:
    """l / r * 100 where both have a sample; r = 0 gives NaN; label type=ratios. Series of different steps are brought to the LCM of all steps that meet."""
    return _ratio(left, right, list(tags), F.when(F.col("r") == 0, nan()).otherwise(F.col("l") / F.col("r") * 100.0), pairwise=False)


def divide(left: SeriesFrame, right: SeriesFrame, tags: list[str] = ()) -> SeriesFrame:
    """l / r where both have a sample; NaN if one of them is NaN or r = 0; label type=ratios. Of series with different steps each pair is brought to the LCM of its two."""
    bad = F.isnan(F.col("l")) | F.isnan(F.col("r")) | (F.col("r") == 0)
    return _ratio(left, right, list(tags), F.when(bad, nan()).otherwise(F.col("l") / F.col("r")), pairwise=True)


def diff(left: SeriesFrame, right: SeriesFrame, keep_nans: bool = False, tags: list[str] = ()) -> SeriesFrame:
    """l - r, several right series of one key being summed. A side that is missing or NaN counts as 0, and no sample on both sides gives none; with keep_nans one missing side gives none. Both sides come together in one aggregation per series and time, not in an outer join."""
    lk, rk = _keyed(left, right, list(tags), unique=False)
    r = right.points.join(rk, "sid").groupBy("key", "ts").agg(F.sum(clean()).alias("r"), F.max(F.isnan("value")).alias("bad"))
    r = r.select("key", "ts", F.when(F.col("r").isNull() | (F.col("bad") & F.lit(keep_nans)), nan()).otherwise(F.col("r")).alias("r"))
    ids = left.alive().meta.select("sid").join(lk, "sid")
    none = F.lit(None).cast("double")
    both = left.points.join(ids, "sid").select("sid", "ts", F.col("value").alias("l"), none.alias("r")).unionByName(r.join(ids, "key").select("sid", "ts", none.alias("l"), "r"))
    p = both.groupBy("sid", "ts").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    if keep_nans:
        p = p.where("l is not null and r is not null").withColumn("value", F.col("l") - F.col("r"))
    else:
        p = p.withColumn("value", F.coalesce(clean("l"), F.lit(0.0)) - F.coalesce(clean("r"), F.lit(0.0)))
    matched = ids.join(rk.select("key").distinct(), "key", "left_semi").select("sid")
    p = p.join(matched, "sid", "left_semi")
    return replace(left, points=p.select("sid", "ts", "value"), meta=left.alive().meta.join(matched, "sid", "left_semi"), live=True)


def intersect(left: SeriesFrame, right: SeriesFrame, tags: list[str] = ()) -> SeriesFrame:
    """Left series for which a right series has equal labels: all labels, or those named. A right series must have the named labels; a left one that lacks one of them compares as empty text."""
    tags = list(dict.fromkeys(tags))
    if tags:
        lk = F.concat(F.lit("g"), *[F.concat(F.lit("\u0001"), F.coalesce(F.col("labels")[t], F.lit(""))) for t in tags])
        rk = label_key(tags)
    else:
        lk = rk = labels_id("labels")
    have = right.alive().meta.select(rk.alias("key")).where("key is not null").distinct()
    ids = left.meta.select("sid", lk.alias("key")).join(have, "key", "left_semi")
    return left.keep(ids)


def union(*frames: SeriesFrame) -> SeriesFrame:
    """All series of all frames; equal ones stay apart."""
    points = meta = None
    for i, f in enumerate(frames):
        sid = F.concat(F.lit(f"{i}\u0003"), "sid").alias("sid")
        p = f.points.select(sid, "ts", "value")
        m = f.meta.select(sid, "labels", F.col("alias").cast("string").alias("alias"), *[F.col(c).cast("long").alias(c) for c in ("g_min", "g_max", "g_step")])
        points, meta = (p, m) if points is None else (points.unionByName(p), meta.unionByName(m))
    steps = _possible(*frames)
    tags = {f.tags for f in frames}
    return SeriesFrame(points, meta, step=next(iter(steps)) if len(steps) == 1 else None, steps=steps if len(steps) > 1 else frozenset(), tags=tags.pop() if len(tags) == 1 else None, live=all(f.live for f in frames))


def fallback(left: SeriesFrame, right: SeriesFrame) -> SeriesFrame:
    """left, or right if left has no series."""
    return right if left.alive().meta.isEmpty() else left


def fallback_constant(left: SeriesFrame, x: float, start: int, end: int) -> SeriesFrame:
    """left, or one series of x at every second, with x in three decimals as its alias."""
    if not left.alive().meta.isEmpty():
        return left
    spark = left.meta.sparkSession
    last = start + (end - start - 1) // 1000 * 1000
    meta = spark.range(1).select(F.lit("constant").alias("sid"), F.expr("cast(map() as map<string,string>)").alias("labels"), F.lit(f"{x:.3f}").alias("alias"), F.lit(start).cast("long").alias("g_min"), F.lit(last).cast("long").alias("g_max"), F.lit(1000).cast("long").alias("g_step"))
    points = spark.range(start, last + 1, 1000).select(F.lit("constant").alias("sid"), F.col("id").alias("ts"), F.lit(float(x)).alias("value"))
    return SeriesFrame(points, meta, step=1000, tags=(), single=True, live=True)
