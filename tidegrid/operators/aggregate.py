"""Aggregations across the series of a group, per grid point."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, clean, label_key, label_map, labels_id, set_label

AGGREGATES = {
    "sum": lambda v: F.sum(v),
    "avg": lambda v: F.avg(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "multiply": lambda v: F.product(v),
    "range": lambda v: F.max(v) - F.min(v),
}


#: The group id of series that lack a tag and so belong to no group. They are told by their aggregates being null, not by a filter on the id: that would reach the scan, which could then not be shared with the samples'.
NO_GROUP = "\u0000"


def _in_group(c: str | Column) -> Column:
    return F.when(F.col("gid") != NO_GROUP, c if isinstance(c, Column) else F.col(c))


def _groups(f: SeriesFrame, tags: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """sid -> group id (None for one global group), and the meta of the groups. Series that lack a tag have the id NO_GROUP, which has no meta."""
    if not tags:
        one = f.meta.agg(F.min("g_min").alias("g_min"), F.max("g_max").alias("g_max"), F.max("g_step").alias("g_step")).where("g_min is not null")
        return None, one.select(F.lit("g").alias("sid"), label_map([]).alias("labels"), F.lit(None).cast("string").alias("alias"), "g_min", "g_max", "g_step")
    gid = F.coalesce(label_key(tags), F.lit(NO_GROUP))
    members = f.meta.select("sid", gid.alias("gid"), "g_min", "g_max", "g_step", *[F.col("labels")[t].alias(t) for t in tags])
    meta = members.groupBy("gid", *[f"`{t}`" for t in tags]).agg(F.min(_in_group("g_min")).alias("g_min"), F.max("g_max").alias("g_max"), F.max("g_step").alias("g_step")).where("g_min is not null")
    return members.select("sid", "gid"), meta.select(F.col("gid").alias("sid"), label_map(tags).alias("labels"), F.lit(None).cast("string").alias("alias"), "g_min", "g_max", "g_step")


def _of_group(points: DataFrame, members: DataFrame | None) -> DataFrame:
    return points.withColumn("gid", F.lit("g")) if members is None else points.join(members, "sid")


def uniform(f: SeriesFrame, tags: list[str]) -> SeriesFrame:
    """The series of each group brought to the largest step in it; a cell's samples are summed for series of type counter or counts, else averaged. Only sets whose steps may differ pay for it."""
    if f.step is not None:
        return f
    gid = label_key(tags) if tags else F.lit("g")
    m = f.meta.withColumn("gid", F.coalesce(gid, F.lit(NO_GROUP)))
    scope = m.groupBy("gid").agg(F.max("g_step").alias("to"), F.min("g_min").alias("base"), F.max("g_max").alias("top"))
    m = m.join(scope, "gid")
    m = m.withColumn("top", F.col("base") + F.floor((F.col("top") - F.col("base")) / F.col("to")) * F.col("to"))
    counts = F.lower(F.col("labels")["type"]).isin("counter", "counts")
    p = f.points.join(m.select("sid", "to", "base", "top", F.coalesce(counts, F.lit(False)).alias("counts")), "sid")
    cell = F.col("base") + F.floor((F.col("ts") - F.col("base")) / F.col("to")) * F.col("to")
    p = p.groupBy("sid", cell.cast("long").alias("ts"), "top").agg(F.when(F.first("counts"), F.sum(clean())).otherwise(F.avg(clean())).alias("value"))
    meta = m.withColumns({"g_min": F.col("base"), "g_max": F.col("top").cast("long"), "g_step": F.col("to")}).drop("gid", "to", "base", "top")
    return replace(f, points=p.where("value is not null and ts <= top").select("sid", "ts", "value"), meta=meta)


def aggregate(f: SeriesFrame, how: str, tags: list[str] = ()) -> SeriesFrame:
    """One series per combination of tags (one in all without tags); NaN is skipped, a point without any other value has no sample. Series that lack a tag are left out. Partial sums are built before the shuffle, so a group of any size costs one row per task and grid point."""
    tags = list(dict.fromkeys(tags))
    if how == "count":
        return count(f, tags)
    f = uniform(f, tags)
    members, meta = _groups(f, tags)
    points = _of_group(f.points, members).groupBy("gid", "ts").agg(AGGREGATES[how](_in_group(clean())).alias("value")).where("value is not null")
    return SeriesFrame(points.select(F.col("gid").alias("sid"), "ts", "value"), meta, step=f.step, steps=f.steps, tags=tuple(tags), single=not tags)


def count(f: SeriesFrame, tags: list[str] = ()) -> SeriesFrame:
    """The number of series of each group, empty ones included, at every grid point."""
    tags = list(dict.fromkeys(tags))
    f = f.alive()
    members, meta = _groups(f, tags)
    n = f.meta.agg(F.count(F.lit(1)).alias("n")).withColumn("gid", F.lit("g")) if members is None else members.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    sized = meta.join(n.withColumnRenamed("gid", "sid"), "sid")
    points = sized.select("sid", F.explode(F.sequence("g_min", "g_max", "g_step")).alias("ts"), F.col("n").cast("double").alias("value"))
    return SeriesFrame(points, meta, step=f.step, steps=f.steps, tags=tuple(tags), single=not tags, live=True)


def _ranked(points: DataFrame) -> DataFrame:
    """gid, ts, value with rank r and number n among the values of a point; ranks come from a sort that can spill, so no list of a group is ever held."""
    w = Window.partitionBy("gid", "ts")
    points = points.withColumn("value", _in_group(clean())).where("value is not null")
    return points.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("value"))})


def _nearest(p: float, interpolate: bool) -> Column:
    exact = F.lit(p / 100.0) * F.col("n")
    rank = F.greatest(F.ceil(exact), F.lit(1))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("value")))
    if not interpolate:
        return at(rank)
    n = F.max("n")
    share = F.lit(p / 100.0) * n - (F.ceil(F.lit(p / 100.0) * n) - 1)
    below, here = at(rank - 1), at(rank)
    return F.when(below.isNull(), here).otherwise(below + share * (here - below))


def percentile_of_series(f: SeriesFrame, percentiles: list[float], tags: list[str] = (), interpolate: bool = False) -> SeriesFrame:
    """Nearest-rank percentiles over the series of each group, per grid point; one series for each percentile, labelled __percentile."""
    tags = list(dict.fromkeys(tags))
    ps = sorted(set(percentiles))
    members, meta = _groups(f, tags)
    ranked = _ranked(_of_group(f.points, members))
    wide = ranked.groupBy("gid", "ts").agg(*[_nearest(p, interpolate).alias(f"p{i}") for i, p in enumerate(ps)])
    name = [f"{p:g}" if p != int(p) else f"{int(p)}" for p in ps]
    pairs = F.array(*[F.struct(F.lit(n).alias("p"), F.col(f"p{i}").alias("value")) for i, n in enumerate(name)])
    points = wide.select("gid", "ts", F.explode(pairs).alias("x")).select(F.concat("gid", F.lit("\u0001"), "x.p").alias("sid"), "ts", F.col("x.value").alias("value"))
    meta = meta.withColumn("p", F.explode(F.array(*[F.lit(n) for n in name])))
    meta = meta.select(F.concat("sid", F.lit("\u0001"), "p").alias("sid"), set_label(F.col("labels"), "__percentile", F.col("p")).alias("labels"), "alias", "g_min", "g_max", "g_step")
    return SeriesFrame(points.where("value is not null"), meta, step=f.step, steps=f.steps, tags=(*tags, "__percentile"))


_UNIT_MS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}
_DURATION = r"(-?[0-9]+(?:\.[0-9]+)?)(ns|us|µs|ms|s|m|h)"
#: Low and high of `low-high`: the dash is the first one that is neither a sign nor part of an exponent.
_RANGE = r"^\s*(-?(?:[^-]|(?<=[eE])-)+?)\s*(?<![eE])-\s*(.+?)\s*$"


def _bound(text: Column) -> Column:
    """A bucket bound: a number, a duration of one or more parts such as 1m30s (in ms), or an infinity; null if unreadable."""
    text = F.replace(text, F.lit("__"), F.lit("µ"))
    part = lambda i: F.regexp_extract_all(text, F.lit(_DURATION), F.lit(i))
    unit = F.create_map(*[x for u, ms in _UNIT_MS.items() for x in (F.lit(u), F.lit(ms))])
    parts = F.zip_with(part(1), part(2), lambda n, u: n.cast("double") * unit[u])
    duration = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    low = F.lower(text)
    infinite = F.when(low.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(low.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return F.coalesce(infinite, F.when(text.rlike(f"^(?:{_DURATION})+$"), duration), F.when(text.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), text.try_cast("double")))


def histogram_percentile(f: SeriesFrame, id_tag: str, range_tag: str, percentiles: list[float]) -> SeriesFrame:
    """Percentiles of histograms whose buckets are series: per group of all other labels and per point, the upper bound of the first bucket, in order of bounds, at which the running count reaches p percent of the total. No sample where the total is 0; label histogramPercentile=pNN. Where the upper bound is infinite, the lower one stands for it. Series without the two tags are left out. A range that can't be read, and two series of one bucket at one point, are errors. Each percentile comes once, in order."""
    percentiles = sorted(set(percentiles))
    rng = F.col("labels")[range_tag]
    low, high = (_bound(F.regexp_extract(rng, _RANGE, i)) for i in (1, 2))
    rest = F.map_filter("labels", lambda k, _: (k != id_tag) & (k != range_tag))
    m = f.meta.where(F.col("labels")[id_tag].isNotNull() & rng.isNotNull())
    bad = F.raise_error(F.concat(F.lit("histogramPercentile: invalid bucket range "), rng)).cast("double")
    ub = F.when(rng.isin("infinity", "+Inf"), F.lit(float("inf"))).when(low.isNull() | high.isNull() | (high <= low), bad).otherwise(F.when(high == float("inf"), low).otherwise(high))
    m = m.withColumns({"ub": ub, "rest": rest, "bucket": F.concat_ws("\u0001", F.col("labels")[id_tag], rng)}).withColumn("gid", labels_id("rest"))
    p = f.points.where(~F.isnan("value")).join(m.select("sid", "gid", "ub", "bucket"), "sid").groupBy("gid", "ts", "ub")
    p = p.agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    again = F.raise_error(F.concat(F.lit("histogramPercentile: two series of one bucket "), "a")).cast("double")
    p = p.select("gid", "ts", "ub", F.when((F.col("n") > 1) & (F.col("a") == F.col("b")), again).otherwise(F.col("value")).alias("value"))
    w = Window.partitionBy("gid", "ts")
    p = p.withColumns({"total": F.sum("value").over(w), "cum": F.sum("value").over(w.orderBy("ub").rowsBetween(Window.unboundedPreceding, 0))}).where("total > 0")
    wide = p.groupBy("gid", "ts").agg(*[F.min(F.when(F.col("cum") >= F.col("total") * (q / 100.0), F.col("ub"))).alias(f"p{i}") for i, q in enumerate(percentiles)])
    name = [f"p{q:g}" for q in percentiles]
    pairs = F.array(*[F.struct(F.lit(n).alias("p"), F.col(f"p{i}").alias("value")) for i, n in enumerate(name)])
    points = wide.select("gid", "ts", F.explode(pairs).alias("x")).select(F.concat("gid", F.lit("\u0001"), "x.p").alias("sid"), "ts", F.col("x.value").alias("value"))
    # The labels of a group are spelled out in its id.
    g = m.groupBy("gid").agg(F.min("g_min").alias("g_min"), F.max("g_max").alias("g_max"), F.max("g_step").alias("g_step"))
    entries = F.transform(F.filter(F.split("gid", "\u0002"), lambda x: x != ""), lambda x: F.struct(F.split(x, "\u0001")[0].alias("key"), F.split(x, "\u0001")[1].alias("value")))
    g = g.withColumn("p", F.explode(F.array(*[F.lit(n) for n in name])))
    meta = g.select(F.concat("gid", F.lit("\u0001"), "p").alias("sid"), set_label(F.map_from_entries(entries), "histogramPercentile", F.col("p")).alias("labels"), F.lit(None).cast("string").alias("alias"), "g_min", "g_max", "g_step")
    return SeriesFrame(points.where("value is not null"), meta, step=f.step, steps=f.steps)
