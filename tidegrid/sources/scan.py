"""Fetching: select series by label, bring their samples onto the step grid."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, grid_end, stored
from tidegrid.sources.documents import canonical_map, usable_samples


class Regex(str):
    """A value that is a whole-value regular expression."""

    def __repr__(self) -> str:
        return "~" + super().__repr__()


@dataclass(frozen=True)
class Matchers:
    """For each label, the values one of which it must have (must) or must not have (must_not). `*` and `?` are wildcards, but not in a Regex; nor in values named in regex, which are regular expressions wherever they stand."""

    must: dict[str, tuple[str, ...]] = field(default_factory=dict)
    must_not: dict[str, tuple[str, ...]] = field(default_factory=dict)
    regex: frozenset[str] = frozenset()

    def predicate(self, label) -> Column:
        """label(name) gives a column. A series without a label fails what it must have and passes what it must not have."""
        keep = F.lit(True)
        for name, values in self.must.items():
            keep = keep & F.coalesce(self._any(label(name), values), F.lit(False))
        for name, values in self.must_not.items():
            keep = keep & ~F.coalesce(self._any(label(name), values), F.lit(False))
        return keep

    def _any(self, c: Column, values: tuple[str, ...]) -> Column:
        pattern = lambda v: isinstance(v, Regex) or v in self.regex
        exact = [v for v in values if not pattern(v) and not re.search(r"[*?]", v)]
        hit = c.isin(*exact) if exact else F.lit(False)
        for v in values:
            if pattern(v):
                hit = hit | c.rlike(f"^(?:{v})$")
            elif v not in exact:
                hit = hit | c.rlike("^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in v) + "$")
        return hit


def gridded(samples: DataFrame, start: int, step: int, order: Column, with_: tuple[str, ...] = ()) -> DataFrame:
    """sid, ts, value and the columns with_, which belong to the series: of each series and cell of the grid from start, the last sample; `order` decides among equal times. Partial results are built before the shuffle, so a hot series costs one row per task and cell. What else is asked of the samples fetched should be asked of this result with its value (stored()), so that Spark sees one exchange and reads the source once."""
    cell = F.expr(f"{start} + ((ts - {start}) div {step}) * {step}")
    return samples.groupBy("sid", *with_, cell.alias("cell")).agg(F.max_by("value", F.struct("ts", order)).alias("value")).select("sid", *with_, F.col("cell").alias("ts"), "value")


def _meta(series: DataFrame, start: int, end: int, step: int) -> DataFrame:
    return series.select("sid", "labels", F.lit(None).cast("string").alias("alias"), F.lit(start).cast("long").alias("g_min"), F.lit(grid_end(start, end, step)).cast("long").alias("g_max"), F.lit(step).cast("long").alias("g_step"))


class TableSource:
    """Samples of a flat table: label columns, a time in ms, a value, and a tie-break among samples of one time. Matchers, time range and columns reach the scan, as labels are plain columns. Rows with a null time or value are left out; a null label is a missing one."""

    def __init__(self, df: DataFrame, labels: dict[str, Column], ts: Column, value: Column, seq: Column):
        self.df, self.labels, self.ts, self.value, self.seq = df, labels, ts, value, seq

    def fetch(self, m: Matchers, start: int, end: int, step: int) -> SeriesFrame:
        none = F.lit(None).cast("string")
        rows = self.df.where(m.predicate(lambda n: self.labels.get(n, none)))
        named = {f"l{i}": c.cast("string") for i, c in enumerate(self.labels.values())}
        rows = rows.select(self.ts.cast("long").alias("ts"), self.value.cast("double").alias("value"), self.seq.alias("seq"), *[c.alias(n) for n, c in named.items()])
        rows = rows.where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("value").isNotNull())
        key = F.concat(*[F.coalesce(F.concat(F.lit("v"), F.col(n)), F.lit("-")) if i == 0 else F.concat(F.lit("\u0001"), F.coalesce(F.concat(F.lit("v"), F.col(n)), F.lit("-"))) for i, n in enumerate(named)])
        rows = rows.withColumn("sid", key)
        wide = gridded(rows, start, step, F.col("seq"), tuple(named))
        series = stored(wide).select("sid", *named).distinct()
        pairs = F.create_map(*[x for name, col in zip(self.labels, named) for x in (F.lit(name), F.col(col))])
        full = F.map_filter(pairs, lambda _, v: v.isNotNull())
        return SeriesFrame(wide.select("sid", "ts", "value"), _meta(series.select("sid", full.alias("labels")), start, end, step), step=step, live=True)


def _sid() -> Column:
    """The id of a catalog series; never null, so that joins add no filter that would tell equal scans apart."""
    return F.coalesce(F.col("series_ref").cast("string"), F.lit("")).alias("sid")


class DocumentSource:
    """Usable samples of ingest documents with their series catalog. Matchers choose among the series, the time range reaches the scan of the documents; samples sent again at one time keep the value that arrived first."""

    def __init__(self, documents: DataFrame, catalog: DataFrame, index_name: str | None = None):
        self.documents, self.catalog, self.index_name = documents, catalog, index_name

    def fetch(self, m: Matchers, start: int, end: int, step: int) -> SeriesFrame:
        series = self.catalog.where(m.predicate(lambda n: F.col("labels")[n])).where((F.col("min_ts") < end) & (F.col("max_ts") >= start))
        if self.index_name:
            series = series.where(F.col("index_name") == self.index_name)
        docs = self.documents.where((F.col("sample_ts") >= start) & (F.col("sample_ts") < end))
        s = usable_samples(docs, series, [], by_text=False).select(_sid(), F.col("sample_ts").alias("ts"), "value", (-F.col("row_id")).alias("seq"))
        return SeriesFrame(gridded(s, start, step, F.col("seq")), _meta(series.select(_sid(), "labels"), start, end, step), step=step)


class UnionSource:
    """Several partitions of one data set, as local or remote indices: series of equal labels are one series, with the last sample of a cell over all of them."""

    def __init__(self, *sources):
        self.sources = sources

    def fetch(self, m: Matchers, start: int, end: int, step: int) -> SeriesFrame:
        frames = [s.fetch(m, start, end, step) for s in self.sources]
        points = meta = None
        for i, f in enumerate(frames):
            ids = f.meta.select("sid", canonical_map("labels").alias("_id"))
            p = f.points.join(ids, "sid").select(F.col("_id").alias("sid"), "ts", "value", F.lit(i).alias("seq"))
            k = f.meta.withColumn("sid", canonical_map("labels"))
            points, meta = (p, k) if points is None else (points.unionByName(p), meta.unionByName(k))
        once = meta.groupBy("sid").agg(F.max("g_min").alias("g_min"))
        pairs = F.transform(F.filter(F.split("sid", "\u0002"), lambda x: x != ""), lambda x: F.struct(F.split(x, "\u0001")[0].alias("k"), F.split(x, "\u0001")[1].alias("v")))
        return SeriesFrame(gridded(points, start, step, F.col("seq")), _meta(once.select("sid", F.map_from_entries(pairs).alias("labels")), start, end, step), step=step, live=all(f.live for f in frames))


def mock_fetch(spark: SparkSession, values: list[float], labels: dict[str, str], start: int, end: int, step: int) -> SeriesFrame:
    """One series with one value per step from start; NaN is a missing sample, values beyond the end are dropped."""
    labels = labels or {"name": "mockFetch"}
    rows = [("mock", start + i * step, float(v)) for i, v in enumerate(values) if v == v and start + i * step < end]
    points = spark.createDataFrame(rows, "sid string, ts long, value double")
    meta = spark.createDataFrame([("mock", labels)], "sid string, labels map<string,string>")
    return SeriesFrame(points, _meta(meta, start, end, step), step=step, tags=tuple(sorted(labels)), single=True, live=True)


def label_values(source_meta: DataFrame) -> DataFrame:
    """Distinct label sets of matching series."""
    return source_meta.select(canonical_map("labels").alias("id"), "labels").dropDuplicates(["id"]).select("labels")


def label_statistics(f: SeriesFrame) -> DataFrame:
    """(label, value, series): how many living series have each label value; label '' and value '' give the number of all series."""
    meta = f.alive().meta
    each = meta.select(F.explode("labels").alias("label", "value")).groupBy("label", "value").agg(F.count(F.lit(1)).alias("series"))
    return each.unionByName(meta.agg(F.count(F.lit(1)).alias("series")).select(F.lit("").alias("label"), F.lit("").alias("value"), "series"))
