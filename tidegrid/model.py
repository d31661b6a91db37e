"""SeriesFrame: a set of series as two DataFrames, samples and what belongs to a series once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


@dataclass(frozen=True)
class SeriesFrame:
    """points: sid, ts, value - one row per stored sample; a missing sample has no row, NaN is a stored sample.
    meta: sid, labels (map), alias, g_min, g_max, g_step - one row per series; the grid runs from g_min to g_max, both included.

    A series in meta without points is an empty series. Stages on values touch only points and stages on labels only meta, so label maps never travel with samples.

    step: the one step of all series, if there is one; steps: those that series may have where there are several. tags: the label names, if all series have exactly these. single: there is at most one series. live: every series of meta is known to exist; else those that never had a sample still have to be taken out (see alive). order: meta columns with True for ascending, if the series are sorted.
    """

    points: DataFrame
    meta: DataFrame
    step: int | None = None
    steps: frozenset[int] = frozenset()
    tags: tuple[str, ...] | None = None
    single: bool = False
    live: bool = False
    order: tuple[tuple[str, bool], ...] | None = None

    def with_points(self, points: DataFrame, **kw) -> "SeriesFrame":
        """Other samples for the same series; the series that exist are settled first, as samples may go."""
        base = self.alive()
        return replace(base, points=points.select("sid", "ts", "value"), **kw)

    def with_values(self, value: Column) -> "SeriesFrame":
        """Another value at each stored sample."""
        return replace(self, points=self.points.select("sid", "ts", value.cast("double").alias("value")))

    def with_meta(self, meta: DataFrame, **kw) -> "SeriesFrame":
        return replace(self, meta=meta, **kw)

    def alive(self) -> "SeriesFrame":
        """Only series that have a sample, unless that is known already: a fetch never yields an empty series."""
        if self.live:
            return self
        return replace(self, meta=self.meta.join(stored(self.points).select("sid").distinct(), "sid", "left_semi"), live=True)

    def of_step(self, step: int) -> "SeriesFrame":
        """Only the series of one step."""
        if self.step is not None:
            return self
        meta = self.meta.where(F.col("g_step") == step)
        return replace(self, points=self.points.join(meta.select("sid"), "sid", "left_semi"), meta=meta, step=step, steps=frozenset())

    def keep(self, series: DataFrame) -> "SeriesFrame":
        """Only the series whose sid is in series."""
        ids = series.select("sid")
        return replace(self, meta=self.meta.join(ids, "sid", "left_semi"), points=self.points.join(ids, "sid", "left_semi"))

    def dense(self) -> DataFrame:
        """sid, ts, value with a row for every grid point of every living series, value null where none is stored. Rows come partitioned by sid: a window over a series needs no further shuffle, and a series has at most as many rows as the grid has points."""
        f = self.alive()
        grid = f.meta.select("sid", F.explode(F.sequence("g_min", "g_max", "g_step")).alias("ts"), F.lit(None).cast("double").alias("value"))
        return grid.unionByName(f.points).repartition("sid").groupBy("sid", "ts").agg(F.max("value").alias("value"))


def stored(points: DataFrame) -> DataFrame:
    """points as they are, their values being looked at: what asks only for their series then shares an exchange with what asks for their values."""
    return points.where("value is not null")


def clean(value: str | Column = "value") -> Column:
    """Null for NaN, so that aggregates skip it."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c), c)


def by_series() -> "Window":
    return Window.partitionBy("sid").orderBy("ts")


def label_key(tags: list[str] | tuple[str, ...], labels: str = "labels") -> Column:
    """Text that is equal for series with equal values of tags; null if one of them is missing."""
    return F.concat(F.lit("g"), *[F.concat(F.lit("\u0001"), F.col(labels)[t]) for t in tags])


def labels_id(labels: str | Column = "labels") -> Column:
    """Text that is equal for equal label sets."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("\u0001"), e["value"]))
    return F.array_join(F.array_sort(pairs), "\u0002")


def label_map(tags: list[str] | tuple[str, ...]) -> Column:
    """A map of columns named like tags; an empty map without any."""
    if not tags:
        return F.expr("cast(map() as map<string,string>)")
    return F.create_map(*[x for t in tags for x in (F.lit(t), F.col(f"`{t}`").cast("string"))])


def set_label(labels: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(labels, lambda k, _: k != name), F.create_map(F.lit(name), value))


def grid_end(start: int, end: int, step: int) -> int:
    """Last grid point before the exclusive end."""
    return start + (end - start - 1) // step * step
