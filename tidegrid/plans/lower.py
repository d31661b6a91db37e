"""From the logical plan to one lazy DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.durations import duration_ms
from tidegrid.model import SeriesFrame
from tidegrid.operators import aggregate, binary, filters, labels, mappers, order, windows
from tidegrid.plans import m3
from tidegrid.plans.nodes import Node
from tidegrid.sources.scan import Matchers, mock_fetch

#: Stages by name: what a plan node's arguments are passed to. Users add their own with register_stage.
STAGES: dict[str, Callable[..., SeriesFrame]] = {
    f.__name__: f
    for f in (
        *(mappers.absolute, mappers.scale, mappers.scale_to_seconds, mappers.offset, mappers.divide_scalar, mappers.round_values, mappers.square_root, mappers.logarithm, mappers.transform_null, mappers.is_non_null),
        *(filters.value_filter, filters.remove_empty, filters.exclude_by_tag, filters.tag_compare, filters.where_tags, filters.sustain),
        *(labels.alias, labels.alias_by_tags, labels.show_tags, labels.tag_sub, labels.map_key),
        *(aggregate.aggregate, aggregate.percentile_of_series, aggregate.histogram_percentile),
        *(windows.keep_last_value, windows.derivative, windows.per_second, windows.integral, windows.changed),
        *(order.sort_series, order.head, order.tail, order.top_k),
        *(binary.as_percent, binary.divide, binary.diff, binary.intersect, binary.union, binary.fallback),
    )
}


def register_stage(name: str, stage: Callable[..., SeriesFrame]) -> None:
    """Adds a stage (frames..., **args) -> SeriesFrame under a name that plan nodes can use."""
    STAGES[name] = stage


class Engine:
    """Runs plans over a source with start (inclusive), end (exclusive) and step in ms."""

    def __init__(self, spark: SparkSession, source, start: int, end: int, step: int):
        if start >= end:
            raise ValueError("start must be before end")
        if step <= 0:
            raise ValueError("step must be positive")
        self.spark, self.source, self.start, self.end, self.step = spark, source, start, end, step
        self._seen: dict[tuple, SeriesFrame] = {}

    def m3(self, query: str) -> SeriesFrame:
        return self.run(m3.plan(query))

    def run(self, node: Node) -> SeriesFrame:
        return self._lower(node, self.start, self.end)

    def _lower(self, node: Node, start: int, end: int) -> SeriesFrame:
        """The frame of a sub-plan over [start, end). Equal sub-plans over equal ranges are one frame, so that Spark can reuse their exchanges."""
        key = (node.key(), start, end)
        if key not in self._seen:
            self._seen[key] = self._fresh(node, start, end)
        return self._seen[key]

    def _fresh(self, node: Node, start: int, end: int) -> SeriesFrame:
        a = dict(node.args)
        if node.op == "fetch":
            return self.source.fetch(Matchers(a["must"], a["must_not"]), start, end, self.step)
        if node.op == "mock_fetch":
            return mock_fetch(self.spark, a["values"], a["labels"], start, end, self.step)
        if node.op in ("moving", "per_second_rate"):
            # Fetch further back by whole steps, so that the grid keeps its place, and cut the result to the range.
            if node.op == "moving":
                w = a.pop("window")
                a["ms"] = int(w[:-2]) * self.step if w.endswith("pt") else duration_ms(w)
            wider = start - -(-a["ms"] // self.step) * self.step
            child = self._lower(node.children[0], wider, end)
            return mappers.truncate(getattr(windows, node.op)(child, **a), start, end)
        if node.op == "timeshift":
            return mappers.timeshift(self._lower(node.children[0], start - a["ms"], end - a["ms"]), a["ms"])
        if node.op == "widen":  # range vectors: further back, and not cut again
            return self._lower(node.children[0], start - a["ms"], end)
        if node.op == "prom_rate":
            return windows.per_second_rate(self._lower(node.children[0], start, end), a["ms"], a["unit"])
        if node.op == "summarize":
            align = a.pop("align_to_from")
            child = node.children[0]
            # A window below reaches back anyway; the first bucket is then whole.
            at = windows.bucket_start(start, a["ms"], windows.YEAR_ONE) if child.op in ("moving", "per_second_rate") and not align else start
            at = start - -(-(start - at) // self.step) * self.step
            return windows.summarize(self._lower(child, at, end), a["ms"], a["how"], start if align else None)
        if node.op == "fallback_constant":
            return binary.fallback_constant(self._lower(node.children[0], start, end), a["x"], start, end)
        return STAGES[node.op](*[self._lower(c, start, end) for c in node.children], **a)


def table(f: SeriesFrame, tags: list[str], *, alias: bool = False, rank: bool = False, digits: int | None = 6) -> DataFrame:
    """A flat result: label columns, ts, value (NaN as null, rounded), and on demand alias and the place in the order."""
    meta = order.ranked(f) if rank else f.meta
    extra = [c for c, on in (("alias", alias), ("ord", rank)) if on]
    meta = meta.select("sid", *[F.col("labels")[t].alias(t) for t in tags], *extra)
    value = F.when(~F.isnan("value"), F.col("value"))
    return f.points.join(meta, "sid").select(*tags, *extra, "ts", (F.round(value, digits) if digits is not None else value).alias("value"))
