"""Results as a Prometheus matrix, and sinks for samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame


def number_text(value: Column) -> Column:
    """A value as the matrix spells it."""
    inf = float("inf")
    return F.when(F.isnan(value), "NaN").when(value == inf, "+Inf").when(value == -inf, "-Inf").otherwise(value.cast("string"))


def matrix(f: SeriesFrame, metadata: bool = False) -> DataFrame:
    """(metric, alias, values): one row per series with metric as JSON, values as JSON [[seconds, "text"], ...] in order of time; with metadata also step, start and end. A series of the grid has at most as many values as the grid has points. Series without samples have an empty list."""
    pair = F.struct("ts", F.concat(F.lit("["), (F.col("ts") / 1000.0).cast("string"), F.lit(',"'), number_text(F.col("value")), F.lit('"]')).alias("text"))
    values = f.points.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["text"]), ",").alias("v"))
    entries = F.map_from_entries(F.array_sort(F.map_entries("labels")))
    extra = [(F.col("g_step")).alias("step"), F.col("g_min").alias("start"), F.col("g_max").alias("end")] if metadata else []
    return f.alive().meta.join(values, "sid", "left").select(F.to_json(entries).alias("metric"), "alias", F.concat(F.lit("["), F.coalesce("v", F.lit("")), F.lit("]")).alias("values"), *extra)


def response(f: SeriesFrame) -> dict:
    """The whole answer as the HTTP interface gives it: for results that are meant for one reader."""
    import json

    rows = matrix(f).collect()
    result = [{"metric": json.loads(r["metric"]), **({"alias": r["alias"]} if r["alias"] is not None else {}), "values": json.loads(r["values"])} for r in rows]
    return {"status": "success", "data": {"resultType": "matrix", "result": result}}


def explain(plan, frame: SeriesFrame | None = None) -> str:
    """Our own plan and, if the frame is given, Spark's plan of its samples."""
    text = plan.explain()
    if frame is not None:
        text += "\n\n" + frame.points._jdf.queryExecution().toString()
    return text


def write_blocks(samples: DataFrame, path: str, block_ms: int = 7_200_000, mode: str = "append") -> None:
    """Samples (labels or series_ref, ts, value, ...) into Parquet directories by block_start, from which readers prune by time."""
    block = (F.col("ts") - F.pmod(F.col("ts"), F.lit(block_ms))).alias("block_start")
    samples.withColumn("block_start", block).write.mode(mode).partitionBy("block_start").parquet(path)


def read_blocks(spark, path: str, start: int, end: int, block_ms: int = 7_200_000) -> DataFrame:
    """Samples of [start, end), reading only blocks that overlap it."""
    df = spark.read.parquet(path)
    return df.where((F.col("block_start") > start - block_ms) & (F.col("block_start") < end) & (F.col("ts") >= start) & (F.col("ts") < end))
