"""Queries of the ingest path: the documents are streamed into blocks in the shared folder, and what stands there is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.lang import promql
from tidegrid.plans import m3
from tidegrid.queries.usable_sql import USABLE
from tidegrid.session import shared_folder
from tidegrid.sources.documents import canonical_text, parsed_value
from tidegrid.sources.output import read_blocks
from tidegrid.sources.tables import table
from tidegrid.streaming import ingest

DAY = 86_400_000
CUTOFF, BLOCK, CHUNK, SHARDS = 2 * DAY, DAY, DAY // 4, 16
#: A range of time that takes some of the blocks; when retention runs and how far back it keeps blocks; the last time at which a series counts as alive.
FROM, UNTIL = 1_741_824_000_000 + 3_600_000, 1_742_774_400_000
NOW, RETENTION, DEAD = 1_743_724_800_000, 14 * DAY, 1_742_774_400_000


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream: series_key, ts, value, event_time and seq, their order of arrival."""
    docs = spark.readStream.schema(table(spark, d, "tsdb_documents").schema).parquet(f"{d}/tsdb_documents[.]parquet")  # a pattern, as a stream takes no single file
    key = F.coalesce(F.concat(F.lit("L"), canonical_text(F.col("labels"))), F.concat(F.lit("R"), F.col("series_ref").cast("string")))
    s = docs.select(key.alias("series_key"), F.col("sample_ts").alias("ts"), parsed_value(F.col("sample_value"), F.col("value_text")).alias("value"), F.col("row_id").alias("seq"))
    return s.where("series_key is not null and ts is not null and value is not null").withColumn("event_time", F.timestamp_millis("ts"))


def _ingested(spark: SparkSession, d: str) -> str:
    """The folder with the blocks of all samples that are not too late."""
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    kept = ingest.reject_late(_stream(spark, d), CUTOFF, shard=F.pmod(F.length("series_key"), F.lit(SHARDS)))
    ingest.start_ingest(kept, f"{at}/blocks", f"{at}/progress", BLOCK, {"availableNow": True}).awaitTermination()
    return f"{at}/blocks"


def _compacted(spark: SparkSession, d: str) -> str:
    blocks = _ingested(spark, d)
    target = blocks.removesuffix("blocks") + "compact"
    starts = ingest.blocks(spark, blocks)
    for some in (starts[::2], starts[1::2]):  # in two runs, of which the second leaves the first one's blocks alone
        ingest.compact(spark, blocks, target, some)
    return target


def ingest_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The samples that come no later than the cutoff behind the newest of their shard."""
    return spark.read.parquet(_ingested(spark, d)).select("series_key", "ts", "value", "seq")


def ingest_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a range of time by block, of which only those that overlap it are read."""
    return read_blocks(spark, _ingested(spark, d), FROM, UNTIL, BLOCK).groupBy("block_start").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ingest_retained(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that retention leaves."""
    at = _ingested(spark, d)
    ingest.retain(spark, at, RETENTION, NOW, BLOCK)
    return spark.read.parquet(at).groupBy("block_start").agg(F.count(F.lit(1)).alias("n"))


def ingest_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Blocks after compaction: of repeated times the first sample to arrive stays."""
    return spark.read.parquet(_compacted(spark, d)).select("block_start", "series_key", "ts", "value", "seq")


def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of each series over the compacted samples."""
    s = spark.read.parquet(_compacted(spark, d)).withColumn("event_time", F.timestamp_millis("ts"))
    return ingest.chunks(s, CHUNK)


def ingest_series(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of series that the stream keeps, without those that are dead."""
    at = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    ingest.registry(_stream(spark, d), f"{at}/catalog", f"{at}/progress", {"availableNow": True}).awaitTermination()
    ingest.drop_series(spark, f"{at}/catalog", DEAD)
    return ingest.series(spark, f"{at}/catalog").select("series_key", "first_ts", "last_ts")


#: Texts and what comes of them: the operators of the plan, or the class of the error.
PLANS = {
    "fetch name:a | sum site | moving 1h avg": "moving aggregate fetch",
    "(fetch name:a | sum) | (fetch name:b | sum) | max": "aggregate union aggregate fetch aggregate fetch",
    "fetch name:a | anomalies": "Unimplemented",
    "fetch name:a | noSuchFunction": "ValueError",
    "fetch name:a | histogramPercentile id bucket 101": "ValueError",
    "fetch name:{a,b": "ParseError",
    "fetch name:a |": "ParseError",
    "sum | fetch name:a": "ValueError",
}


def plan_texts(spark: SparkSession, d: str) -> DataFrame:
    """Operators of planned queries, top down, and the errors of those that can't be planned."""
    rows = []
    for text in PLANS:
        try:
            found = " ".join(line.strip().split("(")[0] for line in m3.plan(text).explain().splitlines())
        except Exception as e:
            found = type(e).__name__
        rows.append((text, found))
    rows.append(("prom: sum by (a) (rate(m[5m]))", " ".join(line.strip().split("(")[0] for line in promql.plan("sum by (a) (rate(m[5m]))").explain().splitlines())))
    return spark.createDataFrame(rows, "query string, result string")


QUERIES = {f.__name__: f for f in (ingest_accepted, ingest_blocks, ingest_retained, ingest_compacted, ingest_chunks, ingest_series, plan_texts)}

_ALL = f"""WITH {USABLE},
all_ AS (SELECT CASE WHEN labels IS NOT NULL THEN 'L' || canon ELSE 'R' || series_ref END AS series_key, sample_ts AS ts, value, row_id AS seq FROM docs WHERE value IS NOT NULL AND (labels IS NOT NULL OR series_ref IS NOT NULL)),
kept AS (SELECT *, ts // {BLOCK} * {BLOCK} AS block_start FROM (SELECT *, max(ts) OVER (PARTITION BY length(series_key) % {SHARDS} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM all_) WHERE ts >= top - {CUTOFF}),
once AS (SELECT block_start, series_key, ts, arg_min(value, seq) AS value, min(seq) AS seq FROM kept GROUP BY ALL)"""

SQL = {
    "ingest_accepted": f"{_ALL} SELECT series_key, ts, value, seq FROM kept",
    "ingest_blocks": f"{_ALL} SELECT block_start, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM kept WHERE ts >= {FROM} AND ts < {UNTIL} GROUP BY ALL",
    "ingest_retained": f"{_ALL} SELECT block_start, count(*) AS n FROM kept WHERE block_start + {BLOCK} > {NOW - RETENTION} GROUP BY ALL",
    "ingest_compacted": f"{_ALL} SELECT block_start, series_key, ts, value, seq FROM once",
    "ingest_chunks": f"{_ALL} SELECT series_key, ts // {CHUNK} * {CHUNK} AS chunk_start, count(*) AS n, arg_min(value, ts) AS first, arg_max(value, ts) AS last, min(value) AS low, max(value) AS high FROM once GROUP BY ALL",
    "ingest_series": f"{_ALL} SELECT series_key, min(ts) AS first_ts, max(ts) AS last_ts FROM all_ GROUP BY ALL HAVING last_ts >= {DEAD}",
    "plan_texts": "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{r}')" for q, r in [*PLANS.items(), ("prom: sum by (a) (rate(m[5m]))", "aggregate prom_rate widen fetch")]) + ") t(query, result)",
}
