"""Streaming ingest of sample documents into Parquet blocks, with late-data rules, retention and compaction."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.sources.documents import canonical_text, parsed_value

#: Defaults in ms: how far behind the newest sample one may be, length of a chunk and of a block.
OOO_CUTOFF, CHUNK, BLOCK = 1_200_000, 1_200_000, 7_200_000
#: Samples that reject_late gives out at once.
PIECE = 100_000
DOCUMENT = "labels string, timestamp long, value string, reference long"


def documents(lines: DataFrame) -> DataFrame:
    """Samples from lines of JSON documents (column value): series_key, labels, series_ref, ts, value, event_time. A document without labels and reference, without a time or with an unreadable value is left out."""
    d = lines.select(F.from_json(F.col("value").cast("string"), DOCUMENT).alias("d")).select("d.*")
    d = d.select("labels", F.col("reference").alias("series_ref"), F.col("timestamp").alias("ts"), parsed_value(F.lit(None).cast("double"), F.col("value")).alias("value"))
    key = F.coalesce(F.concat(F.lit("L"), canonical_text(F.col("labels"))), F.concat(F.lit("R"), F.col("series_ref").cast("string")))
    return d.withColumn("series_key", key).where("series_key is not null and ts is not null and value is not null").withColumn("event_time", F.timestamp_millis("ts"))


def in_time(samples: DataFrame, cutoff_ms: int = OOO_CUTOFF) -> DataFrame:
    """Samples without repeats of one series and time, and without those that come later than the watermark allows. The watermark moves from batch to batch, so it is looser than reject_late within a batch."""
    return samples.withWatermark("event_time", f"{cutoff_ms} milliseconds").dropDuplicatesWithinWatermark(["series_key", "ts"])


def reject_late(samples: DataFrame, cutoff_ms: int = OOO_CUTOFF, shards: int = 16, shard: Column | None = None) -> DataFrame:
    """Exactly the samples that are not older than the newest one seen before in their shard less the cutoff, in order of arrival (column seq, ascending). A shard is a hash of the series, unless one is given; its state is one number, so hot series only need more shards. Of a micro-batch, a shard's times, values and order are held as arrays (24 bytes a sample) and given out in pieces; series are numbered."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        names: dict[str, int] = {}
        held = []
        for b in batches:
            codes = np.fromiter((names.setdefault(s, len(names)) for s in b["series_key"]), dtype=np.int32, count=len(b))
            held.append((codes, b["ts"].to_numpy(np.int64), b["value"].to_numpy(float), b["seq"].to_numpy(np.int64)))
        codes, ts, value, seq = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(seq, kind="stable")
        top = np.maximum.accumulate(ts[order])
        if newest is not None:
            top = np.maximum(top, newest)
        state.update((int(top[-1]),))
        kept = order[ts[order] >= top - cutoff_ms]
        text = np.array(list(names), dtype=object)
        for i in range(0, len(kept), PIECE):
            k = kept[i : i + PIECE]
            yield pd.DataFrame({"series_key": text[codes[k]], "ts": ts[k], "value": value[k], "seq": seq[k]})

    by = F.pmod(F.xxhash64("series_key"), F.lit(shards)) if shard is None else shard
    keyed = samples.where("value is not null").select("series_key", "ts", "value", "seq", by.cast("long").alias("shard"))
    kept = keyed.groupBy("shard").applyInPandasWithState(run, "series_key string, ts long, value double, seq long", "newest long", "append", GroupStateTimeout.NoTimeout)
    return kept.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # pandas gives NaN back as null


def registry(samples: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that keeps the catalog of series at path: (series_key, ref, first_ts, last_ts), one row per series. Each micro-batch adds the series it meets for the first time, with a reference that is a hash of the key, and widens the life of those it meets again; equal keys always get equal references, so getting and creating are one step. The catalog is written to a new version beside the old one and becomes the one that series() reads, so that a batch tried again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, number * 1000  # drop_series() puts its own between
        new = batch.groupBy("series_key").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        before = [v for v in _versions(spark, path) if v < version]
        if before:
            new = new.unionByName(spark.read.parquet(f"{path}/version={before[-1]}").drop("ref"))
        both = new.groupBy("series_key").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        both.select("series_key", F.xxhash64("series_key").alias("ref"), "first_ts", "last_ts").write.mode("overwrite").parquet(f"{path}/version={version}")
        _drop(spark, path, before[:-1])

    return samples.select("series_key", "ts").writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a catalog that were written to their end."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [(re.fullmatch(r"version=(\d+)", s.getPath().getName()), s.getPath()) for s in fs.listStatus(p)]
    return sorted(int(m[1]) for m, at in found if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def _drop(spark: SparkSession, path: str, versions: list[int]) -> None:
    fs, _ = _fs(spark, path)
    for v in versions:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)


def series(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of series as of the last batch."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def drop_series(spark: SparkSession, path: str, dead_before: int) -> None:
    """Takes series out of the catalog whose last sample is older than dead_before; to be run while no registry() is."""
    last = _versions(spark, path)[-1]
    series(spark, path).where(F.col("last_ts") >= dead_before).write.mode("overwrite").parquet(f"{path}/version={last + 1}")
    _drop(spark, path, [last])


def chunks(samples: DataFrame, chunk_ms: int = CHUNK, cutoff_ms: int = OOO_CUTOFF) -> DataFrame:
    """Tumbling windows per series: number, first, last, least and largest value, given out once the watermark has passed the window."""
    w = F.window("event_time", f"{chunk_ms} milliseconds")
    agg = samples.withWatermark("event_time", f"{cutoff_ms} milliseconds").groupBy("series_key", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"))
    return agg.select("series_key", F.unix_millis("w.start").alias("chunk_start"), "n", "first", "last", "low", "high")


def start_ingest(samples: DataFrame, path: str, checkpoint: str, block_ms: int = BLOCK, trigger: dict | None = None):
    """Starts a query that appends samples to path, in directories by block_start and, within, by batch. The checkpoint makes it go on where it ended, and a batch that is tried again replaces what it wrote before, so nothing is read twice; path belongs to one checkpoint. There is no list of files, so blocks may be dropped while the query runs."""
    block = (F.col("ts") - F.pmod(F.col("ts"), F.lit(block_ms))).alias("block_start")

    def write(batch: DataFrame, number: int) -> None:
        out = batch.drop("event_time").withColumns({"block_start": block, "batch": F.lit(number)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_start", "batch").parquet(path)

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def blocks(spark: SparkSession, path: str) -> list[int]:
    """Starts of the blocks in path, in order; there is one for each block length of the data's span."""
    fs, p = _fs(spark, path)
    found = [re.fullmatch(r"block_start=(-?\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted(int(m[1]) for m in found if m)


def retain(spark: SparkSession, path: str, retention_ms: int, now_ms: int | None = None, block_ms: int = BLOCK) -> list[int]:
    """Drops blocks that end retention_ms or more before now; returns their starts."""
    if retention_ms < block_ms:
        raise ValueError("retention must be at least the length of a block")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    fs, _ = _fs(spark, path)
    old = [b for b in blocks(spark, path) if b + block_ms <= now - retention_ms]
    for b in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/block_start={b}"), True)
    return old


def compact(spark: SparkSession, path: str, target: str, starts: list[int] | None = None, files: int = 1) -> None:
    """Blocks rewritten to target with `files` files each, sorted by series and time, so that row groups can be skipped by both; of equal series and times the first to arrive stays. Blocks are written by all executors at once: rows are dealt out by block and a part of the series, and a block's files do not depend on the number of blocks. A block that target has already is replaced by what path holds of it; its other blocks stay. path and target must differ."""
    if path.rstrip("/") == target.rstrip("/"):
        raise ValueError("compact: path and target must differ")
    df = spark.read.parquet(path).drop("batch")
    if starts is not None:
        df = df.where(F.col("block_start").isin(*starts))
    order = "seq" if "seq" in df.columns else "ts"
    cols = [c for c in df.columns if c not in ("series_key", "ts", "block_start")]
    once = df.groupBy("block_start", "series_key", "ts").agg(*[F.min_by(c, order).alias(c) for c in cols])
    part = F.pmod(F.xxhash64("series_key"), F.lit(files))
    once.repartition("block_start", part).sortWithinPartitions("block_start", "series_key", "ts").select(*df.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_start").parquet(target)


def tiers(retention_ms: int | None, block_ms: int = BLOCK) -> list[int]:
    """Lengths in ms of the size tiers: a block, then three times as long each, up to a tenth of the retention (without one, as with a long one, up to 31 days)."""
    out, top = [block_ms], 744 * 3_600_000
    limit = top if retention_ms is None else retention_ms // 10
    while out[-1] * 3 <= min(limit, top):
        out.append(out[-1] * 3)
    if limit > top and out[-1] < top:
        out.append(top)
    return out


def tier_plan(starts: list[int], lengths: list[int]) -> list[int]:
    """The blocks to be compacted next: of the lowest tier with a full range, or one that ended before the newest block, the first such range with more than one block. Empty if there is none. A range is aligned to its length."""
    newest = max(starts, default=0)
    for length in lengths[1:]:
        ranges: dict[int, list[int]] = {}
        for s in sorted(starts):
            ranges.setdefault(s // length * length, []).append(s)
        for at, group in sorted(ranges.items()):
            if len(group) > 1 and at + length <= newest:
                return group
    return []


def lag_listener(record):
    """A listener that calls record(name, batch, rows, lag_ms) for each batch: lag_ms from the newest event time seen to now, None without a watermark."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Lag(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            p = event.progress
            newest = p.eventTime.get("max") if p.eventTime else None
            lag = None if newest is None else int(time.time() * 1000 - pd.Timestamp(newest).timestamp() * 1000)
            record(p.name, p.batchId, p.numInputRows, lag)

        def onQueryTerminated(self, event):
            pass

    return Lag()
