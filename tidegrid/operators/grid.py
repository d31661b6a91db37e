"""Irregular readings onto a regular grid, by validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: What a slot knows of its own readings.
_SUMMARY = "struct<n: bigint, first_ts: bigint, last_ts: bigint, last_value: double, covered: bigint, area: double>"


def regular_grid(readings: DataFrame, series: DataFrame, stale_slots: int = 2, block_slots: int = 64) -> DataFrame:
    """One row per series and grid slot, from the slot of min_ts to that of max_ts: (series_ref, slot_ts, n_readings, mean, coverage, last_value, status).

    Each reading holds from its time until the next reading of its series, at most for stale_slots grid steps: a step function. The intervals are cut at the slot borders; mean is the time-weighted average over the covered part of a slot (null where nothing finite covers it), coverage the covered share of the slot, n_readings the rows that fall into it, repeated ones included, and last_value the latest value that holds in it. status comes from the last interval that begins before the slot's end: `observed` if it begins in the slot, else `carried` if an earlier one covers part of the slot, else `missing`.

    readings: series_ref, sample_ts, value, row_id, grid_ms; of several rows at one time the first to arrive gives the value. series: series_ref, min_ts, max_ts, grid_ms. Series without a positive grid_ms or with min_ts after max_ts give no slot; NaN and infinite readings count as readings but cover nothing; an empty table gives an empty grid.

    Readings are spread by (series, slot), so that a hot series is shared by as many tasks as it has slots: de-duplication, the intervals within a slot and their sums run on that one shuffle and leave one row per slot. Those rows and the slots of the grid are then spread by (series, block of block_slots slots), where each slot learns which value reaches into it from before; a row that can reach into the next block is sent there as well.
    """
    if not 1 <= stale_slots < block_slots:
        raise ValueError("stale_slots must be at least 1 and less than block_slots")
    grid, ts = F.col("grid_ms"), F.col("ts")
    span, reach = grid * block_slots, grid * stale_slots

    def floor_to(x, step):
        return x - F.pmod(x, step)

    alive = series.where("grid_ms > 0 and min_ts <= max_ts").select("series_ref", "grid_ms", floor_to(F.col("min_ts"), grid).alias("first"), floor_to(F.col("max_ts"), grid).alias("last"))
    blocks = alive.withColumn("blk", F.explode(F.sequence(floor_to(F.col("first"), span), F.col("last"), span)))
    within = F.sequence(F.greatest("first", "blk"), F.least(F.col("last"), F.col("blk") + span - grid), grid)
    slots = blocks.select("series_ref", "blk", F.col("grid_ms"), F.explode(within).alias("slot"), F.lit(None).cast(_SUMMARY).alias("own"))

    rows = readings.where("grid_ms > 0").select("series_ref", "grid_ms", F.col("sample_ts").alias("ts"), "value", "row_id").withColumn("slot", floor_to(ts, grid))
    rows = rows.repartition("series_ref", "slot")
    once = rows.groupBy("series_ref", "slot", "grid_ms", "ts").agg(F.min_by("value", "row_id").alias("value"), F.count(F.lit(1)).alias("n"))
    following = F.lead("ts").over(Window.partitionBy("series_ref", "slot").orderBy("ts"))
    held = once.withColumn("held", F.least(F.coalesce(following, ts + reach), ts + reach, F.col("slot") + grid) - ts)
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    inside = held.groupBy("series_ref", "slot", "grid_ms").agg(
        F.sum("n").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max(F.when(F.col("held") > 0, ts)).alias("last_ts"),
        F.max_by("value", "ts").alias("last_value"),
        F.sum(F.when(finite, F.col("held"))).alias("covered"),
        F.sum(F.when(finite, F.col("held") * F.col("value"))).alias("area"),
    )
    own = floor_to(F.col("slot"), span)
    inside = inside.withColumn("blk", F.explode(F.when(F.col("last_ts") + reach > own + span, F.array(own, own + span)).otherwise(F.array(own))))
    inside = inside.select("series_ref", "blk", "grid_ms", "slot", F.struct("n", "first_ts", "last_ts", "last_value", "covered", "area").alias("own"))

    both = slots.withColumn("in_life", F.lit(1)).unionByName(inside.withColumn("in_life", F.lit(0))).repartition("series_ref", "blk")
    cells = both.groupBy("series_ref", "blk", "grid_ms", "slot").agg(F.max("own.n").alias("n"), *[F.max(f"own.{c}").alias(c) for c in ("first_ts", "last_ts", "last_value", "covered", "area")], F.max("in_life").alias("in_life"))
    earlier = Window.partitionBy("series_ref", "blk").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("n").isNotNull(), F.struct(F.col("last_ts").alias("ts"), F.col("last_value").alias("value"))), ignorenulls=True).over(earlier)
    cells = cells.withColumn("before", last).where("in_life = 1")
    reaches = F.greatest(F.least(F.col("before.ts") + reach, F.coalesce("first_ts", F.col("slot") + grid)) - F.col("slot"), F.lit(0))
    usable = ~F.isnan("before.value") & (F.abs("before.value") != float("inf"))
    cells = cells.withColumns({"carried": F.when(usable, reaches), "carried_value": F.when(usable & (reaches > 0), F.col("before.value"))})
    covered = F.coalesce("covered", F.lit(0)) + F.coalesce("carried", F.lit(0))
    area = F.coalesce("area", F.lit(0.0)) + F.coalesce(F.col("carried") * F.col("carried_value"), F.lit(0.0))
    n = F.coalesce("n", F.lit(0))
    begun = F.coalesce("last_ts", "before.ts") >= F.col("slot")
    return cells.select(
        "series_ref",
        F.col("slot").alias("slot_ts"),
        n.alias("n_readings"),
        F.when(covered > 0, area / covered).alias("mean"),
        (covered / grid).alias("coverage"),
        F.when(n > 0, F.col("last_value")).otherwise(F.col("carried_value")).alias("last_value"),
        F.when(begun, "observed").when(covered > 0, "carried").otherwise("missing").alias("status"),
    )
