"""Rolling totals over trailing periods, by block decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_totals(samples: DataFrame, key: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals and averages of each key over the window_days days that end with each day: (key, day, window_days, n_samples, n_active_days, total, mean_sample, mean_day).

    samples: key, sample_ts (ms, UTC days), value. Every day from the key's first to its last active one has a row; a day is active if it has a sample that is not null and not NaN. Repeated rows count as often as they come. total is 0 where no sample lies in the window, mean_sample is then null; mean_day is total over window_days. Infinite values give an infinite (or NaN) total in just the windows that hold them. Rows with a null key or time are left out; an empty table gives no row.

    Samples are first summed per key and day, so what is shuffled and ordered holds at most one row per key and day. Days are then cut into blocks of the window's length: within a block, prefix sums run from its start and suffix sums to its end, and each trailing total is the suffix that starts with the window's first day, in the block before, plus the prefix that ends with its last day. No value is ever subtracted, and no block is larger than a window.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive numbers of days")
    day = F.floor(F.col("sample_ts") / F.lit(86_400_000.0)).cast("int")
    daily = (
        samples.where(F.col(key).isNotNull() & F.col("sample_ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(F.col(key).alias("k"), day.alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    )
    # Every (key, day) row fills the idle days up to the key's next active one; all of a key's rows are its active days.
    ahead = F.lead("d").over(Window.partitionBy("k").orderBy("d"))
    first = F.min("d").over(Window.partitionBy("k"))
    last = F.max("d").over(Window.partitionBy("k"))
    dense = daily.withColumns({"nxt": F.coalesce(ahead, F.col("d") + 1), "first": first, "last": last})
    dense = dense.withColumn("at", F.explode(F.sequence("d", F.col("nxt") - 1)))
    active = F.col("at") == F.col("d")
    dense = dense.select("k", "first", "last", F.col("at").alias("d"), *[F.when(active, F.col(c)).otherwise(F.lit(0)).cast(t).alias(c) for c, t in (("n", "long"), ("s", "double"))], active.cast("long").alias("a"))
    dense = dense.withColumn("w", F.explode(F.array(*[F.lit(int(w)) for w in windows])))
    block = F.floor(F.col("d") / F.col("w"))
    dense = dense.withColumn("b", block)
    up = Window.partitionBy("k", "w", "b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("k", "w", "b").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    sums = dense.withColumns({f"{c}_{side}": F.sum(c).over(w) for c in ("n", "s", "a") for side, w in (("pre", up), ("suf", down))})
    # A prefix belongs to the window that ends with its day; a suffix to the one that starts with it, if that does not fill its own block, which the prefix then covers.
    def part(at, side: str, end: bool):
        return F.struct(at.cast("int").alias("d"), *[F.col(f"{c}_{side}").alias(c) for c in ("n", "s", "a")], F.lit(end).alias("end"))

    d, w = F.col("d"), F.col("w")
    split = F.pmod(d, w) != 0
    none = F.array().cast("array<struct<d: int, n: bigint, s: double, a: bigint, end: boolean>>")
    # Where a window starts before the key's first day, its suffix would start in the idle past; the suffix from the first day on stands in for it, for windows that end in the next block.
    start, until = ((F.col("b") + 1) * w).cast("int"), F.least(d + w - 2, F.col("last")).cast("int")
    head = F.transform(F.sequence(start, F.greatest(start, until)), lambda at: part(at, "suf", False))
    parts = F.concat(F.array(part(d, "pre", True)), F.when(split, F.array(part(d + w - 1, "suf", False))).otherwise(none), F.when(split & (d == F.col("first")) & (start <= until), head).otherwise(none))
    total = sums.select("k", "w", F.explode(parts).alias("p")).groupBy("k", "w", "p.d").agg(F.sum("p.n").alias("n"), F.sum("p.s").alias("s"), F.sum("p.a").alias("a"), F.max("p.end").alias("end"))
    return total.where("end").select(
        F.col("k").alias(key),
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")), "yyyy-MM-dd").alias("day_utc"),
        F.col("w").cast("int").alias("window_days"),
        F.col("n").alias("n_samples"),
        F.col("a").alias("n_active_days"),
        F.col("s").alias("total"),
        F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean_sample"),
        (F.col("s") / F.col("w")).alias("mean_day"),
    )
