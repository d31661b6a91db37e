"""Queries p2, p3 and p5: regular grids, implausible readings, rolling totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.grid import regular_grid
from tidegrid.operators.rolling import rolling_totals
from tidegrid.operators.spikes import judged_readings
from tidegrid.queries.usable_sql import USABLE
from tidegrid.sources.documents import series_with_metric, usable_samples
from tidegrid.sources.tables import table


def _rounded(name: str, digits: int) -> Column:
    """Rounded for a comparison; the 1e-9 keeps ties from falling either way with the order of addition."""
    return F.round(F.col(name) + 1e-9, digits).alias(name)


def _series(spark: SparkSession, d: str) -> DataFrame:
    return series_with_metric(table(spark, d, "series_catalog"), table(spark, d, "metric_info"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    series = _series(spark, d).where("grid_ms is not null")
    return regular_grid(usable_samples(table(spark, d, "tsdb_documents"), series, ["grid_ms"]), series)


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every grid slot of every series with a grid: readings, time-weighted mean, coverage, status."""
    g = _grid(spark, d)
    return g.select("series_ref", "slot_ts", "n_readings", _rounded("mean", 6), F.round("coverage", 6).alias("coverage"), "status")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a usable sample: those in which no validity interval begins."""
    return _grid(spark, d).where("status <> 'observed'").select("series_ref", "slot_ts")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    series = _series(spark, d).where("grid_ms is not null")
    return judged_readings(usable_samples(table(spark, d, "tsdb_documents"), series, ["low_limit", "high_limit"]))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with its anomaly score and, if it is a case, the kind of case."""
    return _judged(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings."""
    return _judged(spark, d).where("kind is not null").select("series_ref", "sample_ts")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    series = _series(spark, d).where("metric_kind = 'counts'").withColumn("tenant", F.col("labels")["tenant"]).where("tenant is not null")
    return rolling_totals(usable_samples(table(spark, d, "tsdb_documents"), series, ["tenant"]), "tenant", (7, 30))


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of each tenant and day over the trailing 7 and 30 days."""
    r = _rolling(spark, d)
    return r.select("tenant", "day_utc", "window_days", "n_samples", *[_rounded(c, 4) for c in ("total", "mean_sample", "mean_day")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days on which no day of the trailing window was active."""
    return _rolling(spark, d).where("n_active_days = 0").select("tenant", "day_utc", "window_days")


_SLOTS = """slots AS (SELECT series_ref, grid_ms, unnest(generate_series(min_ts // grid_ms * grid_ms, max_ts // grid_ms * grid_ms, grid_ms)) AS slot_ts
    FROM series WHERE grid_ms IS NOT NULL AND min_ts <= max_ts)"""
_DAILY = """daily AS (SELECT labels['tenant'] AS tenant, (sample_ts // 86400000)::INT AS d, count(*) AS n, sum(value) AS s FROM usable
    WHERE metric_kind = 'counts' AND labels['tenant'] IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
span AS (SELECT tenant, unnest(generate_series(min(d), max(d)))::INT AS d FROM daily GROUP BY tenant),
wins AS (SELECT unnest([7, 30])::INT AS window_days),
roll AS (SELECT p.tenant, p.d, w.window_days, sum(COALESCE(x.n, 0))::BIGINT AS n, COALESCE(sum(x.s), 0.0) AS s
    FROM span p CROSS JOIN wins w LEFT JOIN daily x ON x.tenant = p.tenant AND x.d BETWEEN p.d - w.window_days + 1 AND p.d GROUP BY ALL)"""

QUERIES = {"p2_found": p2_found, "p2_grid": p2_grid, "p3_found": p3_found, "p3_scores": p3_scores, "p5_found": p5_found, "p5_rolling": p5_rolling}

SQL = {
    "p2_found": f"WITH {USABLE}, {_SLOTS} SELECT series_ref, slot_ts FROM slots s WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.series_ref = s.series_ref AND u.sample_ts // s.grid_ms * s.grid_ms = s.slot_ts)",
    "p2_grid": f"""WITH {USABLE}, {_SLOTS},
reads AS (SELECT series_ref, grid_ms, sample_ts AS ts, arg_min(value, row_id) AS v, count(*) AS n FROM usable WHERE grid_ms IS NOT NULL GROUP BY ALL),
held AS (SELECT *, least(COALESCE(lead(ts) OVER (PARTITION BY series_ref ORDER BY ts), ts + 2 * grid_ms), ts + 2 * grid_ms) AS until FROM reads),
counts AS (SELECT series_ref, ts // grid_ms * grid_ms AS slot_ts, sum(n)::BIGINT AS n FROM reads GROUP BY ALL),
parts AS (SELECT series_ref, grid_ms, v, ts, until, unnest(generate_series(ts // grid_ms * grid_ms, (until - 1) // grid_ms * grid_ms, grid_ms)) AS slot_ts FROM held WHERE NOT isnan(v) AND NOT isinf(v)),
cover AS (SELECT series_ref, slot_ts, sum(least(until, slot_ts + grid_ms) - greatest(ts, slot_ts)) AS covered, sum((least(until, slot_ts + grid_ms) - greatest(ts, slot_ts)) * v) AS area FROM parts GROUP BY ALL)
SELECT s.series_ref, s.slot_ts, COALESCE(c.n, 0)::BIGINT AS n_readings, round(a.area / a.covered + 1e-9, 6) AS mean, round(COALESCE(a.covered, 0) / s.grid_ms, 6) AS coverage,
    CASE WHEN c.n > 0 THEN 'observed' WHEN a.covered > 0 THEN 'carried' ELSE 'missing' END AS status
FROM slots s LEFT JOIN counts c USING (series_ref, slot_ts) LEFT JOIN cover a USING (series_ref, slot_ts)""",
    "p5_found": f"WITH {USABLE}, {_DAILY} SELECT tenant, strftime(DATE '1970-01-01' + d, '%Y-%m-%d') AS day_utc, window_days FROM roll WHERE n = 0",
    "p5_rolling": f"""WITH {USABLE}, {_DAILY} SELECT tenant, strftime(DATE '1970-01-01' + d, '%Y-%m-%d') AS day_utc, window_days, n AS n_samples, round(s + 1e-9, 4) AS total,
    CASE WHEN n > 0 THEN round(s / n + 1e-9, 4) END AS mean_sample, round(s / window_days + 1e-9, 4) AS mean_day FROM roll""",
}
