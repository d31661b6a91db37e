"""A query for every operator of the pipe language over the events table, the stored query cases over the ingest documents, PromQL, statistics and sources; with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.lang import promql
from tidegrid.model import SeriesFrame
from tidegrid.plans import m3
from tidegrid.plans.lower import Engine
from tidegrid.plans.lower import table as flat
from tidegrid.queries.usable_sql import USABLE
from tidegrid.sources.output import matrix
from tidegrid.sources.scan import DocumentSource, TableSource, UnionSource, label_statistics, label_values
from tidegrid.sources.tables import table

HOUR = 3_600_000
STEP = 6 * HOUR
#: The whole span of the events table, from its first day to the end of its last.
START, END = 1_704_067_200_000, 1_706_659_200_000
LAST = END - STEP
TAGS = ["event_type", "user_id"]


def events_source(spark: SparkSession, d: str) -> TableSource:
    e = table(spark, d, "events")
    labels = {"name": F.lit("events"), "type": F.lit("gauge"), "event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")}
    return TableSource(e, labels, F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.col("event_id"))


def events_engine(spark: SparkSession, d: str, step: int = STEP) -> Engine:
    return Engine(spark, events_source(spark, d), START, END, step)


def _m3(query: str, tags: list[str], step: int = STEP, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: flat(events_engine(spark, d, step).m3(query), tags, **kw)


_BASE = f"""ev AS (SELECT event_type, user_id::VARCHAR AS user_id, epoch_ms(ts) AS t, value, event_id FROM events WHERE value IS NOT NULL AND epoch_ms(ts) >= {START} AND epoch_ms(ts) < {END}),
pts AS (SELECT event_type, user_id, {START} + (t - {START}) // {STEP} * {STEP} AS ts, arg_max(value, (t, event_id)) AS v FROM ev GROUP BY ALL),
ser AS (SELECT DISTINCT event_type, user_id FROM pts),
grid AS (SELECT *, unnest(generate_series({START}, {LAST}, {STEP})) AS ts FROM ser),
dense AS (SELECT g.*, p.v FROM grid g LEFT JOIN pts p USING (event_type, user_id, ts)),
bytype AS (SELECT event_type, ts, sum(v) AS v FROM pts GROUP BY ALL),
total AS (SELECT ts, sum(v) AS v FROM pts GROUP BY ALL)"""
_S = "PARTITION BY event_type, user_id"


def _sql(body: str) -> str:
    return f"WITH {_BASE}, {body}" if body.lstrip().startswith("x AS") else f"WITH {_BASE} {body}"


def _map(expr: str, where: str = "true", source: str = "pts") -> str:
    return _sql(f"SELECT event_type, user_id, ts, round({expr}, 6) AS value FROM {source} WHERE {where}")


def _group(expr: str, tags: str = "event_type") -> str:
    return _sql(f"SELECT {tags}, ts, round({expr}, 6) AS value FROM pts GROUP BY {tags}, ts")


def _moving(fn: str, n: int) -> str:
    return _sql(f"x AS (SELECT *, {fn} OVER ({_S} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS m FROM dense) SELECT event_type, user_id, ts, round(m, 6) AS value FROM x WHERE m IS NOT NULL")


def _sorted(key: str, down: bool = True, where: str = "true", value: str = "round(v, 6)") -> str:
    return _sql(
        f"""x AS (SELECT event_type, user_id, row_number() OVER (ORDER BY {key} {"DESC" if down else "ASC"}, 'vevents' || chr(1) || 'vgauge' || chr(1) || 'v' || event_type || chr(1) || 'v' || user_id) AS ord FROM pts GROUP BY event_type, user_id)
        SELECT event_type, user_id, ord::INT AS ord, ts, {value} AS value FROM x JOIN pts USING (event_type, user_id) WHERE {where}"""
    )


def _nearest(p: float, interpolate: bool = False) -> str:
    value = f"l[greatest(ceil({p / 100.0} * n)::INT, 1)]"
    if interpolate:
        value = f"CASE WHEN ceil({p / 100.0} * n) <= 1 THEN l[1] ELSE l[ceil({p / 100.0} * n)::INT - 1] + ({p / 100.0} * n - (ceil({p / 100.0} * n) - 1)) * (l[ceil({p / 100.0} * n)::INT] - l[ceil({p / 100.0} * n)::INT - 1]) END"
    return f"SELECT event_type, '{p:g}' AS __percentile, ts, round({value}, 6) AS value FROM x"


_LIST = "x AS (SELECT event_type, ts, list_sort(list(v)) AS l, count(*) AS n FROM pts GROUP BY ALL)"
_ROLL = f"x AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > {STEP} THEN 1 ELSE 0 END) OVER ({_S} ORDER BY ts) AS part FROM (SELECT *, lag(ts) OVER ({_S} ORDER BY ts) AS prev FROM pts))"
_RATE = """x AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
    last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM ({source})),
y AS (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN ts - pt <= {ms} THEN (CASE WHEN v < pv THEN v ELSE v - pv END) * 1000.0 / (ts - pt) ELSE 'nan'::DOUBLE END END AS own FROM x),
z AS (SELECT *, first_value(CASE WHEN pt IS NULL AND v IS NOT NULL THEN 'nan'::DOUBLE ELSE own END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM y),
w AS (SELECT {k}, ts, avg(CASE WHEN NOT isnan(r) THEN r END) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS m, count(CASE WHEN NOT isnan(r) THEN r END) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS c FROM z)"""
_TYPES = f"SELECT t.event_type, g.ts, b.v FROM (SELECT DISTINCT event_type FROM bytype) t CROSS JOIN (SELECT unnest(generate_series({START}, {LAST}, {STEP})) AS ts) g LEFT JOIN bytype b USING (event_type, ts)"

H12, H18, H36 = 12 * HOUR, 18 * HOUR, 36 * HOUR
_MIXED = "(fetch name:events event_type:click | summarize 12h sum) | (fetch name:events event_type:purchase)"
_RIGHT = "(fetch name:events | summarize 18h avg true | sum)"


def _cell(step: int) -> str:
    return f"{START} + (ts - {START}) // {step} * {step}"


#: mix: click in steps of 12 h, purchase of 6 h; r18: one series in steps of 18 h.
_TWO_STEPS = f"""x AS (SELECT event_type, user_id, {_cell(H12)} AS ts, sum(v) AS v FROM pts WHERE event_type = 'click' GROUP BY ALL),
    mix AS (SELECT * FROM x UNION ALL SELECT event_type, user_id, ts, v FROM pts WHERE event_type = 'purchase'),
    r18 AS (SELECT ts, sum(v) AS v FROM (SELECT event_type, user_id, {_cell(H18)} AS ts, avg(v) AS v FROM pts GROUP BY ALL) GROUP BY ts)"""


def _at(step: int, of: str, keys: str = "event_type, user_id, ") -> str:
    return f"(SELECT {keys}{_cell(step)} AS ts, avg(v) AS v FROM {of} GROUP BY ALL)"


#: name -> (query, label columns, SQL, options of the result)
_CASES: dict[str, tuple] = {
    "m3_fetch": ("fetch name:events", TAGS, _map("v"), {}),
    "m3_fetch_values": ("fetch name:events event_type:{click,purchase}", TAGS, _map("v", "event_type IN ('click', 'purchase')"), {}),
    "m3_fetch_wildcard": ("fetch name:events user_id:1*", TAGS, _map("v", "user_id LIKE '1%'"), {}),
    "m3_fetch_question": ("fetch name:ev?nts user_id:?5", TAGS, _map("v", "user_id LIKE '_5'"), {}),
    "m3_fetch_negated": ("fetch name:events event_type:!{click,v*}", TAGS, _map("v", "event_type <> 'click' AND event_type NOT LIKE 'v%'"), {}),
    "m3_abs": ("fetch name:events | offset -250 | abs", TAGS, _map("abs(v - 250)"), {}),
    "m3_scale": ("fetch name:events | scale 2.5", TAGS, _map("v * 2.5"), {}),
    "m3_scale_to_seconds": ("fetch name:events | scaleToSeconds 60", TAGS, _map(f"v * 60 / {STEP / 1000}"), {}),
    "m3_offset": ("fetch name:events | offset 10", TAGS, _map("v + 10"), {}),
    "m3_divide_scalar": ("fetch name:events | divideScalar 4", TAGS, _map("v / 4"), {}),
    "m3_round": ("fetch name:events | offset -250 | round 1", TAGS, _map("floor((v - 250) * 10 + 0.5) / 10"), {}),
    "m3_sqrt": ("fetch name:events | sqrt", TAGS, _map("sqrt(v)"), {}),
    "m3_logarithm": ("fetch name:events | logarithm", TAGS, _map("log10(v)"), {}),
    "m3_timeshift": ("fetch name:events | timeshift 1d", TAGS, _sql(f"SELECT event_type, user_id, ts + 86400000 AS ts, round(v, 6) AS value FROM pts WHERE ts + 86400000 < {END}"), {}),
    "m3_transform_null": ("fetch name:events | transformNull -1", TAGS, _map("COALESCE(v, -1)", source="dense"), {}),
    "m3_is_non_null": ("fetch name:events | isNonNull", TAGS, _map("CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE", source="dense"), {}),
    **{f"m3_{op}": (f"fetch name:events | {op} 100", TAGS, _map("v", f"v {sign} 100"), {}) for op, sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="))},
    "m3_remove_below": ("fetch name:events | removeBelowValue 50", TAGS, _map("v", "v >= 50"), {}),
    "m3_remove_above": ("fetch name:events | removeAboveValue 50", TAGS, _map("v", "v <= 50"), {}),
    "m3_remove_empty": ("fetch name:events | > 400 | removeEmpty | count event_type", ["event_type"], _sql("x AS (SELECT event_type, count(DISTINCT user_id) AS n FROM pts WHERE v > 400 GROUP BY event_type) SELECT event_type, ts, n::DOUBLE AS value FROM x, (SELECT DISTINCT ts FROM grid)"), {}),
    "m3_exclude_by_tag": ('fetch name:events | excludeByTag event_type "^c" "^p"', TAGS, _map("v", "event_type NOT LIKE 'c%' AND event_type NOT LIKE 'p%'"), {}),
    "m3_tag_compare": ('fetch name:events | tagCompare ">=" "event_type:login"', TAGS, _map("v", "event_type >= 'login'"), {}),
    "m3_where": ('fetch name:events | mapKey user_id other | tagSub other "^1[0-9]$" "click" | where eq event_type other', ["event_type", "other"], _sql("SELECT event_type, 'click' AS other, ts, round(v, 6) AS value FROM pts WHERE event_type = 'click' AND regexp_full_match(user_id, '1[0-9]')"), {}),
    "m3_where_different": ('fetch name:events | mapKey user_id other | tagSub other "^[1-4]?[0-9]$" "click" | where neq event_type other', ["event_type", "other"], _sql("x AS (SELECT *, CASE WHEN regexp_full_match(user_id, '[1-4]?[0-9]') THEN 'click' ELSE user_id END AS other FROM pts) SELECT event_type, other, ts, round(v, 6) AS value FROM x WHERE event_type <> other"), {}),
    "m3_tag_compare_version": ('fetch name:events | tagSub user_id "^(.*)$" "v1.$1.0" | tagCompare "<" "user_id:1.9.0-rc.1"', TAGS, _sql("SELECT event_type, 'v1.' || user_id || '.0' AS user_id, ts, round(v, 6) AS value FROM pts WHERE user_id::INT < 9"), {}),
    "m3_nan_values": ("fetch name:events | offset -250 | sqrt", TAGS, _map("CASE WHEN v >= 250 THEN sqrt(v - 250) END"), {}),
    "m3_nan_transform_null": ("fetch name:events | offset -250 | sqrt | transformNull -1", TAGS, _map("CASE WHEN v >= 250 THEN sqrt(v - 250) ELSE -1 END", source="dense"), {}),
    "m3_nan_avg": ("fetch name:events | offset -250 | sqrt | avg event_type", ["event_type"], _sql("SELECT event_type, ts, round(avg(sqrt(v - 250)), 6) AS value FROM pts WHERE v >= 250 GROUP BY ALL"), {}),
    "m3_empty_series_count": ("fetch name:events | > 400 | count event_type", ["event_type"], _sql("x AS (SELECT event_type, count(*) AS n FROM ser GROUP BY event_type) SELECT event_type, ts, n::DOUBLE AS value FROM x, (SELECT DISTINCT ts FROM grid)"), {}),
    "m3_sustain": ("fetch name:events | sustain 12h", TAGS, _sql(f"x AS (SELECT *, row_number() OVER ({_S} ORDER BY ts) AS n FROM pts) SELECT event_type, user_id, ts, round(v, 6) AS value FROM x WHERE n >= 2"), {}),
    "m3_sum": ("fetch name:events | sum event_type", ["event_type"], _group("sum(v)"), {}),
    "m3_sum_all": ("fetch name:events | sumSeries", [], _sql("SELECT ts, round(v, 6) AS value FROM total"), {}),
    "m3_avg": ("fetch name:events | avg event_type", ["event_type"], _group("avg(v)"), {}),
    "m3_min": ("fetch name:events | minSeries event_type", ["event_type"], _group("min(v)"), {}),
    "m3_max": ("fetch name:events | max user_id", ["user_id"], _group("max(v)", "user_id"), {}),
    "m3_multiply": ("fetch name:events | divideScalar 250 | multiply user_id", ["user_id"], _group("product(v / 250)", "user_id"), {}),
    "m3_range": ("fetch name:events | range event_type", ["event_type"], _group("max(v) - min(v)"), {}),
    "m3_count": ("fetch name:events | count event_type", ["event_type"], _sql("x AS (SELECT event_type, count(*) AS n FROM ser GROUP BY event_type) SELECT event_type, ts, n::DOUBLE AS value FROM x, (SELECT DISTINCT ts FROM grid)"), {}),
    "m3_group_missing_tag": ("fetch name:events | sum no_such_tag", [], _sql("SELECT ts, v AS value FROM total WHERE false"), {}),
    "m3_percentile_of_series": ("fetch name:events | percentileOfSeries 25 99.5 event_type", ["event_type", "__percentile"], _sql(f"{_LIST} {_nearest(25)} UNION ALL {_nearest(99.5)}"), {}),
    "m3_percentile_interpolated": ("fetch name:events | percentileOfSeries 90 true event_type", ["event_type", "__percentile"], _sql(f"{_LIST} {_nearest(90, True)}"), {}),
    "m3_median": ("fetch name:events | median event_type", ["event_type", "__percentile"], _sql(f"{_LIST} {_nearest(50)}"), {}),
    "m3_as_percent": ("fetch name:events | sum event_type | asPercent(fetch name:events | sum)", ["event_type"], _sql("SELECT event_type, ts, round(b.v / t.v * 100, 6) AS value FROM bytype b JOIN total t USING (ts)"), {}),
    "m3_as_percent_tags": ("fetch name:events | asPercent(fetch name:events | sum event_type) event_type", TAGS, _sql("SELECT event_type, user_id, ts, round(p.v / b.v * 100, 6) AS value FROM pts p JOIN bytype b USING (event_type, ts)"), {}),
    "m3_divide": ("fetch name:events event_type:click | divide(fetch name:events event_type:purchase) user_id", ["user_id"], _sql("SELECT a.user_id, a.ts, round(a.v / b.v, 6) AS value FROM pts a JOIN pts b ON a.user_id = b.user_id AND a.ts = b.ts AND a.event_type = 'click' AND b.event_type = 'purchase'"), {}),
    "m3_diff": ("fetch name:events event_type:click | diff(fetch name:events event_type:purchase) user_id", ["user_id"], _sql("""x AS (SELECT user_id, ts, a.v AS l, b.v AS r FROM (SELECT * FROM pts WHERE event_type = 'click') a FULL JOIN (SELECT * FROM pts WHERE event_type = 'purchase') b USING (user_id, ts))
        SELECT user_id, ts, round(COALESCE(l, 0) - COALESCE(r, 0), 6) AS value FROM x WHERE user_id IN (SELECT user_id FROM ser WHERE event_type = 'click') AND user_id IN (SELECT user_id FROM ser WHERE event_type = 'purchase')"""), {}),
    "m3_diff_keep_nans": ("fetch name:events event_type:click | diff(fetch name:events event_type:purchase) true user_id", ["user_id"], _sql("SELECT a.user_id, a.ts, round(a.v - b.v, 6) AS value FROM pts a JOIN pts b ON a.user_id = b.user_id AND a.ts = b.ts AND a.event_type = 'click' AND b.event_type = 'purchase'"), {}),
    "m3_intersect": ("fetch name:events event_type:click | intersect(fetch name:events event_type:purchase) user_id", ["user_id"], _sql("SELECT user_id, ts, round(v, 6) AS value FROM pts WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM ser WHERE event_type = 'purchase')"), {}),
    "m3_fallback_series": ("fetch name:nothing | fallbackSeries(fetch name:events event_type:click)", TAGS, _map("v", "event_type = 'click'"), {}),
    "m3_fallback_constant": ("fetch name:nothing | fallbackSeries 7 | summarize 1d sum", [], f"SELECT {START} + i * 86400000 AS ts, 604800.0::DOUBLE AS value FROM range(30) t(i)", {}),
    "m3_fallback_unused": ("fetch name:events event_type:click | fallbackSeries 7", TAGS, _map("v", "event_type = 'click'"), {}),
    "m3_union": ("(fetch name:events event_type:click | sum) | (fetch name:events | sum)", [], _sql("SELECT ts, round(sum(v), 6) AS value FROM pts WHERE event_type = 'click' GROUP BY ts UNION ALL SELECT ts, round(v, 6) FROM total"), {}),
    "m3_union_function": ("fetch name:events event_type:click | sum | union(fetch name:events event_type:purchase | sum) | avg", [], _sql("x AS (SELECT event_type, ts, v FROM bytype WHERE event_type IN ('click', 'purchase')) SELECT ts, round(avg(v), 6) AS value FROM x GROUP BY ts"), {}),
    "m3_macros": ("a = (fetch name:events event_type:click | sum);\nb = (fetch name:events event_type:purchase | sum); # two groups\na | b | max", [], _sql("x AS (SELECT ts, v FROM bytype WHERE event_type IN ('click', 'purchase')) SELECT ts, round(max(v), 6) AS value FROM x GROUP BY ts"), {}),
    **{f"m3_moving_{fn}": (f"fetch name:events | moving 1d {fn}", TAGS, _moving(f"{fn}(v)", 4), {}) for fn in ("sum", "avg", "min", "max")},
    "m3_moving_median": ("fetch name:events | movingMedian 2d", TAGS, _sql(f"x AS (SELECT *, list_sort(list(v) FILTER (v IS NOT NULL) OVER ({_S} ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS l FROM dense) SELECT event_type, user_id, ts, round(l[(len(l) + 1) // 2], 6) AS value FROM x WHERE len(l) > 0"), {}),
    "m3_moving_long_median": ("fetch name:events | movingMedian 10d", TAGS, _sql(f"x AS (SELECT *, list_sort(list(v) FILTER (v IS NOT NULL) OVER ({_S} ORDER BY ts ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)) AS l FROM dense) SELECT event_type, user_id, ts, round(l[(len(l) + 1) // 2], 6) AS value FROM x WHERE len(l) > 0"), {}),
    "m3_moving_points": ("fetch name:events | moving 3 sum", TAGS, _moving("sum(v)", 3), {}),
    **{f"m3_moving_long_{fn}": (f"fetch name:events | moving 7d {fn}", TAGS, _moving(f"{fn}(v)", 28), {}) for fn in ("sum", "avg", "min", "max")},
    "m3_keep_last_value": ("fetch name:events | keepLastValue 1d", TAGS, _sql(f"x AS (SELECT *, last_value(v IGNORE NULLS) OVER ({_S} ORDER BY ts) AS l, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER ({_S} ORDER BY ts) AS lt FROM dense) SELECT event_type, user_id, ts, round(l, 6) AS value FROM x WHERE ts - lt <= 86400000"), {}),
    "m3_derivative": ("fetch name:events | derivative", TAGS, _sql(f"x AS (SELECT *, v - lag(v) OVER ({_S} ORDER BY ts) AS d, ts - lag(ts) OVER ({_S} ORDER BY ts) AS g FROM pts) SELECT event_type, user_id, ts, round(d, 6) AS value FROM x WHERE g = {STEP}"), {}),
    "m3_per_second": ("fetch name:events | perSecond", TAGS, _sql(f"x AS (SELECT *, v - lag(v) OVER ({_S} ORDER BY ts) AS d, ts - lag(ts) OVER ({_S} ORDER BY ts) AS g FROM pts) SELECT event_type, user_id, ts, round(d / (g / 1000.0), 9) AS value FROM x WHERE d >= 0"), {"digits": 9}),
    "m3_per_second_rate": ("fetch name:events | sum event_type | perSecondRate 12h", ["event_type"], _sql(_RATE.format(k="event_type", source=_TYPES, ms=12 * HOUR, n=2) + " SELECT event_type, ts, round(m, 9) AS value FROM w WHERE c = 2"), {"digits": 9}),
    "m3_integral": ("fetch name:events | integral", TAGS, _sql(f"SELECT event_type, user_id, ts, round(sum(v) OVER ({_S} ORDER BY ts), 6) AS value FROM pts"), {}),
    "m3_integral_reset": ("fetch name:events | integral true", TAGS, _sql(f"{_ROLL} SELECT event_type, user_id, ts, round(sum(v) OVER (PARTITION BY event_type, user_id, part ORDER BY ts), 6) AS value FROM x"), {}),
    "m3_changed": ("fetch name:events | changed", TAGS, _sql(f"x AS (SELECT *, last_value(v IGNORE NULLS) OVER ({_S} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM dense) SELECT event_type, user_id, ts, CASE WHEN v IS NOT NULL AND l IS NOT NULL AND v <> l THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM x"), {}),
    **{f"m3_summarize_{fn}": (f"fetch name:events | summarize 2d {fn}", TAGS, _sql(f"SELECT event_type, user_id, -62135596800000 + (ts + 62135596800000) // 172800000 * 172800000 AS ts, round({sql}, 6) AS value FROM pts GROUP BY ALL"), {}) for fn, sql in (("sum", "sum(v)"), ("avg", "avg(v)"), ("max", "max(v)"), ("min", "min(v)"), ("last", "arg_max(v, pts.ts)"), ("stddev", "COALESCE(stddev_samp(v), 0)"), ("p75", "list_sort(list(v))[greatest(ceil(0.75 * count(*))::INT, 1)]"))},
    "m3_summarize_from_start": ("fetch name:events | summarize 18h avg true", TAGS, _sql(f"SELECT event_type, user_id, {START} + (ts - {START}) // 64800000 * 64800000 AS ts, round(avg(v), 6) AS value FROM pts GROUP BY ALL"), {}),
    **{f"m3_sort_{by}": (f"fetch name:events | {'round | ' if by == 'sum' else ''}sort {by} {'desc' if down else 'asc'}", TAGS, _sorted(key, down, value="floor(v + 0.5)" if by == "sum" else "round(v, 6)"), {"rank": True}) for by, key, down in (("avg", "avg(v)", True), ("current", "arg_max(v, ts)", True), ("max", "max(v)", False), ("min", "min(v)", True), ("sum", "sum(floor(v + 0.5))", False))},
    "m3_sort_stddev": ("fetch name:events | sort stddev desc", TAGS, _sorted("stddev_samp(v)", True).replace("stddev_samp(v) DESC", "stddev_samp(v) DESC NULLS LAST"), {"rank": True}),
    "m3_sort_name": ("fetch name:events | aliasByTags user_id event_type | sort name asc", TAGS, _sorted("user_id || ' ' || event_type", False), {"rank": True}),
    "m3_top_k": ("fetch name:events | topK 7 max", TAGS, _sorted("max(v)", True, "ord <= 7"), {"rank": True}),
    "m3_head": ("fetch name:events | round | sort sum desc | head 4", TAGS, _sorted("sum(floor(v + 0.5))", True, "ord <= 4", "floor(v + 0.5)"), {"rank": True}),
    "m3_tail": ("fetch name:events | round | sort sum desc | tail 4", TAGS, _sql("x AS (SELECT event_type, user_id, row_number() OVER (ORDER BY sum(floor(v + 0.5)) ASC, 'vevents' || chr(1) || 'vgauge' || chr(1) || 'v' || event_type || chr(1) || 'v' || user_id DESC) AS ord FROM pts GROUP BY event_type, user_id) SELECT event_type, user_id, (5 - ord)::INT AS ord, ts, floor(v + 0.5) AS value FROM x JOIN pts USING (event_type, user_id) WHERE ord <= 4"), {"rank": True}),
    "m3_alias": ('fetch name:events | alias "type {{.event_type}} of {{.nobody}}"', TAGS, _sql("SELECT event_type, user_id, 'type ' || event_type || ' of nobody' AS alias, ts, round(v, 6) AS value FROM pts"), {"alias": True}),
    "m3_alias_by_tags": ("fetch name:events | aliasByTags event_type missing user_id", TAGS, _sql("SELECT event_type, user_id, event_type || ' ' || user_id AS alias, ts, round(v, 6) AS value FROM pts"), {"alias": True}),
    "m3_show_tags": ("fetch name:events | showTags", TAGS, _sql("SELECT event_type, user_id, 'event_type:' || event_type || ' name:events type:gauge user_id:' || user_id AS alias, ts, round(v, 6) AS value FROM pts"), {"alias": True}),
    "m3_tag_sub": ('fetch name:events | tagSub event_type "^(.)(.*)$" "\\1-$2"', TAGS, _sql("SELECT event_type[1] || '-' || event_type[2:] AS event_type, user_id, ts, round(v, 6) AS value FROM pts"), {}),
    "m3_map_key": ("fetch name:events | mapKey user_id account", ["event_type", "account"], _sql("SELECT event_type, user_id AS account, ts, round(v, 6) AS value FROM pts"), {}),
    "m3_sum_mixed_steps": (f"{_MIXED} | sum", [], _sql(f"{_TWO_STEPS} SELECT ts, round(sum(v), 6) AS value FROM {_at(H12, 'mix')} GROUP BY ts"), {}),
    "m3_as_percent_mixed_steps": (f"{_MIXED} | asPercent{_RIGHT}", TAGS, _sql(f"{_TWO_STEPS} SELECT event_type, user_id, ts, round(l.v / r.v * 100, 6) AS value FROM {_at(H36, 'mix')} l JOIN {_at(H36, 'r18', '')} r USING (ts)"), {}),
    "m3_divide_mixed_steps": (f"{_MIXED} | divide{_RIGHT}", TAGS, _sql(f"""{_TWO_STEPS} SELECT event_type, user_id, ts, round(l.v / r.v, 9) AS value FROM {_at(H36, "(FROM mix WHERE event_type = 'click')")} l JOIN {_at(H36, 'r18', '')} r USING (ts)
        UNION ALL SELECT event_type, user_id, ts, round(l.v / r.v, 9) FROM {_at(H18, "(FROM mix WHERE event_type = 'purchase')")} l JOIN r18 r USING (ts)"""), {"digits": 9}),
    "m3_moving_mixed_steps": (f"{_MIXED} | moving 1d sum", TAGS, _sql(f"""{_TWO_STEPS}, every AS (SELECT event_type, user_id, unnest(generate_series({START}, {LAST}, CASE event_type WHEN 'click' THEN {H12} ELSE {STEP} END)) AS ts FROM ser WHERE event_type IN ('click', 'purchase')),
        y AS (SELECT event_type, user_id, ts, CASE event_type WHEN 'click' THEN sum(v) OVER ({_S} ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) ELSE sum(v) OVER ({_S} ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS m FROM every LEFT JOIN mix USING (event_type, user_id, ts))
        SELECT event_type, user_id, ts, round(m, 6) AS value FROM y WHERE m IS NOT NULL"""), {}),
    "m3_mock_fetch": ("mockFetch 1,2,nan,4 name:mock env:test | scale 2", ["name", "env"], f"SELECT 'mock' AS name, 'test' AS env, {START} + i * {STEP} AS ts, v AS value FROM (VALUES (0, 2.0::DOUBLE), (1, 4.0), (3, 8.0)) x(i, v)", {}),
}

def m3_histogram_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over buckets: order counts by price band, the bands being series."""
    o = table(spark, d, "orders")
    band = F.floor(F.col("o_totalprice") / 50_000).cast("int")
    low = (band * 50_000).cast("string")
    labels = {"name": F.lit("orders"), "orderpriority": F.col("o_orderpriority"), "bucketid": band.cast("string"), "bucket": F.concat(low, F.lit("-"), ((band + 1) * 50_000).cast("string"))}
    day = F.unix_millis(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    counts = o.select(*[c.alias(n) for n, c in labels.items()], day.alias("t")).groupBy(*labels, "t").agg(F.count(F.lit(1)).cast("double").alias("value"))
    src = TableSource(counts, {n: F.col(n) for n in labels}, F.col("t"), F.col("value"), F.col("t"))
    span = 86_400_000
    e = Engine(spark, src, _ORDERS_START, _ORDERS_END, span)
    return flat(e.m3("fetch name:orders | histogramPercentile bucketid bucket 50 95"), ["orderpriority", "histogramPercentile"])


_ORDERS_START, _ORDERS_END = 631_152_000_000, 1_893_456_000_000


def _cases(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = table(spark, d, "query_cases").where(F.col("query_name") == name).head()
        source = DocumentSource(table(spark, d, "tsdb_documents"), table(spark, d, "series_catalog"), c["index_name"])
        f = Engine(spark, source, c["min_ts"], c["max_ts"], c["step_ms"]).m3(c["query_text"])
        return labelled(f)

    return run


def labelled(f: SeriesFrame) -> DataFrame:
    """labels as sorted text, alias, ts and value."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    meta = f.meta.select("sid", F.array_join(pairs, ",").alias("labels"), "alias")
    return f.points.join(meta, "sid").select("labels", "alias", "ts", F.round(F.when(~F.isnan("value"), F.col("value")), 6).alias("value"))


CASE_NAMES = "temp_by_site flow_gaps humidity_p95 voltage_dips fan_range queue_change pressure_shift gate_load latency_p50_p99 errors_share pods_live not_get units_7d records_30d export_daily both_usage".split()


#: Queries like stored ones whose range holds no samples at small scales, over the whole life of the series: text, index, step.
_WIDE_START, _WIDE_END = 1_740_960_000_000, 1_751_414_400_000
WIDE = {
    "docs_flow_gaps": ("fetch name:coolant_flow_lpm | keepLastValue 10m | isNonNull", "metrics-sensor", HOUR),
    "docs_voltage_dips": ("fetch name:bus_voltage_v | removeAboveValue 48 | removeEmpty", "metrics-sensor", HOUR),
    "docs_fan_range": ("fetch name:fan_speed_rpm | range zone | sort max desc | head 5", "metrics-sensor", HOUR),
    "docs_pressure_shift": ("fetch name:ambient_pressure_hpa | timeshift 1d", "metrics-sensor", HOUR),
    "docs_both_usage": ("fetch name:export_rows | sum region | divide(fetch name:batch_records | sum region) region", "metrics-usage", 24 * HOUR),
}


def _wide(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, index, step = WIDE[name]
    source = lambda spark, d: DocumentSource(table(spark, d, "tsdb_documents"), table(spark, d, "series_catalog"), index)
    return lambda spark, d: labelled(Engine(spark, source(spark, d), _WIDE_START, _WIDE_END, step).m3(text))


def _case_sql(name: str, matched: str, body: str, shift: int = 0, back: int = 0) -> str:
    """For the stored case, or the one in WIDE: WITH usable samples, c (the stored case), pts (series_ref, labels, ts, v) of the matching series from `back` ms before the case's start and t (ts), the grid from there, then body, whose columns are labels, ts and value."""
    return f"""WITH {USABLE}, c AS ({f"SELECT '{WIDE[name][1]}' AS index_name, {_WIDE_START} AS min_ts, {_WIDE_END} AS max_ts, {WIDE[name][2]} AS step_ms" if name in WIDE else f"SELECT * FROM query_cases WHERE query_name = '{name}'"}),
    cells AS (SELECT u.series_ref, c.min_ts - {back} + (u.sample_ts + {shift} - c.min_ts + {back}) // c.step_ms * c.step_ms AS ts, arg_max(u.value, (u.sample_ts, -u.row_id)) AS v
        FROM usable u JOIN series_catalog s USING (series_ref), c WHERE s.index_name = c.index_name AND u.sample_ts + {shift} >= c.min_ts - {back} AND u.sample_ts + {shift} < c.max_ts GROUP BY ALL),
    t AS (SELECT unnest(generate_series(min_ts - {back}, max_ts - 1, step_ms)) AS ts FROM c),
    pts AS (SELECT series_ref, s.labels, ts, v FROM cells JOIN series_catalog s USING (series_ref) WHERE {matched}),
    one AS (SELECT *, array_to_string(list_transform(list_sort(map_entries(labels)), lambda x: x.key || ':' || x.value), ',') AS text FROM pts)
    {body}"""


def _by(label: str, value: str = "sum(v)", source: str = "pts") -> str:
    return f"SELECT '{label}:' || labels['{label}'] AS labels, NULL::VARCHAR AS alias, ts, round({value}, 6) AS value FROM {source} WHERE NOT isnan(v) AND labels['{label}'] IS NOT NULL GROUP BY labels['{label}'], ts"


def _case_moving(name: str, metric: str, label: str, group: str, fn: str, n: int, step: int) -> str:
    """An aggregation by one label and a moving window of n points over it."""
    body = f""", g AS (SELECT labels['{label}'] AS k, ts, {group}(v) AS v FROM pts WHERE NOT isnan(v) AND labels['{label}'] IS NOT NULL GROUP BY ALL),
        d AS (SELECT k, ts, g.v FROM (SELECT DISTINCT k FROM g) JOIN t ON true LEFT JOIN g USING (k, ts)),
        m AS (SELECT k, ts, {fn}(v) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS m FROM d)
        SELECT '{label}:' || k AS labels, NULL::VARCHAR AS alias, ts, round(m, 6) AS value FROM m, c WHERE m IS NOT NULL AND ts >= c.min_ts"""
    return _case_sql(name, f"labels['name'] = '{metric}'", body, back=n * step)


def _case_nearest(label: str, ps: tuple[int, ...]) -> str:
    each = " UNION ALL ".join(f"SELECT '__percentile:{p},{label}:' || k AS labels, NULL::VARCHAR AS alias, ts, round(l[greatest(ceil({p / 100.0} * n)::INT, 1)], 6) AS value FROM x" for p in ps)
    return f", x AS (SELECT labels['{label}'] AS k, ts, list_sort(list(v)) AS l, count(*) AS n FROM pts WHERE NOT isnan(v) AND labels['{label}'] IS NOT NULL GROUP BY ALL) {each}"


def _prom(query: str, tags: list[str], **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: flat(events_engine(spark, d).run(promql.plan(query)), tags, **kw)


def label_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many series have each label value."""
    return label_statistics(events_engine(spark, d).m3("fetch name:events"))


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct label sets of matching series."""
    meta = events_engine(spark, d).m3("fetch name:events event_type:{click,login}").meta
    return label_values(meta).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"))


def matrix_json(spark: SparkSession, d: str) -> DataFrame:
    """The Prometheus matrix form, one row per series."""
    return matrix(events_engine(spark, d).m3("fetch name:events | sum event_type"))


def matrix_values(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the matrix form finds in it: the metric, and seconds and text of each value."""
    m = matrix(events_engine(spark, d).m3("fetch name:events | max event_type"))
    pairs = m.select(F.get_json_object("metric", "$.event_type").alias("event_type"), F.explode(F.from_json("values", "array<array<string>>")).alias("v"))
    return pairs.select("event_type", F.col("v")[0].cast("double").alias("seconds"), F.col("v")[1].alias("text"))


def federated(spark: SparkSession, d: str) -> DataFrame:
    """Two partitions of one data set answer as one."""
    e = table(spark, d, "events")
    labels = {"name": F.lit("events"), "event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")}
    parts = [TableSource(e.where(F.col("event_id") % 2 == i), labels, F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.col("event_id")) for i in (0, 1)]
    return flat(Engine(spark, UnionSource(*parts), START, END, STEP).m3("fetch name:events | max event_type"), ["event_type"])

#: Condition on the labels, body and shift of the stored cases that have a wide one too.
_BODIES: dict[str, tuple] = {
    "flow_gaps": ("labels['name'] = 'coolant_flow_lpm' AND labels['zone'] = 'z3'", """, d AS (SELECT s.text, t.ts, o.v FROM (SELECT DISTINCT series_ref, text FROM one) s JOIN t ON true LEFT JOIN one o ON o.series_ref = s.series_ref AND o.ts = t.ts),
        x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY text ORDER BY ts) AS seen FROM d)
        SELECT text AS labels, NULL::VARCHAR AS alias, ts, CASE WHEN ts - seen <= 600000 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM x""", 0),
    "voltage_dips": ("labels['name'] = 'bus_voltage_v'", "SELECT text AS labels, NULL::VARCHAR AS alias, ts, round(v, 6) AS value FROM one WHERE v <= 46 AND NOT isnan(v)", 0),
    "fan_range": ("labels['name'] = 'fan_speed_rpm'", """, g AS (SELECT labels['zone'] AS k, ts, max(v) - min(v) AS v FROM pts WHERE NOT isnan(v) AND labels['zone'] IS NOT NULL GROUP BY ALL),
        best AS (SELECT k FROM g GROUP BY k ORDER BY max(v) DESC, k LIMIT 5) SELECT 'zone:' || k AS labels, NULL::VARCHAR AS alias, ts, round(v, 6) AS value FROM g SEMI JOIN best USING (k)""", 0),
    "pressure_shift": ("labels['name'] = 'ambient_pressure_hpa'", "SELECT text AS labels, NULL::VARCHAR AS alias, ts, round(CASE WHEN NOT isnan(v) THEN v END, 6) AS value FROM one", 86_400_000),
    "both_usage": ("labels['name'] IN ('export_rows', 'batch_records')", """, y AS (SELECT labels['tenant'] AS tenant, ts, sum(v) FILTER (labels['name'] = 'export_rows') AS l, sum(v) FILTER (labels['name'] = 'batch_records') AS r FROM pts WHERE NOT isnan(v) AND labels['tenant'] IS NOT NULL GROUP BY ALL)
        SELECT 'tenant:' || tenant || ',type:ratios' AS labels, NULL::VARCHAR AS alias, ts, round(CASE WHEN r <> 0 THEN l / r END, 6) AS value FROM y WHERE l IS NOT NULL AND r IS NOT NULL""", 0),
}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _m3(c[0], c[1], **c[3]) for name, c in _CASES.items()},
    "m3_histogram_percentile": m3_histogram_percentile,
    **{f"case_{n}": _cases(n) for n in CASE_NAMES},
    **{n: _wide(n) for n in WIDE},
    "prom_selector": _prom('events{event_type=~"cl.*|login",user_id!="7"}', TAGS),
    "prom_sum_by": _prom("sum by (event_type) (events)", ["event_type"]),
    "prom_count_by": _prom('count(events{event_type!~"v.*"}) by (event_type)', ["event_type"]),
    "prom_avg_nested": _prom("avg(sum by (event_type) (events))", []),
    "prom_rate": _prom("sum(rate(events[12h])) by (event_type)", ["event_type"], digits=9),
    "prom_increase": _prom("max by (event_type) (increase(events[1d]))", ["event_type"], digits=15),
    "label_stats": label_stats,
    "label_sets": label_sets,
    "matrix_json": matrix_json,
    "matrix_values": matrix_values,
    "federated_max": federated,
}

SQL: dict[str, str] = {
    **{name: c[2] for name, c in _CASES.items() if c[2]},
    **{f"case_{n}": _case_sql(n, matched, body, shift) for n, (matched, body, shift) in _BODIES.items()},
    **{f"docs_{n}": _case_sql(f"docs_{n}", matched.replace(" AND labels['zone'] = 'z3'", ""), body.replace("v <= 46", "v <= 48").replace("tenant", "region"), shift) for n, (matched, body, shift) in _BODIES.items()},
    "m3_histogram_percentile": f"""WITH c AS (SELECT o_orderpriority AS orderpriority, epoch_ms(date_trunc('month', o_orderdate)) AS t, floor(o_totalprice / 50000)::INT AS b, count(*) AS n FROM orders GROUP BY ALL),
        g AS (SELECT *, sum(n) OVER (PARTITION BY orderpriority, t) AS total, sum(n) OVER (PARTITION BY orderpriority, t ORDER BY b) AS cum FROM c),
        p AS (SELECT unnest([50, 95]) AS p) SELECT orderpriority, 'p' || p AS "histogramPercentile", {_ORDERS_START} + (t - {_ORDERS_START}) // 86400000 * 86400000 AS ts, min((b + 1) * 50000)::DOUBLE AS value FROM g, p WHERE cum >= total * p / 100.0 GROUP BY ALL""",
    "prom_selector": _map("v", "event_type SIMILAR TO 'cl.*|login' AND user_id <> '7'"),
    "prom_sum_by": _group("sum(v)"),
    "prom_count_by": _sql("x AS (SELECT event_type, count(*) AS n FROM ser WHERE event_type NOT LIKE 'v%' GROUP BY event_type) SELECT event_type, ts, n::DOUBLE AS value FROM x, (SELECT DISTINCT ts FROM grid)"),
    "prom_avg_nested": _sql("SELECT ts, round(avg(v), 6) AS value FROM bytype GROUP BY ts"),
    "prom_rate": _sql(_RATE.format(k="event_type, user_id", source="SELECT * FROM dense", ms=12 * HOUR, n=2) + " SELECT event_type, ts, round(sum(m), 9) AS value FROM w WHERE c = 2 GROUP BY ALL"),
    "prom_increase": _sql(_RATE.format(k="event_type, user_id", source="SELECT * FROM dense", ms=24 * HOUR, n=4) + " SELECT event_type, ts, round(max(m) / 1000, 15) AS value FROM w WHERE c = 4 GROUP BY ALL"),
    "matrix_values": _sql("SELECT event_type, ts / 1000.0 AS seconds, max(v)::VARCHAR AS text FROM pts GROUP BY event_type, ts"),
    "case_temp_by_site": _case_moving("temp_by_site", "zone_temp_c", "site", "avg", "avg", 12, 300_000),
    "case_units_7d": _case_moving("units_7d", "billing_units", "tenant", "sum", "sum", 7, 86_400_000),
    "case_records_30d": _case_moving("records_30d", "batch_records", "tenant", "sum", "avg", 30, 86_400_000),
    "case_humidity_p95": _case_sql("humidity_p95", "labels['name'] = 'rack_humidity_pct'", _case_nearest("site", (95,))),
    "case_latency_p50_p99": _case_sql("latency_p50_p99", "labels['name'] = 'request_latency_ms'", _case_nearest("service", (50, 99))),
    "case_queue_change": _case_sql("queue_change", "labels['name'] = 'queue_depth'", """, d AS (SELECT s.series_ref, s.site, t.ts, CASE WHEN NOT isnan(p.v) THEN p.v END AS v FROM (SELECT DISTINCT series_ref, labels['site'] AS site FROM pts) s JOIN t ON true LEFT JOIN pts p ON p.series_ref = s.series_ref AND p.ts = t.ts),
        x AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY series_ref ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM d)
        SELECT 'site:' || site AS labels, NULL::VARCHAR AS alias, ts, sum(CASE WHEN v <> l THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM x WHERE site IS NOT NULL GROUP BY site, ts"""),
    "case_gate_load": _case_sql("gate_load", "labels['name'] = 'gateway_load_pct' AND labels['service'] = 'edge-gate'", """, d AS (SELECT s.text, t.ts, COALESCE(CASE WHEN NOT isnan(o.v) THEN o.v END, 0) AS v FROM (SELECT DISTINCT series_ref, text FROM one) s JOIN t ON true LEFT JOIN one o ON o.series_ref = s.series_ref AND o.ts = t.ts),
        m AS (SELECT text, ts, max(v) OVER (PARTITION BY text ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m FROM d)
        SELECT text AS labels, NULL::VARCHAR AS alias, ts, round(m, 6) AS value FROM m, c WHERE m IS NOT NULL AND ts >= c.min_ts""", back=6 * HOUR),
    "case_pods_live": _case_sql("pods_live", "labels['name'] = 'request_latency_ms' AND labels['region'] IN ('north-1', 'north-2')", """, n AS (SELECT labels['service'] AS service, labels['region'] AS region, count(DISTINCT series_ref) AS n FROM pts GROUP BY ALL)
        SELECT 'region:' || region || ',service:' || service AS labels, NULL::VARCHAR AS alias, ts, n::DOUBLE AS value FROM n, t WHERE service IS NOT NULL"""),
    "case_errors_share": _case_sql("errors_share", "labels['name'] = 'request_latency_ms'", """, n AS (SELECT labels['service'] AS service, count(DISTINCT series_ref) AS r, count(DISTINCT series_ref) FILTER (labels['status'] LIKE '5%') AS l FROM pts GROUP BY ALL)
        SELECT 'service:' || service || ',type:ratios' AS labels, NULL::VARCHAR AS alias, ts, round(l * 100.0 / r, 6) AS value FROM n, t WHERE service IS NOT NULL AND l > 0"""),
    "case_not_get": _case_sql("not_get", "labels['name'] = 'response_size_bytes' AND COALESCE(labels['method'] <> 'GET', true)", _by("service")),
    "case_export_daily": _case_sql("export_daily", "labels['name'] = 'export_rows'", "SELECT labels, alias, -62135596800000 + (ts + 62135596800000) // 86400000 * 86400000 AS ts, round(sum(value), 6) AS value FROM (" + _by("tenant") + ") GROUP BY ALL"),
    "label_stats": _sql("SELECT 'event_type' AS label, event_type AS value, count(*) AS series FROM ser GROUP BY event_type UNION ALL SELECT 'user_id', user_id, count(*) FROM ser GROUP BY user_id UNION ALL SELECT 'name', 'events', count(*) FROM ser UNION ALL SELECT 'type', 'gauge', count(*) FROM ser UNION ALL SELECT '', '', count(*) FROM ser"),
    "label_sets": _sql("SELECT event_type, user_id FROM ser WHERE event_type IN ('click', 'login')"),
    "federated_max": _sql("""y AS (SELECT event_type, user_id, event_id % 2 AS part, """ + f"{START} + (t - {START}) // {STEP} * {STEP} AS ts, arg_max(value, (t, event_id)) AS v FROM ev GROUP BY ALL), z AS (SELECT event_type, user_id, ts, arg_max(v, part) AS v FROM y GROUP BY ALL) SELECT event_type, ts, round(max(v), 6) AS value FROM z GROUP BY ALL").replace("total AS (SELECT ts, sum(v) AS v FROM pts GROUP BY ALL) y AS", "total AS (SELECT ts, sum(v) AS v FROM pts GROUP BY ALL), y AS"),
}
