import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import distinct


def test_estimates_stay_within_their_interval(spark):
    sizes = {"a": 1, "b": 10, "c": 3_000, "d": 200_000}
    frames = [spark.range(n).select(F.lit(k).alias("g"), F.concat(F.lit(k), F.col("id")).alias("x")) for k, n in sizes.items()]
    ids = frames[0]
    for f in frames[1:]:
        ids = ids.unionByName(f)
    ids = ids.unionByName(ids)  # repeats change nothing
    got = {r["g"]: r for r in distinct.estimates(distinct.matrices(ids, ["g"], "x"), ["g"]).collect()}
    for k, n in sizes.items():
        assert got[k]["low"] - 0.5 <= n <= got[k]["high"] + 0.5, (k, got[k])
    assert got["a"]["estimate"] == 1 and abs(got["b"]["estimate"] - 10) <= 1
    assert got["d"]["std_error"] / 200_000 < 0.012


def test_stated_error_holds_over_many_sets():
    rng = np.random.default_rng(1)
    n, rows, off = 20_000, 1024, []
    for _ in range(60):
        bucket, rank = rng.integers(0, rows, n), np.minimum(rng.geometric(0.5, n) - 1, distinct.RANKS - 1)
        seen = np.unique(bucket * 64 + rank) % 64
        e, s = distinct.likeliest(np.bincount(seen, minlength=distinct.RANKS)[None, :].astype(float), rows)
        off.append((e[0] - n) / s[0])
    assert abs(np.mean(off)) < 0.5 and 0.7 < np.std(off) < 1.3


def test_parts_merge_by_union(spark):
    ids = spark.range(50_000).select((F.col("id") % 7).cast("int").alias("day"), F.lit("x").alias("g"), (F.col("id") % 9_000).alias("x"), F.lit(1).alias("bits"))
    daily = distinct.matrices(ids, ["day", "g"], "x")
    one = distinct.estimates(distinct.matrices(ids, ["g"], "x"), ["g"]).collect()
    assert distinct.estimates(distinct.merged(daily, ["g"]), ["g"]).collect() == one
    assert daily.groupBy("day").count().agg(F.max("count")).head()[0] <= distinct.ROWS


def test_nulls_and_empty(spark):
    ids = spark.createDataFrame([(None, "a"), (None, "a"), ("g", None), ("h", "")], "g string, x string")
    got = {r["g"]: r["estimate"] for r in distinct.estimates(distinct.matrices(ids, ["g"], "x"), ["g"]).collect()}
    assert got == {None: 1, "h": 1}
    assert distinct.estimates(distinct.matrices(ids.limit(0), ["g"], "x"), ["g"]).count() == 0


@pytest.mark.parametrize("grouping", ["day", "all", "day_metric", "day_service_region"])
def test_query_against_exact_counts(spark, grouping):
    from tidegrid.llm import queries

    d = "/root/testdata/sf0.001"
    dims = {"day": ["day_utc"], "all": [], "day_metric": ["day_utc", "metric_name"], "day_service_region": ["day_utc", "service", "region"]}[grouping]
    s = queries._samples(spark, d, ["metric_name", "service", "region", "pod"]).withColumn("day_utc", F.date_format(F.timestamp_millis("sample_ts"), "yyyy-MM-dd"))
    exact = s.groupBy(*dims).agg(F.count_distinct("series_ref").alias("exact")).collect()
    got = queries.p4_distinct(spark, d).where(f"grouping = '{grouping}' and what = 'series'").collect()
    key = lambda r: tuple(r[c] for c in dims)
    have = {key(r): r for r in got}
    assert len(have) == len(got) == len(exact)
    miss = sum(not have[key(r)]["low"] - 1 <= r["exact"] <= have[key(r)]["high"] + 1 for r in exact)
    assert miss <= 0.01 * len(exact)
