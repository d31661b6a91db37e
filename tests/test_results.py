"""Sources, result forms, statistics, federation and user stages."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidegrid.lang import promql
from tidegrid.model import SeriesFrame
from tidegrid.operators.order import ranked, sort_series
from tidegrid.plans import m3
from tidegrid.plans.lower import Engine, register_stage, table
from tidegrid.plans.nodes import Node
from tidegrid.session import small_side
from tidegrid.sources.output import explain, matrix, read_blocks, response, write_blocks
from tidegrid.sources.scan import DocumentSource, Matchers, TableSource, UnionSource, label_statistics, label_values

SCHEMA = "name string, zone string, ts long, value double, seq long, sid string, labels string"


def source(spark, rows):
    return TableSource(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), {"name": F.col("name"), "zone": F.col("zone")}, F.col("ts"), F.col("value"), F.col("seq"))


ROWS = [("m", "a", 0, 1.0, 0), ("m", "a", 5, 2.0, 1), ("m", "a", 5, 3.0, 2), ("m", None, 0, 10.0, 3), ("m", "", 0, 20.0, 4), ("m", "b", None, 1.0, 5), ("m", "b", 10, None, 6), ("m", "b", 20, float("nan"), 7), ("m", "b", 20, float("nan"), 7), (None, "a", 0, 1.0, 8)]


def test_nulls_ties_and_repeats(spark):
    f = Engine(spark, source(spark, ROWS), 0, 30, 10).m3("fetch name:m")
    got = sorted(((r["zone"], r["ts"], r["value"]) for r in table(f, ["zone"]).collect()), key=repr)
    assert got == sorted([("a", 0, 3.0), (None, 0, 10.0), ("", 0, 20.0), ("b", 20, None)], key=repr)
    by_zone = Engine(spark, source(spark, ROWS), 0, 30, 10).m3("fetch name:m | sum zone")
    assert sorted((r["zone"], r["value"]) for r in table(by_zone, ["zone"]).collect()) == [("", 20.0), ("a", 3.0)]
    assert Engine(spark, source(spark, []), 0, 30, 10).m3("fetch name:m | sum").points.count() == 0
    with pytest.raises(ValueError):
        Engine(spark, None, 5, 5, 1)


def test_negated_matcher_passes_series_without_the_label(spark):
    f = source(spark, ROWS).fetch(Matchers({"name": ("m",)}, {"zone": ("a", "b*")}), 0, 30, 10)
    assert sorted(r["value"] for r in f.points.collect()) == [10.0, 20.0]
    g = source(spark, ROWS).fetch(Matchers({"zone": ("[ab]",)}, {}, frozenset({"[ab]"})), 0, 30, 10)
    assert g.points.count() == 3


def test_documents_as_a_source(spark):
    docs = spark.createDataFrame([(0, "z 1 name m", None, 3, 1.0, None), (1, "name m z 1", None, 3, 5.0, None), (2, None, 4, 12, None, "7.5"), (3, None, 4, 99, 1.0, None)], "row_id long, labels string, series_ref long, sample_ts long, sample_value double, value_text string")
    cat = spark.createDataFrame([(4, {"name": "m", "z": "1"}, "i", 0, 50), (5, {"name": "n"}, "i", 0, 50)], "series_ref long, labels map<string,string>, index_name string, min_ts long, max_ts long")
    f = Engine(spark, DocumentSource(docs, cat, "i"), 0, 20, 10).m3("fetch name:m")
    assert sorted((r["z"], r["ts"], r["value"]) for r in table(f, ["z"]).collect()) == [("1", 0, 1.0), ("1", 10, 7.5)]
    assert Engine(spark, DocumentSource(docs, cat, "other"), 0, 20, 10).m3("fetch name:m").points.count() == 0


def test_matrix_response_and_explain(spark):
    e = Engine(spark, source(spark, ROWS), 0, 30, 10)
    f = e.m3('fetch name:m zone:{a,b} | alias "zone {{.zone}}"')
    r = {x["alias"]: x for x in response(f)["data"]["result"]}
    assert r["zone a"] == {"metric": {"name": "m", "zone": "a"}, "alias": "zone a", "values": [[0.0, "3.0"]]}
    assert r["zone b"]["values"] == [[0.02, "NaN"]]
    m = matrix(e.m3("fetch name:m zone:a | > 100"), metadata=True).collect()
    assert m[0]["values"] == "[]" and (m[0]["step"], m[0]["start"], m[0]["end"]) == (10, 0, 20) and json.loads(m[0]["metric"])
    assert "fetch" in explain(m3.plan("fetch name:m"), f) and "Physical Plan" in explain(m3.plan("fetch name:m"), f)


def test_statistics_and_label_sets(spark):
    f = Engine(spark, source(spark, ROWS), 0, 30, 10).m3("fetch name:m")
    s = {(r["label"], r["value"]): r["series"] for r in label_statistics(f).collect()}
    assert s == {("name", "m"): 4, ("zone", "a"): 1, ("zone", "b"): 1, ("zone", ""): 2 - 1, ("", ""): 4}
    assert label_values(f.meta).count() == 4


def test_partitions_answer_as_one(spark):
    one, two = ROWS[:3], [("m", "a", 5, 9.0, 0), ("m", "c", 0, 4.0, 1)]
    f = Engine(spark, UnionSource(source(spark, one), source(spark, two)), 0, 30, 10).m3("fetch name:m")
    assert sorted((r["zone"], r["value"]) for r in table(f, ["zone"]).collect()) == [("a", 9.0), ("c", 4.0)]


def test_promql_runs(spark):
    e = Engine(spark, source(spark, ROWS), 0, 30, 10)
    assert sorted(r["value"] for r in e.run(promql.plan('sum(m{zone=~"a|b"}) by (zone)')).points.collect()) == [3.0]
    assert [r["value"] for r in e.run(promql.plan("count(m)")).points.where("ts = 0").collect()] == [4.0]


def test_user_stage(spark):
    register_stage("negated", lambda f: f.with_values(-F.col("value")))
    f = Engine(spark, source(spark, ROWS), 0, 30, 10).run(Node("negated", {}, [m3.plan("fetch name:m zone:a")]))
    assert [r["value"] for r in f.points.collect()] == [-3.0]


def test_places_of_series_are_whole_numbers_in_order(spark):
    n = 500
    points = spark.range(n).select(F.col("id").cast("string").alias("sid"), F.lit(0).cast("long").alias("ts"), ((F.col("id") * 7919) % n).cast("double").alias("value"))
    meta = points.select("sid", F.create_map(F.lit("i"), F.col("sid")).alias("labels"), F.lit(None).cast("string").alias("alias"), *[F.lit(x).cast("long").alias(c) for c, x in (("g_min", 0), ("g_max", 0), ("g_step", 1))])
    r = ranked(sort_series(SeriesFrame(points, meta, step=1, live=True), "max", "desc")).join(points, "sid").orderBy("ord").collect()
    assert [x["ord"] for x in r] == list(range(1, n + 1))
    assert [x["value"] for x in r] == sorted((x["value"] for x in r), reverse=True)


def test_blocks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", t, float(t)) for t in (0, 7_199_999, 7_200_000, 20_000_000)], "series_key string, ts long, value double")
    write_blocks(df, str(tmp_path / "b"))
    got = read_blocks(spark, str(tmp_path / "b"), 7_199_999, 20_000_000)
    assert sorted(r["ts"] for r in got.collect()) == [7_199_999, 7_200_000]
    assert "PartitionFilters: [isnotnull(block_start" in got._jdf.queryExecution().toString()
    assert not any(math.isnan(r["value"]) for r in got.collect())


def mixed(spark, query, end=3_600_000):
    rows = [("a", "x", t * 60_000, float(t + 1), t) for t in range(12)] + [("b", "x", t * 60_000, 100.0, t) for t in range(12)] + [("c", "x", t * 60_000, 6.0, t) for t in range(12)]
    return {(r["name"], r["ts"] // 60_000): r["value"] for r in table(Engine(spark, source(spark, rows), 0, 12 * 60_000, 60_000).m3(query), ["name"]).collect()}


def test_series_of_different_steps(spark):
    left = "(fetch name:a | summarize 2m sum) | (fetch name:b)"
    third = "(fetch name:c | summarize 3m sum)"  # 18 in every cell
    got = mixed(spark, f"{left} | divide{third}")
    # a against c on 6 minutes, b against c on 3 minutes
    assert got == {("a", 0): round((3 + 7 + 11) / 3 / 18, 6), ("a", 6): round((15 + 19 + 23) / 3 / 18, 6), **{("b", t): round(100 / 18, 6) for t in (0, 3, 6, 9)}}
    got = mixed(spark, f"{left} | asPercent{third}")
    assert got == {("a", 0): round(7 / 18 * 100, 6), ("a", 6): round(19 / 18 * 100, 6), ("b", 0): round(10000 / 18, 6), ("b", 6): round(10000 / 18, 6)}
    got = mixed(spark, f"{left} | moving 4m sum")
    assert got["a", 4] == 3 + 7 and got["a", 2] == 3 and got["b", 5] == 400 and got["b", 1] == 100 and ("a", 3) not in got
    got = mixed(spark, f"{left} | perSecondRate 4m")
    assert got["a", 6] == round(4 / 120, 6) and got["b", 6] == 0
    assert mixed(spark, f"{left} | divide{third} | moving 6m max")["a", 6] == round(7 / 18, 6)


def test_tag_sub_takes_numbered_groups_from_the_first_match(spark):
    def sub(value, search, to):
        f = Engine(spark, source(spark, [("m", value, 0, 1.0, 0)]), 0, 10, 10).m3(f'fetch name:m | tagSub zone "{search}" "{to}"')
        return f.meta.select(F.col("labels")["zone"]).head()[0]

    assert sub("ab1cd2", "([a-z]+)([0-9])", r"\\1-") == "ab-ab-"
    assert sub("ab1cd2", "([a-z]+)([0-9])", "$1-") == "ab-cd-"
    assert sub("a$1b", "(a.*)b", r"\\1c") == "a$1c" and sub("xyz", "(q)", r"\\1") == "xyz"
    with pytest.raises(ValueError):
        sub("ab", "a", r"\\1")


def test_regular_expressions_belong_to_their_matcher(spark):
    rows = [("x1", "x.*", 0, 1.0, 0), ("x1", "x2", 0, 2.0, 1), ("y", "x.*", 0, 4.0, 2)]
    f = Engine(spark, source(spark, rows), 0, 10, 10).run(promql.plan('{name=~"x.*",zone="x.*"}'))
    assert [r["value"] for r in f.points.collect()] == [1.0]
    assert promql.plan('m{a="x"}').key() != promql.plan('m{a=~"x"}').key()


def test_braces_must_come_in_pairs():
    for bad in ("fetch name:{a,b", "fetch name:a}b{", "fetch name:{a,{b}"):
        with pytest.raises(ValueError):
            m3.plan(bad)


def histogram(spark, buckets, query="histogramPercentile id zone 50"):
    rows = [(str(i), b, 0, float(v), i) for i, (b, v) in enumerate(buckets)]
    f = Engine(spark, source(spark, rows), 0, 10, 10).m3(f"fetch name:* | mapKey name id | {query}")
    return {r["histogramPercentile"]: r["value"] for r in table(f, ["histogramPercentile"]).collect()}


def test_histogram_buckets(spark):
    assert histogram(spark, [("0-1m30s", 1), ("1m30s-2h", 3), ("2h-infinity", 0)]) == {"p50": 7_200_000.0}
    assert histogram(spark, [("0-500us", 5), ("500us-1ms", 1)]) == {"p50": 0.5}
    assert histogram(spark, [("-20--10", 1), ("-10-1e-3", 1), ("1e-3-+Inf", 8)], "histogramPercentile id zone 20 5 20 99") == {"p5": -10.0, "p20": 0.001, "p99": 0.001}
    for bad in ("histogramPercentile id zone 101", "histogramPercentile id zone -1", "histogramPercentile id zone"):
        with pytest.raises(ValueError):
            m3.plan(f"fetch name:m | {bad}")
    with pytest.raises(Exception, match="invalid bucket range"):
        histogram(spark, [("ten-20", 1)])
    with pytest.raises(Exception, match="two series of one bucket"):
        f = Engine(spark, source(spark, [("1", "0-5", 0, 1.0, 0)]), 0, 10, 10).m3("(fetch name:1) | (fetch name:1) | mapKey name id | histogramPercentile id zone 50")
        f.points.collect()


def test_a_broadcast_needs_few_rows_and_little_text(spark):
    hinted = lambda df, **kw: "hint" in small_side(df, **kw)._jdf.queryExecution().logical().toString().lower()
    df = spark.range(10).select("id", F.repeat(F.lit("é"), 50).alias("t"))
    assert hinted(df, max_bytes=1000) and not hinted(df, max_bytes=999) and not hinted(df, max_rows=9)
    assert not hinted(df.withColumn("m", F.create_map("t", "t")))
