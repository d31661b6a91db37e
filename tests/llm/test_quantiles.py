import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import quantiles as q

PS = (0.0, 1.0, 25.0, 50.0, 90.0, 99.0, 99.9, 100.0)


def worst(values, found, ps, high=True):
    """Largest rank error over its stated bound."""
    s = np.sort(values)
    out = 0.0
    for v, p in zip(found, ps):
        if 0 < p < 100:
            low, top = np.searchsorted(s, v, "left") / len(s), np.searchsorted(s, v, "right") / len(s)
            off = max(0.0, low - p / 100, p / 100 - top)
            out = max(out, off / (q.ERROR / q.K * ((1 - p / 100) if high else p / 100) + 1 / len(s)))
    return out


@pytest.mark.parametrize("shape", ["normal", "sorted", "reversed", "ties", "heavy"])
@pytest.mark.parametrize("high", [True, False])
def test_merged_sketches_keep_the_stated_error(shape, high):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=300_000), "ties": rng.integers(0, 5, 300_000).astype(float), "heavy": rng.pareto(0.5, 300_000)}.get(shape)
    if x is None:
        x = np.arange(300_000.0)[:: 1 if shape == "sorted" else -1]
    parts = [q.Sketch(high=high).add(c) for c in np.array_split(x, 23)]
    total = parts[0]
    for p in parts[1:]:
        total = q.Sketch.unpack(total.pack()).merge(q.Sketch.unpack(p.pack()))
    assert total.n == len(x) == sum(len(v) << h for h, v in enumerate(total.levels))
    assert len(total.pack()) < 60_000
    found = total.percentiles(list(PS))
    assert found[0] == x.min() and found[-1] == x.max()
    assert worst(x, found, PS, high) <= 1


def test_small_sketches_are_exact():
    s = q.Sketch().add(np.array([3.0, np.nan, 1.0, np.inf, 2.0]))
    assert (s.n, s.nan) == (4, 1)
    assert list(s.percentiles([25.0, 50.0, 75.0, 100.0])) == [1, 2, 3, np.inf]
    assert np.isnan(q.Sketch().percentiles([50.0])[0])


def test_groups_nulls_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(q, "GATHER", 5_000)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=40_000)
    rows = [("hot", float(v), "x") for v in hot] + [(None, 1.0, "x"), ("one", 7.0, "x"), ("one", None, "x"), ("nan", float("nan"), "x")]
    df = spark.createDataFrame(rows, "g string, v double, sketch string").repartition(7)
    parts = q.sketches(df, "g", "v")
    assert parts.where("g = 'hot'").count() >= 7
    merged = q.merge_sketches(q.merge_sketches(parts, ["g", "part"]), ["g"])
    got = {}
    for r in q.percentiles(merged, ["g"], (50.0, 99.0)).collect():
        got.setdefault(r["g"], {})[r["p"]] = r
    assert set(got) == {"hot", None, "one", "nan"}
    assert worst(hot, [got["hot"][p]["value"] for p in (50.0, 99.0)], (50.0, 99.0)) <= 1
    assert got["one"][50.0]["value"] == 7.0 and got["one"][50.0]["n"] == 1 and got["one"][50.0]["rank_error"] == 0
    assert got["nan"][50.0]["value"] is None and got["nan"][50.0]["n_nan"] == 1
    assert q.sketches(df.limit(0), "g", "v").count() == 0


def test_queries_against_exact_ranks(spark):
    from tidegrid.llm import queries
    from tidegrid.sources.tables import table

    d = "/root/testdata/sf0.001"
    s = queries._samples(spark, d, ["metric_name", "service"]).where(~F.isnan("value")).toPandas()
    got = queries.p1_percentiles(spark, d).where("dimension = 'service'").toPandas()
    assert len(got) == len(queries.PERCENTILES) * len(s[["metric_name", "service"]].fillna("").drop_duplicates())
    for (m, label), g in got.groupby(["metric_name", "label"], dropna=False):
        own = s[(s.metric_name == m) & ((s.service == label) if isinstance(label, str) else s.service.isna())].value.to_numpy()
        assert (g.n == len(own)).all()
        assert worst(own, g.value.to_numpy(), g.p.to_numpy()) <= 1
    days = queries.p1_days(spark, d)
    assert days.where("day_utc is null").groupBy("metric_name").agg(F.first("n")).count() == table(spark, d, "metric_info").count()


def test_only_alike_sketches_merge():
    for other in (q.Sketch(k=16), q.Sketch(high=False)):
        with pytest.raises(ValueError):
            q.Sketch().merge(other)


def test_a_metric_of_many_groups_is_merged_in_parts(spark):
    """1,000 finest groups of one metric with 256 parts each in the first step; no task of the upward merge reads much more than the median."""
    packed = {i: q.Sketch().add(np.arange(i, i + 40.0)).pack() for i in range(4)}
    rows = [("m", str(g), bytes(packed[g % 4])) for g in range(1000)]
    fine = spark.createDataFrame(rows, "metric string, grp string, sketch binary").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = fine.select("metric", "sketch", F.pmod(F.xxhash64("grp"), F.lit(q.FAN)).alias("part"))
        sizes = [r["n"] for r in spread.repartition(8, "metric", "part").groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * np.median(sizes)
        out = q.merge_spread(fine, ["metric"], ["grp"])
        assert "part" in out._jdf.queryExecution().optimizedPlan().toString()
        s = q.Sketch.unpack(out.collect()[0]["sketch"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert s.n == 40_000 and s.low == 0 and s.top == 42


def test_queries_that_state_bounds(spark):
    from tidegrid.llm import queries

    d = "/root/testdata/sf0.001"
    assert queries.p1_within(spark, d).where("not within").count() == 0
    assert queries.p4_coverage(spark, d).where("not covered").count() == 0
