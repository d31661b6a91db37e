"""Hand-typed series and expected values; `None` is a missing sample."""

import math

import pytest
from pyspark.sql import functions as F

from tidegrid.plans import m3
from tidegrid.plans.lower import Engine
from tidegrid.sources.scan import TableSource

T0, MIN = 1_735_689_600_000, 60_000
NAN = float("nan")

SERIES = {
    "avg": ({}, [1, 5, 3, 8, 2, 6, 4]),
    "max": ({}, [10, 5, 15, 2, 20, 8, None]),
    "sum": ({}, [2, 4, 6, 8, 10, None, None]),
    "steps": ({}, [10, 20, 30, 40, 50, 60, None]),
    "gaps": ({}, [1, None, None, 4, NAN, 6, None]),
    "counter": ({}, [0, 60, 120, 30, 90, None, 150]),
    "none": ({}, [NAN, NAN]),
}
REQUESTS = {("GET", "200"): [100, 120, 110, 95, 105], ("GET", "404"): [10, 15, 12, None, 11], ("POST", "200"): [80, 85, 90, 75, 88], ("POST", "500"): [5, 3, 7, 4, 6]}


@pytest.fixture(scope="module")
def source(spark):
    rows = []
    for name, (labels, values) in SERIES.items():
        rows += [(name, None, None, T0 + i * MIN, float(v), i) for i, v in enumerate(values) if v is not None]
    for (method, status), values in REQUESTS.items():
        rows += [("requests", method, status, T0 + i * MIN, float(v), i) for i, v in enumerate(values) if v is not None]
    for i, (v, up) in enumerate([(5, "0-10"), (3, "10-20"), (2, "20-+Inf")]):
        rows.append(("hist", str(i), up, T0, float(v), i))
    for v in ("1.2.3", "1.10.0", "2.0.0-rc.1", "2.0.0", "word"):
        rows.append(("versions", v, None, T0, 1.0, 0))
    df = spark.createDataFrame(rows, "name string, method string, status string, ts long, value double, seq long").cache()
    return TableSource(df, {n: F.col(n) for n in ("name", "method", "status")}, F.col("ts"), F.col("value"), F.col("seq"))


@pytest.fixture(scope="module")
def run(spark, source):
    def go(query, start=0, end=7, step=MIN):
        f = Engine(spark, source, T0 + start * MIN, T0 + end * MIN, step).m3(query)
        names = {r["sid"]: r for r in f.alive().meta.collect()}
        out = {}
        for r in f.points.collect():
            m = names[r["sid"]]
            key = m["alias"] if m["alias"] is not None else ",".join(f"{k}={v}" for k, v in sorted(m["labels"].items()) if k != "name")
            out.setdefault(key, {})[(r["ts"] - T0) / MIN] = "nan" if math.isnan(r["value"]) else round(r["value"], 4)
        for m in names.values():
            out.setdefault(m["alias"] if m["alias"] is not None else ",".join(f"{k}={v}" for k, v in sorted(m["labels"].items()) if k != "name"), {})
        return out

    return go


def only(r):
    assert len(r) == 1, r
    return next(iter(r.values()))


def test_moving_excludes_the_current_point(run):
    assert only(run("fetch name:avg | movingAverage 3m", start=1)) == {1: 1, 2: 3, 3: 3, 4: 5.3333, 5: 4.3333, 6: 5.3333}
    assert only(run("fetch name:max | movingMax 3m", start=1, end=6)) == {1: 10, 2: 10, 3: 15, 4: 15, 5: 20}
    assert only(run("fetch name:max | movingMin 3m", start=1, end=6)) == {1: 10, 2: 5, 3: 5, 4: 2, 5: 2}
    assert only(run("fetch name:sum | movingSum 3m", start=1, end=6)) == {1: 2, 2: 6, 3: 12, 4: 18, 5: 24}
    assert only(run("fetch name:avg | movingMedian 3m", start=1)) == {1: 1, 2: 1, 3: 3, 4: 5, 5: 3, 6: 6}


def test_long_windows_equal_short_ones(run, monkeypatch):
    from tidegrid.operators import windows

    for how in ("sum", "avg", "min", "max"):
        for query in (f"fetch name:gaps | moving 3m {how}", f"fetch name:counter | moving 5m {how}"):
            want = run(query)
            monkeypatch.setattr(windows, "SLIDING_POINTS", 1)
            assert run(query) == want
            monkeypatch.undo()


def test_long_medians_equal_short_ones(run, monkeypatch):
    from tidegrid.operators import windows

    queries = [f"fetch name:{name} | moving {n}m median" for name in ("gaps", "counter", "avg") for n in (1, 3, 5)]
    want = [run(q) for q in queries]
    for block in (1, 4, 8192):
        monkeypatch.setattr(windows, "MEDIAN_POINTS", 0)
        monkeypatch.setattr(windows, "MEDIAN_BLOCK", block)
        assert [run(q) for q in queries] == want


def test_summarize(run):
    assert only(run("fetch name:steps | summarize 2m sum")) == {0: 30, 2: 70, 4: 110}
    assert only(run("fetch name:steps | summarize 3m avg")) == {0: 20, 3: 50}
    assert only(run("fetch name:steps | summarize 3m last")) == {0: 30, 3: 60}
    assert only(run("fetch name:steps | summarize 3m stddev")) == {0: 10, 3: 10}
    assert only(run("fetch name:steps | summarize 3m p50")) == {0: 20, 3: 50}
    with pytest.raises(ValueError):
        run("fetch name:steps | summarize 30s")
    with pytest.raises(ValueError):
        run("fetch name:steps | summarize 3m median")


def test_grouping(run):
    r = run("fetch name:requests | sumSeries method", end=5)
    assert r == {"method=GET": {0: 110, 1: 135, 2: 122, 3: 95, 4: 116}, "method=POST": {0: 85, 1: 88, 2: 97, 3: 79, 4: 94}}
    assert run("fetch name:requests | sum nothing", end=5) == {}
    assert run("fetch name:requests | count method", end=2) == {"method=GET": {0: 2, 1: 2}, "method=POST": {0: 2, 1: 2}}
    assert only(run("fetch name:requests | multiply", end=1)) == {0: 100 * 10 * 80 * 5}
    assert run("fetch name:requests | range method", end=1) == {"method=GET": {0: 90}, "method=POST": {0: 75}}
    assert only(run("fetch name:requests | percentileOfSeries 50", end=1)) == {0: 10}
    assert only(run("fetch name:requests | percentileOfSeries 90 true", end=1)) == {0: 92}


def test_missing_is_not_nan(run):
    assert only(run("fetch name:gaps | keepLastValue")) == {0: 1, 1: 1, 2: 1, 3: 4, 4: "nan", 5: 6, 6: 6}
    assert only(run("fetch name:gaps | keepLastValue 1m")) == {0: 1, 1: 1, 3: 4, 4: "nan", 5: 6, 6: 6}
    assert only(run("fetch name:gaps | isNonNull")) == {0: 1, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0}
    assert only(run("fetch name:gaps | transformNull")) == {0: 1, 1: 0, 2: 0, 3: 4, 4: 0, 5: 6, 6: 0}
    assert only(run("fetch name:gaps | changed")) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}
    assert only(run("fetch name:gaps | sum")) == {0: 1, 3: 4, 5: 6}
    assert only(run("fetch name:gaps | integral")) == {0: 1, 3: 5, 5: 11}
    assert only(run("fetch name:gaps | derivative")) == {}
    assert only(run("fetch name:avg | derivative", end=3)) == {1: 4, 2: -2}


def test_empty_series_stay_until_removed(run):
    assert only(run("fetch name:avg | > 100")) == {}
    assert only(run("fetch name:avg | > 100 | count", end=2)) == {0: 1, 1: 1}
    assert run("fetch name:avg | > 100 | removeEmpty") == {}
    assert run("fetch name:none | removeEmpty") == {}
    assert run("fetch name:unknown") == {}
    assert run("fetch name:unknown | sum | moving 2m sum | transformNull | count") == {}


def test_mappers(run):
    assert only(run("fetch name:steps | scaleToSeconds 3600", end=3)) == {0: 600, 1: 1200, 2: 1800}
    assert only(run("mockFetch -2.5,2.5,nan,0 | round")) == {0: -2, 1: 3, 3: 0}
    assert only(run("mockFetch -1,0,100 | logarithm")) == {0: "nan", 1: float("-inf"), 2: 2}
    assert only(run("mockFetch -4,9 | sqrt")) == {0: "nan", 1: 3}
    assert only(run("fetch name:steps | timeshift -1m", start=1, end=5)) == {1: 10, 2: 20, 3: 30, 4: 40}
    with pytest.raises(ValueError):
        run("fetch name:steps | divideScalar 0")


def test_counters(run):
    assert only(run("fetch name:counter | perSecond")) == {1: 1, 2: 1, 4: 1, 6: 0.5}
    assert only(run("fetch name:counter | perSecondRate 2m", end=8)) == {3: 1, 4: 0.75, 5: 0.75, 6: 0.75, 7: 0.5}
    with pytest.raises(ValueError):
        run("fetch name:counter | perSecondRate 90s")
    assert only(run("fetch name:avg | sustain 3m")) == {2: 3, 3: 8, 4: 2, 5: 6, 6: 4}


def test_binary(run):
    get = "fetch name:requests method:GET | sum status"
    assert run(f"{get} | asPercent(fetch name:requests | sum)", end=1) == {"status=200,type=ratios": {0: 51.2821}, "status=404,type=ratios": {0: 5.1282}}
    assert run("fetch name:requests | asPercent(fetch name:requests | sum method) method", end=1)["method=GET,status=200,type=ratios"] == {0: 90.9091}
    assert only(run("fetch name:avg | divide(fetch name:sum)", end=7)) == {0: 0.5, 1: 1.25, 2: 0.5, 3: 1, 4: 0.2}
    assert only(run("fetch name:avg | diff(fetch name:sum)")) == {0: -1, 1: 1, 2: -3, 3: 0, 4: -8, 5: 6, 6: 4}
    assert only(run("fetch name:avg | diff(fetch name:sum) true")) == {0: -1, 1: 1, 2: -3, 3: 0, 4: -8}
    assert only(run("mockFetch 1,2 | divide(mockFetch 0,2)", end=2)) == {0: "nan", 1: 1}
    assert set(run("fetch name:requests | intersect(fetch name:requests status:500) method", end=1)) == {"method=POST,status=200", "method=POST,status=500"}
    assert only(run("fetch name:unknown | fallbackSeries(fetch name:avg)", end=1)) == {0: 1}
    assert len(run("fetch name:unknown | fallbackSeries 1.5", end=1)["1.500"]) == 60
    with pytest.raises(ValueError):
        run("fetch name:requests | divide(fetch name:requests) method")
    assert len(run("(fetch name:avg | alias a) | (fetch name:avg | alias b)")) == 2


def test_order(run):
    assert list(run("fetch name:requests | topK 1 max", end=5)) == ["method=GET,status=200"]
    assert set(run("fetch name:requests | sort avg asc | head 2", end=5)) == {"method=POST,status=500", "method=GET,status=404"}
    assert set(run("fetch name:requests | sort avg asc | tail 1", end=5)) == {"method=GET,status=200"}
    with pytest.raises(ValueError):
        run("fetch name:requests | sort wrong")


def test_labels(run):
    assert set(run('fetch name:requests | alias "{{.method}} of {{.zone}}"', end=1)) == {"GET of zone", "POST of zone"}
    assert set(run("fetch name:requests method:GET | showTags true status method", end=1)) == {"status:200 method:GET", "status:404 method:GET"}
    assert set(run('fetch name:requests method:GET | tagSub status "^(.).*" "\\1xx" | aliasByTags status', end=1)) == {"2xx", "4xx"}
    assert set(run("fetch name:requests method:GET | mapKey status code", end=1)) == {"code=200,method=GET", "code=404,method=GET"}
    assert set(run('fetch name:requests | excludeByTag status "^4" "00$"', end=1)) == set()
    assert set(run('fetch name:versions | tagCompare ">=" "method:1.10.0" | aliasByTags method')) == {"1.10.0", "2.0.0-rc.1", "2.0.0"}
    assert set(run('fetch name:versions | tagCompare "<" "method:2.0.0" | aliasByTags method')) == {"1.2.3", "1.10.0", "2.0.0-rc.1"}
    assert set(run("fetch name:requests | where eq method status")) == set()


def test_histogram_percentile(run):
    r = run("fetch name:hist | histogramPercentile method status 50 80 99", end=1)
    assert r == {"histogramPercentile=p50": {0: 10}, "histogramPercentile=p80": {0: 20}, "histogramPercentile=p99": {0: 20}}


def test_grid_starts_at_the_query_start(run):
    assert only(run("fetch name:steps", start=1, end=6, step=2 * MIN)) == {1: 30, 3: 50, 5: 60}


def test_mixed_steps_are_brought_together(run):
    q = "(fetch name:steps | summarize 2m sum) | (fetch name:steps) | sum"
    assert only(run(q)) == {0: 30 + 15, 2: 70 + 35, 4: 110 + 55}


@pytest.mark.parametrize("query", ["fetch", "fetch name:!x", "sum", "fetch name:a | moving", "fetch name:a | moving x sum", "fetch name:a | nosuch", "fetch name:a | scale", "fetch name:a | moving 1m wrong", "fetch name:a |", "fetch name:a | alias \"x", "a = fetch name:x | a; a"])
def test_errors(query):
    with pytest.raises(ValueError):
        m3.plan(query)


def test_known_but_unimplemented_is_another_error():
    with pytest.raises(NotImplementedError, match="anomalies"):
        m3.plan("fetch name:a | anomalies")
