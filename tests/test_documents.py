"""Usable samples, regular grids, rolling totals and implausible readings on small hand-made tables and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import session
from tidegrid.operators import spikes
from tidegrid.operators.grid import regular_grid
from tidegrid.operators.rolling import rolling_totals
from tidegrid.sources.documents import canonical_text, parsed_value, usable_samples

DOC = "row_id long, labels string, series_ref long, sample_ts long, sample_value double, value_text string, min_ts string"
CAT = "series_ref long, labels map<string,string>, min_ts long, max_ts long, grid_ms long, row_id string"
NAN, INF = float("nan"), float("inf")


def test_canonical_text(spark):
    texts = ["b 2 a 1", "a 1 b 2", "a  b 2", "b 2 a ", "", None, "a 1 a 1", "a 1 b", "k é"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(canonical_text(F.col("t"))).collect()]
    assert got[0] == got[1] == "a\u00011\u0002b\u00012"
    assert got[2] == got[3] == "a\u0001\u0002b\u00012"
    assert got[4] == "" and got[5] is None and got[6] == "a\u00011" and "\u0001" not in got[7].split("\u0002")[-1]


def test_parsed_value(spark):
    texts = [" 12.50 ", "+1.5e+1", "-.5", "7.", "+Inf", " -Inf\t", "Inf", "nan", "NaN", "12;5", "", " ", "1d", "0x1", "--", None, "1 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parsed_value(F.lit(None).cast("double"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [12.5, 15.0, -0.5, 7.0, INF, -INF] + [None] * 11


@pytest.mark.parametrize("by_text", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_usable_samples(spark, monkeypatch, broadcast, by_text):
    if not broadcast:
        monkeypatch.setattr("tidegrid.sources.documents.small_side", lambda df: df)
    docs = [
        (1, "b 2 a 1", None, 10, 1.0, None, "x"),
        (2, None, 7, 10, None, "2.5", "x"),
        (3, "a 1 b 2", 99, 19, NAN, None, "x"),  # labels decide, not the reference
        (4, "a 1 b 2", None, 21, 1.0, None, "x"),  # after its life
        (5, "a 1 b 2", None, 15, None, "n/a", "x"),
        (6, None, None, 15, 1.0, None, "x"),
        (7, None, 8, 15, 1.0, None, "x"),
        (8, "a 1", 7, 15, 1.0, None, "x"),  # unknown labels, known reference
        (9, "b 2 a 1", None, None, 1.0, None, "x"),
        (1, "b 2 a 1", None, 10, 1.0, None, "x"),  # sent twice
        (10, "c ", None, 15, None, "+Inf", "x"),
    ]
    cat = [(7, {"a": "1", "b": "2"}, 10, 20, 5, "clash"), (11, {"c": ""}, 0, 30, 5, "clash"), (12, None, 0, 30, 5, "clash")]
    out = usable_samples(spark.createDataFrame(docs, DOC), spark.createDataFrame(cat, CAT), ["grid_ms"], by_text)
    assert sorted((r["row_id"], r["series_ref"]) for r in out.collect()) == [(1, 7), (1, 7), (2, 7), (3, 7), (10, 11)]
    assert out.columns == ["row_id", "sample_ts", "value", "series_ref", "min_ts", "max_ts", "grid_ms"]
    empty = usable_samples(spark.createDataFrame([], DOC), spark.createDataFrame(cat, CAT), [], by_text)
    assert empty.count() == 0


def brute_grid(readings, series, stale):
    out = {}
    for ref, lo, hi, g in series:
        if not g or g <= 0 or lo > hi:
            continue
        own = sorted({(ts, v) for ts, v in {r[1]: r[2] for r in reversed([x for x in readings if x[0] == ref])}.items()})
        for slot in range(lo // g * g, hi // g * g + 1, g):
            n = sum(1 for r in readings if r[0] == ref and slot <= r[1] < slot + g)
            cover = area = 0
            for i, (ts, v) in enumerate(own):
                until = min(own[i + 1][0] if i + 1 < len(own) else ts + stale * g, ts + stale * g)
                part = min(until, slot + g) - max(ts, slot)
                if part > 0 and math.isfinite(v):
                    cover, area = cover + part, area + part * v
            out[ref, slot] = (n, round(area / cover, 6) if cover else None, round(cover / g, 6), "observed" if n else "carried" if cover else "missing")
    return out


@pytest.mark.parametrize("stale,block", [(2, 64), (3, 4), (1, 2)])
def test_regular_grid_against_brute_force(spark, stale, block):
    rnd = random.Random(stale)
    series = [(1, 3, 955, 10), (2, -45, 200, 7), (3, 0, 50, 10), (4, 5, 3, 10), (5, 0, 9, None), (6, 100, 100, 50)]
    readings, seq = [], 0
    for ref, lo, hi, g in series[:2]:
        for _ in range(150):
            readings.append((ref, rnd.randint(lo, hi), rnd.choice([NAN, INF, 1.0, 2.5, -3.0, 8.0]), seq, g))
            seq += 1
    readings += [(r[0], r[1], 99.0, seq + i, r[4]) for i, r in enumerate(readings[:20])]
    got = regular_grid(spark.createDataFrame(readings, "series_ref long, sample_ts long, value double, row_id long, grid_ms long"), spark.createDataFrame(series, "series_ref long, min_ts long, max_ts long, grid_ms long"), stale, block)
    have = {(r["series_ref"], r["slot_ts"]): (r["n_readings"], None if r["mean"] is None else round(r["mean"], 6), round(r["coverage"], 6), r["status"]) for r in got.collect()}
    assert got.count() == len(have) and have == brute_grid(readings, series, stale)


def test_slots_without_a_sample_come_from_the_intervals(spark):
    from tidegrid.queries.problems import p2_found

    plan = p2_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the window that ends an interval where the next reading begins, and the one that carries it into later slots
    assert plan.count("Window [") == 2 and "lead(ts" in plan and "last(" in plan


def test_grid_of_empty_tables(spark):
    r = spark.createDataFrame([], "series_ref long, sample_ts long, value double, row_id long, grid_ms long")
    s = spark.createDataFrame([], "series_ref long, min_ts long, max_ts long, grid_ms long")
    assert regular_grid(r, s).count() == 0
    with pytest.raises(ValueError):
        regular_grid(r, s, stale_slots=64)


def test_rolling_against_brute_force(spark):
    rnd, day = random.Random(5), 86_400_000
    rows = [(rnd.choice("ab"), rnd.choice([0, 1, 2, 9, 10, 40, 41, 77]) * day + rnd.randint(0, day - 1), rnd.choice([0.0, 1.5, -2.0, 7.0])) for _ in range(60)]
    rows += [("c", 5 * day, 3.0), ("c", 5 * day, 3.0), ("d", -3 * day, 1.0), ("d", 2 * day, INF), ("e", day, NAN), (None, day, 1.0), ("f", None, 1.0), ("f", day, None)]
    got = rolling_totals(spark.createDataFrame(rows, "k string, sample_ts long, value double"), "k", (1, 7, 30)).collect()
    have = {(r["k"], r["day_utc"], r["window_days"]): (r["n_samples"], r["n_active_days"], r["total"]) for r in got}
    want = {}
    for k in "abcd":
        own = [(ts // day, v) for kk, ts, v in rows if kk == k]
        for d in range(min(x for x, _ in own), max(x for x, _ in own) + 1):
            for w in (1, 7, 30):
                inside = [(x, v) for x, v in own if d - w < x <= d]
                want[k, str(np.datetime64("1970-01-01") + d), w] = (len(inside), len({x for x, _ in inside}), sum(v for _, v in inside))
    assert len(got) == len(have) and have.keys() == want.keys()
    assert all(have[k][:2] == want[k][:2] and (have[k][2] == want[k][2] or abs(have[k][2] - want[k][2]) < 1e-9) for k in want)


def waves(n, seed=0):
    rng = np.random.default_rng(seed)
    ts = np.arange(n) * 300_000 + rng.integers(0, 60_000, n)
    return ts, 50 + 10 * np.sin(ts / 86_400_000 * 2 * np.pi) + rng.normal(0, 0.5, n)


def kinds(ts, v, low=np.nan, high=np.nan):
    return spikes.judge(ts, v, low, high)["kind"].to_numpy()


def test_spikes_limits_and_frozen_stretches():
    ts, v = waves(900)
    v[100] += 20
    v[200:206] -= 15
    v[300:320] = v[300]
    v[400:415] = v[400] + np.random.default_rng(1).normal(0, 0.005, 15)
    v[500], v[501], v[502] = 150, np.inf, np.nan
    v[600:] += 30  # a lasting change is no case
    want = np.zeros(900, int)
    want[100] = want[200:206] = spikes.SPIKE
    want[100], want[200:206], want[300:320], want[400:415], want[500:502] = spikes.SPIKE, spikes.SPIKE, spikes.FROZEN, spikes.FROZEN, spikes.LIMIT
    assert (kinds(ts, v, 0, 120) == want).all()


def test_off_phases_trends_and_quiet_sources_are_no_cases():
    ts, v = waves(800, 2)
    v[np.arange(800) % 40 < 10] = 0.0
    assert not kinds(ts, v).any()
    ts, v = waves(800, 3)
    assert not kinds(ts, v + np.arange(800) * 0.3).any()
    assert not kinds(ts, np.full(800, 4.0)).any()
    assert not kinds(ts[:5], v[:5]).any() and not kinds(ts[:0], v[:0]).any()
    assert not kinds(ts[:60], np.full(60, np.nan)).any()


def test_a_frozen_stretch_of_rounded_values():
    ts, v = waves(700, 7)
    v = np.round(v * 6)
    v[200:218] = v[200] + (np.arange(18) % 3 == 1)
    v[199], v[218] = v[200] - 4, v[200] + 5  # neighbours that could not belong to it
    want = np.zeros(700, int)
    want[200:218] = spikes.FROZEN
    assert (kinds(ts, v) == want).all()


def test_a_spike_soon_after_a_lasting_change():
    ts, v = waves(600, 6)
    v[300:] += 25
    v[304:307] -= 20
    want = np.zeros(600, int)
    want[304:307] = spikes.SPIKE
    assert (kinds(ts, v) == want).all()


def test_every_reading_is_judged_once_also_in_periods(spark, monkeypatch):
    monkeypatch.setattr(spikes, "PERIOD_READINGS", 300)
    ts, v = waves(1000, 4)
    v[450] += 30
    rows = [(1, int(t), float(x), i, 0.0, 100.0) for i, (t, x) in enumerate(zip(ts, v))]
    rows += [(1, int(ts[10]), 500.0, 5000, 0.0, 100.0), (2, 0, None, 1, None, None), (3, 0, 1.0, 2, None, None), (3, 0, 1.0, 2, None, None)]
    df = spark.createDataFrame(rows, "series_ref long, sample_ts long, value double, row_id long, low_limit double, high_limit double")
    got = spikes.judged_readings(df).collect()
    assert sorted((r["series_ref"], r["sample_ts"]) for r in got) == sorted([(1, int(t)) for t in ts] + [(3, 0)])
    assert [(r["sample_ts"], r["kind"]) for r in got if r["kind"]] == [(int(ts[450]), "spike")]
    assert spikes.judged_readings(df.limit(0)).count() == 0


def test_small_side_counts_first(spark):
    df = spark.range(10)
    assert "hint" in session.small_side(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in session.small_side(df, 9)._jdf.queryExecution().logical().toString().lower()


def judged(spark, ts, v):
    df = spark.createDataFrame([(1, int(t), float(x), i, None, None) for i, (t, x) in enumerate(zip(ts, v))], "series_ref long, sample_ts long, value double, row_id long, low_limit double, high_limit double")
    return np.array([r["kind"] or "" for r in sorted(spikes.judged_readings(df).collect(), key=lambda r: r["sample_ts"])])


def test_a_sensor_stuck_for_longer_than_a_period(spark, monkeypatch):
    monkeypatch.setattr(spikes, "PERIOD_READINGS", 300)
    ts, v = waves(2000, 8)
    v[500:1500] = v[500]
    v[1700:1720] = v[1700]
    want = np.full(2000, "", dtype=object)
    want[500:1500] = want[1700:1720] = "frozen"
    assert (judged(spark, ts, v) == want).all()


def test_off_phases_rarer_than_three_a_period(spark, monkeypatch):
    monkeypatch.setattr(spikes, "PERIOD_READINGS", 300)
    ts, v = waves(2000, 9)
    v[np.arange(2000) % 200 < 30] = 0.0
    assert not (judged(spark, ts, v) != "").any()
    v[1000:1100] = 0.0  # far longer than a phase, over a border of periods
    want = np.full(2000, "", dtype=object)
    want[1000:1100] = "frozen"
    assert (judged(spark, ts, v) == want).all()


def test_sources_that_usually_repeat_their_value():
    rng = np.random.default_rng(11)
    ts = np.arange(3000) * 300_000
    v = np.repeat(20.0 + rng.integers(0, 3, 1500).cumsum() % 5, rng.integers(2, 4, 1500))[:3000]  # coarse values
    v[1000:1500] = v[1000]
    v[999], v[1500] = v[1000] - 1, v[1000] + 1
    v[2000] += 40
    v[2200:2203] -= 60
    want = np.zeros(3000, int)
    want[1000:1500], want[2000], want[2200:2203] = spikes.FROZEN, spikes.SPIKE, spikes.SPIKE
    assert (kinds(ts, v) == want).all()
    v = np.full(900, 4.0)  # constant, with spikes of different height
    v[300], v[600:602] = 80.0, 55.0
    want = np.zeros(900, int)
    want[300] = want[600:602] = spikes.SPIKE
    assert (kinds(ts[:900], v) == want).all()
    v[600:602] = 4.0
    want[600:602] = 0
    assert (kinds(ts[:900], v) == want).all()
    v = np.repeat(18.0 + 4 * (np.arange(30) % 2), 100)  # set points
    assert not kinds(ts, v).any()
    v = np.floor(np.arange(3000) / 3.0)  # a counter of small integers
    assert not kinds(ts, v).any()
    v[1500:2100] = v[1500]
    want = np.zeros(3000, int)
    want[1500:2100] = spikes.FROZEN
    assert (kinds(ts, v) == want).all()


def test_facts_do_not_depend_on_how_a_source_is_cut():
    rng = np.random.default_rng(7)
    ts, v = waves(4000, 23)
    v[np.arange(4000) % 200 < 30] = 0.0
    for s in rng.integers(0, 3900, 12):
        v[s : s + int(rng.integers(5, 90))] = v[s]
    v[1700:2900] = v[1700]
    v[rng.integers(0, 4000, 40)] = NAN
    for y in (v, np.round(v / 8), np.full(4000, 3.0), np.full(4000, NAN)):
        whole = spikes._facts([spikes._part(ts, y, NAN, NAN)])
        for size in (1, 7, 300, 1500):
            parts = [spikes._part(ts[i : i + size], y[i : i + size], NAN, NAN) for i in range(0, 4000, size)]
            flat = spikes._facts(parts)
            while len(parts) > 1:
                parts = [spikes.reduce(spikes._joined, parts[i : i + 3]) for i in range(0, len(parts), 3)]
            tree = spikes._facts(parts)
            assert (tree.phases == flat.phases).all() and (tree.long == flat.long).all()
            for f in (flat, tree):
                assert f.readings == 4000 and (f.phases == whole.phases).all() and f.usual == whole.usual and f.longest == whole.longest
            assert flat.noise == tree.noise and flat.step == tree.step
            if size >= 300:
                assert flat.noise == pytest.approx(whole.noise, rel=0.02)


def test_coarse_sources_in_periods(spark, monkeypatch):
    monkeypatch.setattr(spikes, "PERIOD_READINGS", 300)
    v = np.floor(np.arange(2000) / 3.0) % 7 + 20
    v[600:1500] = 30.0
    v[1800] += 50
    want = np.full(2000, "", dtype=object)
    want[600:1500], want[1800] = "frozen", "spike"
    assert (judged(spark, np.arange(2000) * 300_000, v) == want).all()


def test_zeros_at_irregular_distances_are_no_off_phases():
    ts, v = waves(2000, 12)
    want = np.zeros(2000, int)
    for s, k, kind in ((210, 4, spikes.SPIKE), (500, 5, spikes.SPIKE), (1370, 4, spikes.SPIKE), (1500, 6, spikes.SPIKE)):
        v[s : s + k], want[s : s + k] = 0.0, kind
    assert (kinds(ts, v) == want).all()
    ts, v = waves(2000, 13)
    want = np.zeros(2000, int)
    for s, k in ((210, 40), (500, 44), (1700, 42)):  # stuck at 0
        v[s : s + k], want[s : s + k] = 0.0, spikes.FROZEN
    assert (kinds(ts, v) == want).all()


def test_a_dropout_between_off_phases():
    ts, v = waves(2000, 14)
    v[np.arange(2000) % 100 < 10] = 0.0
    v[1004] = v[50]  # an interrupted phase
    v[500:510] = v[511]  # a phase that did not come
    v[500:510] += np.random.default_rng(1).normal(0, 0.5, 10)
    v[1250:1255] = 0.0
    got = kinds(ts, v)
    assert (got[1250:1255] == spikes.SPIKE).all() and not np.delete(got, np.arange(1250, 1255))[v[np.delete(np.arange(2000), np.arange(1250, 1255))] == 0].any()


def test_periods_are_bounded_by_readings_also_of_a_bunched_source(spark, monkeypatch):
    monkeypatch.setattr(spikes, "PERIOD_READINGS", 300)
    ts, v = waves(1500, 15)
    ts[:1400] = ts[0] + np.arange(1400) * 1000  # most readings in a small part of its life
    v[700] += 30
    groups = spark.sparkContext.accumulator(0)
    judge = spikes._judge_group

    def counted(g):
        groups.add(int(len(g) > 300 + 2 * 20 + 1))
        return judge(g)

    monkeypatch.setattr(spikes, "_judge_group", counted)
    want = np.full(1500, "", dtype=object)
    want[700] = "spike"
    assert (judged(spark, ts, v) == want).all() and groups.value == 0


def test_a_spike_in_a_short_source():
    for n in range(5, 10):
        ts, v = waves(n, n)
        assert not kinds(ts, v).any()
        v[2] += 40
        assert (kinds(ts, v) == np.where(np.arange(n) == 2, spikes.SPIKE, 0)).all()
        v = np.where(np.arange(n) == 2, 80.0, 4.0)
        assert (kinds(ts, v) == np.where(np.arange(n) == 2, spikes.SPIKE, 0)).all()
        assert not kinds(ts, np.full(n, 4.0)).any()
    assert not kinds(ts[:4], np.array([4.0, 4.0, 80.0, 4.0])).any()


def test_the_forest_decides(monkeypatch):
    """With a threshold of 0, or without scores, the same extents give other cases."""
    ts, v = waves(900, 21)
    noise = 0.5
    rng = np.random.default_rng(3)
    for s, k in ((100, 1), (200, 3), (640, 6)):
        v[s : s + k] = np.median(v[s - 5 : s + 5]) + 6 * noise + rng.normal(0, 0.1, k)
    v[300:303] += 30 * noise
    v[450:461] = v[450] + np.linspace(0, 0.58 * noise, 11)  # hardly still
    v[700:715] = v[700]
    want = np.zeros(900, int)
    want[300:303], want[700:715] = spikes.SPIKE, spikes.FROZEN
    assert (kinds(ts, v) == want).all()
    monkeypatch.setattr(spikes, "CASE", 0.0)
    loose = kinds(ts, v)
    assert loose[100] == loose[201] == loose[642] == spikes.SPIKE and loose[455] == spikes.FROZEN
    monkeypatch.setattr(spikes, "CASE", 0.5)
    monkeypatch.setattr(spikes, "_scores", lambda forest, features: np.zeros(len(features)))
    assert not kinds(ts, v).any()


def test_scores_rise_with_each_feature_and_mean_the_same_for_every_source():
    from tidegrid.functions.iforest import IsolationForest

    rng = np.random.default_rng(5)
    for n in (300, 5000):
        usual = np.column_stack([spikes._squashed(np.abs(rng.normal(0, s, n)), m) for s, m in ((1.2, spikes.FAR), (1.0, spikes.APART), (3.0, spikes.APART))] + [np.zeros(n)])
        forest = IsolationForest(usual, spikes.TREES, spikes.PSI, seed=n)
        own = forest.score(usual)
        assert np.quantile(own, 0.99) < 0.45 and np.median(own) < 0.3
        for feature in range(4):
            row = np.zeros((5, 4))
            row[:, feature] = [0.0, 0.2, 0.5, 0.8, 1.0]
            score = forest.score(row)
            assert (np.diff(score) > 0).all() and score[0] < 0.3 and score[-1] > 0.6


def test_cases_do_not_depend_on_periods(spark, monkeypatch):
    ts, v = waves(6000, 22)
    rng = np.random.default_rng(4)
    for s in range(150, 5900, 310):
        v[s : s + int(rng.integers(1, 9))] += rng.choice([-1, 1]) * rng.uniform(4, 40) * 0.5
    for s in range(290, 5900, 620):
        k = int(rng.integers(10, 40))
        v[s : s + k] = v[s] + rng.normal(0, rng.choice([0.0, 0.02, 0.08, 0.15]), k)
    got = []
    for readings, fan in ((20_000, 64), (2_600, 64), (2_048, 2)):
        monkeypatch.setattr(spikes, "PERIOD_READINGS", readings)
        monkeypatch.setattr(spikes, "FAN", fan)
        got.append(judged(spark, ts, v))
    assert (got[0] != "").sum() > 100 and (got[0] == got[1]).all() and (got[0] == got[2]).all()
