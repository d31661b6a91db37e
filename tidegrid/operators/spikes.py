"""Implausible readings: physical limits, spikes and frozen stretches, by an isolation forest per source."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.iforest import IsolationForest
from tidegrid.session import checkpointed, small_side

#: Readings of one source that are judged together at most, about: a source with more is cut into periods of equal numbers of readings with a margin on both sides.
PERIOD_READINGS = 20_000
#: What periods tell about their source is joined by so many at a time.
FAN = 64
#: Forest: trees, rows per tree, readings of a source they are drawn from, and the score from which a reading is a case unless its surroundings excuse it.
TREES, PSI, SAMPLE, CASE = 64, 128, 4096, 0.5
#: Features lie between 0 and 1, in this many steps; 0.5 stands for a level, and for a difference or distance from the season, of so many times the usual noise, and for a still stretch of so much evidence.
STEPS, FAR, APART, EVIDENCE = 127, 9.0, 13.0, 9.5
#: Extents: longest spike and shortest frozen stretch in readings; distance from the level, in units of the usual noise, at which a reading has left it; parts of the usual noise within which a stretch may be still, in order.
SPIKE_MAX, FROZEN_MIN, LEFT, STILL = 9, 10, 4.0, (0.3, 0.42, 0.6)
#: Readings before and after one that tell its level and the noise around it; smallest part of the noise that evidence tells apart.
LEVEL_HALF, NOISE_HALF, STILLEST = 15, 64, 0.01
#: Fewest readings of a source that tell what is usual for it.
SHORTEST = 5
#: For sources that usually repeat their value: part of the runs of equal values that are usual, and the number of sources that may have one longer run by chance in one of them.
USUAL_RUNS, BY_CHANCE = 0.95, 100
#: Part of that length from which a run of equal values is looked at.
LONG = 0.7
#: Decimals, and part of the value, down to which the values of a source are told apart.
DECIMALS, RELATIVE = 6, 1e-6
#: Off phases: least number; part of their usual distance by which a distance may differ from it, and part of the distances that must keep to this; number of distances to another phase, for gaps in the readings.
PHASES_MIN, PHASE_SPREAD, PHASE_SHARE, PHASE_REACH = 3, 0.2, 0.75, 7
DAY_MS = 86_400_000
#: Kinds of case by their code in the Python workers, whose results stay numeric; 0 is none.
KINDS = ("limit", "spike", "frozen")
LIMIT, SPIKE, FROZEN = 1, 2, 3


def _median(x: np.ndarray, half: int) -> np.ndarray:
    """Centred rolling median over 2 * half + 1 values, fewer at the ends of a short array; the ends repeat the outermost full window."""
    half = min(half, (len(x) - 1) // 2)
    if half < 1:
        return x.copy()
    mid = np.median(sliding_window_view(x, 2 * half + 1), axis=1)
    return np.concatenate([np.full(half, mid[0]), mid, np.full(half, mid[-1])])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each stretch of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def _counted(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each comes."""
    return np.unique(d, return_counts=True)


def _merged(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list of distinct values and counts from several."""
    value, at = np.unique(np.concatenate([v for v, _ in counted]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([c for _, c in counted]), len(value)).astype(np.int64)


def _middle(counted: tuple[np.ndarray, np.ndarray]) -> float:
    """Median of values with counts; 0 for none."""
    value, count = counted
    n = int(count.sum())
    if n == 0:
        return 0.0
    upto = np.cumsum(count)
    return float((value[np.searchsorted(upto, (n - 1) // 2, "right")] + value[np.searchsorted(upto, n // 2, "right")]) / 2)


def _noise(counted: tuple[np.ndarray, np.ndarray]) -> float:
    """Usual noise from the differences of neighbours; 0 if most don't differ."""
    return 1.4826 * _middle(counted) / np.sqrt(2)


def _plausible(value: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the readings beyond the limits, and positions of the others that are numbers."""
    with np.errstate(invalid="ignore"):
        out = np.isinf(value) | (value < low) | (value > high)
    return out, np.flatnonzero(~np.isnan(value) & ~out)


def _equal_runs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else np.zeros(0, dtype=int)
    return starts, np.diff(np.concatenate([starts, [len(y)]])).astype(int)


@dataclass
class Part:
    """What a period, or several in a row, tell about their source. runs: (start time, end time, readings, value) of the first and last run of equal values, the same one if there is no other. zero: (start time, end time, readings) of the runs of 0 between these. long: the same of runs that cross a border of periods. changes: differences of lively neighbours, those of runs of 0 left out, and with them. lengths: readings of the runs between the first and the last. steps: changes of the level, which spikes don't move. resolution: the least step that the values can show. readings: their number."""

    runs: list[tuple[int, int, int, float]]
    zero: np.ndarray
    long: list[tuple[int, int, int]]
    changes: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    lengths: tuple[np.ndarray, np.ndarray]
    steps: tuple[np.ndarray, np.ndarray]
    resolution: float
    readings: int


@dataclass
class Facts:
    """What holds for a source as a whole. noise: usual noise. phases: start and end time of the off phases, usual: their usual readings. long: start time, end time and readings of the runs of equal values that cross a border of periods. step: usual step between levels, at least the resolution of the values. longest: readings from which a run of equal values is longer than the source's other runs let expect. readings: their number."""

    noise: float
    phases: np.ndarray
    usual: float
    long: np.ndarray
    step: float
    longest: float
    readings: int


def _part(ts: np.ndarray, value: np.ndarray, low: float, high: float) -> Part:
    """The facts of one period in order of time, without the margins. Differences are rounded to 8 bits, which bounds how many are distinct."""
    _, at = _plausible(value, low, high)
    t, y = ts[at], value[at]
    starts, length = _equal_runs(y)
    run = np.repeat(length, length)
    lively = _lively(run)
    changes = []
    for flags in (lively & ~((y == 0.0) & (run >= 3)), lively):
        changes.append(_counted(_rounded(np.abs(np.diff(y[flags])))))
    steps, resolution = np.zeros(0), np.inf
    if len(y) and min(map(_middle, changes)) == 0.0:
        level = _median(y, SPIKE_MAX)
        steps, resolution = np.abs(np.diff(level)), _resolution(level)
    ends = starts + length - 1
    runs = [(int(t[starts[i]]), int(t[ends[i]]), int(length[i]), float(y[starts[i]])) for i in ((0, -1) if len(starts) else ())]
    inner = np.arange(1, len(starts) - 1)
    lengths = _counted(length[inner])
    inner = inner[(y[starts[inner]] == 0.0) & (length[inner] >= 3)]
    return Part(runs, np.column_stack([t[starts[inner]], t[ends[inner]], length[inner]]).astype(np.int64).reshape(-1, 3), [], tuple(changes), lengths, _counted(_rounded(steps[steps > 0])), resolution, len(ts))


def _lively(run: np.ndarray) -> np.ndarray:
    """Flags of the readings, given the length of the run each lies in, that tell how the source varies: all in short runs, but not where fewer than FROZEN_MIN of them stand next to a long one, which may be spikes."""
    flags = run < FROZEN_MIN
    if not flags.all():
        for s, e in _runs(flags):
            if e - s < FROZEN_MIN:
                flags[s:e] = False
    return flags


def _rounded(d: np.ndarray) -> np.ndarray:
    mantissa, exponent = np.frexp(d)
    return np.ldexp(np.round(mantissa * 256) / 256, exponent)


def _noise_of_few(y: np.ndarray) -> float:
    """Usual noise of fewer than FROZEN_MIN readings, of whose differences a spike spoils two: from the lower median of these, at least the resolution of the values."""
    d = np.sort(np.abs(np.diff(y)))
    few = np.array([d[(len(d) - 1) // 2]])
    return _noise(_counted(few)) or _resolution(np.sort(y)[[len(y) // 2]])


def _resolution(level: np.ndarray) -> float:
    """The unit of the last decimal that the values use, up to DECIMALS, and not under RELATIVE of them."""
    level = np.unique(level)
    least = max(10.0**-DECIMALS, RELATIVE * float(np.abs(level).max()))
    for k in range(DECIMALS):
        if np.allclose(level, np.round(level, k), rtol=0, atol=1e-9):
            return max(10.0**-k, least)
    return least


def _longest(lengths: tuple[np.ndarray, np.ndarray]) -> float:
    """Readings that a run of equal values reaches by chance in one of BY_CHANCE sources: the tail of the usual runs, carried on as that of a geometric distribution. Too few runs have no tail, so that nothing is too long."""
    value, count = lengths
    n = int(count.sum())
    if n == 0:
        return np.inf
    high = value[np.searchsorted(np.cumsum(count), int(np.ceil(USUAL_RUNS * (n - 1))), "right")]
    return max(FROZEN_MIN, float(high) * np.log(BY_CHANCE * n) / -np.log(1 - USUAL_RUNS))


def _zeros(runs: list) -> np.ndarray:
    """Those of some runs that may be off phases."""
    return np.array([r[:3] for r in runs if r[3] == 0.0 and r[2] >= 3], dtype=np.int64).reshape(-1, 3)


def _lengths(runs: list) -> tuple[np.ndarray, np.ndarray]:
    return _counted(np.array([r[2] for r in runs], dtype=np.int64))


def _ends(p: Part) -> list:
    """First and last run of a part, once if they are one."""
    return p.runs[:1] if p.runs and p.runs[0] == p.runs[1] else p.runs


def _joined(a: Part, b: Part) -> Part:
    """Two parts that follow each other as one: a run that goes on over the border is joined before it is looked at."""
    runs, more, long = _ends(a), _ends(b), [*a.long, *b.long]
    if runs and more and runs[-1][3] == more[0][3]:
        x, y = runs[-1], more[0]
        both = (x[0], y[1], x[2] + y[2], x[3])
        long = [r for r in long if r[0] not in (x[0], y[0])] + [both[:3]]
        runs, more = [*runs[:-1], both], more[1:]
    runs = [*runs, *more]
    inner = runs[1:-1]
    return Part(
        [runs[0], runs[-1]] if runs else [],
        np.concatenate([a.zero, _zeros(inner), b.zero]),
        long,
        tuple(_merged([x, y]) for x, y in zip(a.changes, b.changes)),
        _merged([a.lengths, b.lengths, _lengths(inner)]),
        _merged([a.steps, b.steps]),
        min(a.resolution, b.resolution),
        a.readings + b.readings,
    )


def _facts(parts: list[Part]) -> Facts:
    """Facts of a source from its parts in order of time."""
    p = reduce(_joined, parts)
    ends = _ends(p)
    zero = np.concatenate([p.zero, _zeros(ends)])
    phases, usual = _phases(zero[np.argsort(zero[:, 0], kind="stable")])
    steps = _middle(p.steps)
    step = max(steps, p.resolution) if np.isfinite(p.resolution) else steps
    long = np.array(sorted(p.long), dtype=np.int64).reshape(-1, 3)
    return Facts(_noise(p.changes[0 if len(phases) else 1]), phases, usual, long, step, _longest(_merged([p.lengths, _lengths(ends)])), p.readings)


def _phases(zero: np.ndarray) -> tuple[np.ndarray, float]:
    """(start, end) of off phases among a source's runs (start time, end time, readings) of three or more zeros in order, and their usual readings: off phases come back at regular distances, and a stretch of 0 that is far longer than they are is not one of them."""
    none = zero[:0, :2], 0.0
    if len(zero) < PHASES_MIN:
        return none
    usual = float(np.median(zero[:, 2]))
    fit = zero[zero[:, 2] <= max(2 * usual, usual + 5)]
    pace = np.median((fit[:, 1] - fit[:, 0]) / (fit[:, 2] - 1))
    # a phase that a few other readings interrupt is one phase; but phases may also be that close together
    apart = np.concatenate([[True], fit[1:, 0] - fit[:-1, 1] > (SPIKE_MAX + 1) * pace])
    for first in (apart, np.ones(len(fit), dtype=bool)):
        starts = fit[first, 0]
        on = _regular(starts)
        if on.any():
            return fit[on[np.cumsum(first) - 1], :2], usual
    return none


def _regular(starts: np.ndarray) -> np.ndarray:
    """Flags of the times that come back regularly: all false if the distances spread too far around their median, else those that lie a few median distances from another one."""
    on = np.zeros(len(starts), dtype=bool)
    if len(starts) < PHASES_MIN:
        return on
    gap = np.diff(starts)
    usual = np.median(gap)
    if (np.abs(gap - usual) <= PHASE_SPREAD * usual).mean() < PHASE_SHARE:
        return on
    for m in (*range(-PHASE_REACH, 0), *range(1, PHASE_REACH + 1)):
        want = starts + m * usual
        i = np.clip(np.searchsorted(starts, want), 1, len(starts) - 1)
        on |= np.minimum(np.abs(starts[i] - want), np.abs(starts[i - 1] - want)) <= PHASE_SPREAD * usual
    return on


def _still(y: np.ndarray, width: float, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` values that stay within width, with their ends cut back to what the inside of the stretch looks like."""
    if len(y) < least:
        return []
    w = sliding_window_view(y, least)
    calm = (w.max(axis=1) - w.min(axis=1)) <= width
    out = []
    for a, b in _runs(calm):
        b = b + least - 1
        inside = y[a + 2 : b - 2]
        low, high = np.quantile(inside, [0.05, 0.95])
        pad = 0.5 * (high - low)
        fits = (y[a:b] >= min(low - pad, inside.min())) & (y[a:b] <= max(high + pad, inside.max()))
        runs = _runs(fits)
        if not runs:
            continue
        s, e = max(runs, key=lambda r: r[1] - r[0])
        if e - s >= least:
            out.append((a + s, a + e))
    return out


@dataclass
class View:
    """What is there to judge in a row of readings. out: flags of those beyond the limits; at: positions of the others that are numbers. features: of these, between 0 and 1. once: flags of those that the forest may learn from. still: stretches that hardly vary, as [start, end) among them. rest: positions of those outside such stretches and off phases; unit: the noise that is usual around these."""

    out: np.ndarray
    at: np.ndarray
    y: np.ndarray
    features: np.ndarray
    once: np.ndarray
    still: list[tuple[int, int]]
    rest: np.ndarray
    unit: np.ndarray


def _squashed(x: np.ndarray, middle: float) -> np.ndarray:
    """x from 0 up as a number between 0 and 1, in STEPS steps, that is 0.5 at middle and changes most around it: usual values lie close together at 0, and what is far beyond middle close to 1."""
    with np.errstate(over="ignore", invalid="ignore"):
        r = np.minimum(x / middle, 1e3) ** 4
    return np.round(r / (1 + r) * STEPS) / STEPS


def _view(ts: np.ndarray, value: np.ndarray, low: float, high: float, facts: Facts) -> View:
    """The features of readings in order of time: distance from the level around them, difference to the nearer neighbour, distance from the values at this time the day before and after (the nearer one), all in units of the noise that is usual for the source and around them; and the evidence of the still stretch they lie in."""
    out, at = _plausible(value, low, high)
    t, y = ts[at], value[at]
    starts, length = _equal_runs(y)
    off = _within(t, facts.phases) & (y == 0.0)
    if len(facts.phases) and facts.usual >= 4:  # the remains of a phase that lost readings
        for i in np.flatnonzero((y[starts] == 0.0) & (length < 3)):
            s, e = starts[i], starts[i] + length[i]
            if s == 0 or e == len(y) or off[max(0, s - 2) : s].any() or off[e : e + 2].any():
                off[s:e] = True
    evidence = np.zeros(len(y))
    still: list[tuple[int, int]] = []
    if len(y) < FROZEN_MIN:
        usual = _noise_of_few(y) if len(y) > 1 else 0.0
    elif facts.noise > 0.0:
        usual = facts.noise
        for width in STILL:
            for s, e in _still(y, width * usual, FROZEN_MIN):
                if not any(a < e and s < b for a, b in still) and not off[s:e].all():
                    still.append((s, e))
                    evidence[s:e] = (e - s - 1) * np.log(1 / max(np.ptp(y[s:e]) / usual, STILLEST))
    else:  # the source usually repeats its value
        usual = facts.step
        run = np.repeat(length, length)
        for s, e, k in facts.long:
            run[(t >= s) & (t <= e)] = k
        for i in np.flatnonzero(run[starts] >= max(FROZEN_MIN, LONG * facts.longest)):
            s, e = starts[i], starts[i] + length[i]
            if not off[s:e].all():
                still.append((s, e))
                evidence[s:e] = EVIDENCE * run[s] / facts.longest
    rest = np.flatnonzero((evidence == 0.0) & ~off)
    unit = np.full(len(y), usual or 1.0)
    level, step, season = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    if len(rest) > 1:
        z = y[rest]
        d = np.abs(np.diff(z))
        if facts.noise > 0.0 and len(z) > 2 * NOISE_HALF:
            around = _median(d, NOISE_HALF) * (1.4826 / np.sqrt(2))
            unit[rest] = np.maximum(unit[rest], np.append(around, around[-1]))
        level[rest] = np.abs(z - _median(z, LEVEL_HALF)) / unit[rest]
        step[rest] = np.minimum(np.append(d, d[-1]), np.insert(d, 0, d[0])) / unit[rest]
        tz = t[rest]
        other = np.full((2, len(z)), np.inf)
        for i, days in enumerate((-DAY_MS, DAY_MS)):
            k = np.clip(np.searchsorted(tz, tz + days), 1, len(tz) - 1)
            k -= tz + days - tz[k - 1] < tz[k] - tz - days
            near = np.abs(tz[k] - tz - days) <= DAY_MS // 24
            other[i, near] = np.abs(z - z[k])[near]
        other = other.min(axis=0)
        season[rest] = np.where(np.isfinite(other), other, 0.0) / unit[rest]
    features = np.column_stack([_squashed(f, m) for f, m in ((level, FAR), (step, APART), (season, APART), (evidence, EVIDENCE))])
    once = np.ones(len(y), dtype=bool)
    for s, e in [*still, *_runs(off), *_runs(level > LEFT)]:
        once[s + 1 : e] = False
    return View(out, at, y, features, once, still, rest, unit[rest])


def _sample(ts: np.ndarray, v: View, readings: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and features of the readings from which a source's forest may be drawn: those with small hashes, about twice SAMPLE of all of the source's readings, so that periods choose apart what the whole source would choose."""
    x = ts[v.at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    few = v.once & (x <= np.uint64(min(2**64 - 1, int(2**64 * min(1.0, 2 * SAMPLE / max(readings, 1))))))
    return x[few], v.features[few]


def _forest(hashes: np.ndarray, features: np.ndarray, seed: int) -> IsolationForest | None:
    """The forest of a source: from the SAMPLE of the readings offered that have the least hashes; none if there are fewer than SHORTEST."""
    if len(hashes) < SHORTEST:
        return None
    return IsolationForest(features[np.argsort(hashes, kind="stable")[:SAMPLE]], TREES, PSI, seed=seed)


def judge(ts: np.ndarray, value: np.ndarray, low: float, high: float, seed: int = 0, facts: Facts | None = None, forest: IsolationForest | None = None) -> pd.DataFrame:
    """score, kind of each reading of one source, or of a period of one whose facts and forest are given, in order of time, kind being LIMIT, SPIKE, FROZEN or 0.

    A reading outside [low, high] (a NaN limit is none) or infinite is LIMIT, by rule. NaN is never a case and takes no part. The rest get the features of _view() and a score by a forest fitted on a sample of the source's own readings, in which a still stretch, an off phase or readings in a row that have left their level count once, else they would make each other look normal. A reading that scores CASE or more is unusual; which readings are cases follows from these alone, and what comes after only settles how far a case reaches and whether its surroundings excuse it: a still stretch is FROZEN if most of its readings are unusual, up to SPIKE_MAX readings that leave a level and come back to it are SPIKE if most of them are, while a lasting change of level and values of 0 that come back at regular distances are no cases. Noise, off phases, runs of equal values and forest are those of the whole source; where the readings around one are noisier than the source usually is, their noise counts.

    A source whose neighbours mostly repeat their value - coarse steps, set points, counters - has no noise: there the evidence of a run of equal values is its length compared with what the source's other runs let expect, and the unit of distances is the usual step between levels, at least the resolution of the values. A source of fewer than FROZEN_MIN readings has no frozen stretch but may have spikes; fewer than SHORTEST, still stretches and off phases counting once, don't tell what is usual, and only limits are judged.
    """
    facts = facts or _facts([_part(ts, value, low, high)])
    score, kind = np.zeros(len(value)), np.zeros(len(value), dtype=np.int8)
    v = _view(ts, value, low, high, facts)
    kind[v.out], score[v.out] = LIMIT, 1.0
    if len(v.at) < SHORTEST:
        return pd.DataFrame({"score": score, "kind": kind})
    own = _scores(forest or _forest(*_sample(ts, v, facts.readings, seed), seed), v.features)
    score[v.at] = own
    unusual = own >= CASE
    for s, e in v.still:
        if unusual[s:e].mean() >= 0.5:
            kind[v.at[s:e]] = FROZEN
    if len(v.rest):
        kind[v.at[v.rest[_spikes(v.y[v.rest], unusual[v.rest], LEFT * v.unit)]]] = SPIKE
    return pd.DataFrame({"score": score, "kind": kind})


def _scores(forest: IsolationForest | None, features: np.ndarray) -> np.ndarray:
    """Scores of rows of features, each distinct row being scored once; 0 without a forest."""
    if forest is None:
        return np.zeros(len(features))
    code = np.round(features * STEPS).astype(np.int64) @ ((STEPS + 1) ** np.arange(features.shape[1]))
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    return forest.score(features[first])[back]


def _within(t: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Flags of the times that lie in one of the spans (start, end), which are in order and apart."""
    if len(spans) == 0:
        return np.zeros(len(t), dtype=bool)
    i = np.searchsorted(spans[:, 0], t, "right") - 1
    return (i >= 0) & (t <= spans[i, 1])


def _spikes(z: np.ndarray, unusual: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of up to SPIKE_MAX readings, most of them unusual, that all lie further than `left` from the level just before and just after, which are the same level. Only jumps to unusual readings are looked at."""
    hit = np.zeros(len(z), dtype=bool)
    d = np.abs(np.diff(z)) / left[1:]
    jumps, large = (np.flatnonzero(d > 0.6 * least) + 1 for least in (1.0, FAR / LEFT))
    ahead = np.concatenate([[0], np.cumsum(unusual)])
    some = ahead[np.minimum(jumps + SPIKE_MAX, len(z))] > ahead[jumps]
    done = 0
    for i in jumps[some]:
        if i < done:
            continue
        before = np.median(z[max(0, i - 5) : i])
        gap = np.abs(z[i : i + SPIKE_MAX] - before)
        for k in range(1, min(SPIKE_MAX, len(z) - i - 1) + 1):
            least = gap[:k].min()
            if least <= left[i]:
                break
            after = np.median(z[i + k : i + k + 5])
            if abs(z[i + k] - before) < 0.5 * least and abs(after - before) < 0.5 * least and np.abs(z[i : i + k] - after).min() > left[i]:
                if _returns(z, large, i, k, before):
                    break
                if unusual[i : i + k].mean() >= 0.5:
                    hit[i : i + k] = True
                done = i + k
                break
    return np.flatnonzero(hit)


def _returns(z: np.ndarray, jumps: np.ndarray, i: int, k: int, before: float) -> bool:
    """Whether the source soon jumps back to the level of z[i : i + k] and stays there: then i is a lasting change, and what follows it a spike the other way."""
    up = z[i] > z[i - 1]
    for j in jumps[(jumps > i + k) & (jumps <= i + k + SPIKE_MAX)]:
        if (z[j] > z[j - 1]) == up:
            later = np.median(z[j : j + SPIKE_MAX])
            if abs(later - np.median(z[i : i + k])) < abs(later - before):
                return True
    return False


def judged_readings(samples: DataFrame) -> DataFrame:
    """(series_ref, sample_ts, value, score, kind) for every reading; see judge() for kind.

    samples: series_ref, sample_ts, value, row_id, low_limit, high_limit; rows sent again at the same time are one reading, with the value that arrived first. Null values are left out, NaN stays as a reading without a case, an empty table gives no row.

    Readings are written to the checkpoint folder once; a source's periods have equal numbers of readings, so that no group has more than PERIOD_READINGS readings of a source plus the margins, however many it has and however they are bunched. What is usual for the source as a whole - noise, off phases, runs of equal values over borders of periods - is gathered from all its periods first, then its forest is drawn from a sample of all its readings, and both are handed to each period: a reading is judged alike whether its source is cut or not, but for what margins don't reach.
    """
    once = (
        samples.where("series_ref is not null and sample_ts is not null and value is not null")
        .groupBy("series_ref", "sample_ts")
        .agg(F.min_by("value", "row_id").alias("value"), F.first("low_limit").alias("low"), F.first("high_limit").alias("high"))
    )
    once = checkpointed(once)
    sizes = once.groupBy("series_ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PERIOD_READINGS)
    per = F.ceil(F.col("n") / F.ceil(F.col("n") / F.lit(float(PERIOD_READINGS)))).cast("long")
    sizes = checkpointed(sizes.select("series_ref", "n", per.alias("per"), F.ceil(per / 16.0).cast("long").alias("margin")))
    whole = once.join(small_side(sizes.select("series_ref")), "series_ref", "left_anti")
    whole = whole.select("series_ref", F.lit(0).cast("long").alias("p"), "sample_ts", "value", "low", "high", F.lit(True).alias("own"))
    rows = _numbered(once.join(small_side(sizes), "series_ref"))
    k, inside = F.floor(F.col("rank") / F.col("per")), F.pmod(F.col("rank"), F.col("per"))
    near = F.when((inside < F.col("margin")) & (k > 0), k - 1)
    after = F.when((inside >= F.col("per") - F.col("margin")) & ((k + 1) * F.col("per") < F.col("n")), k + 1)
    rows = rows.withColumn("k", k)
    parts = rows.groupBy("series_ref", "k").applyInPandas(_part_group, "series_ref long, k long, t0 long, t1 long, part binary")
    parts = checkpointed(parts)
    most = sizes.agg(F.max(F.ceil(F.col("n") / F.col("per")))).head()[0] or 0
    joined = parts.select("series_ref", F.col("k").alias("k0"), "part")
    while most > FAN:  # a task never gets more than FAN parts of a source
        joined = joined.withColumn("k", F.floor(F.col("k0") / FAN)).groupBy("series_ref", "k").applyInPandas(_join_parts, "series_ref long, k0 long, part binary")
        most = -(-most // FAN)
    facts = joined.groupBy("series_ref").applyInPandas(_facts_of_source, "series_ref long, facts binary")
    facts = parts.select("series_ref", "k", "t0", "t1").groupBy("series_ref").cogroup(facts.groupBy("series_ref")).applyInPandas(_hand_out, "series_ref long, p long, facts binary")
    facts = checkpointed(facts)
    rows = rows.withColumn("p", F.explode(F.array_compact(F.array("k", near, after))))
    rows = rows.select("series_ref", "p", "sample_ts", "value", "low", "high", (F.col("p") == F.col("k")).alias("own"))
    # The facts of a period are one more row of it, and so is the forest of its source.
    offered = rows.unionByName(facts, allowMissingColumns=True).groupBy("series_ref", "p").applyInPandas(_sample_group, "series_ref long, hashes binary, features binary")
    forests = offered.groupBy("series_ref").applyInPandas(_forest_group, "series_ref long, forest binary")
    rows = whole.unionByName(rows).unionByName(facts.join(forests, "series_ref"), allowMissingColumns=True)
    # By bytes alone the readings would be put into few tasks, but judging them takes long.
    tasks = max(once.sparkSession.sparkContext.defaultParallelism, -(-once.count() // (2 * PERIOD_READINGS)))
    found = rows.repartition(tasks, "series_ref", "p").groupBy("series_ref", "p").applyInPandas(_judge_group, "series_ref long, sample_ts long, value double, score double, code byte")
    kind = F.when(F.col("code") > 0, F.element_at(F.array(*map(F.lit, KINDS)), F.col("code").cast("int")))
    value = F.coalesce("value", F.lit(float("nan")))  # pandas gives NaN back as null
    return found.select("series_ref", "sample_ts", value.alias("value"), "score", kind.alias("kind"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with rank, the position of each from 0 in its source in order of time, by a range sort and counts per task: no task sees all rows of a source."""
    rows = rows.repartitionByRange("series_ref", "sample_ts").sortWithinPartitions("series_ref", "sample_ts").withColumn("id", F.monotonically_increasing_id())
    rows = checkpointed(rows).withColumn("task", F.shiftright("id", 33))
    tasks = rows.groupBy("series_ref", "task").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("series_ref").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("series_ref", "task", (before - F.col("first")).alias("shift"))
    return rows.join(small_side(tasks), ["series_ref", "task"]).withColumn("rank", F.col("id") + F.col("shift")).drop("task", "id", "shift")


def _in_order(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Times, values and limits of a group."""
    g = g.sort_values("sample_ts", kind="stable")
    low, high = (float(g[c].iloc[0]) if pd.notna(g[c].iloc[0]) else np.nan for c in ("low", "high"))
    return g["sample_ts"].to_numpy(dtype=np.int64), g["value"].to_numpy(dtype=float), low, high


def _part_group(g: pd.DataFrame) -> pd.DataFrame:
    ts, value, low, high = _in_order(g)
    part = pickle.dumps(_part(ts, value, low, high))
    return pd.DataFrame({"series_ref": [int(g["series_ref"].iloc[0])], "k": [int(g["k"].iloc[0])], "t0": [ts[0]], "t1": [ts[-1]], "part": [part]})


def _in_turn(g: pd.DataFrame) -> list[Part]:
    return [pickle.loads(p) for p in g.sort_values("k0")["part"]]


def _join_parts(g: pd.DataFrame) -> pd.DataFrame:
    """The parts of up to FAN periods in a row as one."""
    return pd.DataFrame({"series_ref": g["series_ref"].iloc[:1], "k0": g["k"].iloc[:1], "part": [pickle.dumps(reduce(_joined, _in_turn(g)))]})


def _facts_of_source(g: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"series_ref": g["series_ref"].iloc[:1], "facts": [pickle.dumps(_facts(_in_turn(g)))]})


def _hand_out(periods: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """The facts of a source for each of its periods, with the phases and runs that its readings and margins may touch."""
    g = periods.sort_values("k")
    facts = pickle.loads(given["facts"].iloc[0])
    t0, t1 = g["t0"].to_numpy(), g["t1"].to_numpy()
    out = []
    for i in range(len(g)):
        a, b = t0[max(0, i - 1)], t1[min(len(g) - 1, i + 1)]
        near = [x[(x[:, 0] <= b) & (x[:, 1] >= a)] for x in (facts.phases, facts.long)]
        out.append(pickle.dumps(replace(facts, phases=near[0], long=near[1])))
    return pd.DataFrame({"series_ref": g["series_ref"].to_numpy(), "p": g["k"].to_numpy(), "facts": out})


def _seed(ref: int) -> int:
    return ref * 1_000_003 % (1 << 32)


def _apart(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series | None]:
    """The readings of a group in order of time, and the row with its facts."""
    given = g["facts"].notna()
    return g[~given].sort_values("sample_ts", kind="stable"), g[given].iloc[0] if given.any() else None


def _sample_group(g: pd.DataFrame) -> pd.DataFrame:
    """What a period offers to its source's forest, without its margins."""
    g, given = _apart(g)
    facts, ref = pickle.loads(given["facts"]), int(given["series_ref"])
    ts, value, low, high = _in_order(g)
    v = _view(ts, value, low, high, facts)
    v.once &= g["own"].to_numpy(dtype=bool)[v.at]
    hashes, features = _sample(ts, v, facts.readings, _seed(ref))
    return pd.DataFrame({"series_ref": [ref], "hashes": [hashes.tobytes()], "features": [np.round(features * STEPS).astype(np.uint8).tobytes()]})


def _forest_group(g: pd.DataFrame) -> pd.DataFrame:
    """The forest of a source, from what all its periods offer."""
    ref = int(g["series_ref"].iloc[0])
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in g["hashes"]])
    features = np.concatenate([np.frombuffer(x, np.uint8) for x in g["features"]]).reshape(len(hashes), -1) / STEPS
    return pd.DataFrame({"series_ref": [ref], "forest": [pickle.dumps(_forest(hashes, features, _seed(ref)))]})


def _judge_group(g: pd.DataFrame) -> pd.DataFrame:
    g, given = _apart(g)
    facts, forest = (None, None) if given is None else (pickle.loads(given["facts"]), pickle.loads(given["forest"]))
    ts, value, low, high = _in_order(g)
    ref = int(g["series_ref"].iloc[0])
    found = judge(ts, value, low, high, _seed(ref), facts, forest)
    found.insert(0, "series_ref", ref)
    found.insert(1, "sample_ts", ts)
    found.insert(2, "value", value)
    return found[g["own"].to_numpy(dtype=bool)].rename(columns={"kind": "code"})
