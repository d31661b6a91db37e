"""Percentiles of very large columns by mergeable relative-rank sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Section size: larger is more exact and larger. Stated error: the rank of an answer for percentile p is off by at most ERROR / K * (1 - p/100) of all values on the protected (high) side, with a probability of over 99 %.
K, ERROR = 32, 0.5
#: Values gathered in a task before they become sketches, and sketches of a group merged in one step.
GATHER, FAN = 500_000, 256


class Sketch:
    """Levels of relative compactors. Level h holds values that stand for 2**h each. A full compactor keeps the values of the protected tail and at least half of its room, and hands every other of the rest to the next level; how much of the room it compacts follows the trailing ones of the number of its compactions, so that values near the tail are compacted ever more rarely."""

    def __init__(self, k: int = K, high: bool = True):
        self.k, self.high = k, high
        self.n, self.nan, self.low, self.top = 0, 0, np.inf, -np.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.state, self.sections, self.size = [0], [3], [k]

    def add(self, values: np.ndarray) -> "Sketch":
        """Adds values; NaN is counted apart, infinities are values like others."""
        bad = np.isnan(values)
        self.nan += int(bad.sum())
        values = values[~bad]
        if len(values):
            self.n += len(values)
            self.low, self.top = min(self.low, values.min()), max(self.top, values.max())
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compress()
        return self

    def merge(self, other: "Sketch") -> "Sketch":
        """Adds what other holds; sketches of another size or with another protected side can't be merged."""
        if (self.k, self.high) != (other.k, other.high):
            raise ValueError(f"sketches of k={self.k}, high={self.high} and k={other.k}, high={other.high} can't be merged")
        self.n, self.nan = self.n + other.n, self.nan + other.nan
        self.low, self.top = min(self.low, other.low), max(self.top, other.top)
        for h, values in enumerate(other.levels):
            self._level(h)
            self.levels[h] = np.concatenate([self.levels[h], values])
            self.state[h] |= other.state[h]
            if other.sections[h] > self.sections[h]:
                self.sections[h], self.size[h] = other.sections[h], other.size[h]
        self._compress()
        return self

    def _level(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.empty(0))
            self.state.append(0)
            self.sections.append(3)
            self.size.append(self.k)

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= 2 * self.sections[h] * self.size[h]:
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        self._level(h + 1)
        values = np.sort(self.levels[h])
        if not self.high:
            values = values[::-1]
        sections, size, state = self.sections[h], self.size[h], self.state[h]
        ones = ((~state & (state + 1)).bit_length() - 1) + 1
        keep = sections * size + (sections - min(ones, sections)) * size
        take = max(2, (len(values) - keep) // 2 * 2)
        offset = hash((self.n, h, state, float(values[0]))) & 1
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[offset:take:2]])
        self.levels[h] = values[take:]
        self.state[h] = state + 1
        if self.state[h] >= 1 << (sections - 1) and self.size[h] > 4:
            self.sections[h] = 2 * sections
            self.size[h] = max(4, int(round(size / np.sqrt(2) / 2)) * 2)

    def pack(self) -> bytes:
        head = [self.n, self.nan, self.low, self.top, self.k, float(self.high), len(self.levels)]
        for h, values in enumerate(self.levels):
            head += [self.state[h], self.sections[h], self.size[h], len(values)]
        return np.concatenate([np.array(head, dtype=np.float64), *self.levels]).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "Sketch":
        a = np.frombuffer(data, dtype=np.float64)
        s = cls(int(a[4]), bool(a[5]))
        s.n, s.nan, s.low, s.top = int(a[0]), int(a[1]), float(a[2]), float(a[3])
        count = int(a[6])
        info = a[7 : 7 + 4 * count].reshape(count, 4).astype(np.int64)
        at = 7 + 4 * count
        s.levels = []
        for n in info[:, 3]:
            s.levels.append(a[at : at + n])
            at += n
        s.state, s.sections, s.size = ([int(x) for x in info[:, i]] for i in range(3))
        return s

    def percentiles(self, ps: list[float]) -> np.ndarray:
        """The least kept value whose estimated rank reaches p percent of n (nearest rank); NaN if there is no value. 0 and 100 give the exact ends."""
        if self.n == 0:
            return np.full(len(ps), np.nan)
        values = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, rank = values[order], np.cumsum(weight[order])
        want = np.ceil(np.array(ps) / 100 * self.n)
        if self.high:  # counted from the protected end
            want, total = self.n - want, rank[-1]
            at = np.searchsorted(rank, total - want, side="left")
        else:
            at = np.searchsorted(rank, want, side="left")
        out = values[np.clip(at, 0, len(values) - 1)]
        return np.where(np.array(ps) <= 0, self.low, np.where(np.array(ps) >= 100, self.top, out))


def sketches(values: DataFrame, group: str, column: str, k: int = K, high: bool = True) -> DataFrame:
    """(group, part, sketch) from (group, value): one sketch of each group per task and GATHER values, of bounded size however many values it stands for. Null values are left out; a null group is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            d = pc.dictionary_encode(t.column(group), null_encoding="encode").combine_chunks()
            d = d if isinstance(d, pa.DictionaryArray) else d.chunk(0)
            codes, names = d.indices.to_numpy(), d.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            v = t.column(column).to_numpy()[order]
            ends = np.cumsum(np.bincount(codes, minlength=len(names)))
            parts = [Sketch(k, high).add(x).pack() for x in np.split(v, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], [group, "sketch"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    found = values.where(F.col(column).isNotNull()).select(F.col(group).cast("string").alias(group), F.col(column).cast("double").alias(column)).mapInArrow(run, f"`{group}` string, sketch binary")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))


def merge_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., sketch): the sketches of equal keys merged, whatever tasks, days or files they come from. With a column part among the keys this is a first step that leaves at most FAN sketches per group. Rows come sorted by key and are merged as they pass, so a task holds one running sketch, however many a group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packed, sketch = None, None, None
        schema = None

        def give(done: list) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], schema.field(c).type) for i, c in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v for _, v in done], pa.binary())], [*keys, "sketch"])

        for batch in batches:
            schema = batch.schema
            done = []
            for *key, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "sketch"))):
                if key != current:
                    if current is not None:
                        done.append((current, sketch.pack() if sketch else packed))
                    current, packed, sketch = key, data, None
                else:  # a group of one sketch is never unpacked
                    sketch = (sketch or Sketch.unpack(packed)).merge(Sketch.unpack(data))
            if done:
                yield give(done)
        if current is not None:
            yield give([(current, sketch.pack() if sketch else packed)])

    fields = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    return parts.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{fields}, sketch binary")


def merge_spread(parts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(keys..., sketch): merged in two steps, first within FAN parts of each key by a hash of the columns by, so that no task reads more than a part of a large group and then FAN sketches."""
    spread = parts.select(*keys, "sketch", F.pmod(F.xxhash64(*by), F.lit(FAN)).alias("part"))
    return merge_sketches(merge_sketches(spread, [*keys, "part"]), keys)


def percentiles(merged: DataFrame, keys: list[str], ps: tuple[float, ...]) -> DataFrame:
    """(keys..., p, value, n, n_nan, rank_error) of each sketch; rank_error is the stated error as a share of n, 0 while the sketch still holds every value."""

    @F.pandas_udf("array<struct<p: double, value: double, n: long, n_nan: long, rank_error: double>>")
    def read(s: pd.Series) -> pd.Series:
        out = []
        for data in s:
            k = Sketch.unpack(data)
            whole = len(k.levels) == 1
            found = k.percentiles(list(ps)) if k.n else [None] * len(ps)
            out.append([{"p": float(p), "value": None if v is None else float(v), "n": k.n, "n_nan": k.nan, "rank_error": 0.0 if whole else ERROR / k.k * (1 - p / 100 if k.high else p / 100)} for p, v in zip(ps, found)])
        return pd.Series(out)

    return merged.select(*keys, F.explode(read("sketch")).alias("_r")).select(*keys, "_r.*")
