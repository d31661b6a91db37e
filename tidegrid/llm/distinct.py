"""Distinct counts by mergeable bit matrices with maximum likelihood estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bit matrix (a power of two); the relative standard error is about 0.65 / sqrt(rows), here 1.0 %.
ROWS = 4096
#: Ranks that are told apart; higher ones count as the last. Enough for 10**15 identifiers.
RANKS = 40


def matrices(ids: DataFrame, groups: list[str], id_column: str, rows: int = ROWS) -> DataFrame:
    """A bit matrix of each group in sparse form: (groups..., bucket, bits), with only the rows that have a bit.

    The identifier's 64-bit hash gives a row of the matrix by its low bits and a bit of it by the lowest set bit of the rest, so bit r is set by a share 2**-(r+1) of identifiers. Null identifiers are left out; null groups are a group. Partial matrices are built before the shuffle and hold at most `rows` rows per group, whatever is in it.
    """
    h = F.xxhash64(F.col(id_column))
    bucket = h.bitwiseAND(F.lit(rows - 1)).cast("int")
    rest = F.shiftrightunsigned(h, int(np.log2(rows)))
    top = F.lit(1 << (RANKS - 1)).cast("long")
    tail = rest.bitwiseOR(top)
    bits = tail.bitwiseAND(F.negative(tail))
    return ids.where(F.col(id_column).isNotNull()).groupBy(*groups, bucket.alias("bucket")).agg(F.bit_or(bits).alias("bits"))


def merged(parts: DataFrame, groups: list[str]) -> DataFrame:
    """The union of matrices per (coarser) group: of days, files, partitions or label values."""
    return parts.groupBy(*groups, "bucket").agg(F.bit_or("bits").alias("bits"))


def estimates(parts: DataFrame, groups: list[str], rows: int = ROWS) -> DataFrame:
    """(groups..., estimate, std_error, low, high): the maximum likelihood estimate of the number of distinct identifiers of each group, its standard error by the Fisher information, and the interval of three of these around it, not below the number of bits set, and one wider above: of few identifiers two may set one bit, which the estimate can't tell."""
    counts = parts.groupBy(*groups).agg(*[F.sum(F.shiftrightunsigned("bits", r).bitwiseAND(F.lit(1).cast("long"))).alias(f"_c{r}") for r in range(RANKS)])
    packed = counts.select(*groups, F.array(*[f"_c{r}" for r in range(RANKS)]).alias("_c"))
    e = packed.select(*groups, _likeliest(rows)("_c").alias("_e"))
    return e.select(*groups, F.round("_e.estimate").cast("long").alias("estimate"), *[F.col(f"_e.{c}").alias(c) for c in ("std_error", "low", "high")])


def likeliest(c: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and standard errors from the set bits of each rank, one group per line of c.

    With n identifiers, a bit of rank r is set with probability 1 - exp(-n q_r), nearly independently, with q_r = 2**-(r+1) / rows; the last rank takes all that is left. The derivative of the log-likelihood falls with n, so its root is found by bisection.
    """
    q = 0.5 ** np.arange(1, RANKS + 1) / rows
    q[-1] *= 2
    low, high = np.full(len(c), -5.0), np.full(len(c), np.log(rows) + RANKS * np.log(2.0))
    unset = ((rows - c) * q).sum(axis=1)
    for _ in range(70):
        mid = (low + high) / 2
        x = np.exp(mid)[:, None] * q
        grows = (c * q / np.expm1(np.minimum(x, 700))).sum(axis=1) > unset
        low, high = np.where(grows, mid, low), np.where(grows, high, mid)
    n = np.where(c.sum(axis=1) > 0, np.exp((low + high) / 2), 0.0)
    x = np.maximum(n, 1e-9)[:, None] * q
    information = (rows * q * q / np.expm1(np.minimum(x, 700))).sum(axis=1)
    # The information is about the Poisson rate; a count itself varies by n less.
    variance = np.maximum(1 / information - n, 0.0)
    return n, np.sqrt(variance)


def _likeliest(rows: int):
    @F.pandas_udf("struct<estimate: double, std_error: double, low: double, high: double>")
    def solve(c: pd.Series) -> pd.DataFrame:
        m = np.array(c.tolist(), dtype=float).reshape(len(c), RANKS)
        n, s = likeliest(m, rows)
        return pd.DataFrame({"estimate": n, "std_error": s, "low": np.maximum(n - 3 * s, np.minimum(m.sum(axis=1), n)), "high": n + 3 * s + (n > 0)})

    return solve


def exact(ids: DataFrame, groups: list[Column | str], id_column: str) -> DataFrame:
    """Exact counts, for comparison on small data."""
    return ids.groupBy(*groups).agg(F.count_distinct(id_column).alias("exact"))
