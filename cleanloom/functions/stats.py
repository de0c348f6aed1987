"""Fused statistics: all columns' aggregates in one job, distinct values and quantiles in a few."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanloom.core import quoted

#: Accuracy of the sketch that brackets quantiles, and how far on either side its ends are taken, as a share of all values.
ACCURACY, NEAR = 20_000, 1e-4


def finite(c: Column) -> Column:
    """c as a double, null where it is not a finite number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def cells(df: DataFrame, values: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """(c, v) for each value that is not null, c being its place in `values`: one set of expressions then serves all columns."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), e.alias("v")) for i, e in enumerate(values.values()))))
    return df.select(*keep, each.alias("cell")).select(*keep, "cell.c", "cell.v").where("v is not null")


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """How many distinct values each has; repeats go before the shuffle, and no value is held with all others.

    Numbers that a double holds exactly are compared as such, all else by its text.
    """
    if not values:
        return {}
    kinds = dict(zip(values, (t for _, t in df.select(*values.values()).dtypes), strict=True))
    numbers = {k: e.cast("double") for k, e in values.items() if kinds[k] in ("double", "float", "int", "smallint", "tinyint")}
    texts = {k: (F.base64(e) if kinds[k] == "binary" else e).cast("string") for k, e in values.items() if k not in numbers}
    out = dict.fromkeys(values, 0)
    for part in filter(None, (numbers, texts)):
        for r in cells(df, part).distinct().groupBy("c").agg(F.count("*").alias("n")).collect():
            out[list(part)[r.c]] = r.n
    return out


def quantiles(df: DataFrame, values: dict[str, Column], shares: tuple[float, ...], exact: bool = True) -> dict[tuple, float | int | None]:
    """(name, share): the quantile of each value, by linear interpolation between neighbours; (name, "n"): how many there are.

    A sketch of bounded size brackets each quantile; the exact form then counts the values within the brackets, a few in
    ten thousand, and those below, and looks the ranks up among them. So rows are read twice and hardly any is shuffled. A bracket
    that lacks a rank is widened, in the end to all values.
    """
    names = list(values)
    if not names:
        return {}
    e = {k: v.cast("double") for k, v in values.items()}
    ends = [x for p in shares for x in (p, max(0.0, p - NEAR), min(1.0, p + NEAR))]
    rough = one_row(df, {(k, "n"): F.count(v) for k, v in e.items()} | {(k, "at"): F.percentile_approx(v, F.array(*map(F.lit, ends)), F.lit(ACCURACY)) for k, v in e.items()})
    n = {k: rough[k, "n"] for k in names}
    out: dict[tuple, float | int | None] = {(k, "n"): n[k] for k in names} | {(k, p): None for k in names for p in shares}
    full = [k for k in names if n[k]]
    if not exact:
        return out | {(k, p): rough[k, "at"][3 * j] for k in full for j, p in enumerate(shares)}
    # not-a-number is the greatest of all values, so that it leaves a bracket open
    brackets = {(k, p): (rough[k, "at"][3 * j + 1] if p > NEAR else -math.inf, rough[k, "at"][3 * j + 2] if p < 1 - NEAR else math.nan) for k in full for j, p in enumerate(shares)}
    while brackets:
        asked = {k: [(p, ends) for (x, p), ends in brackets.items() if x == k] for k in full if any(x == k for x, _ in brackets)}
        counts = cells(df, {k: _bracketed(e[k], [ends for _, ends in v]) for k, v in asked.items()}).groupBy("c", "v").agg(F.count("*").alias("n"))
        places = F.array(*(F.array(*(F.lit(r) for r in sorted({r for p, _ in v for r in _ranks(n[k], p)}))) for k, v in asked.items()))
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("v"))
        found = counts.withColumn("upto", upto).withColumn("ranks", F.filter(F.get(places, F.col("c")), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).where("size(ranks) > 0")
        at = {(list(asked)[r.c], rank): r.v for r in found.collect() for rank in r.ranks}
        wider = {}
        for (k, p), (lo, hi) in brackets.items():
            low, high = (at.get((k, r)) for r in _ranks(n[k], p))
            if any(v is None or v < lo or v > hi for v in (low, high)):
                wider[k, p] = (-math.inf, math.nan)
            else:
                place = (n[k] - 1) * p
                out[k, p] = low if low == high else low + (high - low) * (place - math.floor(place))
        brackets = wider
    return out


def _bracketed(v: Column, brackets: list[tuple[float, float]]) -> Column:
    """v within the brackets; between them one value for all, which keeps their order; null beyond the last."""
    merged: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets, key=lambda b: b[0]):
        if merged and not lo > merged[-1][1]:
            lo, last = merged.pop()
            hi = math.nan if math.isnan(hi) or math.isnan(last) else max(hi, last)
        merged.append((lo, hi))
    out, below = None, -math.inf
    for lo, hi in merged:
        gap = F.lit(below if below == -math.inf else below / 2 + lo / 2)
        out = (F.when(v < lo, gap) if out is None else out.when(v < lo, gap)).when(v <= hi, v)
        below = hi
    return out


def _ranks(n: int, p: float) -> tuple[int, int]:
    return math.floor((n - 1) * p), math.ceil((n - 1) * p)


def sample_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n <= 2, 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n <= 3, 0.0).otherwise((n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def one_row(df: DataFrame, named: dict[tuple, Column]) -> dict[tuple, object]:
    """All aggregates in one job, under any keys."""
    keys = list(named)
    if not keys:
        return {}
    row = df.agg(*(named[k].alias(f"a{i}") for i, k in enumerate(keys))).first()
    return dict(zip(keys, row, strict=True))


def fences(df: DataFrame, columns: list[str], multiplier: float, only_finite: bool, exact: bool = True) -> dict[str, dict]:
    """n, q1, q3, iqr, lower and upper of each column."""
    value = (lambda c: finite(quoted(c))) if only_finite else (lambda c: quoted(c).try_cast("double"))
    got = quantiles(df, {c: value(c) for c in columns}, (0.25, 0.75), exact)
    out = {}
    for c in columns:
        n, q1, q3 = (got[c, k] for k in ("n", 0.25, 0.75))
        iqr = None if q1 is None else q3 - q1
        out[c] = {"n": n, "q1": q1, "q3": q3, "iqr": iqr, "lower": None if iqr is None else q1 - multiplier * iqr, "upper": None if iqr is None else q3 + multiplier * iqr}
    return out
