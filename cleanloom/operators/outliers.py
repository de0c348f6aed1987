"""Outliers: Tukey fences, isolation forest, and what to do with them."""

from __future__ import annotations

import math
import sys
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.core import is_number, percent, quoted, replaced, resolve_columns, step, stored
from cleanloom.functions.stats import fences, finite, one_row, quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that the forest's trees are drawn from: a bound on what goes to the driver.
FOREST_SAMPLE = 25_600
#: Holds the forest's scores while they are used.
SCORE = "__anomaly_score"


def _fences(df: DataFrame, columns: list[str], multiplier: float, min_samples: int) -> tuple[dict, dict]:
    """Usable fences by column, and why the other columns have none."""
    good, skipped = {}, {}
    for c, f in fences(df, columns, multiplier, only_finite=False).items():
        if f["n"] < min_samples:
            skipped[c] = "too few values"
        elif not f["iqr"] or math.isnan(f["iqr"]):
            skipped[c] = "no spread between the quartiles"
        else:
            good[c] = f
    return good, skipped


def _outside(c: str, f: dict) -> Column:
    v = quoted(c).try_cast("double")
    return F.coalesce((v < f["lower"]) | (v > f["upper"]), F.lit(False))


@step("detect_outliers_iqr")
def detect_outliers_iqr(df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5, min_samples: int = 8) -> tuple[DataFrame, dict]:
    """A boolean cell mask: one column for each analysed column, in the rows' order."""
    named = resolve_columns(df, columns, is_number)
    good, skipped = _fences(df, named, multiplier, min_samples)
    counts = one_row(df, {("rows",): F.count("*")} | {(c,): F.count_if(_outside(c, f)) for c, f in good.items()})
    rows = counts.pop(("rows",))
    mask = df.select(*(c for c in df.columns if c == "__row_id"), *((_outside(c, good[c]) if c in good else F.lit(False)).alias(c) for c in named))
    per_column = {c: {"lower": f["lower"], "upper": f["upper"], "n_outliers": counts[(c,)], "outlier_pct": percent(counts[(c,)], rows)} for c, f in good.items()}
    return mask, {"columns": per_column, "skipped": skipped, "total_outliers": sum(counts.values())}


class Forest:
    """Isolation trees as flat arrays: feature (-1 at a leaf), split, children, and the depth that a leaf adds."""

    def __init__(self, sample: np.ndarray, trees: int, seed: int):
        draw = np.random.default_rng(seed)
        self.psi = min(256, len(sample))
        limit = math.ceil(math.log2(max(2, self.psi)))
        self.trees = [self._grow(sample[draw.choice(len(sample), self.psi, replace=False)], limit, draw) for _ in range(trees)]

    @staticmethod
    def path(n: int) -> float:
        """The mean path length of an unsuccessful search among n values."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, limit: int, draw) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def build(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + self.path(len(rows))])
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if depth < limit and len(spread):
                f = int(draw.choice(spread))
                split = float(draw.uniform(rows[:, f].min(), rows[:, f].max()))
                left = rows[:, f] < split
                nodes[at][:4] = [f, split, build(rows[left], depth + 1), build(rows[~left], depth + 1)]
            return at

        build(x, 0)
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Each row goes down every tree; a leaf leads to itself, so that all rows take the same number of steps."""
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        steps, depth = math.ceil(math.log2(max(2, self.psi))), np.zeros(len(x))
        for feature, split, left, right, length in self.trees:
            here = np.arange(len(feature))
            leaf = feature < 0
            f, limit = np.where(leaf, 0, feature), np.where(leaf, -np.inf, split)
            child = np.stack((np.where(leaf, here, right), np.where(leaf, here, left)), axis=1).ravel()
            at = np.zeros(len(x), np.int64)
            for _ in range(steps):
                at = child[2 * at + (flat[first + f[at]] < limit[at])]
            depth += length[at]
        return 2.0 ** (-depth / len(self.trees) / max(self.path(self.psi), 1e-12))


def _forest_mask(df: DataFrame, named: list[str], contamination: float, n_estimators: int, random_state: int, sample_rows: int = FOREST_SAMPLE, scale: bool = True, impute_missing: bool = True) -> tuple[DataFrame, Column | None, Column | None, dict]:
    """df with a column of scores, which are computed once and stored; the row mask and the score in it, or None with the reason."""
    if not 0 < contamination < 0.5:
        raise ValueError("contamination must be in (0, 0.5)")
    if not named:
        return df, None, None, {"status": "skipped", "reason": "no numeric columns"}
    value = [quoted(c).try_cast("double") for c in named]
    present = F.coalesce(*value).isNotNull() if impute_missing else reduce(and_, (v.isNotNull() for v in value))
    if one_row(df, {("n",): F.count_if(present)})["n",] < 10:
        return df, None, None, {"status": "skipped", "reason": "too few rows"}
    middle = quantiles(df, {c: finite(quoted(c)) for c in named}, (0.5,))
    filled = [F.coalesce(finite(quoted(c)), F.lit(middle[c, 0.5] if middle[c, 0.5] is not None else 0.0)) for c in named]
    if scale:
        spread = one_row(df.where(present), {(i, k): f(e) for i, e in enumerate(filled) for k, f in (("mean", F.avg), ("std", F.stddev_pop))})
        filled = [(e - F.lit(spread[i, "mean"])) / F.lit(spread[i, "std"] or 1.0) for i, e in enumerate(filled)]
    points = df.where(present).select(*(e.alias(f"x{i}") for i, e in enumerate(filled)))
    sample = points.orderBy(F.xxhash64(*points.columns, F.lit(random_state)), *points.columns).limit(sample_rows).collect()
    forest = Forest(np.array(sample, dtype=float), n_estimators, random_state)

    @F.pandas_udf("double")
    def anomaly(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in columns])))

    scored = stored(df.withColumn(SCORE, F.when(present, anomaly(*filled))))
    score = F.col(SCORE)
    cut = quantiles(scored, {"s": score}, (1 - contamination,))["s", 1 - contamination]
    stats = one_row(scored, {(k,): e for k, e in (("min", F.min(score)), ("max", F.max(score)), ("mean", F.avg(score)))})
    report = {"score_threshold": cut, "score_stats": {k: stats[k,] for k in ("min", "max", "mean")}, "features": named, "contamination": contamination}
    return scored, F.coalesce(score > cut, F.lit(False)), score, report


@step("detect_outliers_isolation_forest")
def detect_outliers_isolation_forest(
    df: DataFrame, columns: list[str] | None = None, contamination: float = 0.05, n_estimators: int = 100, random_state: int = 42, scale: bool = True, impute_missing: bool = True, return_scores: bool = False, sample_rows: int = FOREST_SAMPLE
) -> tuple[DataFrame, dict]:
    """A boolean row mask is_outlier, with anomaly_score if asked; rows without any value are never outliers.

    Trees are grown on the driver from at most sample_rows rows, drawn by a hash, and score all rows in Arrow batches.
    With scale the columns have mean 0 and standard deviation 1. With impute_missing a missing value counts as the
    column's median; without, rows that lack any value are neither sampled nor outliers.
    """
    df, mask, score, report = _forest_mask(df, resolve_columns(df, columns, is_number), contamination, n_estimators, random_state, sample_rows, scale, impute_missing)
    ids = [c for c in df.columns if c == "__row_id"]
    if mask is None:
        return df.select(*ids, F.lit(False).alias("is_outlier")), report | {"n_outliers": 0}
    scored = df.select(*ids, mask.alias("is_outlier"), *([score.alias("anomaly_score")] if return_scores else []))
    return scored, report | {"n_outliers": scored.where("is_outlier").count()}


@step("treat_outliers")
def treat_outliers(
    df: DataFrame,
    method: str = "iqr",
    action: str = "flag",
    columns: list[str] | None = None,
    multiplier: float = 1.5,
    contamination: float = 0.05,
    flag_column: str = "is_outlier",
    min_samples: int = 8,
    column_actions: dict[str, str] | None = None,
) -> tuple[DataFrame, dict]:
    """Find outliers by fences, forest or both, and flag, clip, null or remove them.

    clip and nan act on cells outside their fences; with the forest alone clip degrades to flag and nan clears all
    analysed columns of flagged rows. column_actions gives single columns another of clip and nan.
    """
    if method not in ("iqr", "isolation_forest", "both"):
        raise ValueError(f"unknown method {method!r}")
    if action not in ("flag", "clip", "nan", "remove"):
        raise ValueError(f"unknown action {action!r}")
    named = resolve_columns(df, columns, is_number)
    report: dict = {"method": method, "action": action, "warnings": []}
    good: dict = {}
    row = F.lit(False)
    if method != "isolation_forest":
        good, report["skipped"] = _fences(df, named, multiplier, min_samples)
        report["fences"] = {c: {"lower": f["lower"], "upper": f["upper"]} for c, f in good.items()}
        for c, f in good.items():
            row = row | _outside(c, f)
    if method != "iqr":
        df, mask, _, report["isolation_forest"] = _forest_mask(df, named, contamination, 100, 42)
        if mask is not None:
            row = row | mask
    if action == "clip" and method == "isolation_forest":
        report["warnings"].append("a forest has no bounds to clip to; rows are flagged")
        action = "flag"
    counts = one_row(df, {("rows",): F.count_if(row)} | {(c,): F.count_if(_outside(c, f)) for c, f in good.items()})
    report["rows_affected"], report["cells_affected"] = counts.pop(("rows",)), sum(counts.values())
    report["per_column"] = {c: n for (c,), n in counts.items()}
    if action == "flag":
        return replaced(df, {flag_column: row}).drop(SCORE), report
    if action == "remove":
        return df.where(~row).drop(SCORE), report
    new = {}
    for c, f in good.items():
        v = quoted(c).cast("double")
        clipped = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(f["lower"])), F.lit(f["upper"])))
        new[c] = clipped if (column_actions or {}).get(c, action) == "clip" else F.when(~_outside(c, f), v)
    if action == "nan" and method == "isolation_forest":
        new = {c: F.when(~row, quoted(c).cast("double")) for c in named}
    return replaced(df, new).drop(SCORE), report
