"""Exact and fuzzy removal of duplicate rows."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cleanloom.core import ROW_ID, data_columns, is_nested, is_text, quoted, resolve_columns, step, stored, with_row_id
from cleanloom.functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _key(c: str, kind: T.DataType, ignore_case: bool, ignore_whitespace: bool) -> Column:
    e = quoted(c)
    if is_nested(kind):
        return F.to_json(F.struct(e))
    if is_text(kind):
        e = X.strip(X.squash(e)) if ignore_whitespace else e
        e = F.lower(e) if ignore_case else e
    return e


@step("drop_exact_duplicates")
def drop_exact_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", ignore_case: bool = True, ignore_whitespace: bool = True, order_by: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Rows whose normalised keys are equal (null equals null) are one; the survivor keeps its raw values.

    keep is 'first', 'last' or False (none of a group stays). A group's survivor is combined before the shuffle, so that a key
    that very many rows share makes no large task.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    had = ROW_ID in df.columns
    df = with_row_id(df, order_by)
    kinds = {f.name: f.dataType for f in df.schema}
    named = resolve_columns(df, subset)
    if not named:
        return df if had else df.drop(ROW_ID), {"rows_removed": 0, "examples": []}
    key = F.struct(*(_key(c, kinds[c], ignore_case, ignore_whitespace).alias(f"k{i}") for i, c in enumerate(named)))
    groups = df.select(key.alias("key"), ROW_ID).groupBy("key").agg(F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last"), F.count("*").alias("n"))
    repeated = groups.where("n > 1")
    totals = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("groups")).first()
    examples = [{"rows": r.n, "key": r.key.asDict()} for r in repeated.orderBy("first").limit(3).collect()]
    row = F.struct(*(quoted(c) for c in df.columns))
    best = (F.max_by if keep == "last" else F.min_by)(row, F.col(ROW_ID))
    out = df.groupBy(key.alias("__key")).agg(best.alias("__row"), F.count("*").alias("__n"))
    out = (out.where("__n = 1") if keep is False else out).select("__row.*")
    removed = totals.rows - (totals.groups if keep is not False else 0)
    return out if had else out.drop(ROW_ID), {"rows_removed": removed, "duplicate_groups": totals.groups, "keep": keep, "examples": examples}


def similarity(a: Column, b: Column) -> Column:
    """Token-sort ratio: 2 * LCS over the summed lengths of the token-sorted keys; 0 where one is empty."""
    total = F.length(a) + F.length(b)
    common = X.lcs_length(F.when(a != b, a).otherwise(""), F.when(a != b, b).otherwise(""))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(2.0 * common / total)


def fuzzy_pairs(keyed: DataFrame, threshold: float) -> DataFrame:
    """block, l, r and score of pairs in a block whose similarity reaches the threshold.

    The length and Levenshtein bounds hold for every such pair, so the costly measure sees few others.
    """
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, F.expr("a.block = b.block and a.id < b.id")).select(F.col("a.block").alias("block"), F.col("a.id").alias("l"), F.col("b.id").alias("r"), F.col("a.s").alias("x"), F.col("b.s").alias("y"))
    total = F.length("x") + F.length("y")
    pairs = pairs.where(F.abs(F.length("x") - F.length("y")) <= (1 - threshold) * total + 1e-9)
    pairs = pairs.where(F.expr(f"levenshtein(x, y, cast(floor((1 - {threshold}d) * (length(x) + length(y)) + 1e-9) as int)) >= 0"))
    return pairs.withColumn("score", similarity(F.col("x"), F.col("y"))).where(F.col("score") >= threshold - 1e-12).select("block", "l", "r", "score")


def _clusters(block: pd.DataFrame) -> pd.DataFrame:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(block["l"], block["r"], strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return pd.DataFrame({"id": list(root), "cluster": [find(x) for x in root]})


@step("fuzzy_deduplicate")
def fuzzy_deduplicate(
    df: DataFrame,
    columns: list[str] | None = None,
    threshold: float = 0.88,
    blocking_keys: list[str] | None = None,
    block_prefix_length: int = 4,
    keep: str = "most_complete",
    backend: str = "auto",
    dedupe_settings_file: str | None = None,
    max_block_size: int = 2000,
    max_examples: int = 5,
    order_by: list[str] | None = None,
) -> tuple[DataFrame, dict]:
    """Near-duplicate rows, compared within blocks by token-sort similarity, merged transitively; one row of each cluster stays.

    Blocks are explicit keys or the first characters of the match key. Blocks above max_block_size are left out and the
    status is then partial: the pair count grows with a block's square, so the guard is a feature of the operator.
    """
    if keep not in ("most_complete", "first", "last"):
        raise ValueError("keep must be 'most_complete', 'first' or 'last'")
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    had = ROW_ID in df.columns
    df = with_row_id(df, order_by, keep=True)
    named = resolve_columns(df, columns, is_text)
    warnings = [f"backend {backend!r} is not available; the built-in one is used"] if backend not in ("auto", "spark") else []
    if not named:
        return df if had else df.drop(ROW_ID), {"status": "skipped", "reason": "no text columns", "rows_removed": 0}
    key = X.match_key([quoted(c) for c in named])
    block = F.concat_ws("|", *(F.coalesce(quoted(c).cast("string"), F.lit("")) for c in resolve_columns(df, blocking_keys))) if blocking_keys else F.substring(key, 1, block_prefix_length)
    complete = sum((quoted(c).isNotNull().cast("int") for c in data_columns(df)), F.lit(0))
    keyed = df.select(F.col(ROW_ID).alias("id"), key.alias("key"), block.alias("block"), complete.alias("complete")).where("key <> ''").withColumn("s", X.token_sorted(F.col("key")))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n"))
    large = sizes.agg(F.count_if(F.col("n") > max_block_size).alias("blocks"), F.coalesce(F.sum(F.when(F.col("n") > max_block_size, F.col("n"))), F.lit(0)).alias("rows")).first()
    usable = keyed.join(sizes.where((F.col("n") > 1) & (F.col("n") <= max_block_size)).select("block"), "block")
    edges = stored(fuzzy_pairs(usable, threshold))
    members = stored(edges.select("block", "l", "r").groupBy("block").applyInPandas(_clusters, "id long, cluster long").join(keyed.select("id", "key", "complete"), "id"))
    order = {"most_complete": [F.col("complete").desc(), F.col("id")], "first": [F.col("id")], "last": [F.col("id").desc()]}[keep]
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))
    out = df.join(ranked.where("rank > 1").select(F.col("id").alias(ROW_ID)), ROW_ID, "left_anti").select(*df.columns)
    counts = members.agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("clusters")).first()
    few = members.groupBy("cluster").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("key")), 1, 3).alias("records")).orderBy("cluster").limit(max_examples).collect()
    report = {"backend": "spark", "rows_removed": counts.rows - counts.clusters, "clusters": counts.clusters, "pairs": edges.count(), "examples": [{"size": r.n, "records": r.records} for r in few], "blocks_skipped": large.blocks, "rows_in_skipped_blocks": large.rows}
    if large.blocks:
        report["status"] = "partial"
        warnings.append(f"{large.blocks} blocks of more than {max_block_size} rows were not compared")
    return out if had else out.drop(ROW_ID), report | {"warnings": warnings}
