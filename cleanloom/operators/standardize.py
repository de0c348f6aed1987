"""Disguised nulls, names, text and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.core import ROW_ID, data_columns, is_number, is_text, quoted, replaced, resolve_columns, step, with_row_id
from cleanloom.functions import text as X
from cleanloom.functions.stats import cells, distinct_counts, one_row


@step("normalize_missing_tokens")
def normalize_missing_tokens(df: DataFrame, columns: list[str] | None = None, extra_tokens: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Texts that only stand for a missing value become null."""
    kinds = dict(df.dtypes)
    named = [c for c in resolve_columns(df, columns, is_text) if kinds[c] == "string"]
    token = {c: X.is_null_token(quoted(c), tuple(extra_tokens)) for c in named}
    found = one_row(df, {(c,): F.count_if(token[c]) for c in named})
    per_column = {c: n for (c,), n in found.items() if n}
    out = replaced(df, {c: F.when(~token[c], quoted(c)) for c in per_column})
    return out, {"tokens_normalized": sum(per_column.values()), "per_column": per_column}


@step("standardize_column_names", unique=False)
def standardize_column_names(df: DataFrame, case: str = "snake", max_length: int = 64) -> tuple[DataFrame, dict]:
    """Plain names, made unique by _2, _3 and so on; duplicate names are accepted."""
    if case not in ("snake", "lower", "upper", "keep"):
        raise ValueError(f"unknown case {case!r}")
    used, new = set(), []
    for raw in df.columns:
        name = base = raw if raw == "__row_id" else X.column_name(raw, case, max_length)
        n = 2
        while name in used:
            name = f"{base[: max_length - len(str(n)) - 1]}_{n}"
            n += 1
        used.add(name)
        new.append(name)
    mapping = {a: b for a, b in zip(df.columns, new, strict=True) if a != b}
    return df.toDF(*new), {"mapping": mapping, "columns_renamed": len(mapping)}


@step("standardize_text")
def standardize_text(
    df: DataFrame, columns: list[str] | None = None, strip: bool = True, collapse_whitespace: bool = True, case: str | None = None, unicode_form: str | None = "NFKC", remove_control_chars: bool = True
) -> tuple[DataFrame, dict]:
    """Unicode form, control characters, blanks and case, in this order; what is left empty becomes null.

    Plain ASCII values skip the Unicode function, so that it runs on the rest only.
    """
    if case not in (None, "lower", "upper", "title"):
        raise ValueError(f"unknown case {case!r}")
    if unicode_form not in (None, "NFKC"):
        raise ValueError("unicode_form must be 'NFKC' or None")
    kinds = dict(df.dtypes)
    named = [c for c in resolve_columns(df, columns, is_text) if kinds[c] == "string"]
    new = {}
    for c in named:
        e = quoted(c)
        if unicode_form:
            e = F.when(e.rlike(r"^\p{ASCII}*$"), e).otherwise(X.nfkc(F.when(~e.rlike(r"^\p{ASCII}*$"), e)))
        if remove_control_chars:
            e = X.without_controls(e)
        if collapse_whitespace:
            e = X.squash(e)
        if strip:
            e = X.strip(e)
        e = {"lower": F.lower, "upper": F.upper, "title": X.title, None: lambda x: x}[case](e)
        new[c] = F.nullif(e, F.lit(""))
    out = replaced(df, new)
    changed = one_row(df, {(c,): F.count_if(~new[c].eqNullSafe(quoted(c))) for c in named})
    per_column = {c: n for (c,), n in changed.items() if n}
    return out, {"cells_changed": sum(per_column.values()), "per_column": per_column}


_WIDTHS = ((T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31), (T.LongType(), 63))


@step("standardize_types")
def standardize_types(
    df: DataFrame,
    columns: list[str] | None = None,
    convert_numeric: bool = True,
    convert_datetime: bool = True,
    convert_boolean: bool = True,
    datetime_format: str | None = None,
    dayfirst: bool = False,
    min_match_ratio: float = 0.90,
    inference_sample_size: int | None = None,
    category_threshold: float | None = 0.05,
    downcast: bool = False,
    preserve_leading_zeros: bool = True,
    percent_to_fraction: bool = False,
    seed: int = 42,
) -> tuple[DataFrame, dict]:
    """Text columns take the first of boolean, numeric and datetime that enough of their values parse as.

    One job probes all columns, one counts the distinct values of those that stay text; the conversion is a projection. Other
    text of few distinct values is marked as a category in the column's metadata. All rows are probed; an
    inference_sample_size limits that to so many rows, drawn by a seeded hash.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    named = resolve_columns(df, columns)
    texts = [c for c in named if is_text(kinds[c])]
    sample = df if inference_sample_size is None else with_row_id(df).orderBy(F.xxhash64(ROW_ID, F.lit(seed)), ROW_ID).limit(inference_sample_size)
    got = dict.fromkeys(((c, k) for c in texts for k in ("n", "full", "boolean", "numeric", "datetime", "zeros", "digits")), 0)
    if texts:
        v = F.col("v")
        probes = {
            "n": F.count("*"),
            "full": F.count_if(X.strip(v) != ""),
            "boolean": F.count(X.parse_boolean(v)),
            "numeric": F.count(X.parse_number(v)),
            "datetime": F.count(X.parse_datetime(v, datetime_format, dayfirst)),
            "zeros": F.count_if(X.strip(v).rlike(r"^0\d+$")),
            "digits": F.count_if(X.strip(v).rlike(r"^\d+$")),
        }
        for r in cells(sample, {c: quoted(c) for c in texts}).groupBy("c").agg(*(e.alias(k) for k, e in probes.items())).collect():
            got |= {(texts[r.c], k): x for k, x in r.asDict().items() if k != "c"}
    new, chosen = {}, {}
    for c in texts:
        ratio = lambda k, c=c: got[c, k] / got[c, "full"] if got[c, "full"] else 0.0
        if convert_boolean and ratio("boolean") >= min_match_ratio:
            chosen[c], new[c] = "boolean", X.parse_boolean(quoted(c))
        elif convert_numeric and ratio("numeric") >= min_match_ratio and not (preserve_leading_zeros and got[c, "zeros"]):
            chosen[c], new[c] = "numeric", X.parse_number(quoted(c), percent_to_fraction)
        elif convert_datetime and ratio("datetime") >= min_match_ratio and ratio("digits") <= 0.5:
            chosen[c], new[c] = "datetime", X.parse_datetime(quoted(c), datetime_format, dayfirst)
    rest, categories = [c for c in texts if c not in chosen], []
    if category_threshold is not None and rest:
        rows = df.count()
        categories = [c for c, n in distinct_counts(df, {c: quoted(c) for c in rest}).items() if 0 < n <= category_threshold * rows]
    if sample is df:  # the probes have counted all cells
        lost = {(c,): got[c, "n"] - got[c, kind] for c, kind in chosen.items()}
    else:
        lost = one_row(df, {(c,): F.count_if(quoted(c).isNotNull() & e.isNull()) for c, e in new.items()})
    numbers = [c for c in named if downcast and is_number(kinds[c]) and not isinstance(kinds[c], T.DecimalType)]
    ends = one_row(df, {(c, k): f(quoted(c)) for c in numbers for k, f in (("lo", F.min), ("hi", F.max))} | {(c, "err"): F.max(F.abs(quoted(c) - quoted(c).cast("float").cast("double"))) for c in numbers if isinstance(kinds[c], T.DoubleType)})
    shrunk = {}
    for c in numbers:
        if isinstance(kinds[c], T.DoubleType):
            if ends[c, "err"] is not None and ends[c, "err"] <= 5e-4:
                new[c], shrunk[c] = quoted(c).cast("float"), "float"
        elif isinstance(kinds[c], T.IntegralType) and ends[c, "lo"] is not None:
            small = next(t for t, bits in _WIDTHS if -(1 << bits) <= ends[c, "lo"] and ends[c, "hi"] < 1 << bits)
            if small != kinds[c]:
                new[c], shrunk[c] = quoted(c).cast(small), small.simpleString()
    out = replaced(df, new)
    for c in categories:
        out = out.withMetadata(c, {**out.schema[c].metadata, "logical": "category"})
    coerced = {c: n for (c,), n in lost.items() if n}
    return out, {
        "conversions": chosen,
        "categories": categories,
        "downcast": shrunk,
        "coerced_to_null": coerced,
        "warnings": [f"{n} values of {c} did not parse as {chosen[c]} and became null" for c, n in coerced.items()],
        "dtypes_after": {c: t for c, t in out.dtypes if c in data_columns(out)},
    }
