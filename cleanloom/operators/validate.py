"""Expectation suites: built from a profile, checked in one job."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.core import CleaningError, data_columns, is_number, is_text, quoted, step
from cleanloom.functions.stats import one_row
from cleanloom.functions.text import EMAIL

TYPES = ("row_count_between", "columns_match_set", "column_exists", "not_null", "unique", "between", "in_set", "value_lengths_between", "match_regex", "of_type", "in_type_list")


def expectation(kind: str, meta: dict | None = None, **kwargs) -> dict:
    return {"expectation_type": kind, "kwargs": kwargs, "meta": meta or {}}


def build_expectation_suite(profile: dict, suite_name: str = "profile_suite", missing_tolerance: float = 0.05, range_padding: float = 0.10, include_ranges: bool = True, include_sets: bool = True, max_set_size: int = 25, unique_ratio_threshold: float = 0.99) -> dict:
    """What a profile says about the table, as expectations."""
    n = profile["overview"]["n_rows"]
    out = [expectation("row_count_between", min_value=max(1, n // 2), max_value=2 * n), expectation("columns_match_set", column_set=list(profile["columns"]), exact_match=False)]
    for c, p in profile["columns"].items():
        out.append(expectation("column_exists", column=c))
        meaning, full = p["semantic_type"], p["n_non_null"]
        share = p["missing_pct"] / 100
        if full and share <= missing_tolerance:
            out.append(expectation("not_null", column=c, mostly=round(1 - share, 4)))
        if full > 20 and p["n_unique"] >= unique_ratio_threshold * full:
            out.append(expectation("unique", column=c))
        if include_ranges and meaning in ("integer", "float") and p.get("min") is not None:
            pad = range_padding * ((p["max"] - p["min"]) or abs(p["max"]) or 1.0)
            low = p["min"] - pad
            out.append(expectation("between", column=c, min_value=max(0.0, low) if p["min"] >= 0 else low, max_value=p["max"] + pad, mostly=0.99))
        if include_sets and meaning in ("categorical", "boolean", "boolean_as_text") and 0 < len(p.get("distinct_values", [])) <= max_set_size:
            values = [v == "true" for v in p["distinct_values"]] if meaning == "boolean" else p["distinct_values"]
            out.append(expectation("in_set", column=c, value_set=values))
        if meaning in ("text", "categorical") and p.get("max_length"):
            out.append(expectation("value_lengths_between", column=c, min_value=max(0, p["min_length"] - 2), max_value=2 * p["max_length"], mostly=0.99))
        if meaning == "email":
            out.append(expectation("match_regex", column=c, regex=EMAIL, mostly=0.95))
    return {"suite_name": suite_name, "generated_at": datetime.now(timezone.utc).isoformat(), "n_expectations": len(out), "expectations": out}


def _same_kind(kind, values: list) -> bool:
    """Membership does not cast: text matches text, numbers match numbers, truth values match truth values."""
    test = {"boolean": lambda v: isinstance(v, bool)}.get(kind.simpleString(), (lambda v: isinstance(v, str)) if is_text(kind) else (lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)) if is_number(kind) else (lambda v: True))
    return all(test(v) for v in values if v is not None)


def compile_suite(df: DataFrame, expectations: list[dict]) -> dict[tuple, object]:
    """One aggregate for each count that an expectation needs, keyed (place in the suite, name)."""
    kinds = {f.name: f.dataType for f in df.schema}
    wanted = {("rows",): F.count("*")}
    for i, x in enumerate(expectations):
        k, a = x["expectation_type"], x["kwargs"]
        c = a.get("column")
        if c not in kinds or k not in ("not_null", "unique", "between", "in_set", "value_lengths_between", "match_regex"):
            continue
        e = quoted(c)
        wanted[i, "full"] = F.count(e)
        low, high = a.get("min_value"), a.get("max_value")
        inside = lambda v, low=low, high=high: (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True))
        if k == "unique":
            wanted[i, "good"] = F.count_distinct(e)
        elif k == "between":
            wanted[i, "good"] = F.count_if(inside(e.try_cast("double")))
        elif k == "in_set":
            values = [v for v in a["value_set"] if v is not None]
            known = e.isin(*values) if values and _same_kind(kinds[c], values) else F.lit(False)
            wanted[i, "good"] = F.count_if(known)
        elif k == "value_lengths_between":
            wanted[i, "good"] = F.count_if(inside(F.length(e.cast("string"))))
        elif k == "match_regex":
            wanted[i, "good"] = F.count_if(e.cast("string").rlike("^(?:" + a["regex"].removeprefix("^") + ")"))
    return wanted


def _verdict(df: DataFrame, i: int, x: dict, got: dict) -> dict:
    k, a = x["expectation_type"], x["kwargs"]
    c, rows = a.get("column"), got["rows",]
    kinds = dict(df.dtypes)
    if k not in TYPES:
        return {"success": None, "reason": "unknown expectation"}
    if k == "row_count_between":
        return {"success": (a.get("min_value") is None or rows >= a["min_value"]) and (a.get("max_value") is None or rows <= a["max_value"]), "observed": rows}
    if k == "columns_match_set":
        have, want = set(data_columns(df)), set(a["column_set"])
        return {"success": have == want if a.get("exact_match") else want <= have, "missing": sorted(want - have), "unexpected": sorted(have - want)}
    if k == "column_exists" or c not in kinds:
        return {"success": c in kinds, "observed": c in kinds}
    if k in ("of_type", "in_type_list"):
        names = [a["type"]] if k == "of_type" else a["type_list"]
        return {"success": any(t.lower() in kinds[c].lower() for t in names), "observed": kinds[c]}
    full = got[i, "full"]
    if k == "not_null":
        good, of = full, rows
    elif k == "unique":
        return {"success": full == got[i, "good"], "unexpected_count": full - got[i, "good"]}
    else:
        good, of = got[i, "good"], full
    share = good / of if of else 1.0
    return {"success": share >= a.get("mostly", 1.0), "observed_fraction": round(share, 6), "unexpected_count": of - good}


@step("validate_dataframe")
def validate_dataframe(df: DataFrame, suite: dict | list | None = None, profile: dict | None = None, backend: str = "auto", fail_fast: bool = False) -> tuple[DataFrame, dict]:
    """Check a suite, or the one that a profile gives; the table is unchanged.

    All counts come from one job, whatever the number of expectations; failed sets add one small job for their values.
    """
    if suite is None:
        if profile is None:
            raise ValueError("a suite or a profile is needed")
        suite = build_expectation_suite(profile)
    named = suite if isinstance(suite, dict) else {"suite_name": "suite", "expectations": list(suite)}
    checks = named["expectations"]
    got, broken = {}, {}
    try:
        got = one_row(df, compile_suite(df, checks))
    except Exception:  # one bad expectation must not take the others down
        got = {("rows",): df.count()}
        for i, x in enumerate(checks):
            try:
                wanted = {k: v for k, v in compile_suite(df, [x]).items() if k != ("rows",)}
                got |= {(i, k): v for (_, k), v in one_row(df, wanted).items()}
            except Exception as e:
                broken[i] = str(e)
    results = []
    for i, x in enumerate(checks):
        try:
            verdict = {"success": False, "error": broken[i]} if i in broken else _verdict(df, i, x, got)
        except Exception as e:
            verdict = {"success": False, "error": f"{type(e).__name__}: {e}"}
        if x["expectation_type"] == "in_set" and verdict["success"] is False and "error" not in verdict and x["kwargs"]["column"] in df.columns:
            e = quoted(x["kwargs"]["column"])
            known = [v for v in x["kwargs"]["value_set"] if v is not None]
            odd = df.where(e.isNotNull() & ~e.cast("string").isin(*map(str, known))) if known else df.where(e.isNotNull())
            verdict["unexpected_values"] = [r[0] for r in odd.select(e).distinct().limit(10).collect()]
        results.append(x | verdict)
    passed, failed = (sum(r["success"] is v for r in results) for v in (True, False))
    failures = [r for r in results if r["success"] is False]
    report = {
        "suite_name": named.get("suite_name"),
        "success": not failed,
        "backend": "spark",
        "backend_fallback_reason": None if backend in ("auto", "spark") else f"backend {backend!r} is not available",
        "n_expectations": len(results),
        "n_passed": passed,
        "n_failed": failed,
        "n_skipped": len(results) - passed - failed,
        "results": results,
        "failures": failures[:50],
    }
    if fail_fast and failed:
        raise CleaningError("expectations failed: " + "; ".join(f"{r['expectation_type']} {r['kwargs'].get('column', '')}".strip() for r in failures[:5]))
    return df, report


def summarize_validation(results: dict, max_failures: int = 15) -> str:
    """A validation report as Markdown."""
    lines = [f"# Validation: {'PASSED' if results['success'] else 'FAILED'}", "", f"{results['n_passed']} passed, {results['n_failed']} failed, {results['n_skipped']} skipped of {results['n_expectations']}."]
    for r in results["failures"][:max_failures]:
        odd = r.get("unexpected_values", [])[:5]
        lines.append(f"- {r['expectation_type']} {r['kwargs'].get('column', '')}: {r.get('unexpected_count', r.get('observed', r.get('error', '')))}" + (f", such as {odd}" if odd else ""))
    return "\n".join(lines)
