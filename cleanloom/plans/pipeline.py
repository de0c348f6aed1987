"""The cleaning plan: twelve steps from a raw table to a clean one, with an audit log."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from cleanloom.core import ROW_ID, ingest, json_safe, stored
from cleanloom.operators.dedup import drop_exact_duplicates, fuzzy_deduplicate
from cleanloom.operators.missing import handle_missing_values
from cleanloom.operators.outliers import treat_outliers
from cleanloom.operators.profile import profile_dataframe
from cleanloom.operators.rules import RuleMemory
from cleanloom.operators.standardize import normalize_missing_tokens, standardize_column_names, standardize_text, standardize_types
from cleanloom.operators.validate import build_expectation_suite, validate_dataframe


class CleaningPipeline:
    """Outliers come before imputation, so that imputed values do not shape the fences."""

    def __init__(
        self,
        missing_strategy: str = "auto",
        outlier_method: str = "iqr",
        outlier_action: str = "flag",
        fuzzy_dedup: bool = False,
        fuzzy_columns: list[str] | None = None,
        fuzzy_threshold: float = 0.88,
        text_case: str | None = None,
        use_rules: bool = True,
        rules: RuleMemory | None = None,
        errors: str = "coerce",
        order_by: list[str] | None = None,
        apply_outlier_rules: bool = False,
        suite: dict | None = None,
    ):
        self.missing_strategy, self.outlier_method, self.outlier_action = missing_strategy, outlier_method, outlier_action
        self.fuzzy_dedup, self.fuzzy_columns, self.fuzzy_threshold = fuzzy_dedup, fuzzy_columns, fuzzy_threshold
        self.text_case, self.rules, self.errors, self.order_by = text_case, rules if use_rules else None, errors, order_by
        self.apply_outlier_rules, self.suite = apply_outlier_rules, suite

    def run(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """(clean table, summary). Steps are lazy between the points where a table is kept; each report is a few jobs.

        What is kept on the way is let go at the end; the clean table is stored.
        """
        began = time.perf_counter()
        log: list[dict] = []

        def do(step, frame, **options):
            frame, report = step(frame, errors=self.errors, **options)
            log.append(report)
            return frame, report

        raw = ingest(df, self.order_by)
        kept: list[DataFrame] = []
        _, profile = do(profile_dataframe, raw)
        columns, issues = list(profile.get("columns", {})), profile.get("dataset_issues", [])
        impute, tokens, outlier_rules, found = {}, [], {}, []
        if self.rules is not None:
            found = self.rules.query_relevant_rules(columns, issues)
            impute, tokens, outlier_rules = self.rules.resolve_pipeline_overrides(columns, issues)
        now, names = do(standardize_column_names, raw)
        renamed = names.get("mapping", {})
        new = lambda c: renamed.get(c, c)
        now, _ = do(normalize_missing_tokens, now, extra_tokens=tuple(tokens))
        now, _ = do(standardize_text, now, case=self.text_case)
        kept.append(now := now.persist(StorageLevel.MEMORY_AND_DISK))
        now, types = do(standardize_types, now)
        kept.append(now := now.persist(StorageLevel.MEMORY_AND_DISK))
        now, exact = do(drop_exact_duplicates, now)
        kept.append(now := now.persist(StorageLevel.MEMORY_AND_DISK))
        removed_fuzzy = 0
        if self.fuzzy_dedup:
            text = [c for c, t in now.dtypes if t == "string"]
            now, report = do(fuzzy_deduplicate, now, columns=[new(c) for c in self.fuzzy_columns] if self.fuzzy_columns else text[:2], threshold=self.fuzzy_threshold)
            removed_fuzzy = report.get("rows_removed", 0)
        actions = {new(c): a for c, a in outlier_rules.items()} if self.apply_outlier_rules else None
        now, outliers = do(treat_outliers, now, method=self.outlier_method, action=self.outlier_action, column_actions=actions)
        now, missing = do(handle_missing_values, now, strategy=self.missing_strategy, column_strategies={new(c): s for c, s in impute.items() if new(c) in now.columns})
        suite = self.suite
        if suite is None and columns:
            suite = build_expectation_suite(profile)
            for x in suite["expectations"]:
                if "column" in x["kwargs"]:
                    x["kwargs"]["column"] = new(x["kwargs"]["column"])
                if "column_set" in x["kwargs"]:
                    x["kwargs"]["column_set"] = [new(c) for c in x["kwargs"]["column_set"]]
        clean = stored(now.drop(ROW_ID))
        for frame in kept:
            frame.unpersist()
        _, checks = do(validate_dataframe, clean, suite=suite or {"suite_name": "empty", "expectations": []})
        _, after = do(profile_dataframe, clean)
        before, end = profile.get("overview", {}), after.get("overview", {})
        metrics = {
            "rows_before": before.get("n_rows"),
            "rows_after": end.get("n_rows"),
            "columns_before": before.get("n_columns"),
            "columns_after": end.get("n_columns"),
            "missing_before": before.get("missing_cells"),
            "missing_after": end.get("missing_cells"),
            "duplicates_removed": exact.get("rows_removed", 0),
            "fuzzy_duplicates_removed": removed_fuzzy,
            "outlier_rows": outliers.get("rows_affected", 0),
            "values_imputed": missing.get("values_imputed", 0),
            "columns_converted": len(types.get("conversions", {})),
            "rules_retrieved": len(found),
        }
        summary = {
            "status": "success",
            "failed_steps": [r["step"] for r in log if r["status"] == "failed"],
            "metrics": metrics,
            "profile_before": profile,
            "profile_after": after,
            "validation": checks,
            "column_mapping": renamed,
            "audit_log": log,
            "total_duration_seconds": round(time.perf_counter() - began, 3),
        }
        return clean, json_safe(summary)
