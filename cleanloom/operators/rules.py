"""A memory of cleaning rules: an append-only JSON ledger, keyword retrieval, and nearest neighbours by stored embeddings."""

from __future__ import annotations

import re
from datetime import datetime, timezone

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.operators.missing import STRATEGIES

FIELDS = ("id", "column_pattern", "issue_type", "action_type", "action_value", "rationale", "source", "created_at")
RULE_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
VECTOR_SCHEMA = RULE_SCHEMA + ", content string, embedding array<double>"
EMBEDDING = 384

#: The rules that a new memory starts with: (column_pattern, issue_type, action_type, action_value, rationale).
SEEDS = (
    ("age", "has_missing_values", "imputation", "median", "Ages are skewed; the median is robust."),
    ("salary|income|price|revenue|amount", "contains_outliers", "outlier", "clip", "Amounts of money have long tails; clip them."),
    (".*", "disguised_missing", "null_sentinel", "n/a,unknown,none,-,?", "These texts stand for a missing value."),
)


def embed(text: str, size: int = EMBEDDING) -> list[float]:
    """A hashed bag of words of unit length: the same text gives the same vector anywhere."""
    v = np.zeros(size)
    for word in re.findall(r"\w+", text.lower()):
        h = xxhash.xxh3_64_intdigest(word)
        v[h % size] += 1.0 if h >> 63 else -1.0
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def nearest(vectors: DataFrame, id_column: str, vector_column: str, query: list[float], k: int = 5) -> DataFrame:
    """The k rows with the least squared Euclidean distance to query, ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.aggregate(F.zip_with(F.col(vector_column).cast("array<double>"), q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return vectors.withColumn("distance", d).orderBy("distance", id_column).limit(k)


def matching_rules(rules: DataFrame, columns: DataFrame, pattern_mode: str = "substring") -> DataFrame:
    """(rule, column) pairs: a rule fits a column if its pattern is .* or lies in the column's lowered name."""
    fits = "instr(lower(column_name), column_pattern) > 0" if pattern_mode == "substring" else "lower(column_name) rlike column_pattern"
    return rules.join(F.broadcast(columns), F.expr(f"column_pattern = '.*' or {fits}"))


class RuleMemory:
    """Rules in a folder of any file system that Spark reaches: a ledger of JSON lines, and a table of vectors for search.

    Both grow by appending. A ledger that is missing counts as empty, and lines of it that are broken don't count.
    """

    def __init__(self, spark: SparkSession, storage_dir: str, seed: bool = True, pattern_mode: str = "substring"):
        if pattern_mode not in ("substring", "regex"):
            raise ValueError("pattern_mode must be 'substring' or 'regex'")
        self.spark, self.folder, self.pattern_mode = spark, storage_dir.rstrip("/"), pattern_mode
        self.ledger, self.vectors = f"{self.folder}/rules.jsonl", f"{self.folder}/data_cleaning_memory"
        if seed and not self.get_all_rules():
            for s in SEEDS:
                self.add_rule(*s, source="seed")

    def _is_there(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def get_all_rules(self) -> list[dict]:
        """In the order of their making; of equal ids the last record wins at the first place."""
        if not self._is_there(self.ledger):
            return []
        rows = self.spark.read.schema(RULE_SCHEMA).json(self.ledger).where("id is not null").collect()
        found: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: (r.created_at or "", r.id)):
            found[r.id] = {k: r[k] or "" for k in FIELDS}
        return list(found.values())

    def add_rule(self, column_pattern: str, issue_type: str, action_type: str, action_value: str, rationale: str = "", source: str = "user") -> dict:
        """Append one rule to the ledger and its vector to the table; an imputation must name a strategy."""
        clean = lambda x: x.strip().lower()
        if clean(action_type) == "imputation" and action_value.strip() not in STRATEGIES:
            raise ValueError(f"unknown imputation strategy {action_value!r}")
        now = datetime.now(timezone.utc)
        rule = dict(zip(FIELDS, (f"rule_{now.strftime('%Y%m%d%H%M%S%f')}", clean(column_pattern), clean(issue_type), clean(action_type), action_value.strip(), rationale.strip(), clean(source), now.isoformat(timespec="microseconds")), strict=True))
        self.spark.createDataFrame([tuple(rule.values())], RULE_SCHEMA).coalesce(1).write.mode("append").json(self.ledger)
        content = " ".join(rule[k] for k in FIELDS[1:6])
        self.spark.createDataFrame([(*rule.values(), content, embed(content))], VECTOR_SCHEMA).coalesce(1).write.mode("append").parquet(self.vectors)
        return rule

    def frame(self) -> DataFrame:
        """The stored rules with content and embedding; the last row of an id counts."""
        if not self._is_there(self.vectors):
            return self.spark.createDataFrame([], VECTOR_SCHEMA)
        stored = self.spark.read.schema(VECTOR_SCHEMA).parquet(self.vectors)
        last = F.max_by(F.struct(*stored.columns), "created_at").alias("r")
        return stored.groupBy("id").agg(last).select("r.*")

    def _fits(self, rule: dict, column: str) -> bool:
        p = rule["column_pattern"]
        return p == ".*" or (p in column.lower() if self.pattern_mode == "substring" else re.search(p, column.lower()) is not None)

    def query_relevant_rules(self, columns: list[str], issues: list[str], query_text: str | None = None, k: int = 5) -> list[dict]:
        """Rules that fit a column or an issue, and with a query text its k nearest rules as well."""
        rules = self.get_all_rules()
        found = {r["id"]: r for r in rules if any(self._fits(r, c) for c in columns) or r["issue_type"] in issues}
        if query_text and rules:
            for row in nearest(self.frame(), "id", "embedding", embed(query_text), k).select(*FIELDS).collect():
                found.setdefault(row.id, row.asDict())
        return list(found.values())

    def resolve_pipeline_overrides(self, columns: list[str], issues: list[str], query_text: str | None = None) -> tuple[dict, list[str], dict]:
        """(imputation by column, further null tokens, outlier action by column); later rules win."""
        impute, tokens, outliers = {}, set(), {}
        for r in self.query_relevant_rules(columns, issues, query_text):
            if r["action_type"] in ("null_sentinel", "add_sentinel"):
                tokens |= {t.strip().lower() for t in r["action_value"].split(",") if t.strip()}
            for c in (c for c in columns if self._fits(r, c)):
                if r["action_type"] == "imputation":
                    impute[c] = r["action_value"]
                elif r["action_type"] in ("outlier", "outlier_treatment"):
                    outliers[c] = r["action_value"]
        return impute, sorted(tokens), outliers

    def reset_store(self) -> None:
        """Forget all rules, the seeds too."""
        for path in (self.ledger, self.vectors):
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


_memories: dict[str, RuleMemory] = {}


def rule_memory(spark: SparkSession, storage_dir: str) -> RuleMemory:
    """The one memory of a folder in this process."""
    known = _memories.get(storage_dir)
    if known is None or known.spark is not spark:
        known = _memories[storage_dir] = RuleMemory(spark, storage_dir)
    return known
