"""The corpus pipeline: documents of poor quality go, repeated lines go, near copies go, benchmark leaks go, and what is
left is mixed by source. Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanloom.llm._common import cut, table
from cleanloom.llm.compression_quality import fit, kept_by_quality
from cleanloom.llm.decontamination import drop_contaminated
from cleanloom.llm.jaccard_join import drop_near_copies
from cleanloom.llm.line_dedup import drop_repeated_lines
from cleanloom.llm.mixture import mix
from cleanloom.llm.queries import learnable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones; it learns from two thirds of the labels."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable())
    return kept_by_quality(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of fifty words or more."""
    return drop_repeated_lines(docs, min_words=50)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles overlap in four fifths of their union."""
    return drop_near_copies(docs, width=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, copies, taken words and places in the output shards."""
    mixed = mix(docs, weights=(5, 2, 1), share=1.5, most=2.0).where("copies > 0")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "draws")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontamination", benchmark), ("mixture", mixture)]

#: No stage but the last can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each one's result is kept in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
