"""The queries opN_<name>: each operator with production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import table
from cleanloom.llm.cap_filters import cap_filter_links
from cleanloom.llm.compression_quality import fit, quality_scores
from cleanloom.llm.decontamination import decontamination_report
from cleanloom.llm.jaccard_join import jaccard_components
from cleanloom.llm.line_dedup import drop_repeated_lines
from cleanloom.llm.lm_scoring import lm_scores
from cleanloom.llm.mixture import mix
from cleanloom.llm.secret_scan import secret_spans
from cleanloom.llm.url_filter import url_verdicts
from cleanloom.llm.warc_revisit import page_revisits


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the backoff automaton learnt from six sevenths of them."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def learnable() -> Column:
    """The labels that the quality classifier may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality from dictionaries learnt from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learnable())
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under five rules; what no rule fits is allowed."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules, default="allow")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 3-word shingles that overlap in nine tenths of their union."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs of fifty words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, min_words=50, report=True)


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of nine tenths."""
    return cap_filter_links(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through written, resolved and reread archives."""
    return page_revisits(table(spark, sf_dir, "pages"), least_bytes=1000)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to one and a half times their words."""
    mixed = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_compression_quality": op3_compression_quality,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_cap_filters": op8_cap_filters,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_mixture": op10_mixture,
}

SQL: dict[str, str] = {
    "op4_url_filter": """
        WITH u AS (
            SELECT page_id,
                CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
        SELECT page_id, host, path,
            (SELECT arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) FROM r
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
            coalesce((SELECT arg_max(verdict, length(rhost) * 1000 + length(rpath)) FROM r
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
        FROM u""",
    "op9_warc_revisit": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
            CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM q""",
}
