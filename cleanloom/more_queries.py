"""Further queries of the engine: reports, sources, rules, streams and the rarer branches of operators, with SQL for the same rows."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from cleanloom.capabilities import dependency_status
from cleanloom.core import REGISTRY, json_safe, quoted, scratch, with_row_id
from cleanloom.functions import text as X
from cleanloom.functions.stats import finite
from cleanloom.operators.dedup import drop_exact_duplicates, fuzzy_deduplicate
from cleanloom.operators.missing import handle_missing_values
from cleanloom.operators.outliers import detect_outliers_iqr
from cleanloom.operators.profile import column_statistics, profile_dataframe, summarize_profile, top_values
from cleanloom.operators.rules import RuleMemory
from cleanloom.operators.standardize import standardize_text, standardize_types
from cleanloom.operators.validate import expectation, summarize_validation, validate_dataframe
from cleanloom.queries import QUERIES, SQL, dirty, query, table
from cleanloom.sources.files import demo_accounts, demo_customers, preview, read_any, write_csv, write_excel
from cleanloom.streaming import clean_rows

__all__ = ["QUERIES", "SQL"]

# --- text and types ---

CONTROLS = "SELECT event_id, concat(chr(7), event_type, chr(7), '  ', chr(31), CAST(user_id AS VARCHAR(9)), chr(127)) AS t FROM events"


@query("SELECT event_id, concat(event_type, ' ', user_id) AS t FROM events")
def standardize_text_control(spark, sf_dir):
    return standardize_text(dirty(spark, sf_dir, "events", CONTROLS))[0]


@query("SELECT event_id, concat('N', event_type, 'fi ', user_id) AS t FROM events")
def standardize_text_nfkc(spark, sf_dir):
    return standardize_text(dirty(spark, sf_dir, "events", "SELECT event_id, concat('Ｎ', event_type, 'ﬁ ', CAST(user_id AS VARCHAR(9))) AS t FROM events"))[0]


@query("SELECT event_id, upper(trim(event_type)) AS t FROM events")
def standardize_text_upper(spark, sf_dir):
    return standardize_text(dirty(spark, sf_dir, "events", "SELECT event_id, concat(' ', event_type) AS t FROM events"), case="upper")[0]


CURRENCIES = "SELECT o_orderkey, concat(CASE o_orderkey % 5 WHEN 0 THEN '₩' WHEN 1 THEN '₽ ' WHEN 2 THEN '₺' WHEN 3 THEN 'R$' ELSE '₪' END, CAST(o_custkey AS VARCHAR(20)), '_000') AS amount FROM orders"


@query("SELECT o_orderkey, o_custkey * 1000.0::DOUBLE AS amount FROM orders")
def types_currency(spark, sf_dir):
    return standardize_types(dirty(spark, sf_dir, "orders", CURRENCIES))[0]


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, CAST(p_size AS DOUBLE) AS size FROM part")
def types_leading_zeros(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.col("p_size").cast("string").alias("size"))
    return standardize_types(df)[0]


@query("SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) <= 0.05 * count(*) AS category FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) <= 0.05 * count(*) FROM orders UNION ALL SELECT 'clerk', count(DISTINCT o_custkey) <= 0.05 * count(*) FROM orders")
def types_category(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")).alias("clerk"))
    out, report = standardize_types(df)
    return spark.createDataFrame([(c, c in report["categories"] and out.schema[c].metadata.get("logical") == "category") for c in df.columns], "column_name string, category boolean")


KEYS = "SELECT p_partkey, concat(upper(p_name), ', ', p_type, '!') AS name FROM part"


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')), ' ') AS tokens, substr(trim(regexp_replace(lower(name), '[^\\w\\s]', ' ', 'g')), 1, 4) AS prefix FROM ({KEYS})")
def text_match_key(spark, sf_dir):
    key = X.match_key([quoted("name")])
    return dirty(spark, sf_dir, "part", KEYS).select("p_partkey", key.alias("key"), X.token_sorted(key).alias("tokens"), F.substring(key, 1, 4).alias("prefix"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS v FROM events")
def numbers_finite(spark, sf_dir):
    df = dirty(spark, sf_dir, "events", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM events")
    return df.select("event_id", finite(quoted("value")).alias("v"))


# --- profile ---

FORMS = """SELECT event_id, ts, user_id, event_type, value, concat('www.site', CAST(user_id AS VARCHAR(9)), '.org/', CAST(event_id AS VARCHAR(9))) AS www,
    concat('₩', CAST(user_id AS VARCHAR(9)), ',000') AS won, concat('u', CAST(event_id AS VARCHAR(9)), '@mail.org') AS mail, concat('+1 (555) 010-', CAST(1000 + event_id % 9000 AS VARCHAR(9))) AS phone,
    concat('2024-01-', CAST(10 + event_id % 20 AS VARCHAR(9))) AS day, CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS yes, concat('x@host', CAST(event_id AS VARCHAR(9))) AS host,
    concat('0000000', CAST(event_id % 10 AS VARCHAR(9)), '-0000-4000-8000-000000000000') AS uid, CASE WHEN event_id < 0 THEN 'x' END AS nothing FROM events"""


def _share(column: str, pattern: str) -> str:
    return f"avg(CASE WHEN regexp_matches({column}, '{pattern}') THEN 1.0 ELSE 0.0 END)"


_PHONE, _DATE = r"^\+?\(?[0-9][0-9\s().-]{6,19}$", r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}$"
_OTHER = "WHEN count(DISTINCT {c}) > 0.95 * count({c}) AND count({c}) > 20 THEN 'identifier' WHEN count(DISTINCT {c}) < 0.5 * count({c}) AND avg(length({c})) < 50 THEN 'categorical' ELSE 'text' END"
_MEANINGS = {
    "event_id": "CASE WHEN count(DISTINCT event_id) = count(event_id) AND count(*) > 20 THEN 'identifier' ELSE 'integer' END",
    "ts": "CASE WHEN count(ts) > 0 THEN 'datetime' END",
    "user_id": "CASE WHEN count(DISTINCT user_id) = count(user_id) AND count(*) > 20 THEN 'identifier' ELSE 'integer' END",
    "event_type": "CASE " + _OTHER.format(c="event_type"),
    "value": "CASE WHEN count(value) > 0 THEN 'float' END",
    "www": f"CASE WHEN {_share('lower(www)', r'^(https?://|www\.)[^ ]+$')} >= 0.8 THEN 'url' " + _OTHER.format(c="www"),
    "won": f"CASE WHEN {_share('won', r'^[$€£¥₹₽¢₩₪₺R,_ 0-9.]+$')} >= 0.9 THEN 'numeric_as_text' " + _OTHER.format(c="won"),
    "mail": f"CASE WHEN {_share('mail', r'^[^@ ]+@[^@ ]+\.[A-Za-z]{2,}$')} >= 0.8 THEN 'email' " + _OTHER.format(c="mail"),
    "phone": f"CASE WHEN {_share('phone', _PHONE)} - {_share('phone', _DATE)} >= 0.8 THEN 'phone' " + _OTHER.format(c="phone"),
    "day": f"CASE WHEN {_share('day', r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} >= 0.9 THEN 'datetime_as_text' " + _OTHER.format(c="day"),
    "yes": "CASE WHEN avg(CASE WHEN lower(yes) IN ('yes', 'no') THEN 1.0 ELSE 0.0 END) >= 0.95 THEN 'boolean_as_text' " + _OTHER.format(c="yes"),
    "host": f"CASE WHEN {_share('host', r'^[^@ ]+@[^@ ]+\.[A-Za-z]{2,}$')} >= 0.8 THEN 'email' " + _OTHER.format(c="host"),
    "uid": f"CASE WHEN {_share('uid', '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')} >= 0.8 THEN 'uuid' " + _OTHER.format(c="uid"),
    "nothing": "CASE WHEN count(nothing) = 0 THEN 'empty' END",
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {e} AS semantic_type FROM ({FORMS})" for c, e in _MEANINGS.items()))
def profile_semantic_types(spark, sf_dir):
    _, report = profile_dataframe(dirty(spark, sf_dir, "events", FORMS))
    return spark.createDataFrame([(c, p["semantic_type"]) for c, p in report["columns"].items()], "column_name string, semantic_type string")


FAULTS = """SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price, CASE WHEN l_orderkey % 2 = 0 OR l_linenumber > 4 THEN NULL ELSE l_shipdate END AS half,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_linestatus END AS few, 'x' AS one, concat(l_returnflag, ' ') AS padded, CASE WHEN l_linenumber = 1 THEN 'aa' ELSE 'Aa' END AS cased,
    CAST(l_linenumber AS VARCHAR(9)) AS digits, CASE WHEN l_linenumber = 2 THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END AS endless, concat('k', CAST(l_orderkey % 150 AS VARCHAR(9))) AS many FROM lineitem"""
_MISSING = "CASE WHEN 100.0 * (count(*) - count({c})) / count(*) >= 50 THEN 'high_missing_rate' WHEN count({c}) < count(*) THEN 'has_missing_values' END"


@query(
    f"""WITH d AS ({FAULTS}), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM d), r AS (
        SELECT 'half' AS column_name, {_MISSING.format(c='half')} AS issue FROM d UNION ALL SELECT 'few', {_MISSING.format(c='few')} FROM d
        UNION ALL SELECT 'one', CASE WHEN count(DISTINCT one) <= 1 THEN 'constant_column' END FROM d
        UNION ALL SELECT 'padded', CASE WHEN count(*) FILTER (padded <> trim(padded)) > 0 THEN 'untrimmed_whitespace' END FROM d
        UNION ALL SELECT 'cased', CASE WHEN count(DISTINCT lower(cased)) < count(DISTINCT cased) THEN 'inconsistent_casing' END FROM d
        UNION ALL SELECT 'digits', CASE WHEN {_share('digits', '^[0-9]+$')} >= 0.9 THEN 'type_mismatch' END FROM d
        UNION ALL SELECT 'endless', CASE WHEN count(*) FILTER (isinf(endless)) > 0 THEN 'contains_infinite_values' END FROM d
        UNION ALL SELECT 'many', CASE WHEN count(DISTINCT many) > 100 THEN 'high_cardinality_categorical' END FROM d
        UNION ALL SELECT 'price', CASE WHEN count(*) FILTER (price < q.a - 1.5 * (q.b - q.a) OR price > q.b + 1.5 * (q.b - q.a)) > 0 THEN 'contains_outliers' END FROM d, q)
        SELECT * FROM r WHERE issue IS NOT NULL"""
)
def profile_issues(spark, sf_dir):
    _, report = profile_dataframe(dirty(spark, sf_dir, "lineitem", FAULTS))
    return spark.createDataFrame([(c, i) for c, p in report["columns"].items() for i in p["issues"]], "column_name string, issue string")


@query("SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id)) AS place, count(*) AS n FROM events GROUP BY event_type")
def profile_distinct_values(spark, sf_dir):
    """The distinct values of a column of few, as the profile lists them, in the order of first appearance."""
    df = with_row_id(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"])
    first = {r.event_type: r.first for r in df.groupBy("event_type").agg(F.min("event_id").alias("first")).collect()}
    top = top_values(df, ["event_type"], 50)["event_type"]
    return spark.createDataFrame([(t["value"], i, t["count"]) for i, t in enumerate(sorted(top, key=lambda t: first[t["value"]]), 1)], "value string, place long, n long")


@query("SELECT count(*) FILTER (o_orderkey % 7 = 0) AS n_future, count(*) FILTER (o_orderkey % 5 = 1) AS n_empty, count(*) FILTER (o_orderkey % 5 = 2) AS n_null_tokens FROM orders")
def profile_counts(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN CAST('2999-01-01 00:00:00' AS TIMESTAMP) ELSE CAST('1999-01-01 00:00:00' AS TIMESTAMP) END AS day, CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN 'N/A' ELSE 'ok' END AS t FROM orders")
    got = column_statistics(df, ["day", "t"])
    return spark.createDataFrame([(got["day", "n_future"], got["t", "n_empty"], got["t", "n_null_tokens"] - got["t", "n_empty"])], "n_future long, n_empty long, n_null_tokens long")


@query("SELECT round((sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) + 8 * (count(o_orderkey) + count(o_custkey) + count(o_totalprice) + count(o_orderdate)))::DOUBLE / 1e6, 6) AS data_mb FROM orders")
def profile_footprint(spark, sf_dir):
    """The bytes that the values take."""
    _, report = profile_dataframe(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(report["overview"]["data_mb"],)], "data_mb double")


@query("SELECT least(1000, count(*)) AS sample_rows, count(*) > 1000 AS sampled, count(*) AS n_rows FROM orders")
def profile_sample(spark, sf_dir):
    """A profile of a seeded sample of a fixed number of rows."""
    _, report = profile_dataframe(table(spark, sf_dir, "orders").select("o_orderkey"), sample_size=1000)
    o = report["overview"]
    return spark.createDataFrame([(o["sample_rows"], o["sampled"], o["n_rows"])], "sample_rows long, sampled boolean, n_rows long")


@query(
    """SELECT * FROM (SELECT 0 AS place, '# Data profile' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, concat(count(*), ' rows, 3 columns; 0.0 % of cells missing; 0 duplicate rows.') FROM nation UNION ALL SELECT 3, ''
        UNION ALL SELECT 4, '| column | type | meaning | missing % | unique | issues |' UNION ALL SELECT 5, '|---|---|---|---|---|---|'
        UNION ALL SELECT 6, concat('| n_nationkey | int | ', CASE WHEN count(DISTINCT n_nationkey) = count(*) AND count(*) > 20 THEN 'identifier' ELSE 'integer' END, ' | 0.0 | ', count(DISTINCT n_nationkey), ' | - |') FROM nation
        UNION ALL SELECT 7, concat('| n_name | string | ', CASE WHEN count(DISTINCT n_name) > 0.95 * count(*) AND count(*) > 20 THEN 'identifier' ELSE 'text' END, ' | 0.0 | ', count(DISTINCT n_name), ' | - |') FROM nation UNION ALL SELECT 8, '' UNION ALL SELECT 9, '1 further columns are left out.')"""
)
def profile_summary(spark, sf_dir):
    _, report = profile_dataframe(table(spark, sf_dir, "nation"))
    lines = summarize_profile(report, max_columns=2).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


# --- missing values ---

GAPS = "SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN NULL ELSE value END AS value, CASE WHEN event_id % 9 < 7 THEN NULL ELSE event_type END AS kind FROM events"
_LAST = "last_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "first_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"SELECT event_id, coalesce({_LAST.format(c='value')}, {_NEXT.format(c='value')}) AS value, coalesce({_LAST.format(c='kind')}, {_NEXT.format(c='kind')}) AS kind FROM ({GAPS})")
def missing_ffill_whole(spark, sf_dir):
    return handle_missing_values(dirty(spark, sf_dir, "events", GAPS).repartition(7), strategy="ffill", order_by=["event_id"])[0]


@query(f"SELECT event_id, coalesce({_NEXT.format(c='value')}, {_LAST.format(c='value')}) AS value, coalesce({_NEXT.format(c='kind')}, {_LAST.format(c='kind')}) AS kind FROM ({GAPS})")
def missing_bfill_whole(spark, sf_dir):
    return handle_missing_values(dirty(spark, sf_dir, "events", GAPS).repartition(7), strategy="bfill", order_by=["event_id"])[0]


@query(
    f"""WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS i FROM ({GAPS})), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS spot FROM s),
        n AS (SELECT *, {_LAST.format(c='value')} AS pv, {_NEXT.format(c='value')} AS nv, {_LAST.format(c='spot')} AS pi, {_NEXT.format(c='spot')} AS ni FROM k)
        SELECT event_id, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv), 6) AS value FROM n"""
)
def missing_interpolate_whole(spark, sf_dir):
    df = dirty(spark, sf_dir, "events", GAPS).drop("kind").repartition(7)
    return handle_missing_values(df, strategy="interpolate", columns=["value"], order_by=["event_id"])[0].withColumn("value", F.round("value", 6))


MIXED = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_custkey END AS mostly, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice * o_totalprice * o_totalprice END AS skewed,
    CASE WHEN o_orderkey % 10 = 4 THEN NULL ELSE concat('t', CAST(o_orderkey AS VARCHAR(20))) END AS words, CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE o_orderkey % 3 = 0 END AS flag,
    CASE WHEN o_orderkey % 10 IN (0, 6) THEN NULL ELSE o_orderdate END AS day FROM orders"""


@query(
    f"""WITH d AS ({MIXED}) SELECT o_orderkey, coalesce(skewed, (SELECT quantile_cont(skewed, 0.5) FROM d)) AS skewed, coalesce(words, 'Unknown') AS words, coalesce(flag, (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag,
        coalesce(last_value(day IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(day IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS day FROM d"""
)
def missing_auto_branches(spark, sf_dir):
    """The automatic choice's other branches: a column dropped, a median, a constant, a most frequent truth value, dates carried on."""
    return handle_missing_values(dirty(spark, sf_dir, "orders", MIXED), order_by=["o_orderkey"])[0]


LINE = "SELECT l_orderkey % 1000 AS k, l_linenumber, CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_extendedprice END AS price, l_quantity FROM lineitem"


@query(f"WITH d AS (SELECT l_quantity, price FROM ({LINE})) SELECT l_quantity, round(coalesce(price, (SELECT regr_intercept(price, l_quantity) FROM d) + (SELECT regr_slope(price, l_quantity) FROM d) * l_quantity), 2) AS price FROM d")
def missing_iterative(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem", LINE).select("l_quantity", "price")
    return handle_missing_values(df, strategy="iterative", columns=["price"])[0].withColumn("price", F.round("price", 2))


# --- duplicates, outliers, checks ---


@query("SELECT count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id, event_type HAVING count(*) > 1 ORDER BY first LIMIT 3")
def dedup_examples(spark, sf_dir):
    """The first three groups of equal rows, as the report shows them."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    _, report = drop_exact_duplicates(df, subset=["user_id", "event_type"], order_by=["event_id"])
    first = {(r.user_id, r.event_type): r.first for r in df.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first")).collect()}
    return spark.createDataFrame([(x["rows"], first[x["key"]["k0"], x["key"]["k1"]]) for x in report["examples"]], "n long, first long")


@query("WITH b AS (SELECT substr(p_name, 1, 4) AS k, count(*) AS n FROM part GROUP BY 1) SELECT count(*) FILTER (n > 100) AS blocks, coalesce(sum(n) FILTER (n > 100), 0)::BIGINT AS n_rows, CASE WHEN count(*) FILTER (n > 100) > 0 THEN 'partial' ELSE 'success' END AS status FROM b")
def fuzzy_dedup_large_blocks(spark, sf_dir):
    _, report = fuzzy_deduplicate(table(spark, sf_dir, "part").select("p_partkey", "p_name"), columns=["p_name"], max_block_size=100)
    return spark.createDataFrame([(report["blocks_skipped"], report["rows_in_skipped_blocks"], report["status"])], "blocks long, n_rows long, status string")


@query("WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value, false AS same FROM events, f")
def outliers_mask(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("value", F.lit(7).alias("same"))
    return detect_outliers_iqr(df)[0]


@query("WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT round(100.0 * count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*), 2) AS outlier_pct FROM events, f")
def outliers_percent(spark, sf_dir):
    _, report = detect_outliers_iqr(table(spark, sf_dir, "events"), columns=["value"])
    return spark.createDataFrame([(report["columns"]["value"]["outlier_pct"],)], "outlier_pct double")


SHAPES = [
    expectation("columns_match_set", column_set=["n_nationkey", "n_name"], exact_match=False),
    expectation("columns_match_set", column_set=["n_nationkey", "n_name"], exact_match=True),
    expectation("column_exists", column="n_regionkey"),
    expectation("column_exists", column="n_comment"),
    expectation("in_type_list", column="n_name", type_list=["INT", "STRING"]),
    expectation("sounds_right", column="n_name"),
    expectation("match_regex", column="n_name", regex="("),
    expectation("not_null", column="n_name", mostly=1.0),
]


@query("SELECT * FROM (SELECT 0 AS place, true AS success UNION ALL SELECT 1, false UNION ALL SELECT 2, true UNION ALL SELECT 3, false UNION ALL SELECT 4, true UNION ALL SELECT 5, NULL UNION ALL SELECT 6, false UNION ALL SELECT 7, count(n_name) = count(*) FROM nation)")
def validate_shapes(spark, sf_dir):
    """Expectations on columns and types, one that is unknown (null) and one that fails to run (false)."""
    _, report = validate_dataframe(table(spark, sf_dir, "nation"), suite=SHAPES)
    return spark.createDataFrame([(i, r["success"]) for i, r in enumerate(report["results"])], "place int, success boolean")


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def validate_unexpected(spark, sf_dir):
    _, report = validate_dataframe(table(spark, sf_dir, "orders"), suite=[expectation("in_set", column="o_orderpriority", value_set=["1-URGENT", "2-HIGH"])])
    return spark.createDataFrame([(v,) for v in report["results"][0]["unexpected_values"]], "value string")


@query(
    """SELECT * FROM (SELECT 0 AS place, '# Validation: FAILED' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '1 passed, 1 failed, 0 skipped of 2.'
        UNION ALL SELECT 3, concat('- unique o_custkey: ', count(o_custkey) - count(DISTINCT o_custkey)) FROM orders)"""
)
def validation_summary(spark, sf_dir):
    _, report = validate_dataframe(table(spark, sf_dir, "orders"), suite=[expectation("unique", column="o_orderkey"), expectation("unique", column="o_custkey")])
    return spark.createDataFrame(list(enumerate(summarize_validation(report).split("\n"))), "place int, line string")


# --- the frame of operators ---


@query("SELECT * FROM nation")
def step_coerces_errors(spark, sf_dir):
    """A step that fails under errors="coerce" hands its input on unchanged."""
    out, report = handle_missing_values(table(spark, sf_dir, "nation"), columns=["no_such_column"], errors="coerce")
    return out.where(F.lit(report["status"] == "failed"))


@query("SELECT 'drop_exact_duplicates' AS step, 'success' AS status, count(*) AS rows_in, 3 AS columns_in, count(DISTINCT n_regionkey) AS rows_out, 3 AS columns_out FROM nation")
def step_report(spark, sf_dir):
    _, r = drop_exact_duplicates(table(spark, sf_dir, "nation"), subset=["n_regionkey"], measure=True)
    return spark.createDataFrame([(r["step"], r["status"], *r["input_shape"], *r["output_shape"])], "step string, status string, rows_in long, columns_in int, rows_out long, columns_out int")


@query("SELECT * FROM (VALUES ('detect_outliers_iqr'), ('detect_outliers_isolation_forest'), ('drop_exact_duplicates'), ('fuzzy_deduplicate'), ('handle_missing_values'), ('normalize_missing_tokens'), ('profile_dataframe'), ('standardize_column_names'), ('standardize_text'), ('standardize_types'), ('treat_outliers'), ('validate_dataframe')) t(step)")
def step_registry(spark, sf_dir):
    return spark.createDataFrame([(name,) for name in REGISTRY], "step string")


@query("SELECT * FROM (VALUES ('excel', true), ('similarity', true), ('isolation_forest', true), ('validation', true), ('vector_store', true)) t(part, present)")
def capabilities(spark, sf_dir):
    return spark.createDataFrame(list(dependency_status().items()), "part string, present boolean")


@query("SELECT concat('{\"day\": \"', strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S'), '\", \"endless\": null, \"n\": ', count(*), ', \"nothing\": null, \"status\": [\"', string_agg(DISTINCT o_orderstatus, '\", \"' ORDER BY o_orderstatus), '\"]}') AS report FROM orders")
def report_json(spark, sf_dir):
    """A report with a date, a set, infinity and not-a-number, as JSON."""
    r = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("day"), F.count("*").alias("n"), F.collect_set("o_orderstatus").alias("status")).first()
    report = {"n": r.n, "day": r.day, "status": set(r.status), "endless": math.inf, "nothing": math.nan}
    return spark.createDataFrame([(json.dumps(json_safe(report), sort_keys=True),)], "report string")


# --- sources, sinks, streams ---

NATIONS = "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'N/A' ELSE concat(n_name, ', \"', CAST(n_regionkey AS VARCHAR(9)), '\"') END AS n_name, n_nationkey + 0.5 AS half FROM nation"


def _path(spark, suffix: str) -> str:
    return f"{scratch(spark, 'source')}.{suffix}"


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN concat(n_name, ', \"', CAST(n_regionkey AS VARCHAR), '\"') END AS n_name, CAST(n_nationkey + 0.5 AS DOUBLE) AS half FROM nation")
def source_csv(spark, sf_dir):
    """Written as CSV with a header, quotes included, and read back; texts that stand for nothing are null."""
    write_csv(dirty(spark, sf_dir, "nation", NATIONS), path := _path(spark, "csv"))
    return read_any(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def source_json(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).write.text(path := _path(spark, "json"))
    return read_any(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT r_regionkey, r_name FROM region")
def source_column_json(spark, sf_dir):
    """JSON of the form {column: {row: value}}."""
    df = table(spark, sf_dir, "region")
    maps = [F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), F.col(c))))) for c in ("r_regionkey", "r_name")]
    df.agg(F.concat(F.lit('{"r_regionkey": '), maps[0], F.lit(', "r_name": '), maps[1], F.lit("}")).alias("value")).write.text(path := _path(spark, "json"))
    return read_any(spark, path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("SELECT n_nationkey, n_name FROM nation")
def source_jsonl(spark, sf_dir):
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.json(path := _path(spark, "jsonl"))
    return read_any(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT * FROM orders")
def source_orc(spark, sf_dir):
    table(spark, sf_dir, "orders").write.orc(path := _path(spark, "orc"))
    return read_any(spark, path)


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal, s_nationkey % 2 = 0 AS even, CAST('2024-02-03 04:05:06' AS TIMESTAMP) AS at FROM supplier")
def source_excel(spark, sf_dir):
    """Written as an Excel sheet and read back: numbers, text, truth values and times keep their kind."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", (F.col("s_nationkey") % 2 == 0).alias("even"), F.lit("2024-02-03 04:05:06").cast("timestamp_ntz").alias("at"))
    write_excel(df, path := _path(spark, "xlsx"))
    return read_any(spark, path).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@query("SELECT * FROM region")
def source_unknown(spark, sf_dir):
    """A suffix that no reader knows is an error that names it, not a crash of what follows."""
    try:
        return read_any(spark, "table.odd")
    except Exception as e:
        return table(spark, sf_dir, "region").where(F.lit("no reader" in str(e)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def source_preview(spark, sf_dir):
    df = with_row_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return preview(df).drop("__row_id")


@query("SELECT 8 AS n_rows, 6 AS n_columns, 7 AS ids UNION ALL SELECT 6, 5, 6")
def source_demo(spark, sf_dir):
    frames = [demo_customers(spark), demo_accounts(spark)]
    return spark.createDataFrame([(d.count(), len(d.columns), d.select("Customer ID").distinct().count()) for d in frames], "n_rows int, n_columns int, ids int")


STREAM = "SELECT event_id, concat('  ', event_type, CASE WHEN event_id % 5 = 0 THEN '' ELSE '  x ' END) AS kind, value FROM events"


@query(f"SELECT event_id, upper(trim(regexp_replace(kind, '\\s+', ' ', 'g'))) AS kind, least(greatest(value, 10.0), 50.0) AS value FROM ({STREAM})")
def stream_clean(spark, sf_dir):
    """The row-wise operators over a stream of files, run to its end."""
    source, done = _path(spark, "in"), _path(spark, "out")
    dirty(spark, sf_dir, "events", STREAM).write.parquet(source)
    stream = clean_rows(spark.readStream.schema("event_id long, kind string, value double").parquet(source), fences={"value": (10, 50)}, case="upper")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{done}-log").trigger(availableNow=True).start(done).awaitTermination()
    return spark.read.schema(stream.schema).parquet(done)


# --- rules ---


def _memory(spark) -> RuleMemory:
    memory = RuleMemory(spark, scratch(spark, "rules"))
    memory.add_rule("Price", "contains_outliers", "Outlier", "nan", "clerks mistype prices")
    memory.add_rule("status", "has_missing_values", "imputation", "mode")
    memory.add_rule("zip", "disguised_missing", "null_sentinel", "X, tbd", "used by the old system")
    return memory


@query("SELECT * FROM (VALUES ('age', 'imputation', 'median', 'seed'), ('salary|income|price|revenue|amount', 'outlier', 'clip', 'seed'), ('.*', 'null_sentinel', 'n/a,unknown,none,-,?', 'seed'), ('price', 'outlier', 'nan', 'user'), ('status', 'imputation', 'mode', 'user'), ('zip', 'null_sentinel', 'X, tbd', 'user')) t(column_pattern, action_type, action_value, source)")
def rules_ledger(spark, sf_dir):
    """The three seeds and what was added, read back from the ledger."""
    keys = ("column_pattern", "action_type", "action_value", "source")
    return spark.createDataFrame([tuple(r[k] for k in keys) for r in _memory(spark).get_all_rules()], ", ".join(f"{k} string" for k in keys))


@query("SELECT * FROM (VALUES ('imputation', 'o_orderstatus', 'mode'), ('outlier', 'o_totalprice', 'nan'), ('token', '', '-'), ('token', '', '?'), ('token', '', 'n/a'), ('token', '', 'none'), ('token', '', 'unknown')) t(kind, column_name, value)")
def rules_resolve(spark, sf_dir):
    """What the rules that fit the columns of orders ask for."""
    impute, tokens, outliers = _memory(spark).resolve_pipeline_overrides(table(spark, sf_dir, "orders").columns, [])
    rows = [("imputation", c, v) for c, v in impute.items()] + [("outlier", c, v) for c, v in outliers.items()] + [("token", "", t) for t in tokens]
    return spark.createDataFrame(rows, "kind string, column_name string, value string")


@query("SELECT * FROM (VALUES ('.*'), ('age'), ('status')) t(column_pattern)")
def rules_by_issue(spark, sf_dir):
    """Rules that fit no column but an issue that was found, and the one for all columns."""
    found = _memory(spark).query_relevant_rules(["r_regionkey"], ["has_missing_values"])
    return spark.createDataFrame([(r["column_pattern"],) for r in found], "column_pattern string")


@query("SELECT * FROM (VALUES ('.*'), ('price')) t(column_pattern)")
def rules_by_text(spark, sf_dir):
    """The stored vectors' nearest rule to a text, beside the rule for all columns."""
    found = _memory(spark).query_relevant_rules(["r_regionkey"], [], "clerks mistype prices", k=1)
    return spark.createDataFrame([(r["column_pattern"],) for r in found], "column_pattern string")


@query("SELECT 0 AS n_rules, 0 AS n_vectors")
def rules_reset(spark, sf_dir):
    memory = _memory(spark)
    memory.reset_store()
    return spark.createDataFrame([(len(memory.get_all_rules()), memory.frame().count())], "n_rules int, n_vectors int")
