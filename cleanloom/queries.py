"""The engine's own queries over the driver's tables, and DuckDB SQL for the same rows.

The tables hold no nulls, so each query dirties its input with the same SQL text that its oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.core import quoted
from cleanloom.functions import text as X
from cleanloom.operators.dedup import drop_exact_duplicates, fuzzy_deduplicate, fuzzy_pairs
from cleanloom.operators.missing import handle_missing_values
from cleanloom.operators.outliers import detect_outliers_iqr, detect_outliers_isolation_forest, treat_outliers
from cleanloom.operators.profile import column_statistics, duplicate_rows, profile_dataframe, top_values
from cleanloom.operators.rules import matching_rules, nearest
from cleanloom.operators.standardize import normalize_missing_tokens, standardize_column_names, standardize_text, standardize_types
from cleanloom.operators.validate import build_expectation_suite, expectation, validate_dataframe
from cleanloom.plans.pipeline import CleaningPipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """A SELECT over one table, written so that both engines take it."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


# --- inputs ---

PRICES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price FROM lineitem"
QUANTITIES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem"
EVENTS = "SELECT event_id, user_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE value END AS value FROM events"
TOKENS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Unknown' WHEN 2 THEN '-' WHEN 3 THEN '?' ELSE event_type END AS kind FROM events"
TEXTS = "SELECT c_custkey, concat('  ', c_name, '   ', lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN '  x ' ELSE '' END) AS a, CASE WHEN c_custkey % 4 = 0 THEN '   ' ELSE c_mktsegment END AS b FROM customer"


@query(f"SELECT count(*) AS n_rows, 3 AS n_columns, count(price) AS n_non_null, count(*) - count(price) AS n_missing, count(*) - count(DISTINCT (l_orderkey, l_linenumber, price)) AS duplicate_rows FROM ({PRICES})")
def profile_overview(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem", PRICES)
    got = column_statistics(df, df.columns)
    rows, full = got["", "rows"], got["price", "n_non_null"]
    return spark.createDataFrame([(rows, len(df.columns), full, rows - full, duplicate_rows(df))], "n_rows long, n_columns int, n_non_null long, n_missing long, duplicate_rows long")


_NUMERIC = ("n_non_null", "n_unique", "min", "max", "mean", "median", "q1", "q3", "std", "skewness", "kurtosis", "n_zeros", "n_negative", "n_outliers")


def _numeric_sql(c: str) -> str:
    return f"""
        SELECT '{c}' AS column_name, count(v) AS n_non_null, count(DISTINCT v) AS n_unique, round(min(v), 5) AS "min", round(max(v), 5) AS "max", round(avg(v), 5) AS mean,
            round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.25), 5) AS q1, round(quantile_cont(v, 0.75), 5) AS q3, round(stddev_samp(v), 5) AS std,
            round(skewness(v), 5) AS skewness, round(kurtosis(v), 5) AS kurtosis, count(*) FILTER (v = 0) AS n_zeros, count(*) FILTER (v < 0) AS n_negative,
            count(*) FILTER (v < f.lo OR v > f.hi) AS n_outliers
        FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
            (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)) f"""


@query(" UNION ALL ".join(map(_numeric_sql, ("l_quantity", "l_extendedprice", "l_discount"))))
def profile_numeric(spark, sf_dir):
    named = ["l_quantity", "l_extendedprice", "l_discount"]
    got = column_statistics(table(spark, sf_dir, "lineitem").select(*named), named)
    rows = [(c, *(round(got[c, k], 5) if isinstance(got[c, k], float) else got[c, k] for k in _NUMERIC)) for c in named]
    kinds = ", ".join(f"`{k}` {'long' if k.startswith('n_') else 'double'}" for k in _NUMERIC)
    return spark.createDataFrame(rows, f"column_name string, {kinds}")


@query("SELECT count(o_orderdate) AS n_non_null, count(DISTINCT o_orderdate) AS n_unique, min(o_orderdate) AS first, max(o_orderdate) AS last, CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS BIGINT) AS range_days FROM orders")
def profile_datetime(spark, sf_dir):
    got = column_statistics(table(spark, sf_dir, "orders").select("o_orderdate"), ["o_orderdate"])
    c = "o_orderdate"
    return spark.createDataFrame([(got[c, "n_non_null"], got[c, "n_unique"], got[c, "min"], got[c, "max"], got[c, "range_days"])], "n_non_null long, n_unique long, first timestamp_ntz, last timestamp_ntz, range_days long")


@query("SELECT count(p_type) AS n_non_null, count(DISTINCT p_type) AS n_unique, CAST(min(length(p_type)) AS INTEGER) AS min_length, CAST(max(length(p_type)) AS INTEGER) AS max_length, round(avg(length(p_type)), 4) AS mean_length FROM part")
def profile_text(spark, sf_dir):
    got = column_statistics(table(spark, sf_dir, "part").select("p_type"), ["p_type"])
    c = "p_type"
    return spark.createDataFrame([(got[c, "n_non_null"], got[c, "n_unique"], got[c, "min_length"], got[c, "max_length"], round(got[c, "mean_length"], 4))], "n_non_null long, n_unique long, min_length int, max_length int, mean_length double")


@query("SELECT * FROM (SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus)")
def profile_top_values(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").withColumn("__row_id", F.monotonically_increasing_id())
    top = top_values(df, ["l_returnflag", "l_linestatus"], 5)
    return spark.createDataFrame([(c, t["value"], t["count"]) for c, v in top.items() for t in v], "column_name string, value string, n long")


@query(f"SELECT event_id, CASE WHEN lower(trim(kind)) IN ('n/a', 'unknown', '-', '?') THEN NULL ELSE kind END AS kind FROM ({TOKENS})")
def missing_tokens(spark, sf_dir):
    return normalize_missing_tokens(dirty(spark, sf_dir, "events", TOKENS))[0]


def _fill(name: str, source: str, base: str, strategy: str, sql: str, **options):
    def run(spark, sf_dir):
        return handle_missing_values(dirty(spark, sf_dir, base, source), **({"strategy": strategy} | options))[0]

    run.__name__ = name
    query(sql)(run)


_fill("missing_mean", PRICES, "lineitem", "mean", f"SELECT l_orderkey, l_linenumber, round(coalesce(price, avg(price) OVER ()), 4) AS price FROM ({PRICES})")
_fill("missing_median", PRICES, "lineitem", "median", f"WITH p AS ({PRICES}) SELECT l_orderkey, l_linenumber, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM p)) AS price FROM p")
_fill("missing_mode", QUANTITIES, "lineitem", "mode", f"WITH p AS ({QUANTITIES}) SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT qty FROM p WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)) AS qty, coalesce(flag, (SELECT flag FROM p WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM p")
_fill("missing_constant", QUANTITIES, "lineitem", "constant", f"SELECT l_orderkey, l_linenumber, coalesce(qty, 0.0) AS qty, coalesce(flag, 'Unknown') AS flag FROM ({QUANTITIES})")
_fill("missing_drop_rows", QUANTITIES, "lineitem", "drop_rows", f"SELECT * FROM ({QUANTITIES}) WHERE qty IS NOT NULL AND flag IS NOT NULL")
_fill("missing_drop_columns", QUANTITIES, "lineitem", "drop_columns", f"SELECT l_orderkey, l_linenumber FROM ({QUANTITIES})")
_fill("missing_leave", QUANTITIES, "lineitem", "leave", QUANTITIES)
_fill("missing_indicator", QUANTITIES, "lineitem", "constant", f"SELECT l_orderkey, l_linenumber, coalesce(qty, 0.0) AS qty, coalesce(flag, 'Unknown') AS flag, qty IS NULL AS qty__was_missing, flag IS NULL AS flag__was_missing FROM ({QUANTITIES})", add_indicator=True)
_fill("missing_row_threshold", QUANTITIES, "lineitem", "leave", f"SELECT * FROM ({QUANTITIES}) WHERE (CASE WHEN qty IS NULL THEN 1 ELSE 0 END + CASE WHEN flag IS NULL THEN 1 ELSE 0 END) / 4.0 <= 0.3", row_missing_threshold=0.3)
_fill("missing_auto", QUANTITIES, "lineitem", "auto", f"WITH p AS ({QUANTITIES}) SELECT l_orderkey, l_linenumber, round(coalesce(qty, (SELECT avg(qty) FROM p)), 4) AS qty, coalesce(flag, (SELECT flag FROM p WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM p")
_ORDERED = {"order_by": ["event_id"], "partition_by": ["user_id"]}
_W = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN"
_LAST, _NEXT = f"last_value(value IGNORE NULLS) OVER ({_W} UNBOUNDED PRECEDING AND CURRENT ROW)", f"first_value(value IGNORE NULLS) OVER ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING)"
_fill("missing_ffill", EVENTS, "events", "ffill", f"SELECT event_id, user_id, coalesce({_LAST}, {_NEXT}) AS value FROM ({EVENTS})", **_ORDERED)
_fill("missing_bfill", EVENTS, "events", "bfill", f"SELECT event_id, user_id, coalesce({_NEXT}, {_LAST}) AS value FROM ({EVENTS})", **_ORDERED)
_fill(
    "missing_interpolate", EVENTS, "events", "interpolate",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({EVENTS})),
        s AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS k FROM r),
        n AS (SELECT *, {_LAST} AS pv, {_NEXT} AS nv, {_LAST.replace('value IGNORE', 'k IGNORE')} AS pi, {_NEXT.replace('value IGNORE', 'k IGNORE')} AS ni FROM s)
        SELECT event_id, user_id, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv), 6) AS value FROM n""",
    **_ORDERED,
)
for _name, _columns in (("missing_mean", {"price": 4}), ("missing_auto", {"qty": 4}), ("missing_interpolate", {"value": 6})):
    QUERIES[_name] = (lambda f, cs: lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.round(c, d) for c, d in cs.items()}))(QUERIES[_name], _columns)

SUPPLIERS = "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier"


@query(
    f"""WITH p AS ({SUPPLIERS}), d AS (
        SELECT r.s_suppkey, d.s_acctbal AS v, row_number() OVER (PARTITION BY r.s_suppkey ORDER BY sqrt(((r.s_suppkey - d.s_suppkey) ** 2 + (r.s_nationkey - d.s_nationkey) ** 2) * 3.0 / 2), d.s_suppkey) AS k
        FROM p r JOIN p d ON r.s_acctbal IS NULL AND d.s_acctbal IS NOT NULL),
        m AS (SELECT s_suppkey, avg(v) AS v FROM d WHERE k <= 5 GROUP BY s_suppkey)
        SELECT p.s_suppkey, s_nationkey, round(coalesce(s_acctbal, m.v), 4) AS s_acctbal FROM p LEFT JOIN m ON p.s_suppkey = m.s_suppkey"""
)
def missing_knn(spark, sf_dir):
    out, _ = handle_missing_values(dirty(spark, sf_dir, "supplier", SUPPLIERS), strategy="knn", columns=["s_acctbal"], order_by=["s_suppkey"])
    return out.withColumn("s_acctbal", F.round("s_acctbal", 4))


@query("SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS total_price, o_orderstatus AS total_price_2, o_orderpriority AS col_2024_priority FROM orders")
def standardize_names(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return standardize_column_names(df.toDF("Order Key", " custKey ", "Total  Price", "totalPrice", "2024 priority#"))[0]


_SQUASHED = "nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


@query(f"SELECT c_custkey, {_SQUASHED.format(c='a')} AS a, {_SQUASHED.format(c='b')} AS b FROM ({TEXTS})")
def standardize_text_strip(spark, sf_dir):
    return standardize_text(dirty(spark, sf_dir, "customer", TEXTS))[0]


@query(f"SELECT c_custkey, lower({_SQUASHED.format(c='a')}) AS a, lower({_SQUASHED.format(c='b')}) AS b FROM ({TEXTS})")
def standardize_text_lower(spark, sf_dir):
    return standardize_text(dirty(spark, sf_dir, "customer", TEXTS), case="lower")[0]


def _titled(c: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')"


@query(f"SELECT c_custkey, {_titled('a')} AS a, {_titled('b')} AS b FROM (SELECT c_custkey, {_SQUASHED.format(c='a')} AS a, {_SQUASHED.format(c='b')} AS b FROM ({TEXTS}))")
def standardize_text_title(spark, sf_dir):
    return standardize_text(dirty(spark, sf_dir, "customer", TEXTS), case="title")[0]


AMOUNTS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('$', CAST(o_custkey AS VARCHAR(20)), '.50') WHEN 1 THEN concat('(', CAST(o_custkey AS VARCHAR(20)), ')') WHEN 2 THEN concat('1,', CAST(100 + o_custkey % 900 AS VARCHAR(20))) ELSE CAST(o_custkey AS VARCHAR(20)) END AS amount FROM orders"


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 0.5 WHEN 1 THEN -CAST(o_custkey AS DOUBLE) WHEN 2 THEN 1100.0 + o_custkey % 900 ELSE CAST(o_custkey AS DOUBLE) END::DOUBLE AS amount FROM orders")
def types_numeric(spark, sf_dir):
    return standardize_types(dirty(spark, sf_dir, "orders", AMOUNTS))[0]


@query("SELECT l_orderkey, l_linenumber, round(CAST(CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) / 100, 6) AS rate FROM lineitem")
def types_percent(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem", "SELECT l_orderkey, l_linenumber, concat(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR(9)), ' %') AS rate FROM lineitem")
    return standardize_types(df, percent_to_fraction=True)[0].withColumn("rate", F.round("rate", 6))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS flag FROM orders")
def types_boolean(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'TRUE' ELSE '0' END AS flag FROM orders")
    return standardize_types(df)[0]


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders")
def types_datetime(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("day"))
    return standardize_types(df)[0]


@query("SELECT p_partkey, p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")
def types_downcast(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
    return standardize_types(df, downcast=True)[0].select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"), F.round(F.col("p_retailprice").cast("double"), 2).alias("p_retailprice"))


COPIES = "SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN '  ' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END, ' ', CAST(user_id AS VARCHAR(20)), CASE WHEN event_id % 10 = 7 THEN concat('-', CAST(event_id AS VARCHAR(20))) ELSE '' END) AS k FROM events"


def _exact(name: str, keep, sql: str):
    def run(spark, sf_dir):
        return drop_exact_duplicates(dirty(spark, sf_dir, "events", COPIES), subset=["k"], keep=keep, order_by=["event_id"])[0]

    run.__name__ = name
    query(sql)(run)


_exact("dedup_exact_first", "first", f"SELECT event_id, k FROM ({COPIES}) QUALIFY row_number() OVER (PARTITION BY lower(trim(k)) ORDER BY event_id) = 1")
_exact("dedup_exact_last", "last", f"SELECT event_id, k FROM ({COPIES}) QUALIFY row_number() OVER (PARTITION BY lower(trim(k)) ORDER BY event_id DESC) = 1")
_exact("dedup_exact_none", False, f"SELECT event_id, k FROM ({COPIES}) QUALIFY count(*) OVER (PARTITION BY lower(trim(k))) = 1")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_exact_duplicates(df, subset=["text"], ignore_case=False, ignore_whitespace=False, order_by=["doc_id"])[0].select("doc_id")


NAMES = "SELECT min(p_partkey) AS id, concat(p_name, CASE WHEN p_size % 5 = 0 THEN ' x' ELSE '' END) AS name FROM part GROUP BY 2"
BRANDED = "SELECT min(p_partkey) AS id, concat(p_name, CASE WHEN p_size % 5 = 0 THEN ' x' ELSE '' END) AS name, p_brand AS brand FROM part GROUP BY 2, 3"


def _pairs_sql(source: str, block: str, least: float) -> str:
    """Pairs (l, r, score) in a block: twice the longest common subsequence of the sorted words, over both lengths.

    d holds a row of the recurrence for each pair of texts: the running maximum of what the cell above, or the one before it and
    a match, gives.
    """
    return f"""
        k AS (SELECT id, {block} AS block, array_to_string(list_sort(string_split(lower(name), ' ')), ' ') AS s FROM ({source})),
        t AS (SELECT DISTINCT a.s AS x, b.s AS y FROM k a JOIN k b ON a.block = b.block AND a.id < b.id),
        d AS (SELECT x, y, 0 AS i, list_transform(range(1, length(y) + 1), lambda j: 0) AS row FROM t UNION ALL
            SELECT x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda h: greatest(row[h], (CASE WHEN h > 1 THEN row[h - 1] ELSE 0 END) + CASE WHEN x[i + 1] = y[h] THEN 1 ELSE 0 END)))) FROM d WHERE i < length(x)),
        m AS (SELECT x, y, 2.0 * row[length(y)] / (length(x) + length(y)) AS score FROM d WHERE i = length(x)),
        p AS (SELECT a.id AS l, b.id AS r, m.score FROM k a JOIN k b ON a.block = b.block AND a.id < b.id JOIN m ON m.x = a.s AND m.y = b.s WHERE m.score >= {least} - 1e-12)"""


_SURVIVORS = """
        e AS (SELECT l AS u, r AS v FROM p UNION SELECT r, l FROM p), c AS (SELECT u AS id, u AS root FROM e UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id),
        g AS (SELECT id, min(root) AS root FROM c GROUP BY id)"""


@query(f"WITH RECURSIVE {_pairs_sql(NAMES, 'substr(lower(name), 1, 4)', 0.8)} SELECT l, r, round(CAST(score AS DOUBLE), 6) AS score FROM p")
def fuzzy_dedup_pairs(spark, sf_dir):
    df = spark.sql(NAMES.replace("FROM part", "FROM {t}"), t=table(spark, sf_dir, "part"))
    key = X.match_key([quoted("name")])
    return fuzzy_pairs(df.select("id", F.substring(key, 1, 4).alias("block"), X.token_sorted(key).alias("s")), 0.8).select("l", "r", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {_pairs_sql(NAMES, 'substr(lower(name), 1, 4)', 0.88)}, {_SURVIVORS} SELECT id, name FROM ({NAMES}) WHERE id NOT IN (SELECT id FROM g WHERE id <> root)")
def fuzzy_dedup(spark, sf_dir):
    df = spark.sql(NAMES.replace("FROM part", "FROM {t}"), t=table(spark, sf_dir, "part"))
    return fuzzy_deduplicate(df, columns=["name"], threshold=0.88, order_by=["id"])[0]


@query(f"WITH RECURSIVE {_pairs_sql(BRANDED, 'brand', 0.9)}, {_SURVIVORS} SELECT id, name, brand FROM ({BRANDED}) WHERE id NOT IN (SELECT id FROM g WHERE id <> root)")
def fuzzy_dedup_blocked(spark, sf_dir):
    df = spark.sql(BRANDED.replace("FROM part", "FROM {t}"), t=table(spark, sf_dir, "part"))
    return fuzzy_deduplicate(df, columns=["name"], threshold=0.9, blocking_keys=["brand"], order_by=["id"], max_block_size=10**9)[0]


_FENCES = "f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)"


@query(f"WITH {_FENCES} SELECT round(b.lo, 6) AS lower, round(b.hi, 6) AS upper, (SELECT count(*) FROM events WHERE value < b.lo OR value > b.hi) AS n_outliers FROM b")
def outliers_iqr(spark, sf_dir):
    _, report = detect_outliers_iqr(table(spark, sf_dir, "events"), columns=["value"])
    r = report["columns"]["value"]
    return spark.createDataFrame([(round(r["lower"], 6), round(r["upper"], 6), r["n_outliers"])], "lower double, upper double, n_outliers long")


def _treat(name: str, action: str, sql: str):
    def run(spark, sf_dir):
        return treat_outliers(table(spark, sf_dir, "events").select("event_id", "value"), action=action, columns=["value"])[0]

    run.__name__ = name
    query(f"WITH {_FENCES} {sql}")(run)


_treat("outliers_flag", "flag", "SELECT event_id, value, value < b.lo OR value > b.hi AS is_outlier FROM events, b")
_treat("outliers_clip", "clip", "SELECT event_id, least(greatest(value, b.lo), b.hi) AS value FROM events, b")
_treat("outliers_nan", "nan", "SELECT event_id, CASE WHEN value >= b.lo AND value <= b.hi THEN value END AS value FROM events, b")
_treat("outliers_remove", "remove", "SELECT event_id, value FROM events, b WHERE value >= b.lo AND value <= b.hi")


@query()
def outliers_isolation_forest(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return detect_outliers_isolation_forest(df, contamination=0.02, return_scores=True)[0]


CHECKS = [
    expectation("row_count_between", min_value=1),
    expectation("not_null", column="o_orderkey"),
    expectation("unique", column="o_orderkey"),
    expectation("unique", column="o_custkey"),
    expectation("between", column="o_totalprice", min_value=0, max_value=200000, mostly=0.9),
    expectation("in_set", column="o_orderstatus", value_set=["F", "O"]),
    expectation("value_lengths_between", column="o_orderpriority", min_value=5, max_value=10),
    expectation("match_regex", column="o_orderpriority", regex="[1-5]-"),
    expectation("of_type", column="o_totalprice", type="double"),
]


@query(
    """SELECT * FROM (
        SELECT 0 AS place, count(*) >= 1 AS success, CAST(0 AS BIGINT) AS unexpected FROM orders
        UNION ALL SELECT 1, count(o_orderkey) = count(*), count(*) - count(o_orderkey) FROM orders
        UNION ALL SELECT 2, count(o_orderkey) = count(DISTINCT o_orderkey), count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 3, count(o_custkey) = count(DISTINCT o_custkey), count(o_custkey) - count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 4, count(*) FILTER (o_totalprice BETWEEN 0 AND 200000) >= 0.9 * count(o_totalprice), count(*) FILTER (NOT o_totalprice BETWEEN 0 AND 200000) FROM orders
        UNION ALL SELECT 5, bool_and(o_orderstatus IN ('F', 'O')), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
        UNION ALL SELECT 6, bool_and(length(o_orderpriority) BETWEEN 5 AND 10), count(*) FILTER (NOT length(o_orderpriority) BETWEEN 5 AND 10) FROM orders
        UNION ALL SELECT 7, bool_and(regexp_matches(o_orderpriority, '^[1-5]-')), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-')) FROM orders
        UNION ALL SELECT 8, true, 0)"""
)
def validate_suite(spark, sf_dir):
    _, report = validate_dataframe(table(spark, sf_dir, "orders"), suite=CHECKS)
    rows = [(i, r["success"], r.get("unexpected_count", 0)) for i, r in enumerate(report["results"])]
    return spark.createDataFrame(rows, "place int, success boolean, unexpected long")


def _suite_sql(c: str, kind: str) -> str:
    """The expectations of a column of customer, by what kind of column it is."""
    each = [f"SELECT 'column_exists' AS expectation, '{c}' AS column_name, NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mostly, NULL::INTEGER AS n_values, true AS success"]
    each += [f"SELECT 'not_null', '{c}', NULL, NULL, 1.0, NULL, true", f"SELECT 'unique', '{c}', NULL, NULL, NULL, NULL, count(DISTINCT {c}) = count({c}) FROM customer HAVING count({c}) > 20 AND count(DISTINCT {c}) >= 0.99 * count({c})"]
    if kind == "number":
        pad = f"0.1 * coalesce(nullif(max({c}) - min({c}), 0), nullif(abs(max({c})), 0), 1)"
        tag = f"HAVING count(DISTINCT {c}) < count({c}) OR '{c}' = 'c_acctbal'"
        each.append(f"SELECT 'between', '{c}', CASE WHEN min({c}) >= 0 THEN greatest(0, min({c}) - {pad}) ELSE min({c}) - {pad} END, max({c}) + {pad}, 0.99, NULL, true FROM customer {tag}")
    if kind == "category":
        each.append(f"SELECT 'in_set', '{c}', NULL, NULL, NULL, count(DISTINCT {c})::INTEGER, true FROM customer")
        each.append(f"SELECT 'value_lengths_between', '{c}', greatest(0, min(length({c})) - 2), 2 * max(length({c})), 0.99, NULL, true FROM customer")
    return " UNION ALL ".join(each)


@query(
    "SELECT expectation, column_name, round(low, 4) AS low, round(high, 4) AS high, mostly, n_values, success FROM (SELECT 'row_count_between' AS expectation, NULL AS column_name, greatest(1, count(*) // 2)::DOUBLE AS low, 2.0 * count(*)::DOUBLE AS high, NULL::DOUBLE AS mostly, NULL::INTEGER AS n_values, true AS success FROM customer UNION ALL SELECT 'columns_match_set', NULL, NULL, NULL, NULL, 5, true UNION ALL "
    + " UNION ALL ".join(_suite_sql(c, k) for c, k in (("c_custkey", "number"), ("c_name", "name"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "category")))
    + ")"
)
def suite_from_profile(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    _, profile = profile_dataframe(df)
    _, report = validate_dataframe(df, suite=build_expectation_suite(profile))
    number = lambda v: None if v is None else round(float(v), 4)
    rows = [(r["expectation_type"], a.get("column"), number(a.get("min_value")), number(a.get("max_value")), number(a.get("mostly")), len(s) if (s := a.get("value_set") or a.get("column_set")) else None, r["success"]) for r in report["results"] for a in (r["kwargs"],)]
    return spark.createDataFrame(rows, "expectation string, column_name string, low double, high double, mostly double, n_values int, success boolean")


RULES = [("r1", "price"), ("r2", "key"), ("r3", ".*"), ("r4", "nothing")]


@query("SELECT r.id, c.column_name FROM (VALUES ('r1', 'price'), ('r2', 'key'), ('r3', '.*'), ('r4', 'nothing')) r(id, p), (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) c(column_name) WHERE r.p = '.*' OR contains(lower(c.column_name), r.p)")
def rules_match(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "id string, column_pattern string")
    columns = spark.createDataFrame([(c,) for c in table(spark, sf_dir, "orders").columns], "column_name string")
    return matching_rules(rules, columns).select("id", "column_name")


@query("SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, e.vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = df.where("vec_id = 0").first().embedding
    return nearest(df, "vec_id", "embedding", q, 5).select("vec_id", F.round("distance", 6).alias("distance"))


def _slice_sql() -> str:
    return f"""WITH p AS ({PRICES}), f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM p),
        c AS (SELECT l_orderkey, l_linenumber, CASE WHEN price IS NOT NULL THEN least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS price FROM p, f)
        SELECT l_orderkey, l_linenumber, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM c)) AS price FROM c"""


@query(_slice_sql())
def clip_then_median(spark, sf_dir):
    """The flagship slice: fences, clipping, median fill."""
    df = dirty(spark, sf_dir, "lineitem", PRICES)
    out, _ = treat_outliers(df, action="clip", columns=["price"])
    return handle_missing_values(out, strategy="median", columns=["price"])[0]


RAW_ORDERS = "SELECT o_orderkey AS `Order Key`, o_custkey AS custKey, CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE concat('$', CAST(o_totalprice AS VARCHAR(20))) END AS `Total Price`, concat(' ', o_orderstatus, ' ') AS status FROM orders"


def _clipped(c: str) -> str:
    return f"least(greatest(CAST({c} AS DOUBLE), f.{c}_lo), f.{c}_hi)"


def _fence(c: str) -> str:
    q = lambda p: f"quantile_cont(CAST({c} AS DOUBLE), {p})"
    return f"{q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)}) AS {c}_lo, {q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)}) AS {c}_hi"


@query(
    f"""WITH d AS (SELECT o_orderkey AS order_key, o_custkey AS cust_key, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS total_price, trim(o_orderstatus) AS status FROM orders),
        f AS (SELECT {', '.join(map(_fence, ('order_key', 'cust_key', 'total_price')))} FROM d),
        c AS (SELECT {', '.join(f'{_clipped(c)} AS {c}' for c in ('order_key', 'cust_key'))}, CASE WHEN total_price IS NOT NULL THEN {_clipped('total_price')} END AS total_price, status FROM d, f)
        SELECT order_key, cust_key, round(coalesce(total_price, (SELECT quantile_cont(total_price, 0.5) FROM c)), 4) AS total_price, status FROM c"""
)
def pipeline_clean(spark, sf_dir):
    df = dirty(spark, sf_dir, "orders", RAW_ORDERS)
    out, _ = CleaningPipeline(errors="raise", outlier_action="clip", missing_strategy="median", order_by=["Order Key"]).run(df)
    return out.withColumn("total_price", F.round("total_price", 4))
