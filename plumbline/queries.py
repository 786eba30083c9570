"""Registered queries: each operator over a test table, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import pii, text, types_dates, validators
from plumbline.operators import aggregate as A
from plumbline.operators import clean, evidence, findings, fuzzy, stats, structure, vocabulary
from plumbline.operators import metrics as M
from plumbline.operators.profile import profile_by, profile_columns, table_overview

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# column and table profiles

_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numeric_sql(table: str, column: str) -> str:
    c = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", count(*) AS n, count(*) - count({column}) AS n_missing, count(DISTINCT {column}) AS n_distinct, min({c}) AS min, max({c}) AS max,
 round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, round(quantile_cont({c}, 0.5), 4) AS median, count(*) FILTER ({c} = 0) AS n_zeros, count(*) FILTER ({c} < 0) AS n_negatives,
 (SELECT CAST(v AS VARCHAR) FROM (SELECT CAST({c} AS DECIMAL(18,2)) AS v, count(*) AS k FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY k DESC, {column} LIMIT 1)) AS mode,
 count(*) FILTER ({c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {table}) OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {table})) AS n_outliers
FROM {table}"""


@_query(" UNION ALL ".join(_numeric_sql("lineitem", c) for c in _NUMBERS))
def profile_lineitem(spark, sf_dir):
    """Numeric column profile: counts, distinct values, mode, moments, median and IQR outliers."""
    rows = profile_columns(_t(spark, sf_dir, "lineitem"), columns=list(_NUMBERS))
    keep = [(r["column"], r["n"], r["n_missing"], r["n_distinct"], r["min"], r["max"], r["mean"], r["stddev"], r["median"], r["n_zeros"], r["n_negatives"], f"{float(r['mode']):.2f}", r["n_outliers"]) for r in rows]
    out = _rows(spark, keep, "column string, n long, n_missing long, n_distinct long, min double, max double, mean double, stddev double, median double, n_zeros long, n_negatives long, mode string, n_outliers long")
    return out.withColumns({c: _r(F.col(c), 4) for c in ("mean", "stddev", "median")})


@_query(
    """WITH v AS (SELECT 9007199254740992 + CAST(event_id AS BIGINT) * 3 AS big, CASE WHEN event_id % 5 = 0 THEN 9007199254740993 ELSE 9007199254740994 - event_id % 7 END AS low, -9007199254740993 - event_id % 100 AS minus FROM events)
SELECT name AS "column", count(*) AS n, count(DISTINCT x) AS n_distinct, CAST(min(x) AS VARCHAR) AS min_exact, CAST(max(x) AS VARCHAR) AS max_exact, (SELECT CAST(y AS VARCHAR) FROM (SELECT y, count(*) AS k FROM (SELECT 'big' AS name, big AS y FROM v UNION ALL SELECT 'low', low FROM v UNION ALL SELECT 'minus', minus FROM v) m WHERE m.name = u.name GROUP BY y) ORDER BY k DESC, y LIMIT 1) AS mode
FROM (SELECT 'big' AS name, big AS x FROM v UNION ALL SELECT 'low', low FROM v UNION ALL SELECT 'minus', minus FROM v) u GROUP BY name"""
)
def profile_bigint(spark, sf_dir):
    """Distinct values, modes and extremes of integers beyond 2^53, which doubles don't tell apart."""
    v = _t(spark, sf_dir, "events").selectExpr("9007199254740992L + CAST(event_id AS BIGINT) * 3 AS big", "CASE WHEN event_id % 5 = 0 THEN 9007199254740993L ELSE 9007199254740994L - event_id % 7 END AS low", "-9007199254740993L - event_id % 100 AS minus")
    rows = profile_columns(v)
    return _rows(spark, [(r["column"], r["n"], r["n_distinct"], r["min_exact"], r["max_exact"], r["mode"]) for r in rows], "column string, n long, n_distinct long, min_exact string, max_exact string, mode string")


def _text_sql(table: str, column: str) -> str:
    return f"""SELECT '{table}.{column}' AS "column", count(*) AS n, count(*) FILTER ({column} IS NULL) AS n_missing, count(DISTINCT {column}) AS n_distinct, min(length({column})) AS length_min, max(length({column})) AS length_max,
 round(avg(length({column})), 4) AS length_mean, count(*) FILTER (length(trim({column})) = 0) AS n_blanks, count(*) FILTER (regexp_matches({column}, '^\\s+\\S|\\S\\s+$')) AS n_border_spaces,
 (SELECT {column} FROM (SELECT {column}, count(*) AS k FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY k DESC, 1 LIMIT 1)) AS mode FROM {table}"""


@_query(" UNION ALL ".join(_text_sql(t, c) for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_type"))))
def profile_text(spark, sf_dir):
    """Text column profile: lengths, blanks, border spaces, distinct values, mode."""
    out = []
    for table, names in (("customer", ["c_name", "c_mktsegment"]), ("part", ["p_name", "p_type"])):
        for r in profile_columns(_t(spark, sf_dir, table), columns=names):
            out.append((f"{table}.{r['column']}", r["n"], r["n_missing"], r["n_distinct"], r["length_min"], r["length_max"], r["length_mean"], r["n_blanks"], r["n_border_spaces"], r["mode"]))
    return _rows(spark, out, "column string, n long, n_missing long, n_distinct long, length_min long, length_max long, length_mean double, n_blanks long, n_border_spaces long, mode string").withColumn("length_mean", _r(F.col("length_mean"), 4))


@_query(
    """WITH g AS (SELECT count(*) AS k, bool_and(event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND props IS NOT NULL) AS whole
 FROM events GROUP BY event_id, user_id, ts, event_type, value, props)
SELECT CAST(sum(k) AS BIGINT) AS n_rows, 6 AS n_columns, CAST(sum(k) * 6 AS BIGINT) AS n_cells, CAST(sum(CASE WHEN whole THEN k ELSE 0 END) AS BIGINT) AS n_complete, CAST(sum(k - 1) AS BIGINT) AS n_surplus,
 CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS n_in_duplicates FROM g"""
)
def table_overview_events(spark, sf_dir):
    """Rows, cells, complete rows and duplicate rows of a table."""
    r = table_overview(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", "props"))
    return _rows(spark, [tuple(r.values())], "n_rows long, n_columns int, n_cells long, n_complete long, n_surplus long, n_in_duplicates long")


@_query(
    """SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_applicable, count(*) FILTER (NOT (o_orderstatus = 'F')) AS n_not_applicable, count(*) FILTER (o_orderstatus IS NULL) AS n_undetermined,
 count(*) FILTER (NOT (o_orderstatus = 'F') AND o_totalprice IS NOT NULL) AS n_present_outside, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice IS NULL) AS n_missing FROM orders"""
)
def applicability_universe(spark, sf_dir):
    """Counts under a declared, three-valued applicability rule."""
    r = profile_columns(_t(spark, sf_dir, "orders"), mode="counts", columns=["o_totalprice"], applicability={"o_totalprice": "o_orderstatus = 'F'"})[0]
    names = ("n", "n_applicable", "n_not_applicable", "n_undetermined", "n_present_outside", "n_missing")
    return _rows(spark, [tuple(r[k] for k in names)], ", ".join(f"{k} long" for k in names))


_SENTINEL_SQL = "lower(trim({c})) IN (" + ", ".join("'" + s + "'" for s in ("", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "missing", "unknown", "s/d", "s/n", "sin dato", "sin datos", "no aplica", "no corresponde", "-", "--", "?", ".", "#n/a", "#null!", "<na>")) + ")"


@_query(
    f"""WITH d AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN '-999' ELSE event_type END AS v FROM events)
SELECT count(*) AS n, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER ({_SENTINEL_SQL.format(c="v")} AND length(trim(v)) > 0) AS n_disguised_text, count(*) FILTER (length(trim(v)) = 0) AS n_blanks,
 count(*) FILTER (coalesce(try_cast(trim(v) AS DOUBLE) IN (-9, -99, -999, -9999, 999), false)) AS n_disguised_number FROM d"""
)
def missing_disguised(spark, sf_dir):
    """Texts and numbers that stand for a missing value."""
    v = F.expr("CASE WHEN event_id % 11 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN '-999' ELSE event_type END")
    r = profile_columns(_t(spark, sf_dir, "events").select(v.alias("v")), mode="safe")[0]
    names = ("n", "n_missing", "n_disguised_text", "n_blanks", "n_disguised_number")
    return _rows(spark, [tuple(r[k] for k in names)], ", ".join(f"{k} long" for k in names))


@_query(" UNION ALL ".join(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS probability, round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS value FROM lineitem" for p in (0, 0.25, 0.5, 0.75, 0.9, 1)) for c in ("l_quantity", "l_extendedprice", "l_orderkey")))
def quantiles_lineitem(spark, sf_dir):
    """Exact type-7 quantiles."""
    return stats.quantiles(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_orderkey"], [0, 0.25, 0.5, 0.75, 0.9, 1]).withColumn("value", _r(F.col("value")))


@_query(
    """WITH v AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY "column") AS total FROM c)
SELECT "column", value, n, round(n / total, 6) AS share, rank FROM r WHERE rank <= 5"""
)
def top_values_orders(spark, sf_dir):
    """The most frequent values of columns."""
    return stats.top_values(_t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], 5).withColumns({"share": _r(F.col("share")), "rank": F.col("rank").cast("long")})


@_query(
    """SELECT CASE WHEN event_type IS NULL THEN '(missing)' ELSE event_type END AS "group", 'value' AS "column", count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS n_missing, count(DISTINCT value) AS n_distinct, min(value) AS min, max(value) AS max,
 round(avg(value), 6) AS mean FROM events GROUP BY event_type HAVING count(*) >= 30"""
)
def profile_by_group(spark, sf_dir):
    """Profiles within groups, in one pass."""
    return profile_by(_t(spark, sf_dir, "events"), "event_type", ["value"]).withColumn("mean", _r(F.col("mean")))


@_query(
    """SELECT count(DISTINCT o_orderkey) AS n_distinct, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS sequence_gaps, round(count(DISTINCT o_orderkey) / (max(o_orderkey) - min(o_orderkey) + 1), 6) AS sequence_density,
 count(DISTINCT o_orderkey) >= 20 AND count(DISTINCT o_orderkey) / (max(o_orderkey) - min(o_orderkey) + 1) >= 0.8 AS dense_sequence FROM orders"""
)
def dense_integer_sequence(spark, sf_dir):
    """Density and gaps of an integer column."""
    r = profile_columns(_t(spark, sf_dir, "orders"), columns=["o_orderkey"])[0]
    return _rows(spark, [(r["n_distinct"], r["sequence_gaps"], r["sequence_density"], r["dense_sequence"])], "n_distinct long, sequence_gaps long, sequence_density double, dense_sequence boolean").withColumn("sequence_density", _r(F.col("sequence_density")))


@_query()
def profile_approximate(spark, sf_dir):
    """The approximate mode: sketches instead of sorts and groups."""
    rows = profile_columns(_t(spark, sf_dir, "lineitem"), mode="approximate", columns=list(_NUMBERS))
    return _rows(spark, [(r["column"], r["n_distinct"], r["median"], r["state"]) for r in rows], "column string, n_distinct long, median double, state string")


@_query()
def profile_sampled(spark, sf_dir):
    """The sampled mode: counts scaled to the table, with the state of each."""
    rows = profile_columns(_t(spark, sf_dir, "lineitem"), mode="sampled", columns=list(_NUMBERS), fraction=0.2)
    return _rows(spark, [(r["column"], r["n"], r["n_zeros"], r["n_distinct"], r["state"]) for r in rows], "column string, n long, n_zeros long, n_distinct long, state string")


# text, types, dates, validators

_SHAPE_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]+', '9+', 'g'), '[A-Z]+', chr(1), 'g'), '[a-z]+', 'a+', 'g'), chr(1), 'A+', 'g')"


@_query(f"WITH s AS (SELECT {_SHAPE_SQL.format(c='c_name')} AS pattern, c_name AS v FROM customer) SELECT pattern, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share, min(v) AS example FROM s GROUP BY pattern ORDER BY n DESC, pattern LIMIT 20")
def patterns_customer(spark, sf_dir):
    """Text shapes and their frequencies."""
    return findings.discover_patterns(_t(spark, sf_dir, "customer"), "c_name").select("pattern", "n", _r(F.col("share")).alias("share"), "example")


@_query(
    r"""SELECT count(*) FILTER (regexp_matches(text, '^\s+\S|\S\s+$')) AS border_spaces, count(*) FILTER (length(trim(text)) = 0) AS blanks, count(*) FILTER (regexp_matches(text, '[\n\r\t]')) AS field_separators,
 count(*) FILTER (regexp_matches(text, '&([A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});')) AS html_entities FROM documents"""
)
def text_hygiene(spark, sf_dir):
    """Text diagnostics of a column in one pass."""
    flags = text.hygiene_flags(F.col("text"))
    return _t(spark, sf_dir, "documents").agg(*[F.count(F.when(flags[k], 1)).alias(k) for k in ("border_spaces", "blanks", "field_separators", "html_entities")])


@_query(
    r"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders), t AS (SELECT CASE WHEN k % 3 = 0 THEN strftime(d, '%Y-%m-%d') WHEN k % 3 = 1 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%Y%m%d') END AS v FROM d)
SELECT count(*) FILTER (regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')) AS iso, count(*) FILTER (regexp_matches(v, '^\d{2}/\d{2}/\d{4}$')) AS day_first, count(*) FILTER (regexp_matches(v, '^\d{2}/\d{2}/\d{4}$') AND CAST(v[1:2] AS INT) <= 12) AS month_first_possible, count(*) FILTER (regexp_matches(v, '^\d{8}$')) AS compact FROM t"""
)
def date_formats(spark, sf_dir):
    """Counts of texts per date format, with both readings of day and month."""
    d = F.to_date("o_orderdate")
    v = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyyMMdd"))
    got = types_dates.date_format_counts(_t(spark, sf_dir, "orders").select(v.alias("v")), "v")
    return _rows(spark, [(got["yyyy-MM-dd"], got["dd/MM/yyyy"], got["MM/dd/yyyy"], got["yyyyMMdd"])], "iso long, day_first long, month_first_possible long, compact long")


def _type_sql(name: str, expression: str) -> str:
    share = lambda r: f"count(*) FILTER (regexp_matches(v, '{r}')) >= 0.8 * count(*)"
    return f"""SELECT '{name}' AS "column", CASE WHEN count(*) FILTER (try_strptime(v, '%Y-%m-%d') IS NOT NULL) >= 0.8 * count(*) THEN 'date' WHEN {share("^[+-]?[0-9]+$")} THEN 'integer'
 WHEN {share("^[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?$")} THEN 'double' ELSE 'text' END AS type, count(*) AS n FROM (SELECT {expression} AS v FROM orders) WHERE length(trim(v)) > 0"""


@_query(" UNION ALL ".join(_type_sql(*x) for x in (("integer_text", "CAST(o_orderkey AS VARCHAR)"), ("double_text", "CAST(CAST(o_totalprice AS DOUBLE) AS VARCHAR)"), ("date_text", "strftime(o_orderdate, '%Y-%m-%d')"), ("o_orderpriority", "o_orderpriority"))))
def implicit_types(spark, sf_dir):
    """The implicit type of text columns."""
    df = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("integer_text"), F.col("o_totalprice").cast("string").alias("double_text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"), "o_orderpriority")
    return _rows(spark, [(c, r["type"], r["n"]) for c in df.columns for r in [types_dates.infer_type(df, c)]], "column string, type string, n long")


@_query(
    """WITH v AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN '$ 1.234,50' WHEN p_partkey % 4 = 1 THEN '1,234.50' WHEN p_partkey % 4 = 2 THEN '12%' ELSE '1.234' END AS v FROM part)
SELECT v, count(*) AS n, v = '$ 1.234,50' AS decimal_comma, v = '1,234.50' AS decimal_point, v = '1.234' AS ambiguous, CASE WHEN v = '12%' THEN '%' ELSE '' END AS unit FROM v GROUP BY v"""
)
def numbers_as_text(spark, sf_dir):
    """Parts and conventions of numbers written as text."""
    v = F.expr("CASE WHEN p_partkey % 4 = 0 THEN '$ 1.234,50' WHEN p_partkey % 4 = 1 THEN '1,234.50' WHEN p_partkey % 4 = 2 THEN '12%' ELSE '1.234' END").alias("v")
    counts = _t(spark, sf_dir, "part").select(v).groupBy("v").agg(F.count("*").alias("n"))
    parts = text.number_parts(F.col("v"))
    return counts.select("v", "n", *[parts[k].alias(k) for k in ("decimal_comma", "decimal_point", "ambiguous", "unit")])


@_query(
    """WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS v FROM orders), x AS (SELECT v, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (len(v) - i) % 2 = 1 THEN (CAST(v[i] AS INT) * 2) // 10 + (CAST(v[i] AS INT) * 2) % 10 ELSE CAST(v[i] AS INT) END)) AS s FROM d)
SELECT count(*) AS n, count(*) FILTER (s % 10 = 0) AS n_luhn FROM x"""
)
def validate_luhn(spark, sf_dir):
    """Luhn check digits."""
    ok = validators.is_luhn(F.col("o_orderkey").cast("string"))
    return _t(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_luhn"))


@_query("SELECT count(*) AS n, count(*) FILTER (CAST(o_orderkey AS BIGINT) % 97 = 1) AS n_mod97 FROM orders")
def validate_mod97(spark, sf_dir):
    """Remainders modulo 97 of digit texts of any length."""
    ok = validators.is_mod97(F.col("o_orderkey").cast("string"))
    return _t(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_mod97"))


@_query(r"SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '^https?://([A-Za-z0-9-]+\.)*[A-Za-z0-9-]+([/?#][^\s%<>]*)?$')) AS n_valid FROM pages")
def validate_url(spark, sf_dir):
    """URL syntax."""
    return _t(spark, sf_dir, "pages").agg(F.count("*").alias("n"), F.count(F.when(validators.is_url(F.col("url")), 1)).alias("n_valid"))


@_query(
    r"""WITH w AS (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents)
SELECT count(*) AS n, count(*) FILTER (regexp_matches(w, '^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$')) AS n_ip, count(*) FILTER (regexp_matches(w, '^[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$')) AS n_email FROM w"""
)
def pii_shapes(spark, sf_dir):
    """Words with the shape of personal data."""
    words = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    shape = pii.shapes(F.col("w"))
    return words.agg(F.count("*").alias("n"), F.count(F.when(shape["ip"], 1)).alias("n_ip"), F.count(F.when(shape["email"], 1)).alias("n_email"))


# structure


@_query(
    """WITH l AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS a, count(DISTINCT turn) AS b, count(DISTINCT (conv_id, turn)) AS ab FROM conversations)
SELECT 'conv_id,turn' AS columns, n AS n_rows, ab AS n_distinct FROM l WHERE ab = n AND a < n AND b < n UNION ALL SELECT 'conv_id', n, a FROM l WHERE a = n UNION ALL SELECT 'turn', n, b FROM l WHERE b = n"""
)
def key_candidates(spark, sf_dir):
    """Minimal keys of one and two columns."""
    rows = structure.detect_keys(_t(spark, sf_dir, "conversations"), 2, ["conv_id", "turn"])
    return _rows(spark, [(",".join(r["columns"]), r["n_rows"], r["n_distinct"]) for r in rows if r["kind"] == "key"], "columns string, n_rows long, n_distinct long")


_FD = [(x, y) for x in ("l_returnflag", "l_linestatus", "l_suppkey") for y in ("l_returnflag", "l_linestatus", "l_suppkey") if x != y]


@_query(
    " UNION ALL ".join(f"SELECT '{x}' AS determinant, '{y}' AS dependent, round(sum(m) / sum(k), 6) AS compliance, CAST(sum(k) AS BIGINT) AS n, CAST(sum(k) - sum(m) AS BIGINT) AS violations FROM (SELECT {x}, max(c) AS m, sum(c) AS k FROM (SELECT {x}, {y}, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1)" for x, y in _FD)
)
def functional_dependencies(spark, sf_dir):
    """Compliance of every column pair as a functional dependency."""
    out = structure.detect_dependencies(_t(spark, sf_dir, "lineitem"), 0.0, ["l_returnflag", "l_linestatus", "l_suppkey"], near_constant=1.1, near_key=1.1)
    return out.withColumn("compliance", _r(F.col("compliance")))


@_query(
    """WITH a AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS v, count(*) AS n FROM customer GROUP BY 1), j AS (SELECT a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.v = b.v)
SELECT 'o_custkey' AS "left", 'c_custkey' AS "right", count(*) FILTER (an IS NOT NULL AND bn IS NOT NULL) AS n_common, round(coalesce(sum(an) FILTER (bn IS NOT NULL), 0) / sum(an), 6) AS coverage_left,
 round(coalesce(sum(bn) FILTER (an IS NOT NULL), 0) / sum(bn), 6) AS coverage_right, CASE WHEN max(an) = 1 AND max(bn) = 1 THEN '1:1' WHEN max(an) = 1 THEN '1:m' WHEN max(bn) = 1 THEN 'm:1' ELSE 'm:m' END AS cardinality FROM j"""
)
def inclusion_relations(spark, sf_dir):
    """Coverage both ways and cardinality of a column pair."""
    out = structure.detect_relations(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")], 0.0)
    return out.withColumns({"coverage_left": _r(F.col("coverage_left")), "coverage_right": _r(F.col("coverage_right"))})


@_query(
    """SELECT 'l_discount' AS low, 'l_mark' AS high, count(*) AS n_evaluated, count(*) FILTER (l_discount > m) AS n_affected FROM (SELECT l_discount, CASE WHEN l_orderkey % 50 = 0 THEN l_discount - 0.01 ELSE l_discount + 0.02 END AS m FROM lineitem)"""
)
def column_order(spark, sf_dir):
    """Columns of which one is nearly always at most the other."""
    df = _t(spark, sf_dir, "lineitem").selectExpr("l_discount", "CASE WHEN l_orderkey % 50 = 0 THEN l_discount - 0.01 ELSE l_discount + 0.02 END AS l_mark")
    rows = structure.detect_order(df)
    return _rows(spark, [(r["low"], r["high"], r["n_evaluated"], r["n_affected"]) for r in rows], "low string, high string, n_evaluated long, n_affected long")


@_query("SELECT 'additive' AS kind, 'l_extendedprice,l_quantity,total' AS columns, count(*) AS n_evaluated, count(*) FILTER (l_orderkey % 100 = 0) AS n_affected FROM lineitem")
def arithmetic_relations(spark, sf_dir):
    """Additive identities between columns."""
    df = _t(spark, sf_dir, "lineitem").selectExpr("l_extendedprice", "l_quantity", "l_extendedprice + l_quantity + IF(l_orderkey % 100 = 0, 5, 0) AS total")
    rows = structure.detect_arithmetic(df)
    return _rows(spark, [(r["kind"], ",".join(r["columns"]), r["n_evaluated"], r["n_affected"]) for r in rows if r["kind"] == "additive"], "kind string, columns string, n_evaluated long, n_affected long")


@_query("SELECT CAST(left(ltrim(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '0'), 1) AS INT) AS digit, count(*) AS n FROM orders WHERE o_totalprice >= 1 GROUP BY 1")
def benford_digits(spark, sf_dir):
    """Leading digits of a column."""
    digit = structure.first_digit(F.col("o_totalprice"))
    return _t(spark, sf_dir, "orders").where("o_totalprice >= 1").groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))


@_query(
    """WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) * pow(10, o_orderkey % 4) AS x FROM orders), d AS (SELECT CAST(left(format('{:.15e}', x), 1) AS INTEGER) AS d FROM x WHERE x > 0), n AS (SELECT count(*) AS n FROM d), k AS (SELECT unnest(range(1, 10)) AS k),
c AS (SELECT k, n, n * log10(1 + 1.0 / k) AS e, (SELECT count(*) FROM d WHERE d.d = k.k) AS o FROM k, n), chi AS (SELECT sum((o - e) * (o - e) / e) AS chi2, any_value(n) AS n FROM c)
SELECT 'x' AS "column", n, round(chi2, 4) AS chi2, round(CASE WHEN chi2 < 1400 THEN exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6) ELSE 0 END, 6) AS p, CAST(NULL AS VARCHAR) AS reason FROM chi"""
)
def benford_test(spark, sf_dir):
    """Benford's law with its preconditions."""
    r = structure.benford(_t(spark, sf_dir, "orders").selectExpr("o_totalprice * pow(10, o_orderkey % 4) AS x"), "x")
    return _rows(spark, [(r["column"], r["n"], r["chi2"], r["p"], r["reason"])], "column string, n long, chi2 double, p double, reason string").withColumns({"chi2": _r(F.col("chi2"), 4), "p": _r(F.col("p"))})


@_query("SELECT 'v' AS \"column\", 'event_type' AS determinant, count(*) AS n_evaluated, count(*) FILTER (event_type <> 'click') AS n_affected FROM events WHERE event_type IS NOT NULL")
def structural_absence(spark, sf_dir):
    """Columns whose absence another column determines."""
    df = _t(spark, sf_dir, "events").where("event_type IS NOT NULL").selectExpr("event_type", "CASE WHEN event_type = 'click' THEN event_id END AS v")
    rows = structure.structural_absence(df)
    return _rows(spark, [(r["column"], r["determinant"], r["n_evaluated"], r["n_affected"]) for r in rows], "column string, determinant string, n_evaluated long, n_affected long")


@_query("SELECT 'quantity' AS signal, count(*) AS n_evaluated, count(*) FILTER (l_orderkey % 7 = 0) AS n_affected FROM lineitem WHERE l_quantity IS NOT NULL")
def redundant_signals(spark, sf_dir):
    """Rows in which declared redundant columns disagree."""
    df = _t(spark, sf_dir, "lineitem").selectExpr("l_quantity AS a", "l_quantity + IF(l_orderkey % 7 = 0, 2, 0.5) AS b")
    rows = structure.detect_discordances(df, [structure.RedundantSignal(("a", "b"), 1.0, name="quantity")])
    return _rows(spark, [(r["signal"], r["n_evaluated"], r["n_affected"]) for r in rows], "signal string, n_evaluated long, n_affected long")


@_query("SELECT 'l_tax' AS a, 'copy' AS b")
def duplicate_columns(spark, sf_dir):
    """Columns that are equal in every row."""
    df = _t(spark, sf_dir, "lineitem").selectExpr("l_tax", "l_discount", "l_tax AS copy")
    return _rows(spark, structure.duplicate_columns(df), "a string, b string")


# statistics


@_query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS value FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def associations_pearson(spark, sf_dir):
    """Pearson correlations of all pairs."""
    return stats.correlations(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "n", _r(F.col("value")).alias("value"))


@_query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(x, y), 6) AS value FROM r"""
)
def associations_spearman(spark, sf_dir):
    """Spearman's rank correlation."""
    return stats.correlations(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman").select("a", "b", "n", _r(F.col("value")).alias("value"))


@_query(
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL), e AS (SELECT *, sum(o) OVER () AS n, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS k FROM c)
SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, CAST(max(n) AS BIGINT) AS n, round(sqrt(greatest(0, sum(CAST(o AS DOUBLE) * o / (CAST(r AS DOUBLE) * k)) - 1) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)), 6) AS value FROM e"""
)
def associations_cramer(spark, sf_dir):
    """Cramér's V."""
    return stats.cramers_v(_t(spark, sf_dir, "lineitem"), [("l_returnflag", "l_linestatus")]).select("a", "b", "n", _r(F.col("value")).alias("value"))


@_query(
    """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT avg(l_quantity) AS mean FROM lineitem)
SELECT 'l_returnflag' AS a, 'l_quantity' AS b, CAST(sum(n) AS BIGINT) AS n, round(sum(n * (m - mean) ** 2) / (sum(n * (m - mean) ** 2) + sum(n * v)), 9) AS value FROM g, t"""
)
def associations_eta2(spark, sf_dir):
    """Eta squared of a number by a category."""
    return stats.eta_squared(_t(spark, sf_dir, "lineitem"), [("l_returnflag", "l_quantity")]).select("a", "b", "n", _r(F.col("value"), 9).alias("value"))


@_query("SELECT CAST(isodow(o_orderdate) AS INT) AS weekday, count(*) AS n FROM orders GROUP BY 1")
def weekdays(spark, sf_dir):
    """Rows per ISO weekday."""
    return stats.weekday_counts(_t(spark, sf_dir, "orders"), "o_orderdate")


@_query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT d - lag(d) OVER (ORDER BY d) AS step FROM d), c AS (SELECT step, count(*) AS k FROM s WHERE step IS NOT NULL GROUP BY 1),
m AS (SELECT (SELECT step FROM c ORDER BY k DESC, step LIMIT 1) AS f, (SELECT max(k) / sum(k) FROM c) AS contiguity), x AS (SELECT count(*) AS n, min(d) AS a, max(d) AS b FROM d)
SELECT n AS n_dates, a AS first_date, b AS last_date, CAST(f AS INT) AS frequency_days, round(contiguity, 6) AS contiguity, CAST((b - a) // f + 1 AS BIGINT) AS n_expected FROM m, x"""
)
def time_regularity(spark, sf_dir):
    """Frequency and regularity of a date column."""
    out = stats.time_regularity(_t(spark, sf_dir, "orders"), "o_orderdate")
    return out.select("n_dates", "first_date", "last_date", "frequency_days", _r(F.col("contiguity")).alias("contiguity"), "n_expected")


@_query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 5 = 0), g AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY)) AS DATE) AS d),
m AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM g), r AS (SELECT d, i - row_number() OVER (ORDER BY d) AS run FROM m WHERE d NOT IN (SELECT d FROM d)) SELECT min(d) AS gap_start, max(d) AS gap_end, count(*) AS n_days FROM r GROUP BY run"""
)
def time_gaps(spark, sf_dir):
    """Runs of missing dates."""
    return stats.time_gaps(_t(spark, sf_dir, "orders").where("o_orderkey % 5 = 0"), "o_orderdate")


def _drift_sql(c: str) -> str:
    half = lambda where: f"SELECT count({c}) AS n, count(*) AS all_n, count(DISTINCT {c}) AS d, min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM lineitem WHERE {where}"
    level = lambda d: f"CASE WHEN abs({d}) > 0.2 THEN 'error' WHEN abs({d}) > 0.05 THEN 'suspicious' END"
    width = "greatest(a.hi - a.lo, 1e-12)"
    rows = (
        ("missing_rate", "round(1 - a.n / a.all_n, 6)", "round(1 - b.n / b.all_n, 6)", "(1 - b.n / b.all_n) - (1 - a.n / a.all_n)"), ("distinct_rate", "round(a.d / a.n, 6)", "round(b.d / b.n, 6)", "b.d / b.n - a.d / a.n"),
        ("min", "a.lo", "b.lo", f"(a.lo - b.lo) / {width}"), ("max", "a.hi", "b.hi", f"(b.hi - a.hi) / {width}"),
    )
    both = f"FROM ({half('l_orderkey % 2 = 0')}) a, ({half('l_orderkey % 2 = 1 AND l_quantity < 25')}) b"
    return " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", '{n}' AS aspect, CAST({x} AS VARCHAR) AS before, CAST({y} AS VARCHAR) AS after, {level(d)} AS severity {both}) WHERE severity IS NOT NULL" for n, x, y, d in rows)


@_query(" UNION ALL ".join(_drift_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def compare_profiles(spark, sf_dir):
    """Drift between the profiles of two slices."""
    df = _t(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    from plumbline.operators.profile import Profile

    p = [Profile("x", {}, profile_columns(df.where(c), columns=names)).to_df(spark) for c in ("l_orderkey % 2 = 0", "l_orderkey % 2 = 1 AND l_quantity < 25")]
    return stats.compare_profiles(*p)


# metrics


def _measure(spark, sf_dir, name, entity, attributes=(), key=(), reference=None, tables=(), **properties) -> DataFrame:
    specific = M.specialize({**M.CORE_METRICS, **M.REFERENCE_METRICS}[name], **properties)
    bound = M.bind(specific, entity, attributes, key=key, reference=reference)
    return M.measure(bound, {t: _t(spark, sf_dir, t) for t in (entity, *tables)}, "m1")


def _summary(measures: DataFrame) -> DataFrame:
    return measures.groupBy("metric", F.coalesce("attribute", F.lit("")).alias("attribute")).agg(F.count("*").alias("n"), _r(F.sum("result"), 4).alias("total"))


def _summary_sql(metric: str, attribute: str, table: str, result: str, where: str = "true") -> str:
    return f"SELECT '{metric}' AS metric, '{attribute}' AS attribute, count(*) AS n, round(sum(CAST({result} AS DOUBLE)), 4) AS total FROM {table} WHERE {where}"


@_query(" UNION ALL ".join(_summary_sql("not_null", c, "events", f"({c} IS NOT NULL)::INT") for c in ("value", "props")))
def metric_not_null(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "not_null", "events", ["value", "props"], ["event_id"]))


@_query(_summary_sql("format", "c_name", "customer", "regexp_matches(c_name, '^Customer#[0-9]+$')::INT", "c_name IS NOT NULL"))
def metric_format(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "format", "customer", ["c_name"], ["c_custkey"], regex="^Customer#[0-9]+$"))


@_query(_summary_sql("allowed_values", "o_orderstatus", "orders", "(o_orderstatus IN ('F', 'O'))::INT", "o_orderstatus IS NOT NULL"))
def metric_allowed_values(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "allowed_values", "orders", ["o_orderstatus"], ["o_orderkey"], values=["F", "O"]))


@_query(_summary_sql("allowed_range", "l_quantity", "lineitem", "(l_quantity >= 10 AND l_quantity < 40)::INT", "l_quantity IS NOT NULL"))
def metric_allowed_range(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "allowed_range", "lineitem", ["l_quantity"], ["l_orderkey", "l_linenumber"], low=10, high=40, include_high=False))


@_query(_summary_sql("intra_entity_rule", "", "lineitem", "(l_extendedprice > l_quantity * 1000)::INT"))
def metric_intra_entity_rule(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "intra_entity_rule", "lineitem", (), ["l_orderkey", "l_linenumber"], rule="l_extendedprice > l_quantity * 1000"))


@_query("SELECT 'inter_entity_rule' AS metric, '' AS attribute, CAST(1 AS BIGINT) AS n, round(avg((l_orderkey IN (SELECT o_orderkey FROM orders))::INT), 4) AS total FROM lineitem WHERE l_orderkey IS NOT NULL")
def metric_inter_entity_rule(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "inter_entity_rule", "lineitem", ["l_orderkey"], other="orders", other_attributes=["o_orderkey"], tables=["orders"]))


@_query("SELECT 'standard_error' AS metric, 'l_quantity' AS attribute, CAST(1 AS BIGINT) AS n, round(stddev_samp(l_quantity), 4) AS total FROM lineitem")
def metric_standard_error(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "standard_error", "lineitem", ["l_quantity"]))


@_query(_summary_sql("scale", "l_quantity", "lineitem", "CASE WHEN l_quantity = 0 THEN 0 ELSE greatest(0, least(1, 1 - 0.5 / abs(l_quantity))) END", "l_quantity IS NOT NULL"))
def metric_scale(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "scale", "lineitem", ["l_quantity"], **M.measurement_scale(0.5)))


@_query("SELECT 'duplicate_attribute' AS metric, 'o_custkey' AS attribute, CAST(sum(k) AS BIGINT) AS n, round(CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS DOUBLE), 4) AS total FROM (SELECT count(*) AS k FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)")
def metric_duplicate_attribute(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "duplicate_attribute", "orders", ["o_custkey"], ["o_orderkey"]))


@_query("SELECT 'duplicate_attribute_set' AS metric, '' AS attribute, CAST(sum(k) AS BIGINT) AS n, round(CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS DOUBLE), 4) AS total FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_partkey, l_suppkey)")
def metric_duplicate_set(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "duplicate_attribute_set", "lineitem", ["l_partkey", "l_suppkey"]))


@_query("SELECT 'duplicate_entity' AS metric, '' AS attribute, count(*) AS n, CAST(0 AS DOUBLE) AS total FROM nation")
def metric_duplicate_entity(spark, sf_dir):
    return _summary(M.measure(M.bind(M.specialize(M.CORE_METRICS["duplicate_entity"], key=["n_nationkey"]), "nation"), {"nation": _t(spark, sf_dir, "nation")}, "m1"))


@_query(_summary_sql("outdated_by_format", "o_orderpriority", "orders", "(NOT regexp_matches(o_orderpriority, '^[1-3]'))::INT", "o_orderpriority IS NOT NULL"))
def metric_outdated_by_format(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "outdated_by_format", "orders", ["o_orderpriority"], regex="^[1-3]"))


@_query(_summary_sql("outdated_by_date", "o_orderdate", "orders", "greatest(0, epoch(TIMESTAMP '1999-01-01' - CAST(o_orderdate AS TIMESTAMP)) / 86400.0 - 30)"))
def metric_outdated_by_date(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "outdated_by_date", "orders", ["o_orderdate"], validity=M.validity("o_orderdate", accessed_at="1999-01-01", change_every_days=30)))


@_query(_summary_sql("outdated_by_changes", "o_orderdate", "orders", "floor(greatest(0, epoch(TIMESTAMP '1999-01-01' - CAST(o_orderdate AS TIMESTAMP)) / 86400.0) / 30)"))
def metric_outdated_by_changes(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "outdated_by_changes", "orders", ["o_orderdate"], validity=M.validity("o_orderdate", accessed_at="1999-01-01", change_every_days=30)))


@_query(_summary_sql("timely_by_date", "o_orderdate", "orders", "(o_orderdate <= TIMESTAMP '1996-01-01')::INT", "o_orderdate IS NOT NULL"))
def metric_timely_by_date(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "timely_by_date", "orders", ["o_orderdate"], limit="1996-01-01"))


@_query(_summary_sql("timely_by_interval", "o_orderdate", "orders", "(o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01')::INT", "o_orderdate IS NOT NULL"))
def metric_timely_by_interval(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "timely_by_interval", "orders", ["o_orderdate"], start="1995-01-01", end="1996-01-01"))


@_query(_summary_sql("timeliness_degree", "o_orderdate", "orders", "greatest(0, least(1, 1 - epoch(CAST(o_orderdate AS TIMESTAMP) - TIMESTAMP '1995-01-01') / epoch(TIMESTAMP '1997-01-01' - TIMESTAMP '1995-01-01')))", "o_orderdate IS NOT NULL"))
def metric_timeliness_degree(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "timeliness_degree", "orders", ["o_orderdate"], start="1995-01-01", end="1997-01-01"))


@_query(_summary_sql("entity_timely", "", "orders", "(o_orderdate <= TIMESTAMP '1996-01-01')::INT", "o_orderdate IS NOT NULL"))
def metric_entity_timely(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "entity_timely", "orders", (), ["o_orderkey"], validity=M.validity("o_orderdate", limit="1996-01-01")))


@_query(_summary_sql("weighted_density", "", "events", "0.5 * (value IS NOT NULL)::INT + 0.3 * (props IS NOT NULL)::INT + 0.2 * (event_type IS NOT NULL)::INT"))
def metric_weighted_density(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "weighted_density", "events", (), ["event_id"], weights={"value": 0.5, "props": 0.3, "event_type": 0.2}))


@_query("SELECT 'strong_correctness' AS metric, 'o_custkey' AS attribute, count(*) AS n, round(sum((o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))::INT)::DOUBLE, 4) AS total FROM orders WHERE o_custkey IS NOT NULL")
def metric_strong_correctness(spark, sf_dir):
    ref = M.reference_set(_t(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), ["c_custkey"])
    return _summary(_measure(spark, sf_dir, "strong_correctness", "orders", ["o_custkey"], ["o_orderkey"], ref))


@_query("SELECT 'weak_correctness' AS metric, 'name' AS attribute, count(*) AS n, round(sum((n_nationkey % 2 = 0)::INT)::DOUBLE, 4) AS total FROM nation")
def metric_weak_correctness(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    ref = M.reference_set(nation, ["n_nationkey"], ["n_name"])
    bent = nation.selectExpr("n_nationkey", "IF(n_nationkey % 2 = 0, n_name, concat(n_name, '?')) AS name")
    return _summary(M.measure(M.bind(M.REFERENCE_METRICS["weak_correctness"], "bent", ["n_nationkey", "name"], reference=ref), {"bent": bent}, "m1"))


@_query("SELECT 'coverage_ratio' AS metric, '' AS attribute, CAST(1 AS BIGINT) AS n, round(avg((c_custkey IN (SELECT o_custkey FROM orders))::INT), 4) AS total FROM customer")
def metric_coverage_ratio(spark, sf_dir):
    ref = M.reference_set(_t(spark, sf_dir, "customer"), ["c_custkey"], complete=True)
    return _summary(_measure(spark, sf_dir, "coverage_ratio", "orders", ["o_custkey"], (), ref))


@_query("SELECT 'contradictory_entity' AS metric, 'n_name' AS attribute, count(*) AS n, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM nation b WHERE b.n_name <> a.n_name AND jaro_winkler_similarity(a.n_name, b.n_name) >= 0.9)) AS DOUBLE) AS total FROM nation a WHERE n_name IS NOT NULL")
def metric_contradictory_entity(spark, sf_dir):
    return _summary(_measure(spark, sf_dir, "contradictory_entity", "nation", ["n_name"], ["n_nationkey"]))


def _order_measures(spark, sf_dir) -> DataFrame:
    orders = {"orders": _t(spark, sf_dir, "orders")}
    of = lambda name, attribute, **p: M.bind(M.specialize(M.CORE_METRICS[name], **p), "orders", [attribute] if attribute else (), key=["o_orderkey"])
    return M.measure(M.model(of("not_null", "o_custkey"), of("allowed_values", "o_orderstatus", values=["F", "O"]), of("timeliness_degree", "o_orderdate", start="1995-01-01", end="1997-01-01"), of("duplicate_attribute", "o_custkey")), orders, "m1")


_ORDER_SQL = """WITH m AS (SELECT 'not_null' AS metric, 'completeness' AS dimension, 'conformity' AS orientation, 'o_custkey' AS attribute, (o_custkey IS NOT NULL)::INT::DOUBLE AS v FROM orders
 UNION ALL SELECT 'allowed_values', 'consistency', 'conformity', 'o_orderstatus', (o_orderstatus IN ('F', 'O'))::INT FROM orders WHERE o_orderstatus IS NOT NULL
 UNION ALL SELECT 'timeliness_degree', 'freshness', 'conformity', 'o_orderdate', greatest(0, least(1, 1 - epoch(CAST(o_orderdate AS TIMESTAMP) - TIMESTAMP '1995-01-01') / epoch(TIMESTAMP '1997-01-01' - TIMESTAMP '1995-01-01'))) FROM orders WHERE o_orderdate IS NOT NULL
 UNION ALL SELECT 'duplicate_attribute', 'uniqueness', 'defect', 'o_custkey', (count(*) OVER (PARTITION BY o_custkey) > 1)::INT FROM orders WHERE o_custkey IS NOT NULL)
"""


@_query(_ORDER_SQL + "SELECT metric, attribute, round(avg((v = 1)::INT), 6) AS result, count(*) AS n_parts FROM m GROUP BY ALL")
def aggregate_ratio(spark, sf_dir):
    """Cells to columns by the share of ones."""
    return A.aggregate_measures(_order_measures(spark, sf_dir), "column", "ratio").select("metric", "attribute", _r(F.col("result")).alias("result"), "n_parts")


@_query(_ORDER_SQL + "SELECT metric, attribute, round(avg((v >= 0.5)::INT), 6) AS result, count(*) AS n_parts FROM m GROUP BY ALL")
def aggregate_threshold_ratio(spark, sf_dir):
    """Cells to columns by the share above a threshold."""
    return A.aggregate_measures(_order_measures(spark, sf_dir), "column", "threshold_ratio", 0.5).select("metric", "attribute", _r(F.col("result")).alias("result"), "n_parts")


@_query(_ORDER_SQL + "SELECT metric, attribute, round(avg(v), 6) AS result, count(*) AS n_parts FROM m GROUP BY ALL")
def aggregate_mean(spark, sf_dir):
    """Cells to columns by the mean."""
    return A.aggregate_measures(_order_measures(spark, sf_dir), "column", "mean").select("metric", "attribute", _r(F.col("result")).alias("result"), "n_parts")


@_query("SELECT 'not_null' AS metric, 'events' AS entity, round(0.6 * (SELECT avg((value IS NOT NULL)::INT) FROM events) + 0.4 * (SELECT avg((props IS NOT NULL)::INT) FROM events), 6) AS result")
def aggregate_weighted_mean(spark, sf_dir):
    """Cells to columns, then columns to the table by weights."""
    cells = _measure(spark, sf_dir, "not_null", "events", ["value", "props"])
    return A.aggregate_measures(A.aggregate_measures(cells, "column", "mean"), "table", "weighted_mean", weights={"value": 0.6, "props": 0.4}).select("metric", "entity", _r(F.col("result")).alias("result"))


@_query(_ORDER_SQL + "SELECT dimension, metric, attribute, CASE WHEN metric = 'timeliness_degree' THEN round(avg(v), 6) ELSE round(avg((v = 1)::INT), 6) END AS value, count(*) AS n FROM m GROUP BY dimension, metric, attribute")
def dashboard(spark, sf_dir):
    """The dashboard of a model's measures."""
    return A.dashboard(_order_measures(spark, sf_dir)).select("dimension", "metric", "attribute", _r(F.col("value")).alias("value"), "n")


_WEIGHTS = {"completeness": 0.4, "consistency": 0.3, "freshness": 0.2, "uniqueness": 0.1}


@_query(_ORDER_SQL + ", b AS (SELECT dimension, orientation, avg(v) AS v FROM m GROUP BY ALL) SELECT round(sum(CASE dimension WHEN 'completeness' THEN 0.4 WHEN 'consistency' THEN 0.3 WHEN 'freshness' THEN 0.2 ELSE 0.1 END * CASE WHEN orientation = 'defect' THEN 1 - v ELSE v END), 6) AS index FROM b")
def quality_index(spark, sf_dir):
    """The weighted quality index."""
    return A.quality_index(A.dashboard(_order_measures(spark, sf_dir)), _WEIGHTS).select(_r(F.col("index")).alias("index"))


@_query(_ORDER_SQL + "SELECT 'base' AS profile, 'complete' AS rule, CAST((avg((v = 1)::INT) >= 0.9)::INT AS DOUBLE) AS value, count(*) AS n FROM m WHERE metric = 'not_null' UNION ALL SELECT 'base', 'fresh', round(avg((v > 0.5)::INT), 6), count(*) FROM m WHERE metric = 'timeliness_degree'")
def evaluate_rules(spark, sf_dir):
    """Rules over measures."""
    profile = A.evaluation_profile("base", A.evaluation_rule("complete", "result = 1", ["not_null"], 0.9), A.evaluation_rule("fresh", lambda c: c > 0.5, ["timeliness_degree"]))
    return A.evaluate(_order_measures(spark, sf_dir), profile).rules.select("profile", "rule", _r(F.col("value")).alias("value"), "n")


@_query(_ORDER_SQL + " SELECT p AS profile, round(avg((v > t)::INT), 6) AS value FROM m, (VALUES ('initial', 0.5), ('intermediate', 0.7), ('advanced', 0.9)) x(p, t) WHERE metric = 'timeliness_degree' GROUP BY p")
def maturity(spark, sf_dir):
    """Maturity levels."""
    measures = _order_measures(spark, sf_dir)
    parts = [A.evaluate(measures, p).profile.select("profile", _r(F.col("value")).alias("value")) for p in A.maturity_profiles(["timeliness_degree"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("SELECT 'p' AS profile, 'm2' AS measurement_id, round(a, 6) AS before, round(b, 6) AS after, CASE WHEN b - a < -0.05 THEN 'worse' WHEN b - a > 0.05 THEN 'better' ELSE 'stable' END AS state FROM (SELECT avg((l_quantity > 10)::INT) AS a, avg((l_quantity > 20)::INT) AS b FROM lineitem)")
def history_drift(spark, sf_dir):
    """Changes between consecutive evaluations of a history."""
    df = {"lineitem": _t(spark, sf_dir, "lineitem")}
    runs = []
    for mid, low in (("m1", 10), ("m2", 20)):
        bound = M.bind(M.specialize(M.CORE_METRICS["allowed_range"], low=low, include_low=False), "lineitem", ["l_quantity"])
        runs.append((mid, f"2024-0{mid[1]}-01", A.evaluate(M.measure(bound, df, mid), A.evaluation_profile("p", A.evaluation_rule("r", "result = 1")))))
    drift = A.detect_quality_drift(A.append_history(A.quality_history(runs[0]), A.quality_history(*runs)))
    return drift.where("before IS NOT NULL").select("profile", "measurement_id", _r(F.col("before")).alias("before"), _r(F.col("after")).alias("after"), "state")


# fuzzy duplicates and cleaning


@_query("WITH v AS (SELECT DISTINCT lower(c_name) AS v, left(lower(c_name), 17) AS k FROM customer) SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.k = b.k AND a.v < b.v WHERE levenshtein(a.v, b.v) <= 1")
def near_duplicates_blocked(spark, sf_dir):
    """Pairs of near values within blocks."""
    v = _t(spark, sf_dir, "customer").select(F.lower("c_name").alias("v"))
    return fuzzy.near_pairs(v, "v", "lv", 1, F.substring("v", 1, 17)).select("a", "b")


@_query()
def near_duplicates_lsh(spark, sf_dir):
    """Near record texts by MinHash LSH."""
    return fuzzy.detect_near_duplicates(_t(spark, sf_dir, "part"), ["p_name"], strategy="lsh")


@_query(
    """WITH f AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 89 = 0 THEN o_orderpriority || 'X' ELSE o_orderpriority END AS v FROM orders), c AS (SELECT v, lower(v) AS l, count(*) AS n FROM f GROUP BY v),
m AS (SELECT a.v AS value, a.n, b.v AS hub, b.n AS hub_n, round(1 - jaro_winkler_similarity(a.l, b.l), 6) AS distance FROM c a JOIN c b ON a.v <> b.v AND b.n > a.n AND jaro_winkler_similarity(a.l, b.l) >= 0.9 AND regexp_extract_all(a.v, '[0-9]+') = regexp_extract_all(b.v, '[0-9]+'))
SELECT value, n, hub, hub_n, distance FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY hub_n DESC, distance, hub DESC) AS r FROM m) WHERE r = 1"""
)
def vocabulary_variants(spark, sf_dir):
    """Variants of more frequent values in a vocabulary."""
    df = _t(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 97 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 89 = 0 THEN concat(o_orderpriority, 'X') ELSE o_orderpriority END AS v")
    return fuzzy.vocabulary_variants(df, "v").withColumn("distance", _r(F.col("distance")))


@_query("SELECT l_orderkey, l_linenumber, round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), l_extendedprice)), 4) AS price FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)")
def clean_winsorize(spark, sf_dir):
    """Outliers brought to the fences."""
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    plan = clean.CleaningPlan([clean.Action("winsorize", "price", 520, chosen=True)])
    return clean.apply_cleaning(plan, df).data.withColumn("price", _r(F.col("price"), 4))


@_query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN event_type ELSE event_type END AS v FROM events")
def clean_text(spark, sf_dir):
    """Sentinels to null, then spaces trimmed."""
    df = _t(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 11 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN concat('  ', event_type, ' ') ELSE event_type END AS v")
    plan = clean.CleaningPlan([clean.Action("null_text_sentinels", "v", 100, chosen=True), clean.Action("trim", "v", 200, chosen=True)])
    return clean.apply_cleaning(plan, df).data


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def clean_keep_first(spark, sf_dir):
    """The most complete row of each key, ties to the smallest."""
    df = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    plan = clean.CleaningPlan([clean.Action("keep_most_complete", None, 36, chosen=True, destructive=True, options={"key": ["o_custkey"]})])
    return clean.apply_cleaning(plan, df, allow_removal=True).data


@_query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def clean_impute_dependency(spark, sf_dir):
    """Nulls filled by a functional dependency."""
    df = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "c_nationkey", "n_name AS full")
    # one customer of each nation is told its name, all others lose it
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) <= 2
    holes = df.withColumn("n_name", F.when(first, F.col("full"))).drop("full")
    return clean.impute_dependency(holes, "c_nationkey", "n_name", 1)


@_query()
def profile_findings(spark, sf_dir):
    """The findings of a whole profile."""
    p = findings.profile(_t(spark, sf_dir, "orders"), "orders", deep_text=False)
    return _rows(spark, [(f["column"], f["finding"], f["severity"], f["n_evaluated"], f["n_affected"]) for f in p.findings], "column string, finding string, severity string, n_evaluated long, n_affected long")


# vocabularies, guards and evidence


_FORMS_SQL = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || 'S' WHEN o_orderkey % 97 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS v FROM orders"
_NEAR_SQL = f"f AS ({_FORMS_SQL}), c AS (SELECT v, count(*) AS n FROM f GROUP BY v), p AS (SELECT a.v AS a, b.v AS b, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.v < b.v AND levenshtein(a.v, b.v) <= 1)"


def _forms(spark, sf_dir):
    return _t(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderpriority, 'S') WHEN o_orderkey % 97 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS v")


@_query(f"WITH {_NEAR_SQL} SELECT a, b, n_a, n_b FROM p WHERE greatest(n_a, n_b) <= 3 * least(n_a, n_b)")
def vocabulary_equifrequent(spark, sf_dir):
    """Near forms of a vocabulary of which neither is much more frequent."""
    return vocabulary.equifrequent_variants(_forms(spark, sf_dir), "v", "lv", 1, 3.0).select("a", "b", "n_a", "n_b")


@_query(
    f"""WITH RECURSIVE {_NEAR_SQL}, e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r AS (SELECT x AS value, x AS "group" FROM e UNION SELECT r.value, e.y FROM r JOIN e ON r."group" = e.x),
m AS (SELECT value, min("group") AS "group" FROM r GROUP BY value) SELECT m.value, c.n, m."group", count(*) OVER (PARTITION BY m."group") AS size FROM m JOIN c ON m.value = c.v"""
)
def vocabulary_groups(spark, sf_dir):
    """Values of a vocabulary that near pairs connect."""
    return vocabulary.vocabulary_components(_forms(spark, sf_dir), "v", "lv", 1)


@_query(
    """WITH v AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN left(n_name, length(n_name) - 1) WHEN s_suppkey % 7 = 0 THEN n_name || 'XX' ELSE n_name END AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT value, count(*) AS n FROM v WHERE value NOT IN (SELECT n_name FROM nation) GROUP BY value), d AS (SELECT value, n, n_name AS reference, levenshtein(value, n_name) AS distance FROM c, nation),
m AS (SELECT *, min(distance) OVER (PARTITION BY value) AS least FROM d WHERE distance <= 2) SELECT value, n, reference, CAST(distance AS DOUBLE) AS distance FROM m WHERE distance = least"""
)
def reference_proximity(spark, sf_dir):
    """The nearest reference values of values that are in none."""
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    v = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("CASE WHEN s_suppkey % 4 = 0 THEN left(n_name, length(n_name) - 1) WHEN s_suppkey % 7 = 0 THEN concat(n_name, 'XX') ELSE n_name END AS value")
    return vocabulary.nearest_references(v, "value", n, "n_name").withColumn("distance", F.col("distance").cast("double"))


@_query("WITH v AS (SELECT DISTINCT lower(c_name) AS v FROM customer WHERE c_custkey <= 400), p AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.v < b.v AND levenshtein(a.v, b.v) <= 1) SELECT count(*) AS n_pairs, count(*) FILTER (left(a, 17) <> left(b, 17)) AS n_lost, round(count(*) FILTER (left(a, 17) <> left(b, 17)) / count(*), 6) AS loss FROM p")
def blocking_loss(spark, sf_dir):
    """Near pairs that a block would lose."""
    df = _t(spark, sf_dir, "customer").where("c_custkey <= 400").select(F.lower("c_name").alias("v"))
    return vocabulary.blocking_loss(df, "v", F.substring("value", 1, 17)).withColumn("loss", _r(F.col("loss")))


@_query(
    """WITH p AS (SELECT p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x' WHEN 2 THEN p_name || 's' ELSE 'zq ' || array_to_string(string_split(p_name, ' ')[2:], ' ') END AS b FROM part),
t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p), d AS (SELECT a, b, x, y, list_filter(list_zip(x, y), lambda z: z[1] <> z[2]) AS df FROM t),
w AS (SELECT *, list_filter(df, lambda z: (length(z[1]) >= 2 AND length(z[2]) >= 2 AND (left(z[1], 2) = left(z[2], 2) OR right(z[1], 2) = right(z[2], 2))) OR contains(z[1], z[2]) OR contains(z[2], z[1])) AS ins FROM d)
SELECT CASE WHEN len(x) <> len(y) THEN 'mixed' WHEN len(x) = 1 THEN 'single_token' WHEN len(df) = 0 THEN 'none' WHEN len(ins) = len(df) THEN 'within_word' WHEN len(ins) = 0 THEN 'whole_token' ELSE 'mixed' END AS difference, count(*) AS n FROM w GROUP BY 1"""
)
def difference_classes(spark, sf_dir):
    """How pairs of texts differ."""
    b = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' x') WHEN 2 THEN concat(p_name, 's') ELSE concat('zq ', array_join(slice(split(p_name, ' '), 2, 100), ' ')) END")
    return _t(spark, sf_dir, "part").select(vocabulary.difference_class(F.col("p_name"), b).alias("difference")).groupBy("difference").agg(F.count("*").alias("n"))


@_query("SELECT 'big' AS \"column\", CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(min(9007199254740993 + event_id) AS VARCHAR) AS min_exact, CAST(max(9007199254740993 + event_id) AS VARCHAR) AS max_exact, 'integer_beyond_double' AS reason FROM events")
def impossible_values(spark, sf_dir):
    """Figures that can't be are not published, with the reason."""
    rows = profile_columns(_t(spark, sf_dir, "events").selectExpr("9007199254740993L + event_id AS big"), mode="safe")
    out, why = evidence.guard_impossible(rows[0])
    return _rows(spark, [(out["column"], out["min"], out["max"], out["min_exact"], out["max_exact"], why[0]["reason"])], "column string, min double, max double, min_exact string, max_exact string, reason string")


@_query("SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS n_applicable, count(*) FILTER (o_orderkey % 5 = 0) AS n_not_applicable, 0 AS n_missing FROM orders")
def optional_column(spark, sf_dir):
    """An optional column's universe is its present cells."""
    df = _t(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v")
    r = profile_columns(df, mode="counts", optional=["v"])[0]
    return _rows(spark, [(r["n"], r["n_applicable"], r["n_not_applicable"], r["n_missing"])], "n long, n_applicable long, n_not_applicable long, n_missing long")


@_query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '\\t' || '<U+200B>' WHEN 1 THEN '<U+FEFF>' || event_type WHEN 2 THEN event_type || '<U+0007>\\n' ELSE event_type END AS shown FROM events")
def visible_evidence(spark, sf_dir):
    """Invisible characters of evidence written out."""
    v = F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit("\t​"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("﻿"), "event_type")).when(F.col("event_id") % 5 == 2, F.concat("event_type", F.lit("\x07\n"))).otherwise(F.col("event_type"))
    return _t(spark, sf_dir, "events").select("event_id", evidence.visible(v).alias("shown"))


@_query("SELECT 'o_orderdate' AS \"column\", count(d) AS n, count(*) FILTER (d < DATE '1900-01-01') AS n_before, count(*) FILTER (d > DATE '1995-06-30') AS n_after, 'error' AS severity FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN CAST(o_orderdate - INTERVAL 100 YEAR AS DATE) ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)")
def birth_dates(spark, sf_dir):
    """Birth dates out of range, counted without telling them."""
    import datetime

    df = _t(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 50 = 0 THEN CAST(o_orderdate AS DATE) - INTERVAL 100 YEAR ELSE CAST(o_orderdate AS DATE) END AS o_orderdate")
    return evidence.birth_date_range(df, "o_orderdate", datetime.date(1995, 6, 30))


@_query("SELECT 'v' AS \"column\", 'rule_silences_absence' AS finding, count(*) AS n_rows, count(*) FILTER (o_orderkey % 7 <> 0 OR o_orderstatus <> 'F') AS n_absent, count(*) FILTER (o_orderstatus = 'F') AS n_applicable, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 7 <> 0) AS n_absent_applicable FROM orders")
def silenced_absence(spark, sf_dir):
    """Columns that a declared rule keeps from counting as incomplete."""
    df = _t(spark, sf_dir, "orders").selectExpr("o_orderstatus", "CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'F' THEN 1 END AS v", "o_totalprice AS full")
    found = evidence.silenced_absence(df, {"v": "o_orderstatus = 'F'", "full": "o_orderstatus = 'F'"})
    return _rows(spark, [(r["column"], r["finding"], r["n_rows"], r["n_absent"], r["n_applicable"], r["n_absent_applicable"]) for r in found], "column string, finding string, n_rows long, n_absent long, n_applicable long, n_absent_applicable long")


@_query(
    """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS x, (l_quantity >= 31) <> (l_orderkey % 1000 = 0) AS gone FROM lineitem), c AS (SELECT x, count(*) AS n, count(*) FILTER (gone) AS g FROM r GROUP BY x), t AS (SELECT sum(n) AS n, sum(g) AS g FROM c),
k AS (SELECT a.x AS cut, sum(b.n) FILTER (b.x < a.x) AS un, sum(b.g) FILTER (b.x < a.x) AS ug FROM c a, c b GROUP BY a.x), s AS (SELECT cut, CAST(t.g - coalesce(ug, 0) + coalesce(un, 0) - coalesce(ug, 0) AS BIGINT) AS n_right, CAST(t.n AS BIGINT) AS n, coalesce(un, 0) AS un FROM k, t)
SELECT '>=' AS sense, cut, n, n_right, round(n_right / n, 6) AS compliance FROM s WHERE least(un, n - un) >= 0.05 * n ORDER BY n_right DESC, cut LIMIT 1"""
)
def absence_by_threshold(spark, sf_dir):
    """The cut of a number from which on another column is absent."""
    df = _t(spark, sf_dir, "lineitem").selectExpr("l_quantity", "CASE WHEN NOT ((l_quantity >= 31) <> (l_orderkey % 1000 = 0)) THEN 1 END AS v")
    r = evidence.absence_threshold(df, "v", "l_quantity")
    return _rows(spark, [(r["sense"], r["cut"], r["n"], r["n_right"], r["compliance"])], "sense string, cut double, n long, n_right long, compliance double").withColumn("compliance", _r(F.col("compliance")))


@_query("SELECT o_orderkey, CAST(running AS BIGINT) AS running FROM (SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey) AS running FROM orders) WHERE running <= 500000")
def work_within_budget(spark, sf_dir):
    """Rows whose running cost stays within a budget."""
    df = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return evidence.within_budget(df, "o_orderkey", "o_custkey", 500_000).select("o_orderkey", F.col("running").cast("long").alias("running"))


@_query(
    """WITH v AS (SELECT c_custkey % 2 AS h, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 THEN 'a+-9+' WHEN c_custkey % 10 = 0 THEN '9+' ELSE 'a+' END AS pattern FROM customer), c AS (SELECT h, pattern, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT h, pattern, n / sum(n) OVER (PARTITION BY h) AS share FROM c), j AS (SELECT coalesce(a.pattern, b.pattern) AS pattern, a.share AS before, b.share AS after FROM (SELECT * FROM s WHERE h = 0) a FULL JOIN (SELECT * FROM s WHERE h = 1) b ON a.pattern = b.pattern)
SELECT pattern, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' ELSE 'changed' END AS state, CASE WHEN abs(coalesce(after, 0) - coalesce(before, 0)) > 0.2 THEN 'error' ELSE 'suspicious' END AS severity
FROM j WHERE before IS NULL OR after IS NULL OR abs(after - before) > 0.05"""
)
def pattern_drift(spark, sf_dir):
    """Shapes of a column that are new, gone or of another share in a later table."""
    c = F.col("c_custkey")
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.when((c % 2 == 1) & (c % 3 == 0), "x-7").when(c % 10 == 0, "5").otherwise("q").alias("v"))
    out = evidence.compare_patterns(*[findings.discover_patterns(df.where(f"c_custkey % 2 = {h}"), "v") for h in (0, 1)])
    return out.select("pattern", _r(F.col("before")).alias("before"), _r(F.col("after")).alias("after"), "state", "severity")


@_query(
    """WITH a AS (SELECT n_name AS "column", n_nationkey AS k FROM nation), x AS (SELECT "column", 'f' || k % 3 AS finding, k AS n_affected FROM a WHERE k % 4 <> 0), y AS (SELECT "column", 'f' || k % 3 AS finding, CASE WHEN k % 5 = 0 THEN k + 1 ELSE k END AS n_affected FROM a WHERE k % 6 <> 0)
SELECT coalesce(x."column", y."column") AS "column", coalesce(x.finding, y.finding) AS finding, x.n_affected AS before, y.n_affected AS after, CASE WHEN x."column" IS NULL THEN 'new' WHEN y."column" IS NULL THEN 'gone' ELSE 'changed' END AS state
FROM x FULL JOIN y ON x."column" = y."column" AND x.finding = y.finding WHERE x."column" IS NULL OR y."column" IS NULL OR x.n_affected <> y.n_affected"""
)
def finding_drift(spark, sf_dir):
    """Findings that are new, gone or changed between two profiles."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("column"), F.concat(F.lit("f"), (F.col("n_nationkey") % 3).cast("string")).alias("finding"), F.col("n_nationkey").alias("k"))
    a = n.where("k % 4 <> 0").withColumn("n_affected", F.col("k"))
    return evidence.compare_findings(a, n.where("k % 6 <> 0").withColumn("n_affected", F.expr("CASE WHEN k % 5 = 0 THEN k + 1 ELSE k END")))


# wide tables: 40 columns derived from lineitem's


def _wide(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(*[(F.col(c) + i).alias(f"{c}_{i}") for i in range(5) for c in _NUMBERS])


@_query(" UNION ALL ".join(f"SELECT '{c}_{i}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_missing FROM lineitem" for i in range(5) for c in _NUMBERS))
def profile_wide_counts(spark, sf_dir):
    """The counts-only mode on 40 columns."""
    return _rows(spark, [(r["column"], r["n"], r["n_missing"]) for r in profile_columns(_wide(spark, sf_dir), mode="counts")], "column string, n long, n_missing long")


@_query(" UNION ALL ".join(f"SELECT '{c}_{i}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_missing, CAST(min({c} + {i}) AS DOUBLE) AS min, CAST(max({c} + {i}) AS DOUBLE) AS max, round(avg(CAST({c} + {i} AS DOUBLE)), 3) AS mean, round(stddev_samp(CAST({c} + {i} AS DOUBLE)), 3) AS stddev, count(*) FILTER ({c} + {i} = 0) AS n_zeros FROM lineitem" for i in range(5) for c in _NUMBERS))
def profile_wide_safe(spark, sf_dir):
    """The mode that neither sorts nor groups, on 40 columns."""
    rows = profile_columns(_wide(spark, sf_dir), mode="safe")
    out = _rows(spark, [tuple(r[k] for k in ("column", "n", "n_missing", "min", "max", "mean", "stddev", "n_zeros")) for r in rows], "column string, n long, n_missing long, min double, max double, mean double, stddev double, n_zeros long")
    return out.withColumns({c: _r(F.col(c), 3) for c in ("mean", "stddev")})
