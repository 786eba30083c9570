"""Temporal URL filter: dated list entries become validity intervals, captures are judged as of their fetch time.

A list is a history of dated entries (``kind`` domain or prefix, ``value``, ``action`` add or remove, ``category``,
``listed_at``). Per kind, value and category an entry holds from its date until the next one of the same key, so
intervals of a key never overlap and each (capture, key) meets at most one. A capture is looked up by equality
under each parent domain of its host and each leading part of its path, then by time: no range join, no scan of
the list. Of several entries in force the most specific (longest) decides what is reported.

Defined results: null URLs, URLs without a host and null fetch times are never blocked. Entries with a null value,
date or action are ignored. At equal dates of one key a removal wins; repeated entries count once. Repeated
captures are judged each, alike. An empty list blocks nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_if_small, materialize

#: A list history for the registered query: kind, value, action, category, date.
HISTORY = [
    ("domain", "casino-win.example.com", "add", "gambling", "2024-01-15"),
    ("domain", "casino-win.example.com", "remove", "gambling", "2024-06-01"),
    ("domain", "casino-win.example.com", "add", "gambling", "2024-09-10"),
    ("domain", "free-bets.example.com", "add", "gambling", "2024-03-01"),
    ("domain", "cheap-pills.example.com", "add", "pharma", "2023-11-20"),
    ("domain", "cheap-pills.example.com", "add", "pharma", "2024-05-05"),
    ("domain", "cheap-pills.example.com", "remove", "pharma", "2024-05-05"),
    ("domain", "cheap-pills.example.com", "add", "spam", "2024-08-08"),
    ("domain", "ads-track.example.com", "add", "tracking", "2024-02-29"),
    ("domain", "ads-track.example.com", "remove", "tracking", "2024-12-01"),
    ("prefix", "tiontion.example.net/en", "add", "mirror", "2024-04-01"),
    ("prefix", "tiontion.example.net/en", "remove", "mirror", "2024-10-01"),
    ("domain", "therst.example.net", "add", "takedown", "2024-07-01"),
    ("domain", "example.invalid", "add", "test", "2020-01-01"),
]


def history(spark: SparkSession) -> DataFrame:
    """``HISTORY`` as a table."""
    rows = spark.createDataFrame(HISTORY, "kind string, value string, action string, category string, listed_at string")
    return rows.withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))


def intervals(entries: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``category``, ``valid_from`` and ``valid_to`` (null: still in force) of each entry in force."""
    clean = entries.where("value IS NOT NULL AND listed_at IS NOT NULL AND action IN ('add', 'remove')")
    clean = clean.groupBy("kind", F.lower("value").alias("value"), "category", "listed_at").agg(F.max("action").alias("action"))
    of_key = Window.partitionBy("kind", "value", "category").orderBy("listed_at")
    return (
        clean.withColumn("valid_to", F.lead("listed_at").over(of_key))
        .where("action = 'add'")
        .select("kind", "value", "category", F.col("listed_at").alias("valid_from"), "valid_to")
    )


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case without user and port; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def lookup_keys(url: Column) -> Column:
    """All (kind, value) keys under which a list may hold the URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_extract(F.lower(url), r"://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    one = F.lit(1)
    domains = F.transform(F.sequence(one, F.greatest(F.size(labels) - 1, one)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(one, F.greatest(F.size(parts), one)), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, one, k), "/")).alias("value"))))
    return F.when(host != "", F.concat(domains, F.coalesce(prefixes, F.array().cast("array<struct<kind:string,value:string>>"))))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (``page_id``, ``url``, ``fetched_at``) with ``host``, ``blocked``, and the deciding entry's ``kind``, ``value``, ``category`` and ``valid_from``."""
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in ("page_id", "url", "fetched_at")])
    both = F.struct(*[F.xxhash64(F.lit(k), nulls, "page_id", "url", "fetched_at").alias(k) for k in ("a", "b")])
    rows = captures.select("page_id", "url", "fetched_at", both.alias("_row"))
    listed = materialize(intervals(entries), "intervals").withColumnsRenamed({"kind": "_kind", "value": "_value"})
    keys = rows.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("_row", "fetched_at", F.explode(lookup_keys(F.col("url"))).alias("k"))
    in_force = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keys.join(broadcast_if_small(listed, F.lit(64) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("_kind", "_value", "category"))), (F.col("k.kind") == F.col("_kind")) & (F.col("k.value") == F.col("_value")) & in_force)
    best = F.max(F.struct(F.length("k.value").alias("n"), F.col("k.kind").alias("kind"), F.col("k.value").alias("value"), "category", "valid_from"))
    verdicts = materialize(hits.groupBy("_row").agg(best.alias("b")), "verdicts").withColumnRenamed("_row", "_hit")
    joined = rows.join(broadcast_if_small(verdicts, F.lit(96) + sum(F.coalesce(F.octet_length(F.col("b")[c]), F.lit(0)) for c in ("kind", "value", "category"))), F.col("_row") == F.col("_hit"), "left")
    return joined.select(
        "page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.col("b").isNotNull().alias("blocked"), F.col("b.kind").alias("kind"), F.col("b.value").alias("value"), F.col("b.category").alias("category"), F.col("b.valid_from").alias("valid_from")
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` as captures; the table has no fetch time, so a day of 2024 follows from the id."""
    day = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 366 as int))")
    return pages.select("page_id", "url", day.alias("fetched_at"))


URL_FILTER_SQL = f"""
WITH entry(kind, value, action, category, listed_at) AS (VALUES {", ".join(str(x) for x in HISTORY)}),
once AS (SELECT kind, value, category, CAST(listed_at AS TIMESTAMP) AS listed_at, max(action) AS action FROM entry GROUP BY ALL),
spans AS (SELECT *, lead(listed_at) OVER (PARTITION BY kind, value, category ORDER BY listed_at) AS valid_to FROM once),
capture AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched_at,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    list_filter(string_split(regexp_extract(lower(url), '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages
), k AS (
  SELECT page_id, url, fetched_at, 'domain' AS kind, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS value FROM capture
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', unnest(list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/'))) FROM capture
), hit AS (
  SELECT page_id, url, k.kind, k.value, category, listed_at,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(k.value) DESC, k.kind DESC, k.value DESC, category DESC, listed_at DESC) AS r
  FROM k JOIN spans s ON k.kind = s.kind AND k.value = s.value AND s.action = 'add' AND fetched_at >= listed_at AND (valid_to IS NULL OR fetched_at < valid_to)
)
SELECT c.page_id, c.url, c.fetched_at, c.host, h.value IS NOT NULL AS blocked, h.kind, h.value, h.category, h.listed_at AS valid_from
FROM capture c LEFT JOIN hit h ON c.page_id = h.page_id AND c.url = h.url AND h.r = 1
"""
