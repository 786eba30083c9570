"""Cross-site boilerplate lines: distinct-site spread per line hash, from mergeable sketches.

One aggregation per line hash keeps a HyperLogLog sketch of the sites and the first place of the line; sketches
merge map-side, so a line that stands on a million sites costs one sketch per task. Lines whose estimate lies
within ``margin`` of the limit get an exact distinct count; the rest are decided by the estimate. A line on at
least ``min_sites`` sites is boilerplate and goes, except from the first document that has it (smallest doc_id,
then first line), so text that only exists as copies is not lost.

Defined results: lines are compared as they are but for spaces around them; blank lines are never boilerplate.
A null site counts for nothing, a null text stays null, an empty text stays empty. A row with a null doc_id
comes after all others in the order, and loses boilerplate as they do. Repeated rows (same id and text) are one
place: all keep a line or none does. Other columns, whatever their names, are ignored by ``spread_lines`` and kept as
they are by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_if_small, fresh, materialize, row_key

MIN_SITES, MARGIN, LG_K = 8, 0.1, 12


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row per non-blank line: row key, id, site, position, 128-bit line hash."""
    trimmed = F.trim("_line")
    return (
        docs.select(row_key().alias("_key"), F.col("doc_id").alias("_id"), F.col(site).alias("_site"), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
        .where(F.length(trimmed) > 0)
        .select("_key", "_id", "_site", "_pos", F.xxhash64(trimmed).alias("_h1"), F.xxhash64(F.lit(7), trimmed).alias("_h2"))
    )


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K, site: str = "source") -> DataFrame:
    """Boilerplate lines: ``_h1``, ``_h2`` (the line's hash) and the ``_first`` place (order of id, key, position), materialized."""
    lines = _lines(docs, site)
    place = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("_pos").alias("pos"))
    counted = materialize(
        lines.groupBy("_h1", "_h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce(F.col("_site").cast("string"), F.lit("\0none")), F.lit(lg_k))).alias("_sites"), F.max(F.col("_site").isNull()).alias("_none"), F.min(place).alias("_first"))
        .withColumn("_sites", F.col("_sites") - F.col("_none").cast("int"))
        .where(F.col("_sites") >= min_sites * (1 - margin) - 1)
        .select("_h1", "_h2", "_sites", "_first"),
        "spread",
    )
    near = counted.where(F.col("_sites") <= min_sites * (1 + margin) + 1).select("_h1", "_h2")
    exact = (
        lines.join(broadcast_if_small(near, 24), ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2")
        .agg(F.countDistinct("_site").alias("_exact"))
    )
    return materialize(
        counted.join(exact, ["_h1", "_h2"], "left").where(F.coalesce("_exact", "_sites") >= min_sites).select("_h1", "_h2", "_first"), "boilerplate"
    )


def _removals(docs: DataFrame, boilerplate: DataFrame, site: str) -> DataFrame:
    """Per row key (and id) the positions of the lines that go, materialized."""
    hit = _lines(docs, site).join(broadcast_if_small(boilerplate, 80), ["_h1", "_h2"])
    # repeated rows give equal positions: the set has each once
    goes = ~((F.col("_key") == F.col("_first.key")) & F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_pos") == F.col("_first.pos")))
    return materialize(hit.where(goes).groupBy("_key").agg(F.collect_set("_pos").alias("_gone")), "removals")


def _clean(gone: Column) -> Column:
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def _with_removals(docs: DataFrame, removals: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the positions that go and the cleaned text, and the names of these two columns."""
    key, gone, row, text = fresh(docs.columns, "_key", "_gone", "_row", "_text")
    named = removals.select(F.col("_key").alias(key), F.col("_gone").alias(gone))
    # a removal's row holds its key and four bytes for each position
    side = broadcast_if_small(named, F.lit(64) + F.size(gone) * 4)
    joined = docs.withColumn(row, row_key()).join(side, F.col(row) == F.col(key), "left")
    return joined.withColumn(text, _clean(F.col(gone))), gone, text


def drop_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K, site: str = "source", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``drop_emptied`` without the rows that have no other text left."""
    out, gone, text = _with_removals(docs, _removals(docs, spread_lines(docs, min_sites, margin, lg_k, site), site))
    if drop_emptied:
        out = out.where(F.col(gone).isNull() | (F.length(F.trim(text)) > 0))
    return out.select(*[F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K, site: str = "source") -> DataFrame:
    """Every document's ``doc_id``, ``n_removed`` lines and cleaned ``text``."""
    out, gone, text = _with_removals(docs.select("doc_id", "text"), _removals(docs, spread_lines(docs, min_sites, margin, lg_k, site), site))
    return out.select("doc_id", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.col(text).alias("text"))


#: The same result in SQL: exact distinct sites per line, all but the first place of a boilerplate line removed.
LINE_DEDUP_SQL = f"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), spread AS (
  SELECT trim(line, ' ') AS line, min(struct_pack(d := doc_id, p := pos)) AS first FROM line WHERE length(trim(line, ' ')) > 0
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT doc_id, pos FROM line JOIN spread ON trim(line.line, ' ') = spread.line WHERE NOT (doc_id = first.d AND pos = first.p)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
