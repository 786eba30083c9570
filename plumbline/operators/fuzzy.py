"""Fuzzy duplicates of records and vocabularies: exact blocked comparison, MinHash LSH on q-grams, stars of variants.

Texts are normalized and compared as distinct values with their rows' counts, so equal records never meet in pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.distances import distance
from plumbline.functions.normalize import Normalization, normalize
from plumbline.functions.text import qgrams
from plumbline.schemas import declared_type

#: Values with more pairs than this need blocking or LSH.
MAX_PAIRS = 50_000_000
#: Values of a tile; each pair of tiles is compared by itself.
TILE = 1_000


def record_text(df: DataFrame, columns: list[str], how: Normalization | None = Normalization()) -> Column:
    """The compared text of a row: its columns, joined by spaces and normalized."""
    joined = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns])
    return normalize(joined, how) if how else joined


def near_pairs(values: DataFrame, column: str, method: str = "jw", threshold: float = 0.10, block: Column | None = None, p: float = 0.1, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """All pairs of distinct values at a distance of at most ``threshold``: ``a``, ``b`` (a < b), ``distance``.

    With ``block`` only values of an equal block (null is a block) are compared. Lengths that rule a pair out under
    the metric are filtered before any distance is computed.
    """
    v = values.select(F.col(f"`{column}`").alias("v"), (block if block is not None else F.lit(0)).alias("k")).where("v IS NOT NULL").distinct()
    sizes = v.groupBy("k").agg(F.count("*").alias("n"))
    all_pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    if all_pairs > max_pairs:
        raise ValueError(f"{all_pairs:.0f} pairs exceed the limit of {max_pairs}; use blocking or LSH")
    # a block is cut into tiles, and each pair of tiles is a key of its own, so that no task has a whole block's pairs
    tiles = sizes.select(F.col("k").alias("of"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    cut = v.join(tiles, F.col("k").eqNullSafe(F.col("of"))).select("v", "k", "tiles", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int").alias("tile"))
    a = cut.select(F.col("v").alias("x"), "k", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"))
    b = cut.select(F.col("v").alias("y"), F.col("k").alias("k2"), F.explode(F.sequence(F.lit(0), "tile")).alias("i2"), F.col("tile").alias("j2"))
    met = F.col("k").eqNullSafe(F.col("k2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    pairs = a.join(b, met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if method == "jw":
        # Jaro is at most (2 + shorter/longer) / 3, and the prefix bonus closes at most 4 p of the rest
        short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
        bound = (1 - (2 + short / F.greatest(long, F.lit(1))) / 3) * (1 - 4 * p)
        pairs = pairs.where(bound <= threshold)
    elif method in ("lv", "osa"):
        pairs = pairs.where(F.abs(F.length("a") - F.length("b")) <= threshold)
    return pairs.withColumn("distance", distance(F.col("a"), F.col("b"), method, p)).where(F.col("distance") <= threshold)


def lsh_guarantee(similarity: float, bands: int = 12, rows: int = 3) -> float:
    """The chance that a pair of a Jaccard similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


def lsh_pairs(values: DataFrame, column: str, bands: int = 12, rows: int = 3, q: int = 3) -> DataFrame:
    """Candidate pairs of distinct values by MinHash over q-grams, within the JVM: ``a``, ``b``. Large buckets are compared, never dropped."""
    v = values.select(F.col(f"`{column}`").alias("v")).where("v IS NOT NULL").distinct().withColumn("grams", qgrams(F.col("v"), q))
    keys = []
    for band in range(bands):
        samples = [F.array_min(F.transform("grams", lambda g, s=band * rows + r: F.xxhash64(F.lit(s), g))) for r in range(rows)]
        keys.append(F.xxhash64(F.lit(band), *samples))
    banded = v.select("v", F.explode(F.array(*keys)).alias("key"))
    a, b = banded.select(F.col("v").alias("a"), "key"), banded.select(F.col("v").alias("b"), "key")
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def detect_near_duplicates(
    df: DataFrame, columns: list[str] | None = None, key: str | None = None, method: str = "jw", threshold: float = 0.10, p: float = 0.1, how: Normalization | None = Normalization(), block_by: str | None = None, strategy: str = "auto", bands: int = 12, rows: int = 3, max_pairs: int = MAX_PAIRS
) -> DataFrame:
    """Pairs of distinct record texts that are near: ``a``, ``b``, ``distance``, with the numbers of rows ``n_a`` and ``n_b``.

    ``strategy`` is exact, lsh, or auto: exact up to ``max_pairs`` pairs, then lsh; the column ``strategy`` tells which of them ran.
    """
    if columns is None:
        columns = [n for n in df.columns if declared_type(df.schema[n].dataType) == "text"]
        if len(columns) > 2:
            import re

            columns = [n for n in columns if not re.search(r"(^|_)(id|code|key|cod|codigo)($|_)", n.lower())]
        if not 1 <= len(columns) <= 2:
            raise ValueError("name the columns to compare")
    raw = df.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]).alias("raw"), *([F.col(f"`{block_by}`").alias("block")] if block_by else [F.lit(0).alias("block")]))
    distinct = raw.groupBy("raw", "block").agg(F.count("*").alias("n"))
    texts = distinct.withColumn("v", normalize(F.col("raw"), how) if how else F.col("raw")).where("v <> ''").groupBy("v", "block").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
    values = texts.select("v", "block")
    if strategy == "auto":
        sizes = values.groupBy("block").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        strategy = "exact" if sizes <= max_pairs else "lsh"
    if strategy == "exact":
        pairs = near_pairs(values, "v", method, threshold, F.col("block"), p, max_pairs)
    else:
        pairs = lsh_pairs(values, "v", bands, rows).withColumn("distance", distance(F.col("a"), F.col("b"), method, p)).where(F.col("distance") <= threshold)
    n = texts.groupBy("v").agg(F.sum("n").alias("n"))
    return pairs.join(n.select(F.col("v").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("v").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "distance", "n_a", "n_b", F.lit(strategy).alias("strategy"))


def exact_duplicates(df: DataFrame, columns: list[str], how: Normalization = Normalization()) -> dict:
    """Pairs of rows with equal texts, and pairs that are equal only when normalized."""
    raw = df.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]).alias("raw")).where("raw <> ''")
    forms = raw.groupBy("raw").agg(F.count("*").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    same = forms.agg(pairs).first()[0] or 0
    merged = forms.withColumn("v", normalize(F.col("raw"), how)).groupBy("v").agg(F.sum("n").alias("n")).agg(pairs).first()[0] or 0
    return {"exact": int(same), "exact_normalized": int(merged - same)}


def estimate_cost(df: DataFrame, columns: list[str], bands: int = 12, rows: int = 3, block_by: str | None = None, how: Normalization | None = None) -> dict:
    """Distinct values and pairs that exact and LSH comparison would meet, before either runs."""
    block = F.col(f"`{block_by}`") if block_by else F.lit(0)
    values = df.select(record_text(df, columns, how).alias("v"), block.alias("block")).where("v <> ''").distinct()
    r = values.groupBy("block").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    v = values.select("v").distinct().withColumn("grams", qgrams(F.col("v")))
    keys = [F.xxhash64(F.lit(b), *[F.array_min(F.transform("grams", lambda g, s=b * rows + k: F.xxhash64(F.lit(s), g))) for k in range(rows)]) for b in range(bands)]
    met = v.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return {"n_values": r[0] or 0, "exact_pairs": int(r[1] or 0), "lsh_pairs_at_most": int(met)}


def numeric_signature(column: Column) -> Column:
    """The numbers in a text, without leading zeros and thousands marks, in order."""
    return F.transform(F.regexp_extract_all(column, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, r"[.,]", ""), r"^0+(?=\d)", ""))


def vocabulary_variants(df: DataFrame, column: str, threshold: float = 0.10, how: Normalization = Normalization(), max_pairs: int = MAX_PAIRS, min_ratio: float = 1.0) -> DataFrame:
    """Stars of variants in a column's vocabulary: each value with the strictly more frequent near value it belongs to.

    Numbers in both must be the same. Returns ``value``, ``n``, ``hub``, ``hub_n``, ``distance`` (0 when only
    normalization differs). The whole vocabulary is compared; one of more than ``max_pairs`` pairs is an error.
    """
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    words = counts.withColumn("v", normalize(F.col("value"), how))
    pairs = near_pairs(words, "v", "jw", threshold, max_pairs=max_pairs)
    pairs = pairs.unionByName(words.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("distance")).distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance").where("a <> b"))
    x = words.select("value", "n", F.col("v").alias("a"))
    y = words.select(F.col("value").alias("hub"), F.col("n").alias("hub_n"), F.col("v").alias("b"))
    met = x.join(both, "a").join(y, "b").where((F.col("hub_n") > F.col("n") * min_ratio) & (F.col("value") != F.col("hub")) & numeric_signature(F.col("value")).eqNullSafe(numeric_signature(F.col("hub"))))
    best = F.max_by(F.struct("hub", "hub_n", "distance"), F.struct("hub_n", (-F.col("distance")).alias("d"), "hub"))
    return met.groupBy("value", "n").agg(best.alias("b")).select("value", "n", "b.hub", "b.hub_n", "b.distance")
