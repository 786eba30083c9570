"""Vocabularies of near values: what kind of difference two forms have, forms that share a column evenly, their groups, and nearest references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.distances import distance
from plumbline.operators.fuzzy import MAX_PAIRS, TILE, near_pairs, numeric_signature
from plumbline.plans.graph import components


def difference_class(a: Column, b: Column) -> Column:
    """How two texts differ: ``none``, ``within_word``, ``whole_token``, ``single_token`` (one token each) or ``mixed``.

    Texts of unequally many tokens are mixed. A pair of tokens differs within a word if they share the first or the last two
    characters, or one holds the other.
    """
    x, y = (F.split(F.trim(t), r"\s+") for t in (a, b))

    def within(p: Column, q: Column) -> Column:
        ends = (F.length(p) >= 2) & (F.length(q) >= 2) & ((F.substring(p, 1, 2) == F.substring(q, 1, 2)) | (F.substring(p, -2, 2) == F.substring(q, -2, 2)))
        return ends | F.contains(p, q) | F.contains(q, p)

    differing = F.filter(F.arrays_zip(x.alias("p"), y.alias("q")), lambda t: t["p"] != t["q"])
    inside = F.filter(differing, lambda t: within(t["p"], t["q"]))
    return (
        F.when(F.size(x) != F.size(y), "mixed")
        .when(F.size(x) == 1, "single_token")
        .when(F.size(differing) == 0, "none")
        .when(F.size(inside) == F.size(differing), "within_word")
        .when(F.size(inside) == 0, "whole_token")
        .otherwise("mixed")
    )


def _counts(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`").cast("string")
    return df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))


def equifrequent_variants(df: DataFrame, column: str, method: str = "jw", threshold: float = 0.10, max_ratio: float = 2.0, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Pairs of near values of which neither is much more frequent: ``a``, ``b``, ``n_a``, ``n_b``, ``distance``, ``difference``.

    Frequencies differ by at most ``max_ratio`` times; numbers in both are the same. Nothing says which form is right.
    """
    counts = _counts(df, column)
    pairs = near_pairs(counts, "value", method, threshold, max_pairs=max_pairs)
    met = pairs.join(counts.select(F.col("value").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("value").alias("b"), F.col("n").alias("n_b")), "b")
    even = F.greatest("n_a", "n_b") <= F.least("n_a", "n_b") * max_ratio
    same = numeric_signature(F.col("a")).eqNullSafe(numeric_signature(F.col("b")))
    return met.where(even & same).select("a", "b", "n_a", "n_b", "distance", difference_class(F.col("a"), F.col("b")).alias("difference"))


def vocabulary_components(df: DataFrame, column: str, method: str = "jw", threshold: float = 0.10, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Groups of values connected by near pairs: ``value``, ``n``, ``group`` (its smallest value) and the group's ``size``."""
    from pyspark.sql import Window

    counts = _counts(df, column)
    groups = components(near_pairs(counts, "value", method, threshold, max_pairs=max_pairs))
    out = groups.join(counts, groups["node"] == counts["value"]).select("value", "n", F.col("root").alias("group"))
    return out.withColumn("size", F.count("*").over(Window.partitionBy("group")))


def nearest_references(failed: DataFrame, column: str, reference: DataFrame, reference_column: str, method: str = "lv", threshold: float = 2, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """For each distinct value that isn't in the reference, the nearest reference values within ``threshold``: ``value``, ``n``, ``reference``, ``distance``.

    Ties keep each. Both sides are distinct values cut into tiles; more than ``max_pairs`` pairs are an error.
    """
    known = reference.where(F.col(f"`{reference_column}`").isNotNull()).select(F.col(f"`{reference_column}`").cast("string").alias("reference")).distinct()
    counts = _counts(failed, column).join(known, F.col("value") == F.col("reference"), "left_anti")
    n, m = counts.count(), known.count()
    if n * m > max_pairs:
        raise ValueError(f"{n * m} pairs exceed the limit of {max_pairs}")
    rows, columns = max(1, -(-n // TILE)), max(1, -(-m // TILE))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = counts.select("value", "n", F.pmod(F.xxhash64("value"), F.lit(rows)).cast("int").alias("i"), each(columns).alias("j"))
    b = known.select("reference", each(rows).alias("i"), F.pmod(F.xxhash64("reference"), F.lit(columns)).cast("int").alias("j"))
    near = a.join(b, ["i", "j"]).withColumn("distance", distance(F.col("value"), F.col("reference"), method, 0.1)).where(F.col("distance") <= threshold)
    least = near.groupBy("value").agg(F.min("distance").alias("least")).withColumnRenamed("value", "of")
    return near.join(least, (F.col("value") == F.col("of")) & (F.col("distance") == F.col("least"))).select("value", "n", "reference", "distance")


def blocking_loss(df: DataFrame, column: str, block: Column, method: str = "lv", threshold: float = 1, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row on what a block loses: near pairs of distinct values ``n_pairs``, those whose blocks differ ``n_lost``, and their share ``loss``."""
    counts = _counts(df, column)
    pairs = near_pairs(counts, "value", method, threshold, max_pairs=max_pairs)
    key = counts.select("value", block.alias("k"))
    both = pairs.join(key.select(F.col("value").alias("a"), F.col("k").alias("ka")), "a").join(key.select(F.col("value").alias("b"), F.col("k").alias("kb")), "b")
    out = both.agg(F.count("*").alias("n_pairs"), F.count(F.when(~F.col("ka").eqNullSafe(F.col("kb")), 1)).alias("n_lost"))
    return out.withColumn("loss", F.col("n_lost") / F.nullif(F.col("n_pairs"), F.lit(0)))
