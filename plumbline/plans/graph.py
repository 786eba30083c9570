"""Connected components of edge tables, for keys of any type that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keep(df: DataFrame) -> DataFrame:
    """Cuts the plan of a round: a checkpoint where the session has a shared folder for them, else the rows are kept."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def components(edges: DataFrame, a: str = "a", b: str = "b", keep=_keep) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, by large-star and small-star steps (Kiveris et al., 2014)."""
    edges = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def least(of: DataFrame) -> DataFrame:
        return of.join(of.groupBy("u").agg(F.min("v").alias("m")), "u")

    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).withColumn("m", F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = least(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = keep(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first())
        if now[0] == now[2] and now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
