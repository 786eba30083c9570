"""Table sources: names, readers, samples, saved analyses."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.profile import Profile

_PART = re.compile(r'\s*(?:"((?:[^"]|"")*)"|`((?:[^`]|``)*)`|\[([^\]]*)\]|([^.\s"`\[]+))\s*(\.|$)')


def parse_identifier(name: str) -> list[str]:
    """The parts of a qualified name, quotes removed (double quotes, backticks, brackets)."""
    parts, at = [], 0
    while at < len(name):
        m = _PART.match(name, at)
        if not m:
            raise ValueError(f"cannot read the name {name!r}")
        value = next(g for g in m.groups()[:4] if g is not None)
        parts.append(value.replace('""', '"').replace("``", "`"))
        at = m.end()
        if m[5] == "" and at < len(name):
            raise ValueError(f"cannot read the name {name!r}")
        if m[5] == "." and at == len(name):
            raise ValueError(f"cannot read the name {name!r}")
    if not parts:
        raise ValueError("an empty name")
    return parts


def quote_identifier(parts: list[str]) -> str:
    """A qualified name that Spark reads as these parts."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def read_source(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """A table from a DataFrame, a path (Parquet, ORC, JSON, CSV by its ending) or a catalog name; JDBC by a url option."""
    if isinstance(source, DataFrame):
        return source
    if "url" in options:
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    for ending, kind in ((".parquet", "parquet"), (".orc", "orc"), (".json", "json"), (".csv", "csv")):
        if source.rstrip("/").endswith(ending):
            reader = spark.read.options(**options)
            return reader.csv(source, header=True) if kind == "csv" else getattr(reader, kind)(source)
    return spark.table(quote_identifier(parse_identifier(source)))


def systematic_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows at even distances in a declared, unique order: the first and last are in it.

    Places are rounded half to even. Ranks within ranges of the order come from a range partitioning, so no task
    sorts the whole table.
    """
    keys = [F.col(f"`{c}`") for c in order]
    n = df.count()
    if n <= limit:
        return df
    wanted = sorted({round(1 + k * (n - 1) / (limit - 1)) for k in range(limit)}) if limit > 1 else [1]
    # ranges of the first key, so that equal first keys share a range
    kind = df.schema[order[0]].dataType
    cuts = df.where(keys[0].isNotNull()).select(keys[0].alias("k")).sample(fraction=min(1.0, 20_000 / n), seed=1).orderBy("k").collect()
    bounds = F.array(*[F.lit(r["k"]).cast(kind) for r in cuts[:: max(1, len(cuts) // 200)]])
    bucket = F.when(keys[0].isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= keys[0])))
    placed = df.withColumn("_bucket", bucket)
    sizes = {r["_bucket"]: r["count"] for r in placed.groupBy("_bucket").count().collect()}
    before, total = [], 0
    for b in sorted(sizes):
        before.append((b, total))
        total += sizes[b]
    offsets = df.sparkSession.createDataFrame(before, "_bucket int, _before long")
    ranked = placed.join(F.broadcast(offsets), "_bucket").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)))
    picks = df.sparkSession.createDataFrame([(w,) for w in wanted], "_rank long")
    return ranked.join(F.broadcast(picks), "_rank", "left_semi").drop("_rank", "_bucket", "_before")


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same ones on every run: those with the smallest hash of their key."""
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key])
    return df.orderBy(h, *[F.col(f"`{c}`") for c in key]).limit(n)


def check_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Order values that more than one row has; an order with any doesn't make samples reproducible."""
    return df.groupBy(*[F.col(f"`{c}`") for c in order]).agg(F.count("*").alias("n")).where("n > 1")


def readable_columns(df: DataFrame, probe: Callable[[DataFrame], object] | None = None) -> tuple[list[str], dict[str, str]]:
    """Columns that can be read, and the reason for each that can't; columns are tried alone only if the whole row fails."""
    probe = probe or (lambda d: d.limit(1).collect())
    try:
        probe(df)
        return df.columns, {}
    except Exception:  # noqa: BLE001 - a driver's failure of any kind isolates its column
        good, bad = [], {}
        for c in df.columns:
            try:
                probe(df.select(F.col(f"`{c}`")))
                good.append(c)
            except Exception as e:  # noqa: BLE001
                bad[c] = str(e)[:200]
        return good, bad


def save_analysis(spark: SparkSession, profile: Profile, path: str, overwrite: bool = False) -> None:
    """A profile as one JSON row in Parquet; an existing one stays unless ``overwrite``."""
    row = json.dumps(asdict(profile), default=str)
    spark.createDataFrame([(1, row)], "version int, profile string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_analysis(spark: SparkSession, path: str) -> Profile:
    r = spark.read.parquet(path).first()
    if r["version"] != 1:
        raise ValueError(f"unknown version {r['version']}")
    return Profile(**json.loads(r["profile"]))


class TableReader:
    """Reads tables by name and keeps those that fit a budget of bytes (by the plan's estimate), so that a collection's tables are read once; the log tells what each read did."""

    def __init__(self, spark: SparkSession, sources: dict[str, str | DataFrame], budget_bytes: int = 1 << 30) -> None:
        self.spark, self.sources, self.left = spark, sources, budget_bytes
        self.kept: dict[str, DataFrame] = {}
        self.log: list[dict] = []

    def read(self, name: str) -> DataFrame:
        """A table; an unknown name is an error."""
        if name in self.kept:
            self.log.append({"table": name, "read": "kept", "bytes": 0})
            return self.kept[name]
        df = read_source(self.spark, self.sources[name])
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size <= self.left:
            self.left -= size
            df = self.kept[name] = df.persist()
        self.log.append({"table": name, "read": "source" if name not in self.kept else "source, kept", "bytes": size})
        return df

    def close(self) -> None:
        """Gives up what is kept."""
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
