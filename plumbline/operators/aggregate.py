"""Aggregation of measures along the granularity lattice, dashboards, the quality index, evaluation and history.

All functions take and return DataFrames of the measures' fact table; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.schemas import GRANULARITIES, GRANULARITY_EDGES


def granularities() -> tuple[str, ...]:
    return GRANULARITIES


def granularity_edges() -> tuple[tuple[str, str], ...]:
    return GRANULARITY_EDGES


@dataclass(frozen=True)
class Collection:
    """A declared set of tables."""

    name: str
    tables: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.tables or len(set(self.tables)) != len(self.tables):
            raise ValueError("a collection has distinct tables")


@dataclass(frozen=True)
class Organization:
    """A named set of collections."""

    name: str
    collections: tuple[Collection, ...]


def collection(name: str, tables: list[str]) -> Collection:
    return Collection(name, tuple(tables))


def organization(name: str, collections: list[Collection]) -> Organization:
    if len({c.name for c in collections}) != len(collections):
        raise ValueError("collections need distinct names")
    return Organization(name, tuple(collections))


_TARGET_KEYS = {"column": ("entity", "attribute"), "tuple": ("entity", "row"), "table": ("entity",)}
FUNCTIONS = ("ratio", "threshold_ratio", "mean", "weighted_mean")


def aggregate_measures(measures: DataFrame, target: str, function: str = "ratio", threshold: float | None = None, weights: dict[str, float] | None = None, within: Collection | Organization | None = None) -> DataFrame:
    """Measures of one granularity, aggregated to a neighbouring one.

    ``ratio`` is the share of ones, ``threshold_ratio`` the share of at least ``threshold``, ``mean`` the mean, and
    ``weighted_mean`` the sum by ``weights`` (of source objects: attributes towards a table, else entities), which
    must sum to 1. Above a table the parts are those that ``within`` declares.
    """
    sources = [a for a, b in GRANULARITY_EDGES if b == target]
    if not sources:
        raise ValueError(f"nothing aggregates to {target}")
    if function not in FUNCTIONS or (function == "threshold_ratio") != (threshold is not None) or (function == "weighted_mean") != (weights is not None):
        raise ValueError("a function of ratio, threshold_ratio (with threshold), mean, weighted_mean (with weights)")
    own = measures.where(F.col("granularity").isin(*sources))
    if target in _TARGET_KEYS:
        keys, name = _TARGET_KEYS[target], None
    else:
        if within is None:
            raise ValueError(f"aggregation to {target} needs the collection or organization that bounds it")
        parts = within.tables if isinstance(within, Collection) else tuple(c.name for c in within.collections)
        own = own.where(F.col("entity").isin(*parts))
        keys, name = (), within.name
    r = F.col("result")
    if function == "ratio":
        # on boolean measures only: a mean of ones and zeros
        value: Column = F.avg((r == 1).cast("double"))
    elif function == "threshold_ratio":
        value = F.avg((r >= threshold).cast("double"))
    elif function == "mean":
        value = F.avg(r)
    else:
        if abs(sum(weights.values()) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
        of = F.coalesce(F.col("attribute"), F.col("entity")) if target == "table" else F.col("entity")
        pairs = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
        value = F.sum(r * pairs[of])
    group = ["metric", "specific_metric", "instance", "dimension", "factor", "orientation", "measurement_id", "measured_at", *keys]
    out = own.groupBy(*group).agg(value.alias("result"), F.count("*").alias("n_parts"))
    entity = F.col("entity") if name is None else F.lit(name)
    attribute = F.col("attribute") if "attribute" in keys else F.lit(None).cast("string")
    row = F.col("row") if "row" in keys else F.lit(None).cast("string")
    return out.select(
        "measurement_id", "measured_at", "metric", "specific_metric", "instance", "dimension", "factor", "orientation", F.lit(target).alias("granularity"), F.lit("real").alias("result_type"),
        entity.alias("entity"), attribute.alias("attribute"), row.alias("row"), F.concat_ws(".", entity, attribute, row).alias("object"), "result", F.lit(function).alias("aggregation"), "n_parts",
    )


def boundary_coverage(measures: DataFrame, within: Collection) -> DataFrame:
    """Per declared table whether it is measured, and with how many measures."""
    declared = measures.sparkSession.createDataFrame([(t,) for t in within.tables], "entity string")
    counted = measures.groupBy("entity").agg(F.count("*").alias("n"))
    return declared.join(counted, "entity", "left").select("entity", F.col("n").isNotNull().alias("measured"), F.coalesce("n", F.lit(0)).alias("n_measures"))


def dashboard(measures: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per metric and object of attribute level: ratio of boolean measures, mean of others; with ``thresholds`` (metric: error below, suspicious below) a state."""
    value = F.when(F.first("result_type") == "boolean", F.avg((F.col("result") == 1).cast("double"))).otherwise(F.avg("result"))
    out = measures.groupBy("dimension", "factor", "metric", "orientation", "entity", "attribute").agg(value.alias("value"), F.count("*").alias("n"))
    if thresholds:
        low = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v[0])))])[F.col("metric")]
        high = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v[1])))])[F.col("metric")]
        good = F.when(F.col("orientation") == "defect", 1 - F.col("value")).otherwise(F.col("value"))
        out = out.withColumn("state", F.when(low.isNull(), None).when(good < low, "error").when(good < high, "suspicious").otherwise("ok"))
    return out


def quality_index(board: DataFrame, weights: dict[str, float], inner_weights: dict[str, float] | None = None) -> DataFrame:
    """One weighted figure: per dimension the (weighted) mean of its metrics, then the weighted sum of dimensions.

    Defects count as 1 - value; metrics without orientation don't count. All dimensions present need a weight.
    """
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    good = F.when(F.col("orientation") == "defect", 1 - F.col("value")).otherwise(F.col("value"))
    used = board.where("orientation <> 'not_applicable' AND value IS NOT NULL").withColumn("good", good)
    per_metric = used.groupBy("dimension", "metric").agg(F.avg("good").alias("good"))
    if inner_weights:
        w = F.create_map(*[x for k, v in inner_weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("metric")]
        inner = F.sum(F.col("good") * w) / F.sum(w)
    else:
        inner = F.avg("good")
    per_dimension = per_metric.groupBy("dimension").agg(inner.alias("value"))
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("dimension")]
    return per_dimension.where(weight.isNotNull()).agg(F.sum(F.col("value") * weight).alias("index"), F.sum(weight).alias("weight"), F.count("*").alias("n_dimensions"))


@dataclass(frozen=True)
class Rule:
    """A condition on measures: an SQL expression over ``result``, or a function of its column."""

    name: str
    condition: str | Callable[[Column], Column]
    metrics: tuple[str, ...] | None = None
    min_share: float | None = None
    outcome: str | None = None


@dataclass(frozen=True)
class EvaluationProfile:
    """A named set of rules."""

    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def evaluation_rule(name: str, condition: str | Callable[[Column], Column], metrics: list[str] | None = None, min_share: float | None = None, outcome: str | None = None) -> Rule:
    if min_share is not None and not 0 <= min_share <= 1:
        raise ValueError("min_share is a share")
    return Rule(name, condition, tuple(metrics) if metrics else None, min_share, outcome)


def rule_properties(rule: Rule) -> dict:
    return {"name": rule.name, "metrics": rule.metrics, "min_share": rule.min_share, "outcome": rule.outcome}


def evaluation_profile(name: str, *rules: Rule) -> EvaluationProfile:
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules need distinct names")
    return EvaluationProfile(name, tuple(rules))


def maturity_profiles(metrics: list[str] | None = None, thresholds: tuple[float, float, float] = (0.5, 0.7, 0.9)) -> list[EvaluationProfile]:
    """Three levels, each a rule that results exceed its threshold (strictly)."""
    return [evaluation_profile(name, evaluation_rule(f"{name}_above_{t:g}", lambda c, t=t: c > t, metrics)) for name, t in zip(("initial", "intermediate", "advanced"), thresholds)]


@dataclass
class Evaluation:
    """Results per measure, rule and profile."""

    measures: DataFrame
    rules: DataFrame
    profile: DataFrame


def evaluate(measures: DataFrame, profile: EvaluationProfile) -> Evaluation:
    """Applies each rule to its measures; a rule's result is the share that satisfies it, or whether that reaches ``min_share``."""
    parts = None
    for r in profile.rules:
        own = measures.where(F.col("metric").isin(*r.metrics)) if r.metrics else measures
        value = F.col("result")
        ok = r.condition(value) if callable(r.condition) else F.expr(r.condition)
        part = own.where("result IS NOT NULL").select(
            F.lit(profile.name).alias("profile"), F.lit(r.name).alias("rule"), F.lit(r.min_share).cast("double").alias("min_share"), F.lit(r.outcome).cast("string").alias("outcome"), "measure_id", "object", ok.cast("double").alias("value")
        )
        parts = part if parts is None else parts.unionByName(part)
    share = F.avg("value")
    rules = parts.groupBy("profile", "rule", "min_share", "outcome").agg(share.alias("share"), F.count("value").alias("n"))
    rules = rules.withColumn("value", F.when(F.col("min_share").isNull(), F.col("share")).otherwise((F.col("share") >= F.col("min_share")).cast("double")))
    rules = rules.withColumn("outcome", F.when(F.col("min_share").isNotNull() & (F.col("value") == 0), F.col("outcome")))
    return Evaluation(parts, rules, rules.groupBy("profile").agg(F.avg("value").alias("value"), F.count("*").alias("n_rules")))


def compare_evaluations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two evaluations' profiles side by side."""
    a, b = before.select("profile", F.col("value").alias("before")), after.select("profile", F.col("value").alias("after"))
    return a.join(b, "profile", "full").select("profile", "before", "after", (F.col("after") - F.col("before")).alias("change"))


HISTORY = ("record_id", "measurement_id", "measured_at", "level", "profile", "rule", "value", "n")


def quality_history(*evaluations: tuple[str, str, Evaluation]) -> DataFrame:
    """Evaluations (measurement_id, measured_at, evaluation) as rows of one history, profiles and rules."""
    out = None
    for measurement_id, measured_at, e in evaluations:
        rows = e.rules.select("profile", "rule", "value", "n", F.lit("rule").alias("level")).unionByName(
            e.profile.select("profile", F.lit(None).cast("string").alias("rule"), "value", F.col("n_rules").alias("n"), F.lit("profile").alias("level"))
        )
        rows = rows.withColumns({"measurement_id": F.lit(measurement_id), "measured_at": F.lit(measured_at)})
        rows = rows.withColumn("record_id", F.sha2(F.concat_ws("\0", "measurement_id", "level", "profile", F.coalesce("rule", F.lit(""))), 256)).select(*HISTORY)
        out = rows if out is None else out.unionByName(rows)
    return out


def append_history(history: DataFrame, more: DataFrame) -> DataFrame:
    """``history`` with new records; records that it has already are not added again, and must agree."""
    clash = history.alias("a").join(more.alias("b"), "record_id").where(~F.col("a.value").eqNullSafe(F.col("b.value"))).take(1)
    if clash:
        raise ValueError("a record of the history has another value now")
    return history.unionByName(more.join(history.select("record_id"), "record_id", "left_anti").select(*HISTORY))


def detect_quality_drift(history: DataFrame, level: str = "profile", threshold: float = 0.05) -> DataFrame:
    """Changes between consecutive measurements of each profile or rule, by date then id; falls beyond the threshold are flagged."""
    series = ["profile"] if level == "profile" else ["profile", "rule"]
    of = Window.partitionBy(*series).orderBy("measured_at", "measurement_id")
    rows = history.where(F.col("level") == level).withColumn("before", F.lag("value").over(of))
    change = F.col("value") - F.col("before")
    state = F.when(F.col("before").isNull(), None).when(change < -threshold, "worse").when(change > threshold, "better").otherwise("stable")
    return rows.select(*series, "measurement_id", "measured_at", "before", F.col("value").alias("after"), change.alias("change"), state.alias("state"))


def save_history(history: DataFrame, path: str, overwrite: bool = False) -> None:
    history.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_history(spark, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    if set(HISTORY) - set(out.columns):
        raise ValueError(f"{path} is not a history")
    return out
