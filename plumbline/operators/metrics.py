"""Quality metrics: declare, specialise, bind, measure. Every measurement is a row of one fact table.

A method is a function (tables, instance) to a DataFrame with ``result`` (double), ``attribute`` and ``row``. Nothing
runs until the fact table is used: ``measure`` only unions lazy selects.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.missing import is_missing
from plumbline.schemas import GRANULARITIES, MEASURE, ORIENTATIONS, RESULT_TYPES

Method = Callable[[dict[str, DataFrame], "Instance"], DataFrame]


@dataclass(frozen=True)
class Metric:
    """A generic metric."""

    name: str
    semantics: str
    granularity: str
    result_type: str
    method: Method
    properties: tuple[str, ...] = ()
    dimension: str | None = None
    factor: str | None = None
    orientation: str = "conformity"

    def __post_init__(self) -> None:
        if self.granularity not in GRANULARITIES or self.result_type not in RESULT_TYPES or self.orientation not in ORIENTATIONS:
            raise ValueError(f"metric {self.name}: unknown granularity, result type or orientation")
        if self.orientation != "not_applicable" and self.result_type not in ("boolean", "real"):
            raise ValueError(f"metric {self.name}: only boolean and real results have an orientation")


@dataclass(frozen=True)
class SpecificMetric:
    """A metric with its properties set."""

    metric: Metric
    name: str
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Instance:
    """A specific metric bound to a table and attributes."""

    specific: SpecificMetric
    entity: str
    attributes: tuple[str, ...] = ()
    name: str = ""
    key: tuple[str, ...] = ()
    reference: "ReferenceSet | None" = None

    @property
    def properties(self) -> dict:
        return self.specific.properties


@dataclass(frozen=True)
class Model:
    """Instances that are measured together."""

    instances: tuple[Instance, ...]


def specialize(metric: Metric, name: str | None = None, **properties) -> SpecificMetric:
    """Sets a metric's properties; all must be declared by it."""
    unknown = set(properties) - set(metric.properties)
    if unknown:
        raise ValueError(f"metric {metric.name} has no properties {sorted(unknown)}")
    return SpecificMetric(metric, name or metric.name, properties)


def bind(specific: SpecificMetric | Metric, entity: str, attributes: list[str] | tuple[str, ...] = (), name: str | None = None, key: list[str] | tuple[str, ...] = (), reference: "ReferenceSet | None" = None) -> Instance:
    """Binds a specific metric to a table, its attributes and, for row results, the table's key."""
    if isinstance(specific, Metric):
        specific = specialize(specific)
    return Instance(specific, entity, tuple(attributes), name or f"{specific.name}({entity}{'.' + ','.join(attributes) if attributes else ''})", tuple(key), reference)


def model(*instances: Instance) -> Model:
    """A model of distinctly named instances."""
    names = [i.name for i in instances]
    if len(set(names)) != len(names):
        raise ValueError("instances need distinct names")
    return Model(tuple(instances))


def metric_properties(x: Metric | SpecificMetric | Instance) -> dict:
    """The properties of a metric at any stage."""
    if isinstance(x, Metric):
        return {p: None for p in x.properties}
    return dict(x.properties)


def measure(what: Model | Instance, tables: dict[str, DataFrame], measurement_id: str | None = None, measured_at: str = "1970-01-01") -> DataFrame:
    """The fact table of all instances."""
    measurement_id = measurement_id or uuid.uuid4().hex
    instances = what.instances if isinstance(what, Model) else (what,)
    parts = []
    for i in instances:
        if i.entity not in tables:
            raise ValueError(f"no table {i.entity}")
        absent = [a for a in (*i.attributes, *i.key) if a not in tables[i.entity].columns]
        if absent:
            raise ValueError(f"{i.name}: {i.entity} has no {absent}")
        m = i.specific.metric
        out = i.specific.metric.method(tables, i)
        text = lambda v: F.lit(v).cast("string")
        row = F.col("row").cast("string")
        thing = F.concat_ws(".", F.lit(i.entity), F.col("attribute"), row)
        parts.append(
            out.select(
                F.sha2(F.concat_ws("\0", F.lit(measurement_id), F.lit(i.name), F.coalesce("attribute", F.lit("")), F.coalesce(row, F.lit(""))), 256).alias("measure_id"),
                text(measurement_id).alias("measurement_id"), text(measured_at).alias("measured_at"), text(m.name).alias("metric"), text(i.specific.name).alias("specific_metric"),
                text(i.name).alias("instance"), text(m.dimension).alias("dimension"), text(m.factor).alias("factor"), text(m.orientation).alias("orientation"), text(m.granularity).alias("granularity"),
                text(m.result_type).alias("result_type"), text(i.entity).alias("entity"), F.col("attribute").cast("string").alias("attribute"), row.alias("row"), thing.alias("object"),
                F.col("result").cast("double").alias("result"), text(None).alias("aggregation"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select([f.name for f in MEASURE.fields])


def _row(i: Instance) -> Column:
    """A row's name: its key, if one is declared."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in i.key]) if i.key else F.lit(None).cast("string")


def _cells(tables: dict, i: Instance, result: Callable[[Column], Column], skip_null: bool = True) -> DataFrame:
    df = tables[i.entity]
    parts = []
    for a in i.attributes:
        c = F.col(f"`{a}`")
        parts.append(F.struct(F.lit(a).alias("attribute"), result(c).cast("double").alias("result"), is_missing(c, df.schema[a].dataType).alias("lost")))
    rows = df.select(_row(i).alias("row"), F.explode(F.array(*parts)).alias("c")).select("row", "c.*")
    if skip_null:
        rows = rows.where("NOT lost")
    return rows.select("attribute", "row", "result").where("result IS NOT NULL")


def _rows(tables: dict, i: Instance, result: Column) -> DataFrame:
    return tables[i.entity].select(F.lit(None).cast("string").alias("attribute"), _row(i).alias("row"), result.cast("double").alias("result"))


def _one(df: DataFrame, attribute: str | None, result: Column) -> DataFrame:
    return df.agg(result.cast("double").alias("result")).select(F.lit(attribute).cast("string").alias("attribute"), F.lit(None).cast("string").alias("row"), "result")


def _not_null(tables, i):
    nulls = i.properties.get("null_values") or ()
    rule = i.properties.get("applicable")
    df = tables[i.entity]
    scoped = {**tables, i.entity: df.where(F.expr(rule))} if rule else tables

    def result(c: Column) -> Column:
        return c.isNotNull() & ~F.coalesce(c.cast("string").isin(*nulls), F.lit(False)) if nulls else c.isNotNull()

    return _cells(scoped, i, result, skip_null=False)


def _format_ok(i: Instance) -> Callable[[Column], Column]:
    given = [k for k in ("regex", "dictionary", "validator") if i.properties.get(k) is not None]
    if len(given) != 1:
        raise ValueError("a format needs exactly one of regex, dictionary and validator")
    value = i.properties[given[0]]
    return {"regex": lambda c: c.cast("string").rlike(value), "dictionary": lambda c: c.cast("string").isin(*value), "validator": lambda c: value(c.cast("string"))}[given[0]]


def _format(tables, i):
    return _cells(tables, i, _format_ok(i))


def _values(tables, i):
    return _cells(tables, i, lambda c: c.isin(*i.properties["values"]))


def _range(tables, i):
    p = i.properties
    if p.get("predicate") is not None:
        return _cells(tables, i, lambda c: p["predicate"](c))

    def result(c: Column) -> Column:
        out = F.lit(True)
        if p.get("low") is not None:
            out = out & (c >= p["low"] if p.get("include_low", True) else c > p["low"])
        if p.get("high") is not None:
            out = out & (c <= p["high"] if p.get("include_high", True) else c < p["high"])
        return out

    return _cells(tables, i, result)


def _row_rule(tables, i):
    return _rows(tables, i, F.expr(i.properties["rule"]))


def _inter(tables, i):
    df, other = tables[i.entity], tables[i.properties["other"]]
    to = i.properties["other_attributes"]
    here = df.select(*[F.col(f"`{a}`").alias(f"k{n}") for n, a in enumerate(i.attributes)]).dropna()
    there = other.select(*[F.col(f"`{a}`").alias(f"k{n}") for n, a in enumerate(to)]).dropna().distinct().withColumn("found", F.lit(1))
    return _one(here.join(there, [f"k{n}" for n in range(len(to))], "left"), None, F.when(F.count(F.lit(1)) > 0, F.count("found") / F.count(F.lit(1))))


def _deviation(tables, i):
    out = None
    for a in i.attributes:
        d = F.col(f"`{a}`").cast("double")
        part = _one(tables[i.entity], a, F.stddev_samp(F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d))).where("result IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def _scale(tables, i):
    error, relative = i.properties["error"], i.properties.get("kind", "absolute") == "relative"

    def result(c: Column) -> Column:
        if relative:
            return F.lit(1.0 - error)
        share = F.lit(1.0) - F.lit(float(error)) / F.abs(c)
        return F.when(c == 0, F.lit(1.0 if error == 0 else 0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))

    return _cells(tables, i, result)


def _attribute_duplicate(tables, i):
    out = None
    for a in i.attributes:
        c = F.col(f"`{a}`")
        rows = tables[i.entity].where(c.isNotNull()).select(F.lit(a).alias("attribute"), _row(i).alias("row"), (F.count("*").over(Window.partitionBy(c)) > 1).cast("double").alias("result"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _set_duplicate(tables, i):
    by = Window.partitionBy(*[F.col(f"`{a}`") for a in i.attributes])
    return _rows(tables, i, F.count(F.lit(1)).over(by) > 1)


def _entity_duplicate(tables, i):
    df = tables[i.entity]
    key = i.properties.get("key")
    if not key:
        return _rows(tables, i, F.count(F.lit(1)).over(Window.partitionBy(*[F.col(f"`{c}`") for c in df.columns])) > 1)
    rest = [c for c in df.columns if c not in key]
    # a null agrees with anything, so equality isn't transitive: rows of a key are compared in pairs, within distinct contents
    content = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumn("_content", F.xxhash64(F.concat(*[c.isNull().cast("string") for c in content]), *content)).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*content)))
    distinct = marked.dropDuplicates(["_content", *key])
    a, b = distinct.alias("a"), distinct.alias("b")
    meet = F.col("a._content") != F.col("b._content")
    for k in key:
        meet = meet & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    for c in rest:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        meet = meet & (x.isNull() | y.isNull() | (x == y))
    twins = a.join(b, meet, "left_semi").select("_content").distinct().withColumn("_twin", F.lit(True))
    return marked.join(twins, "_content", "left").select(F.lit(None).cast("string").alias("attribute"), _row(i).alias("row"), ((F.col("_same") > 1) | F.coalesce("_twin", F.lit(False))).cast("double").alias("result"))


def _contradictory(tables, i):
    from plumbline.operators.fuzzy import near_pairs

    out = None
    for a in i.attributes:
        c = F.col(f"`{a}`")
        values = tables[i.entity].where(c.isNotNull()).select(c.cast("string").alias("value")).distinct()
        pairs = near_pairs(values, "value", threshold=i.properties.get("threshold", 0.10))
        near = pairs.select(F.explode(F.array("a", "b")).alias("value")).distinct().withColumn("near", F.lit(1.0))
        rows = tables[i.entity].where(c.isNotNull()).select(F.lit(a).alias("attribute"), _row(i).alias("row"), c.cast("string").alias("value"))
        part = rows.join(near, "value", "left").select("attribute", "row", F.coalesce("near", F.lit(0.0)).alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


def _stale_format(tables, i):
    ok = _format_ok(i)
    return _cells(tables, i, lambda c: ~ok(c))


def _days(c: Column | str) -> Column:
    """Days since 1970 of a date or time (or its text), fractions included."""
    t = F.lit(c) if isinstance(c, str) else c
    return F.unix_micros(t.cast("timestamp")) / 86_400_000_000.0


def _behind(i: Instance, updated: Column) -> Column:
    v: Validity = i.properties["validity"]
    if v.last_change is not None:
        last = F.expr(v.last_change) if not isinstance(v.last_change, Column) else v.last_change
        return F.greatest(F.lit(0.0), _days(last) - _days(updated))
    return F.greatest(F.lit(0.0), _days(v.accessed_at) - _days(updated) - float(v.change_every_days or 0))


def _stale_date(tables, i):
    return _cells(tables, i, lambda c: _behind(i, c))


def _stale_changes(tables, i):
    v: Validity = i.properties["validity"]
    return _cells(tables, i, lambda c: F.floor(F.greatest(F.lit(0.0), _days(v.accessed_at) - _days(c)) / v.change_every_days))


def _timely_date(tables, i):
    return _cells(tables, i, lambda c: _days(c) <= _days(i.properties["limit"]))


def _timely_interval(tables, i):
    return _cells(tables, i, lambda c: (_days(c) >= _days(i.properties["start"])) & (_days(c) <= _days(i.properties["end"])))


def _timely_degree(tables, i):
    a, b = _days(i.properties["start"]), _days(i.properties["end"])
    return _cells(tables, i, lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (_days(c) - a) / (b - a))))


def _timely_entity(tables, i):
    v: Validity = i.properties["validity"]
    c = F.col(f"`{v.updated_column}`")
    ok = _days(c) <= _days(v.limit) if v.limit is not None else (_days(c) >= _days(v.start)) & (_days(c) <= _days(v.end))
    return _rows(tables, i, ok).where("result IS NOT NULL")


def _density(tables, i):
    weights = i.properties["weights"]
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    df = tables[i.entity]
    total = F.lit(0.0)
    for a, w in weights.items():
        total = total + F.when(is_missing(F.col(f"`{a}`"), df.schema[a].dataType), 0.0).otherwise(float(w))
    return _rows(tables, i, total)


@dataclass(frozen=True)
class ReferenceSet:
    """A reference table with a unique key without nulls, and optional values."""

    data: DataFrame
    key: tuple[str, ...]
    value: tuple[str, ...] = ()
    complete: bool = False
    scope: str | None = None
    name: str | None = None


def reference_set(data: DataFrame, key: list[str], value: list[str] = (), complete: bool = False, scope: str | None = None, name: str | None = None) -> ReferenceSet:
    """A checked reference: the key is without nulls and unique."""
    columns = [F.col(f"`{k}`") for k in key]
    lost = F.lit(False)
    for c in columns:
        lost = lost | c.isNull()
    bad = data.groupBy(*columns).agg(F.count("*").alias("n")).select((lost | (F.col("n") > 1)).alias("bad")).where("bad").take(1)
    if bad:
        raise ValueError("a reference needs a unique key without nulls")
    return ReferenceSet(data, tuple(key), tuple(value), complete, scope, name)


def _against(tables, i, with_value: bool):
    ref = i.reference
    if ref is None:
        raise ValueError(f"{i.name} needs a reference")
    columns = (*ref.key, *ref.value) if with_value else ref.key
    if len(i.attributes) != len(columns):
        raise ValueError(f"{i.name}: attributes must match the reference's {columns}")
    df = tables[i.entity]
    own = df.select(_row(i).alias("row"), *[F.col(f"`{a}`").alias(f"k{n}") for n, a in enumerate(i.attributes)]).dropna(subset=[f"k{n}" for n in range(len(columns))])
    known = ref.data.select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(columns)]).dropna().distinct().withColumn("found", F.lit(1.0))
    return own.join(known, [f"k{n}" for n in range(len(columns))], "left").select(F.lit(i.attributes[-1]).alias("attribute"), "row", F.coalesce("found", F.lit(0.0)).alias("result"))


def _coverage(tables, i):
    ref = i.reference
    if ref is None or not ref.complete:
        raise ValueError(f"{i.name} needs a complete reference")
    have = tables[i.entity].select(*[F.col(f"`{a}`").alias(f"k{n}") for n, a in enumerate(i.attributes)]).dropna().distinct().withColumn("found", F.lit(1))
    wanted = ref.data.select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(ref.key)])
    return _one(wanted.join(have, [f"k{n}" for n in range(len(ref.key))], "left"), None, F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.count("found") / F.count(F.lit(1))))


@dataclass(frozen=True)
class Validity:
    """When data are of use: the column of updates, and a limit, an interval, or how often they change."""

    updated_column: str
    accessed_at: str | None = None
    last_change: str | Column | None = None
    limit: str | None = None
    start: str | None = None
    end: str | None = None
    change_every_days: float | None = None

    def __post_init__(self) -> None:
        if (self.start is None) != (self.end is None):
            raise ValueError("an interval needs a start and an end")
        if self.change_every_days is not None and self.change_every_days <= 0:
            raise ValueError("change_every_days must be positive")


def validity(updated_column: str, **options) -> Validity:
    return Validity(updated_column, **options)


def measurement_scale(error: float, kind: str = "absolute") -> dict:
    """Properties of the scale metric: an absolute or relative error."""
    if kind not in ("absolute", "relative") or error < 0 or kind == "relative" and error > 1:
        raise ValueError("the error must be at least 0, and at most 1 if relative")
    return {"error": error, "kind": kind}


def _m(name, semantics, granularity, result_type, method, properties=(), dimension=None, factor=None, orientation="conformity") -> Metric:
    return Metric(name, semantics, granularity, result_type, method, tuple(properties), dimension, factor, orientation)


_FORMAT = ("regex", "dictionary", "validator")

CORE_METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        _m("not_null", "a cell has a value", "cell", "boolean", _not_null, ("null_values", "applicable"), "completeness", "density"),
        _m("format", "a value has its format", "cell", "boolean", _format, _FORMAT, "accuracy", "syntactic_correctness"),
        _m("allowed_values", "a value is one of a list", "cell", "boolean", _values, ("values",), "consistency", "domain_integrity"),
        _m("allowed_range", "a value is in a range or satisfies a predicate", "cell", "boolean", _range, ("low", "high", "include_low", "include_high", "predicate"), "consistency", "domain_integrity"),
        _m("intra_entity_rule", "a row satisfies a rule", "tuple", "boolean", _row_rule, ("rule",), "consistency", "intra_entity_integrity"),
        _m("inter_entity_rule", "values exist in another table", "table", "real", _inter, ("other", "other_attributes"), "consistency", "inter_entity_integrity"),
        _m("standard_error", "sample standard deviation of a column", "column", "real_number", _deviation, (), "accuracy", "precision", "not_applicable"),
        _m("scale", "precision of a value under a measurement error", "cell", "real", _scale, ("error", "kind"), "accuracy", "precision", "not_applicable"),
        _m("duplicate_attribute", "a value is repeated", "cell", "boolean", _attribute_duplicate, (), "uniqueness", "no_duplication", "defect"),
        _m("duplicate_attribute_set", "a combination is repeated", "tuple", "boolean", _set_duplicate, (), "uniqueness", "no_duplication", "defect"),
        _m("duplicate_entity", "an entity is repeated", "tuple", "boolean", _entity_duplicate, ("key",), "uniqueness", "no_duplication", "defect"),
        _m("contradictory_entity", "a value has a near neighbour", "cell", "boolean", _contradictory, ("threshold",), "uniqueness", "no_contradiction", "defect"),
        _m("outdated_by_format", "a value has lost its format", "cell", "boolean", _stale_format, _FORMAT, "freshness", "currency", "defect"),
        _m("outdated_by_date", "days behind the last change", "cell", "duration", _stale_date, ("validity",), "freshness", "currency", "not_applicable"),
        _m("outdated_by_changes", "missed changes", "cell", "integer", _stale_changes, ("validity",), "freshness", "currency", "not_applicable"),
        _m("timely_by_date", "a date is not past a limit", "cell", "boolean", _timely_date, ("limit",), "freshness", "timeliness"),
        _m("timely_by_interval", "a date is in an interval", "cell", "boolean", _timely_interval, ("start", "end"), "freshness", "timeliness"),
        _m("timeliness_degree", "share of an interval that is left", "cell", "real", _timely_degree, ("start", "end"), "freshness", "timeliness"),
        _m("entity_timely", "a row is timely by its validity", "tuple", "boolean", _timely_entity, ("validity",), "freshness", "timeliness"),
        _m("weighted_density", "weighted share of present attributes", "tuple", "real", _density, ("weights",), "completeness", "density"),
    )
}

REFERENCE_METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        _m("strong_correctness", "a key exists in the reference", "cell", "boolean", lambda t, i: _against(t, i, False), (), "accuracy", "semantic_correctness"),
        _m("weak_correctness", "a key has the reference's value", "cell", "boolean", lambda t, i: _against(t, i, True), (), "accuracy", "semantic_correctness"),
        _m("coverage_ratio", "share of a complete reference that a table covers", "table", "real", _coverage, (), "completeness", "coverage"),
    )
}


def core_metrics() -> dict[str, Metric]:
    return dict(CORE_METRICS)


def reference_metrics() -> dict[str, Metric]:
    return dict(REFERENCE_METRICS)


ESTIMATE_STATISTICS = tuple("stat se cv n df deff ess".split())


def measures_from_estimates(estimates: DataFrame, entity: str, source: str, attribute: str | None = None, measured_at: str = "1970-01-01") -> DataFrame:
    """Measures of survey estimates made elsewhere: one row per estimate and statistic."""
    names = [c for c in ESTIMATE_STATISTICS if c in estimates.columns]
    if not names:
        raise ValueError(f"estimates need one of {ESTIMATE_STATISTICS}")
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("result")) for n in names])).alias("e")
    rows = estimates.select((F.col(attribute).cast("string") if attribute else F.lit(None).cast("string")).alias("attribute"), parts).where("e.result IS NOT NULL")
    text = lambda v: F.lit(v).cast("string")
    out = {
        "measure_id": F.sha2(F.concat_ws("\0", F.lit(source), F.lit(entity), F.coalesce("attribute", F.lit("")), F.col("e.metric")), 256), "measurement_id": text(source), "measured_at": text(measured_at),
        "metric": F.col("e.metric"), "specific_metric": F.col("e.metric"), "instance": F.concat_ws(".", F.lit(entity), F.col("e.metric")), "dimension": text("accuracy"), "factor": text("precision"),
        "orientation": text("not_applicable"), "granularity": text("column"), "result_type": text("real_number"), "entity": text(entity), "attribute": F.col("attribute"), "row": text(None),
        "object": F.concat_ws(".", F.lit(entity), F.col("attribute")), "result": F.col("e.result"), "aggregation": text(None),
    }
    return rows.select(*[c.alias(k) for k, c in out.items()])
