"""Cleaning plans: findings become auditable actions; nothing destructive runs without a second consent.

A plan is a list of actions; ``apply_cleaning`` runs those that are chosen, in order, as lazy column transforms.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import encoding, missing, text, types_dates
from plumbline.operators.profile import Profile
from plumbline.plans.aggplan import quantiles_of_counts, value_counts
from plumbline.schemas import NUMERIC, declared_type


@dataclass(frozen=True)
class Action:
    """One step of a plan. Of a ``group`` only one action can be chosen."""

    strategy: str
    column: str | None
    order: int
    recommended: bool = False
    chosen: bool = False
    destructive: bool = False
    reversible: bool = False
    blocked: str | None = None
    group: str = ""
    options: dict = field(default_factory=dict)


@dataclass
class CleaningPlan:
    """Actions in execution order."""

    actions: list[Action]

    def choose(self, strategy: str, column: str | None = None, **options) -> CleaningPlan:
        """The plan with an action chosen, and others of its group not."""
        hit = [a for a in self.actions if a.strategy == strategy and (column is None or a.column == column)]
        if not hit:
            raise ValueError(f"the plan has no {strategy} for {column}")
        groups = {a.group for a in hit}
        out = []
        for a in self.actions:
            if a in hit:
                out.append(replace(a, chosen=True, blocked=None if options else a.blocked, options=a.options | options))
            else:
                out.append(replace(a, chosen=False) if a.group in groups else a)
        return CleaningPlan(out)


@dataclass
class CleaningResult:
    """The cleaned table, rows and columns that were removed, and a log entry per action."""

    data: DataFrame
    removed: DataFrame | None
    log: list[dict]


#: Finding to actions: strategy, order, recommended, applied by default, destructive, reversible, blocked until.
_PLAN: dict[str, list[tuple]] = {
    "duplicate_rows": [("mark_duplicate_rows", 30, True, True, False, True, None), ("keep_first_duplicate", 35, False, False, True, False, None), ("keep_most_complete", 36, False, False, True, False, "a key")],
    "missing": [("mark_missing_rows", 40, True, False, False, True, None), ("drop_missing_rows", 45, False, False, True, False, None), ("impute_dependency", 150, False, False, False, False, "a determinant")],
    "disguised_missing": [("null_text_sentinels", 100, True, True, False, False, None), ("null_number_sentinels", 110, False, False, False, False, None)],
    "border_spaces": [("trim", 200, True, True, False, False, None)],
    "invisible_controls": [("strip_controls", 205, True, True, False, False, None)],
    "invisible_spaces": [("normalize_spaces", 206, False, False, True, False, None)],
    "html_entities": [("decode_entities", 207, False, False, False, False, None)],
    "field_separators": [("replace_separators", 209, False, False, False, False, None)],
    "broken_encoding": [("repair_encoding", 180, True, False, False, False, None)],
    "mixed_date_formats": [("convert_date", 300, False, False, False, False, "confirmed formats")],
    "ambiguous_date_format": [("convert_date", 300, False, False, False, False, "confirmed formats")],
    "declared_type_differs": [("convert_type", 310, True, False, False, False, None)],
    "number_as_text": [("convert_number", 320, False, False, False, False, "a convention")],
    "outliers": [("mark_outliers", 510, True, False, False, True, None), ("winsorize", 520, False, False, False, False, None)],
    "inconsistent_case": [("lower", 600, False, False, False, False, None), ("upper", 600, False, False, False, False, None), ("title", 600, False, False, False, False, None), ("dictionary", 600, False, False, False, False, "a dictionary")],
    "duplicate_columns": [("mark_duplicate_column", 700, True, True, False, True, None), ("drop_duplicate_column", 705, False, False, True, False, None)],
    "constant": [("drop_constant_column", 710, False, False, True, False, None)],
    "problematic_column_names": [("normalize_names", 900, True, True, False, False, None), ("snake_case_names", 900, False, False, False, False, None)],
}


def plan_cleaning(profile: Profile) -> CleaningPlan:
    """A plan for a profile's findings; findings without a strategy become reviews."""
    actions = []
    for f in profile.findings:
        steps = _PLAN.get(f["finding"])
        group = f"{f['finding']}:{f['column']}"
        if steps is None:
            actions.append(Action("review", f["column"], 800, group=group, options={"finding": f["finding"]}))
            continue
        for strategy, order, recommended, chosen, destructive, reversible, blocked in steps:
            options = {"to": f["evidence"].removeprefix("inferred=")} if strategy == "convert_type" else {}
            actions.append(Action(strategy, f["column"], order, recommended, chosen, destructive, reversible, blocked, group, options))
    return CleaningPlan(sorted(actions, key=lambda a: (a.order, a.column or "", a.strategy)))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _bounds(df: DataFrame, column: str, factor: float) -> tuple[float, float] | None:
    found = quantiles_of_counts(value_counts(df.select(F.col(f"`{column}`").cast("double").alias("v")), ["v"]), [0.25, 0.75]).collect()
    q = [r["value"] for r in sorted(found, key=lambda r: r["probability"])]
    return (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])) if q else None


def _distinct_map(df: DataFrame, column: str, make) -> DataFrame:
    """A column replaced by a function of its values that runs once per distinct value."""
    values = df.select(F.col(f"`{column}`").alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_new", make(F.col("_v")))
    names = [F.col("_new").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    return df.join(values, F.col(f"`{column}`") == F.col("_v"), "left").select(*names)


def text_transform(strategy: str, c: Column, options: dict) -> Column | None:
    """The expression of a strategy that works on one column by itself; None for others."""
    if strategy == "trim":
        return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    if strategy == "strip_controls":
        return F.regexp_replace(c, text.CONTROLS, "")
    if strategy == "normalize_spaces":
        return F.regexp_replace(c, text.INVISIBLE_SPACES, " ")
    if strategy == "replace_separators":
        return F.regexp_replace(c, text.LINE_SEPARATORS + "+", options.get("by", " "))
    if strategy in ("lower", "upper", "title"):
        return {"lower": F.lower, "upper": F.upper, "title": F.initcap}[strategy](c)
    if strategy == "dictionary":
        pairs = F.create_map(*[F.lit(x) for kv in options["dictionary"].items() for x in kv])
        return F.coalesce(pairs[c], c)
    if strategy == "null_text_sentinels":
        return F.when(~missing.is_text_sentinel(c), c)
    if strategy == "convert_number":
        return text.regional_number(c, options["convention"])
    if strategy == "convert_date":
        return types_dates.parse_dates(c, options["formats"])
    if strategy == "convert_type":
        to = options["to"]
        if to == "logical":
            t = F.lower(F.trim(c))
            return F.when(t.isin("true", "yes", "si", "sí", "verdadero", "t", "y", "1"), True).when(t.isin("false", "no", "falso", "f", "n", "0"), False)
        if to in ("date", "timestamp"):
            return types_dates.parse_dates(c, [f[0] for f in types_dates.DATE_FORMATS if f[3] == "ymd"])
        return F.trim(c).try_cast({"integer": "bigint", "double": "double"}.get(to, "string"))
    return None


def _run(df: DataFrame, a: Action, key: list[str] | None) -> tuple[DataFrame, DataFrame | None]:
    c = F.col(f"`{a.column}`") if a.column and a.column in df.columns else None
    s, o = a.strategy, a.options
    if s == "review":
        return df, None
    if s in ("normalize_names", "snake_case_names"):
        return df.toDF(*text.unique_names(df.columns, s == "snake_case_names")), None
    if s in ("mark_duplicate_rows", "keep_first_duplicate"):
        same = Window.partitionBy(*[F.col(f"`{x}`") for x in df.columns])
        first = F.row_number().over(same.orderBy(*(F.col(f"`{k}`") for k in (key or df.columns[:1]))))
        marked = df.withColumn("duplicate_row", first > 1)
        if s == "mark_duplicate_rows":
            return marked, None
        return marked.where("NOT duplicate_row").drop("duplicate_row"), marked.where("duplicate_row").drop("duplicate_row")
    if s == "keep_most_complete":
        key = o.get("key", key)
        if not key:
            raise ValueError("keep_most_complete needs a key")
        full = sum((F.when(F.col(f"`{x}`").isNotNull(), 1).otherwise(0) for x in df.columns), F.lit(0))
        rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(full.desc(), *[F.col(f"`{x}`") for x in df.columns]))
        marked = df.withColumn("_rank", rank)
        return marked.where("_rank = 1").drop("_rank"), marked.where("_rank > 1").drop("_rank")
    if s in ("drop_duplicate_column", "drop_constant_column"):
        return df.drop(a.column), None
    if s == "mark_duplicate_column":
        return df.withMetadata(a.column, {"duplicate_column": True}), None
    if c is None:
        raise ValueError(f"no column {a.column}")
    kind = df.schema[a.column].dataType
    if s == "mark_missing_rows":
        return df.withColumn(f"{a.column}_missing", missing.is_missing(c, kind)), None
    if s == "drop_missing_rows":
        lost = missing.is_missing(c, kind)
        return df.where(~lost), df.where(lost)
    if s == "null_number_sentinels":
        return df.withColumn(a.column, F.when(~F.coalesce(c.try_cast("double").isin(*o.get("sentinels", missing.NUMBER_SENTINELS)), F.lit(False)), c)), None
    if s == "impute_dependency":
        return impute_dependency(df, o["determinant"], a.column, o.get("min_support", 2)), None
    if s == "decode_entities":
        return _distinct_map(df, a.column, lambda v: _unescape(v)), None
    if s == "repair_encoding":
        return _distinct_map(df, a.column, lambda v: encoding.repair_column(v)["text"]), None
    if s in ("mark_outliers", "winsorize"):
        bounds = _bounds(df, a.column, o.get("factor", 1.5))
        if bounds is None:
            return df, None
        if s == "mark_outliers":
            return df.withColumn(f"{a.column}_outlier", (c < bounds[0]) | (c > bounds[1])), None
        return df.withColumn(a.column, F.when(c.isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), c.cast("double"))))), None
    if s == "null_text_sentinels" and declared_type(kind) in NUMERIC:
        return df, None
    return df.withColumn(a.column, text_transform(s, c, o)), None


def impute_dependency(df: DataFrame, determinant: str, dependent: str, min_support: int = 2) -> DataFrame:
    """Nulls of ``dependent`` filled by what the determinant's value implies, where it implies one value only."""
    d, y = F.col(f"`{determinant}`"), F.col(f"`{dependent}`")
    known = df.where(d.isNotNull() & y.isNotNull()).groupBy(d.alias("_d")).agg(F.min(y).alias("_y"), F.max(y).alias("_z"), F.count("*").alias("_n"))
    if known.where(F.col("_y") != F.col("_z")).take(1):
        raise ValueError(f"{determinant} doesn't determine {dependent}")
    filled = df.join(known.where(F.col("_n") >= min_support).select("_d", "_y"), d == F.col("_d"), "left")
    return filled.select(*[F.coalesce(y, F.col("_y")).alias(c) if c == dependent else F.col(f"`{c}`") for c in df.columns])


def apply_cleaning(plan: CleaningPlan, df: DataFrame, allow_removal: bool = False, key: list[str] | None = None, check: bool = False) -> CleaningResult:
    """Plans the chosen actions in order. An action that fails is logged and leaves the table as it was; the rest go on.

    Actions are lazy: what only fails on rows shows when the result is read. With ``check`` each action is run over all
    rows as soon as it is planned (a pass each), so that such failures are logged too.
    """
    log, removed = [], None
    for a in (a for a in plan.actions if a.chosen):
        entry = {"strategy": a.strategy, "column": a.column, "state": "done", "reason": None}
        if a.blocked:
            entry |= {"state": "blocked", "reason": f"needs {a.blocked}"}
        elif a.destructive and not allow_removal:
            entry |= {"state": "refused", "reason": "removal needs a second consent"}
        else:
            try:
                made, gone = _run(df, a, key)
                if check:
                    made.write.format("noop").mode("overwrite").save()
                df = made
                if gone is not None:
                    removed = gone if removed is None else removed.unionByName(gone, allowMissingColumns=True)
            except Exception as e:  # noqa: BLE001 - each action stands alone, by contract
                entry |= {"state": "failed", "reason": str(e)[:200]}
        log.append(entry)
    return CleaningResult(df, removed, log)


def guide_cleaning(plan: CleaningPlan, df: DataFrame, select=None, max_examples: int = 5) -> CleaningPlan:
    """Walks through the plan's groups; ``select(group, actions, examples)`` returns the strategy to choose, or None."""
    from plumbline.operators.findings import sample_values

    for group in dict.fromkeys(a.group for a in plan.actions if a.strategy != "review"):
        actions = [a for a in plan.actions if a.group == group]
        column = actions[0].column
        examples = sample_values(df, column, max_examples) if column in df.columns else []
        choice = select(group, actions, examples) if select else next((a.strategy for a in actions if a.recommended and not a.blocked), None)
        if choice:
            plan = plan.choose(choice, column)
    return plan
