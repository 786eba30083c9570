"""Column and table profiles: one aggregate pass plus one pass over value counts, whatever the number of columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import missing, text
from plumbline.plans.aggplan import aggregate, as_number, modes_of_counts, quantiles_of_counts, value_counts
from plumbline.schemas import NUMERIC, TEMPORAL, declared_type

#: Groups of figures that each mode computes.
MODES = {
    "exact": ("counts", "basics", "deviation", "distinct", "mode", "median"),
    "safe": ("counts", "basics", "deviation"),
    "counts": ("counts",),
    "sampled": ("counts", "basics", "deviation", "distinct", "mode", "median"),
    "approximate": ("counts", "basics", "deviation", "distinct", "mode", "median"),
}

PROFILE = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("declared_type", T.StringType()),
        *(T.StructField(n, T.LongType()) for n in ("n", "n_applicable", "n_not_applicable", "n_undetermined", "n_present_outside", "n_missing")),
        T.StructField("missing_rate", T.DoubleType()),
        *(T.StructField(n, T.LongType()) for n in ("n_disguised", "n_disguised_text", "n_disguised_number", "n_missing_total")),
        T.StructField("missing_total_rate", T.DoubleType()),
        T.StructField("n_distinct", T.LongType()),
        T.StructField("distinct_rate", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("mode_n", T.LongType()),
        T.StructField("length_min", T.LongType()),
        T.StructField("length_max", T.LongType()),
        T.StructField("length_mean", T.DoubleType()),
        *(T.StructField(n, T.DoubleType()) for n in ("min", "max", "mean", "median", "stddev", "q1", "q3")),
        *(T.StructField(n, T.StringType()) for n in ("min_exact", "max_exact", "min_date", "max_date")),
        *(T.StructField(n, T.LongType()) for n in ("n_zeros", "n_negatives", "n_outliers", "n_nan", "n_pos_inf", "n_neg_inf")),
        *(T.StructField(n, T.LongType()) for n in ("n_blanks", "n_border_spaces", "n_invisible_controls", "n_invisible_spaces", "n_meaningful_invisibles", "n_html_entities", "n_field_separators", "n_broken_encoding", "n_number_text")),
        T.StructField("dense_sequence", T.BooleanType()),
        T.StructField("sequence_density", T.DoubleType()),
        T.StructField("sequence_gaps", T.LongType()),
        T.StructField("state", T.StringType()),
    ]
)


@dataclass
class Profile:
    """A table's profile: one dict per column, table figures, findings and coverage rows."""

    name: str
    general: dict
    columns: list[dict]
    findings: list[dict] = field(default_factory=list)
    coverage: list[dict] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def column(self, name: str) -> dict:
        return next(c for c in self.columns if c["column"] == name)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The columns' profile as a DataFrame of the fixed schema."""
        rows = [tuple(c.get(f.name) for f in PROFILE.fields) for c in self.columns]
        return spark.createDataFrame(rows, PROFILE)


def columns(profile: Profile) -> list[dict]:
    return profile.columns


def findings(profile: Profile) -> list[dict]:
    return profile.findings


def coverage(profile: Profile) -> list[dict]:
    return profile.coverage


def row_count(profile: Profile) -> int:
    return profile.general["n_rows"]


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _finite(c: Column, kind: T.DataType) -> Column:
    """The column as a double, null where it isn't finite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d) if isinstance(kind, (T.FloatType, T.DoubleType)) else d


def column_expressions(df: DataFrame, name: str, groups: tuple[str, ...], applicable: str | Column | None = None, number_sentinels: tuple[float, ...] = missing.NUMBER_SENTINELS) -> dict[str, Column]:
    """One column's figures that a single aggregate pass gives, by name."""
    kind, raw = df.schema[name].dataType, F.col(f"`{name}`")
    declared = declared_type(kind)
    yes, no, unknown, outside = missing.applicability(applicable, raw, kind)
    c = raw if applicable is None else F.when(yes, raw)
    lost = missing.is_missing(c, kind)
    if applicable is None:
        # all rows are: nothing but the rows is to be counted, once for all columns
        out = {"n_missing": _count(lost)}
    else:
        out = {"n_applicable": _count(yes), "n_not_applicable": _count(no), "n_undetermined": _count(unknown), "n_present_outside": _count(outside), "n_missing": _count(yes & lost)}
    if declared == "text":
        out["n_disguised_text"] = _count(missing.is_text_sentinel(c) & (F.length(F.trim(c)) > 0))
        out["n_disguised_number"] = _count(F.coalesce(F.trim(c).try_cast("double").isin(*number_sentinels), F.lit(False)))
    elif declared in NUMERIC:
        out["n_disguised_number"] = _count(c.cast("double").isin(*number_sentinels))
    if "basics" in groups:
        if declared in NUMERIC:
            d = _finite(c, kind)
            out |= {"mean": F.avg(d), "n_zeros": _count(d == 0), "n_negatives": _count(d < 0)}
            if declared == "integer" or isinstance(kind, T.DecimalType):
                # their doubles follow from these
                out |= {"min_exact": F.min(c).cast("string"), "max_exact": F.max(c).cast("string")}
            else:
                out |= {"min": F.min(d), "max": F.max(d)}
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                out |= {"n_nan": _count(F.isnan(c)), "n_pos_inf": _count(c == float("inf")), "n_neg_inf": _count(c == float("-inf"))}
        elif declared in TEMPORAL:
            out |= {"min_date": F.min(c).cast("string"), "max_date": F.max(c).cast("string")}
        elif declared == "text":
            n = F.length(c).cast("long")
            out |= {"length_min": F.min(n), "length_max": F.max(n), "length_mean": F.avg(n)}
            out |= {f"n_{k}": _count(flag) for k, flag in text.hygiene_flags(c).items()}
            out["n_number_text"] = _count(c.rlike(text.NUMBER_TEXT))
    if "deviation" in groups and declared in NUMERIC:
        out["stddev"] = F.stddev_samp(_finite(c, kind))
    return out


def _decode_number(value: float | None, kind: T.DataType) -> str | None:
    """A mode's text from its double form."""
    import datetime

    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return str(bool(value)).lower()
    if isinstance(kind, T.DateType):
        return str(datetime.date(1970, 1, 1) + datetime.timedelta(days=int(value)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return str(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=int(value)))
    return repr(value)


def profile_columns(
    df: DataFrame,
    mode: str = "exact",
    columns: list[str] | None = None,
    applicability: dict[str, str | Column] | None = None,
    number_sentinels: tuple[float, ...] = missing.NUMBER_SENTINELS,
    dense_min_distinct: int = 20,
    dense_threshold: float = 0.8,
    iqr_factor: float = 1.5,
    fraction: float = 0.1,
    seed: int = 42,
    optional: list[str] | None = None,
) -> list[dict]:
    """The columns' profile rows, as dicts in the table's column order.

    ``exact`` computes all; ``safe`` nothing that sorts or groups; ``counts`` only counts; ``sampled`` all on a
    Bernoulli sample, with counts scaled to the table (distinct counts are not); ``approximate`` uses sketches for
    distinct counts and medians, so nothing but one row is shuffled. What a mode doesn't measure is None, never 0.
    The universe of an ``optional`` column is its present cells.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    groups, names = MODES[mode], columns or df.columns
    applicability = {n: F.col(f"`{n}`").isNotNull() for n in optional or []} | (applicability or {})
    total = None
    source = df
    if mode == "sampled":
        total = df.count()
        source = df.sample(fraction=fraction, seed=seed)
    analysed = [n for n in names if declared_type(df.schema[n].dataType) not in ("composite", "binary", "duration")]
    masked = source.select(*[(F.when(missing.applicability(applicability[n], F.col(f"`{n}`"), df.schema[n].dataType)[0], F.col(f"`{n}`")).alias(n) if n in applicability else F.col(f"`{n}`")) for n in names])
    expressions = {}
    for n in names:
        for k, e in column_expressions(source, n, groups, applicability.get(n), number_sentinels).items():
            expressions[f"{n}\0{k}"] = e
        kind = df.schema[n].dataType
        if mode == "approximate" and n in analysed:
            c = masked_column(n, applicability, df)
            expressions[f"{n}\0n_distinct"] = F.approx_count_distinct(c)
            number = as_number(c, kind)
            if number is not None and declared_type(kind) in NUMERIC:
                expressions[f"{n}\0quartiles"] = F.percentile_approx(_finite(c, kind), [0.25, 0.5, 0.75], 10_000)
    values = aggregate(source, expressions | {"\0n": F.count(F.lit(1))})
    n_rows = values.pop("\0n")
    every = {"n": n_rows, "n_applicable": n_rows, "n_not_applicable": 0, "n_undetermined": 0, "n_present_outside": 0}
    rows = {n: {"column": n, "declared_type": declared_type(df.schema[n].dataType), "state": "computed"} | every for n in names}
    for key, v in values.items():
        n, k = key.split("\0")
        rows[n][k] = v
        if k in ("min_exact", "max_exact"):
            rows[n][k[:3]] = None if v is None else float(v)
    if "distinct" in groups and mode != "approximate" and analysed:
        counts = value_counts(masked, analysed).persist()
        try:
            for r in modes_of_counts(counts).collect():
                row, kind = rows[r["column"]], df.schema[r["column"]].dataType
                row["n_distinct"], row["mode_n"] = r["n_distinct"], r["mode_n"]
                whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(kind, T.DecimalType) and r["mode_exact"] is not None
                row["mode"] = r["mode_text"] if r["mode_text"] is not None else r["mode_exact"] if whole else _decode_number(r["mode_number"], kind)
            numeric = [n for n in analysed if declared_type(df.schema[n].dataType) in NUMERIC]
            if numeric:
                for r in quantiles_of_counts(counts.where(F.col("column").isin(*numeric)), [0.25, 0.5, 0.75]).collect():
                    rows[r["column"]][{0.25: "q1", 0.5: "median", 0.75: "q3"}[r["probability"]]] = r["value"]
                fences = {n: (r["q1"] - iqr_factor * (r["q3"] - r["q1"]), r["q3"] + iqr_factor * (r["q3"] - r["q1"])) for n in numeric if (r := rows[n]).get("q1") is not None}
                if fences:
                    out_of = F.lit(False)
                    for n, (low, high) in fences.items():
                        out_of = out_of | ((F.col("column") == n) & ((F.col("number") < low) | (F.col("number") > high)))
                    outliers = {r[0]: r[1] for r in counts.where(out_of).groupBy("column").agg(F.sum("n")).collect()}
                    for n in fences:
                        rows[n]["n_outliers"] = outliers.get(n, 0)
        finally:
            counts.unpersist()
        for n in analysed:
            if rows[n].get("n_distinct") is None:
                rows[n] |= {"n_distinct": 0, "mode_n": 0}
    for n in names:
        row, kind = rows[n], df.schema[n].dataType
        if quartiles := row.pop("quartiles", None):
            row["q1"], row["median"], row["q3"] = quartiles
        _derive(row, kind, dense_min_distinct, dense_threshold)
        if n not in analysed:
            row["state"] = "not_applicable"
        elif mode == "approximate":
            row["state"] = "estimated"
        elif total is not None:
            _scale(row, total)
    return [rows[n] for n in names]


def masked_column(name: str, applicability: dict, df: DataFrame) -> Column:
    """A column, null where it doesn't apply."""
    c = F.col(f"`{name}`")
    return F.when(missing.applicability(applicability[name], c, df.schema[name].dataType)[0], c) if name in applicability else c


def _derive(row: dict, kind: T.DataType, dense_min_distinct: int, dense_threshold: float) -> None:
    applicable = row["n_applicable"]
    valid = applicable - row["n_missing"]
    distinct, low, high = row.get("n_distinct"), row.get("min"), row.get("max")
    if row["declared_type"] == "integer" and distinct is not None and low is not None:
        span = int(row.get("max_exact") or high) - int(row.get("min_exact") or low) + 1
        row["sequence_density"] = distinct / span
        row["sequence_gaps"] = span - distinct
        row["dense_sequence"] = distinct >= dense_min_distinct and row["sequence_density"] >= dense_threshold
    numbers = row.get("n_disguised_number")
    if row.get("dense_sequence"):
        numbers = row["n_disguised_number"] = 0
    if numbers is not None or row.get("n_disguised_text") is not None:
        blanks = row.get("n_blanks") or 0
        row["n_disguised"] = (numbers or 0) + (row.get("n_disguised_text") or 0) + blanks
    row["n_missing_total"] = row["n_missing"] + (row.get("n_disguised") or 0)
    row["missing_rate"] = row["n_missing"] / applicable if applicable else None
    row["missing_total_rate"] = row["n_missing_total"] / applicable if applicable else None
    if distinct is not None:
        row["distinct_rate"] = distinct / valid if valid else None


def _scale(row: dict, total: int) -> None:
    """Scales a sample's counts to the table; distinct values and modes stay as observed."""
    seen = row["n"]
    for k, v in row.items():
        if k.startswith("n_") and k not in ("n_distinct",) and v is not None and seen:
            row[k] = round(v * total / seen)
    row["n"], row["state"] = total, "estimated"


def table_overview(df: DataFrame, key: list[str] | None = None) -> dict:
    """Rows, columns, cells, complete rows, surplus duplicate rows and rows in duplicate groups (null equals null)."""
    names = df.columns
    whole = F.lit(True)
    for n in names:
        whole = whole & ~missing.is_missing(F.col(f"`{n}`"), df.schema[n].dataType)
    # equal rows meet by two hashes of all columns, so that 16 bytes a row are shuffled, not the row
    comparable = [F.to_json(F.struct(F.col(f"`{n}`"))) if isinstance(df.schema[n].dataType, T.MapType) else F.col(f"`{n}`") for n in names]
    nulls = F.concat(*[F.col(f"`{n}`").isNull().cast("string") for n in names])
    keyed = df.select(F.xxhash64(nulls, *comparable).alias("h"), F.xxhash64(F.lit(1), nulls, *comparable).alias("g"), whole.alias("whole"))
    groups = keyed.groupBy("h", "g").agg(F.count("*").alias("n"), _count(F.col("whole")).alias("whole"))
    r = groups.agg(F.sum("n"), F.sum("whole"), F.sum(F.col("n") - 1), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))).first()
    n = r[0] or 0
    return {"n_rows": n, "n_columns": len(names), "n_cells": n * len(names), "n_complete": r[1] or 0, "n_surplus": r[2] or 0, "n_in_duplicates": r[3] or 0}


def profile_by(df: DataFrame, by: str, columns: list[str] | None = None, min_rows: int = 30) -> DataFrame:
    """Profiles within groups, in one shuffle: ``group``, ``column``, ``n``, ``n_missing``, ``n_distinct``, ``min``, ``max``, ``mean``.

    Null groups are ``(missing)``; groups under ``min_rows`` are left out; so are columns without any value in a group.
    """
    names = [c for c in (columns or df.columns) if c != by]
    cells = []
    for n in names:
        kind, c = df.schema[n].dataType, F.col(f"`{n}`")
        number = as_number(c, kind)
        cells.append(F.struct(F.lit(n).alias("column"), missing.is_missing(c, kind).alias("lost"), (number if number is not None else F.lit(None).cast("double")).alias("number"), c.cast("string").alias("text")))
    long = df.select(F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("(missing)")).alias("group"), F.explode(F.array(*cells)).alias("c")).select("group", "c.*")
    values = long.groupBy("group", "column", "lost", "number", "text").agg(F.count("*").alias("n"))
    some = ~F.col("lost")
    out = values.groupBy("group", "column").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("lost"), F.col("n"))), F.lit(0)).alias("n_missing"),
        _count(some).alias("n_distinct"),
        F.min(F.when(some, F.col("number"))).alias("min"),
        F.max(F.when(some, F.col("number"))).alias("max"),
        (F.sum(F.when(some, F.col("number") * F.col("n"))) / F.sum(F.when(some & F.col("number").isNotNull(), F.col("n")))).alias("mean"),
    )
    return out.where((F.col("n") >= min_rows) & (F.col("n_missing") < F.col("n")))
