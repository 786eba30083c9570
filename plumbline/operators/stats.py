"""Statistics across columns and time: distributions, associations, temporal regularity, profile drift."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.missing import is_missing
from plumbline.plans.aggplan import aggregate, quantiles_of_counts, ranks_of_counts, value_counts
from plumbline.schemas import NUMERIC, declared_type

QUARTILES = tuple(k / 4 for k in range(5))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 20) -> DataFrame:
    """The k most frequent values of each column, as text: ``column``, ``value``, ``n``, ``share``, ``rank``; ties to the smaller text."""
    names = columns or df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])).alias("c")
    counts = df.select(cells).select("c.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    # a rank limit within the window's group: each task keeps k rows a column before the shuffle
    of = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    best = counts.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k)
    return best.join(F.broadcast(totals), "column").select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"), "rank")


def quantiles(df: DataFrame, columns: list[str] | None = None, probabilities: list[float] = QUARTILES) -> DataFrame:
    """Exact type-7 quantiles of the finite values: ``column``, ``probability``, ``value``."""
    names = columns or [n for n in df.columns if declared_type(df.schema[n].dataType) in NUMERIC]
    return quantiles_of_counts(value_counts(df, names), list(probabilities))


def value_distribution(df: DataFrame, k: int = 20, probabilities: list[float] = QUARTILES) -> tuple[DataFrame, DataFrame]:
    """Top values of all columns and quantiles of the numeric ones."""
    return top_values(df, None, k), quantiles(df, None, probabilities)


def _with_ranks(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with each column's average ranks as ``rank_<i>``; ranks are made for all columns together, by ranges of values."""
    ranks = ranks_of_counts(value_counts(df, names))
    out = df
    for i, n in enumerate(names):
        own = ranks.where(F.col("column") == n).select(F.col("number").alias(f"value_{i}"), F.col("rank").alias(f"rank_{i}"))
        out = out.join(own, F.col(n) == F.col(f"value_{i}"), "left")
    return out.select([f"rank_{i}" for i in range(len(names))])


def _spearman(df: DataFrame, names: list[str]) -> dict[tuple[str, str], tuple[int, float | None]]:
    """Spearman's coefficient of each pair over its complete rows: at once for the columns without gaps, and by pair for the others."""
    out: dict[tuple[str, str], tuple[int, float | None]] = {}
    # zero has one form, and what is not finite is a gap
    clean = {n: F.col(f"`{n}`").cast("double") for n in names}
    clean = {n: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.when(c == 0, 0.0).otherwise(c)) for n, c in clean.items()}
    named = {n: f"v{i}" for i, n in enumerate(names)}
    rows = df.select(*[c.alias(named[n]) for n, c in clean.items()])
    held = aggregate(rows, {n: F.count(v) for n, v in named.items()} | {"\0n": F.count(F.lit(1))})
    full = [n for n in names if held[n] == held["\0n"]]
    groups = [full] if len(full) > 1 else []
    groups += [[a, b] for a, b in combinations(names, 2) if not (a in full and b in full)]
    for group in groups:
        part = rows.select([named[n] for n in group]).dropna()
        ranked = _with_ranks(part, [named[n] for n in group])
        at = {n: f"rank_{i}" for i, n in enumerate(group)}
        e = {f"{a}\0{b}": F.corr(at[a], at[b]) for a, b in combinations(group, 2)}
        got = aggregate(ranked, e | {"\0n": F.count(F.lit(1))})
        out |= {(a, b): (got["\0n"], got[f"{a}\0{b}"]) for a, b in combinations(group, 2)}
    return out


def correlations(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", min_rows: int = 3) -> DataFrame:
    """Pearson or Spearman correlation of each pair of numeric columns over complete rows, all pairs in one pass."""
    names = columns or [n for n in df.columns if declared_type(df.schema[n].dataType) in NUMERIC]
    spark = df.sparkSession
    schema = "a string, b string, method string, n long, value double"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    if method == "spearman":
        got = _spearman(df, names)
        return spark.createDataFrame([(a, b, method, n, value if n >= min_rows else None) for a, b in combinations(names, 2) for n, value in [got[a, b]]], schema)
    e = {}
    clean = {n: F.when(~F.isnan(F.col(f"`{n}`").cast("double")), F.col(f"`{n}`").cast("double")) for n in names}
    for a, b in combinations(names, 2):
        both = clean[a].isNotNull() & clean[b].isNotNull()
        e[f"{a}\0{b}\0n"], e[f"{a}\0{b}\0r"] = F.count(F.when(both, 1)), F.corr(F.when(both, clean[a]), F.when(both, clean[b]))
    got = aggregate(df, e)
    return spark.createDataFrame([(a, b, method, got[f"{a}\0{b}\0n"], got[f"{a}\0{b}\0r"] if got[f"{a}\0{b}\0n"] >= min_rows else None) for a, b in combinations(names, 2)], schema)


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramér's V of pairs of categorical columns over complete rows; one expanded contingency count for all pairs."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")) for a, b in pairs])).alias("c")
    counts = df.select(cells).select("c.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    pair, row, column = Window.partitionBy("a", "b"), Window.partitionBy("a", "b", "x"), Window.partitionBy("a", "b", "y")
    e = counts.withColumns({"n": F.sum("o").over(pair), "r": F.sum("o").over(row), "k": F.sum("o").over(column)})
    # chi-square over all cells of the table, empty ones included, is n (sum o^2 / (r k) - 1)
    return (
        e.groupBy("a", "b")
        .agg(F.max("n").alias("n"), (F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("k"))) - 1).alias("phi2"), F.countDistinct("x").alias("rows"), F.countDistinct("y").alias("columns"))
        .select("a", "b", F.lit("cramers_v").alias("method"), "n", F.when(F.least("rows", "columns") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("phi2")) / (F.least("rows", "columns") - 1))).alias("value"))
    )


def eta_squared(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of a number's variance between the groups of a category, for pairs (category, number)."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in pairs])).alias("c")
    rows = df.select(cells).select("c.*").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    groups = rows.groupBy("a", "b", "x").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    total = Window.partitionBy("a", "b")
    centred = groups.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total))
    between = F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    within = F.sum(F.col("n") * F.col("v"))
    return centred.groupBy("a", "b").agg(F.sum("n").alias("n"), (between / F.nullif(between + within, F.lit(0.0))).alias("value")).select("a", "b", F.lit("eta_squared").alias("method"), "n", "value")


def detect_associations(df: DataFrame, threshold: float = 0.3, method: str = "pearson", max_columns: int = 50, max_levels: int = 50, max_pairs: int = 500) -> DataFrame:
    """Associations of at least ``threshold``: numbers by correlation, categories by Cramér's V, mixed pairs by eta squared.

    ``association_coverage`` tells which columns the limits leave out.
    """
    names = df.columns[:max_columns]
    numeric = [n for n in names if declared_type(df.schema[n].dataType) in NUMERIC]
    other = [n for n in names if declared_type(df.schema[n].dataType) in ("text", "boolean")]
    sizes = aggregate(df, {n: F.approx_count_distinct(F.col(f"`{n}`")) for n in other} | {"\0n": F.count(F.lit(1))})
    cats = [n for n in other if 1 < sizes[n] <= max_levels and sizes[n] / max(1, sizes["\0n"]) < 0.8]
    out = correlations(df, numeric[: int((2 * max_pairs) ** 0.5) + 1], method)
    if len(cats) > 1:
        out = out.unionByName(cramers_v(df, list(combinations(cats, 2))[:max_pairs]))
    if cats and numeric:
        out = out.unionByName(eta_squared(df, [(c, n) for c in cats for n in numeric][:max_pairs]))
    return out.where(F.abs("value") >= threshold).orderBy(F.desc(F.abs("value")), "a", "b").limit(max_pairs)


def association_coverage(df: DataFrame, max_columns: int = 50, max_levels: int = 50, max_pairs: int = 500) -> list[dict]:
    """The columns that ``detect_associations`` leaves out with these limits, and why."""
    row = lambda c, reason, remedy: {"diagnostic": "associations", "column": c, "reason": reason, "remedy": remedy, "dependency": None}
    out = [row(c, f"beyond the first {max_columns} columns", "max_columns") for c in df.columns[max_columns:]]
    names = df.columns[:max_columns]
    numeric = [n for n in names if declared_type(df.schema[n].dataType) in NUMERIC]
    out += [row(c, f"beyond {max_pairs} pairs of numbers", "max_pairs") for c in numeric[int((2 * max_pairs) ** 0.5) + 1 :]]
    other = [n for n in names if declared_type(df.schema[n].dataType) in ("text", "boolean")]
    sizes = aggregate(df, {n: F.approx_count_distinct(F.col(f"`{n}`")) for n in other}) if other else {}
    return out + [row(c, f"more than {max_levels} levels", "max_levels") for c in other if sizes[c] > max_levels]


def weekday_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per ISO weekday of a date or time column."""
    day = (F.weekday(F.col(f"`{column}`")) + 1).alias("weekday")
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(day).agg(F.count("*").alias("n"))


def time_regularity(df: DataFrame, column: str, calendar: list[int] = (1, 2, 3, 4, 5, 6, 7), frequency_days: int | None = None) -> DataFrame:
    """One row on a column's civil dates: distinct dates, span, modal interval (ties to the shorter), its share, the share of the expected dates that exist, and confidence (the lesser share)."""
    days = df.where(F.col(f"`{column}`").isNotNull()).select(F.unix_date(F.col(f"`{column}`").cast("date")).alias("d")).distinct()
    steps = days.withColumn("step", F.col("d") - F.lag("d").over(Window.orderBy("d")))
    of_steps = steps.where("step IS NOT NULL").groupBy("step").agg(F.count("*").alias("n"))
    modal = of_steps.agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("modal"), (F.max("n") / F.sum("n")).alias("contiguity"))
    span = days.agg(F.count("*").alias("n_dates"), F.min("d").alias("first"), F.max("d").alias("last"))
    frequency = F.lit(frequency_days) if frequency_days else F.coalesce("modal", F.lit(1))
    both = span.crossJoin(modal).withColumn("frequency_days", frequency.cast("int"))
    grid = both.where("n_dates > 0").select(F.explode(F.sequence("first", "last", "frequency_days")).alias("d"))
    grid = grid.where((F.weekday(F.date_from_unix_date("d")) + 1).isin(*calendar))
    met = grid.join(days.withColumn("seen", F.lit(1)), "d", "left").agg(F.count("*").alias("n_expected"), F.count("seen").alias("n_seen"))
    out = both.crossJoin(met)
    share = F.col("n_seen") / F.nullif(F.col("n_expected"), F.lit(0))
    return out.select("n_dates", F.date_from_unix_date("first").alias("first_date"), F.date_from_unix_date("last").alias("last_date"), "frequency_days", "contiguity", "n_expected", share.alias("coverage"), F.least("contiguity", share).alias("confidence"))


def time_gaps(df: DataFrame, column: str, frequency_days: int = 1, calendar: list[int] = (1, 2, 3, 4, 5, 6, 7)) -> DataFrame:
    """Runs of expected dates that are missing: ``gap_start``, ``gap_end``, ``n_days``."""
    days = df.where(F.col(f"`{column}`").isNotNull()).select(F.unix_date(F.col(f"`{column}`").cast("date")).alias("d")).distinct()
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a IS NOT NULL")
    grid = span.select(F.posexplode(F.sequence("a", "b", F.lit(frequency_days))).alias("i", "d")).where((F.weekday(F.date_from_unix_date("d")) + 1).isin(*calendar))
    order = Window.orderBy("d")
    missing = grid.withColumn("i", F.row_number().over(order)).join(days, "d", "left_anti")
    runs = missing.withColumn("run", F.col("i") - F.row_number().over(order))
    return runs.groupBy("run").agg(F.date_from_unix_date(F.min("d")).alias("gap_start"), F.date_from_unix_date(F.max("d")).alias("gap_end"), F.count("*").alias("n_days")).drop("run")


def monotonicity(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The share of rows, in a declared order, whose date is not before the last one's."""
    c = F.unix_date(F.col(f"`{column}`").cast("date"))
    rows = df.where(F.col(f"`{column}`").isNotNull()).select(c.alias("d"), F.lag(c).over(Window.orderBy(*order)).alias("p"))
    return rows.agg(F.count("p").alias("n_steps"), F.avg(F.when(F.col("p").isNotNull(), (F.col("d") >= F.col("p")).cast("double"))).alias("monotonic"))


def analyze_time(df: DataFrame, column: str, **options) -> dict[str, DataFrame]:
    """Regularity, weekdays and gaps of a date column."""
    return {"regularity": time_regularity(df, column, **options), "weekdays": weekday_counts(df, column), "gaps": time_gaps(df, column)}


def compare_profiles(before: DataFrame, after: DataFrame, change: float = 0.05, error: float = 0.20) -> DataFrame:
    """Drift between two column profiles (as DataFrames): one row per column and aspect that changed, with a severity."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, "column", "full")
    aspects = []

    def add(name, before_value, after_value, severity):
        aspects.append(F.struct(F.lit(name).alias("aspect"), before_value.cast("string").alias("before"), after_value.cast("string").alias("after"), severity.alias("severity")))

    gone, new = F.col("b.declared_type").isNull(), F.col("a.declared_type").isNull()
    add("schema", F.when(~new, F.col("column")), F.when(~gone, F.col("column")), F.when(gone, "error").when(new, "suspicious"))
    add("type", F.col("a.declared_type"), F.col("b.declared_type"), F.when(~gone & ~new & (F.col("a.declared_type") != F.col("b.declared_type")), "error"))

    def level(delta):
        return F.when(F.abs(delta) > error, "error").when(F.abs(delta) > change, "suspicious")

    for name in ("missing_rate", "distinct_rate"):
        add(name, F.round(F.col(f"a.{name}"), 6), F.round(F.col(f"b.{name}"), 6), level(F.col(f"b.{name}") - F.col(f"a.{name}")))
    width = F.greatest(F.col("a.max") - F.col("a.min"), F.lit(1e-12))
    add("min", F.col("a.min"), F.col("b.min"), level((F.col("a.min") - F.col("b.min")) / width))
    add("max", F.col("a.max"), F.col("b.max"), level((F.col("b.max") - F.col("a.max")) / width))
    return both.select("column", F.explode(F.array(*aspects)).alias("x")).select("column", "x.*").where("severity IS NOT NULL")
