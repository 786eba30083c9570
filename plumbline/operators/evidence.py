"""Guards and evidence: figures that can't be, absence that a threshold or a rule explains, visible text, ranges of birth dates, work within a budget, drift of shapes and findings."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.aggplan import RANGE_VALUES, aggregate, in_ranges

#: The code points that evidence shows as <U+XXXX>: controls, soft hyphen, joiners, direction marks, variation selectors, byte order mark.
INVISIBLE = r"[\x00-\x08\x0E-\x1F\x7F-\x9F­؜​-‏ -‮⁠-⁤⁦-⁯︀-️﻿]"


def guard_impossible(row: dict) -> tuple[dict, list[dict]]:
    """A profile row without the figures that can't be, and a coverage row with the reason for each.

    More distinct values, or rows of the mode, than valid cells; a greatest value under the least; and doubles of integers beyond 2^53,
    whose exact forms stay.
    """
    out, why = dict(row), []
    valid = row["n_applicable"] - row["n_missing"]

    def lost(fields: tuple[str, ...], reason: str) -> None:
        for f in fields:
            if out.get(f) is not None:
                out[f] = None
                why.append({"diagnostic": f, "column": row["column"], "reason": reason, "remedy": "read the column in a type that holds its values", "dependency": None})

    if (row.get("n_distinct") or 0) > valid:
        lost(("n_distinct", "distinct_rate"), "more_distinct_than_valid")
    if (row.get("mode_n") or 0) > valid:
        lost(("mode", "mode_n"), "mode_more_frequent_than_valid")
    if row.get("min") is not None and row.get("max") is not None and row["max"] < row["min"]:
        lost(("min", "max", "min_exact", "max_exact"), "greatest_under_least")
    if row.get("declared_type") == "integer" and row.get("max_exact") and max(abs(int(row["max_exact"])), abs(int(row["min_exact"]))) > 2**53:
        lost(("min", "max", "median", "q1", "q3"), "integer_beyond_double")
    return out, why


def visible(column: Column) -> Column:
    """A text with tabs, line ends and invisible characters written out."""
    names = {"\t": "\\t", "\n": "\\n", "\x0b": "\\v", "\x0c": "\\f", "\r": "\\r"}

    def one(c: Column) -> Column:
        out = F.when(c.rlike(INVISIBLE), F.concat(F.lit("<U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(">")))
        for raw, name in names.items():
            out = out.when(c == raw, F.lit(name))
        return out.otherwise(c)

    return F.when(column.rlike(INVISIBLE + "|[\\t\\n\\x0B\\f\\r]"), F.array_join(F.transform(F.split(column, ""), one), "")).otherwise(column)


def birth_date_range(df: DataFrame, column: str, today: datetime.date, first: datetime.date = datetime.date(1900, 1, 1)) -> DataFrame:
    """One row on a column of birth dates: dates before ``first`` and after ``today``, and the severity; the dates themselves are not told."""
    d = F.col(f"`{column}`").cast("date")
    out = df.agg(F.count(d).alias("n"), F.count(F.when(d < F.lit(first), 1)).alias("n_before"), F.count(F.when(d > F.lit(today), 1)).alias("n_after"))
    return out.select(F.lit(column).alias("column"), "n", "n_before", "n_after", F.when(F.col("n_after") > 0, "error").when(F.col("n_before") > 0, "suspicious").otherwise("ok").alias("severity"))


def silenced_absence(df: DataFrame, rules: dict[str, str | Column], least: float = 0.5) -> list[dict]:
    """Columns that a declared rule keeps from counting as incomplete although, within the rule or by it, most cells are absent.

    One pass: cells absent in all, applicable cells, and absent ones among these.
    """
    e = {}
    for n, rule in rules.items():
        p = F.expr(rule) if isinstance(rule, str) else rule
        absent = F.col(f"`{n}`").isNull()
        e |= {f"{n}\0all": F.count(F.when(absent, 1)), f"{n}\0of": F.count(F.when(p, 1)), f"{n}\0in": F.count(F.when(p & absent, 1)), f"{n}\0n": F.count(F.lit(1))}
    got = aggregate(df, e) if e else {}
    out = []
    for n in rules:
        whole, of, inside, rows = (got[f"{n}\0{k}"] for k in ("all", "of", "in", "n"))
        if whole and (inside > least * of if of else True):
            out.append({"column": n, "finding": "rule_silences_absence", "severity": "ok", "n_rows": rows, "n_absent": whole, "n_applicable": of, "n_absent_applicable": inside})
    return out


def absence_threshold(df: DataFrame, column: str, by: str, least: float = 0.99, least_side: float = 0.05, max_cuts: int = 200) -> dict | None:
    """The cut of a numeric column that best tells where another one is absent: absent at ``>=`` the cut or ``<`` it.

    Cuts are all the values where there are at most ``max_cuts``, else as many quantiles; all are judged by one pass over the counts of values.
    """
    absent, x = F.col(f"`{column}`").isNull(), F.col(f"`{by}`").cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.count("*").alias("n"), F.count(F.when(absent, 1)).alias("absent"))
    size = counts.agg(F.count("*"), F.sum("n"), F.sum("absent")).first()
    if not size[0] or size[0] < 2:
        return None
    if size[0] <= max_cuts:
        cuts = sorted(r[0] for r in counts.select("x").collect())
    else:
        cuts = sorted(set(df.agg(F.percentile_approx(x, [k / max_cuts for k in range(1, max_cuts)], 10_000)).first()[0]))
    n, lost = size[1], size[2]
    below = counts.agg(*[F.sum(F.when(F.col("x") < c, F.col(v)).otherwise(0)).alias(f"{v}{i}") for i, c in enumerate(cuts) for v in ("n", "absent")]).first()
    best = None
    for i, c in enumerate(cuts):
        under, gone = below[f"n{i}"], below[f"absent{i}"]
        # absent from the cut on: absent ones above it and present ones under it are right
        for sense, right in ((">=", (lost - gone) + (under - gone)), ("<", gone + (n - under) - (lost - gone))):
            if min(under, n - under) >= least_side * n and (best is None or right > best["n_right"]):
                best = {"column": column, "by": by, "sense": sense, "cut": c, "n": n, "n_right": right}
    return best | {"compliance": best["n_right"] / n} if best and best["n_right"] >= least * n else None


def _within_reach(sums: list[tuple], budget: float) -> list[tuple]:
    """Of ranges in their order (``range``, sum ``m`` and sum of negative costs ``down``, null without any), those in which a running cost may be within the budget, each with the sum ``before`` it."""
    out, before = [], None
    with decimal.localcontext(prec=80):
        for k, m, down in sums:
            start, fall = float(before or 0), float(down or 0)
            # doubles may differ in their last digits; what comes along too much is left out later
            if start + fall <= float(budget) + 1e-9 * (abs(start) + abs(fall) + abs(float(budget))):
                out.append((k, before))
            if m is not None:
                before = m if before is None else before + m
    return out


def within_budget(df: DataFrame, order: str, cost: str, budget: float, range_values: int = RANGE_VALUES) -> DataFrame:
    """The rows, in the order of a numeric column, whose running cost stays within a budget: ``df``'s columns and ``running``.

    Equal places of the order share one running sum; null costs add nothing. One pass sums each range of the order, and its negative costs apart, which
    bound from below what any running sum in it can be: only the rows of ranges that may come within the budget are summed one by one and
    shuffled, by range, so that no task has all rows.
    """
    at, c = F.col(f"`{order}`"), F.col(f"`{cost}`")
    rows = df.where(at.isNotNull()).select(F.lit("o").alias("column"), at.cast("double").alias("number"), at.alias("at"), c.alias("cost"), F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row"))
    n_rows = rows.count()
    if not n_rows:
        return df.limit(0).withColumn("running", F.lit(None).cast("double"))
    placed = in_ranges(rows, {"o": (n_rows, n_rows)}, range_values)
    sums = placed.groupBy("range").agg(F.sum("cost").alias("m"), F.sum(F.when(F.col("cost") < 0, F.col("cost"))).alias("down"))
    held = _within_reach(sorted(map(tuple, sums.collect())), budget)
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("before", sums.schema["m"].dataType)])
    near = placed.join(F.broadcast(df.sparkSession.createDataFrame(held, schema)), "range")
    steps = near.groupBy("range", "before", "at").agg(F.sum("cost").alias("n"))
    own = F.sum("n").over(Window.partitionBy("range").orderBy("at"))
    running = steps.select("range", "at", F.coalesce(F.col("before") + own, "before", own).alias("running")).where(F.col("running") <= budget)
    return near.select("range", "at", "row").join(running, ["range", "at"]).select("row.*", "running")


def compare_patterns(before: DataFrame, after: DataFrame, change: float = 0.05, error: float = 0.20) -> DataFrame:
    """Drift of a column's shapes (``pattern``, ``share``): ``pattern``, ``before``, ``after``, ``state`` (new, gone, changed) and ``severity``."""
    a, b = before.select("pattern", F.col("share").alias("before")), after.select("pattern", F.col("share").alias("after"))
    both = a.join(b, "pattern", "full")
    delta = F.abs(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(delta > change, "changed")
    return both.withColumn("state", state).where("state IS NOT NULL").withColumn("severity", F.when(delta > error, "error").otherwise("suspicious"))


def compare_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings (``column``, ``finding``, ``n_affected``) that are new, gone, or affect another number of rows."""
    a, b = before.select("column", "finding", F.col("n_affected").alias("before")), after.select("column", "finding", F.col("n_affected").alias("after"))
    met = a.withColumn("_a", F.lit(1)).alias("a").join(b.withColumn("_b", F.lit(1)).alias("b"), F.col("a.column").eqNullSafe(F.col("b.column")) & (F.col("a.finding") == F.col("b.finding")), "full")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return met.select(F.coalesce("a.column", "b.column").alias("column"), F.coalesce("a.finding", "b.finding").alias("finding"), "before", "after", state.alias("state")).where("state IS NOT NULL")
