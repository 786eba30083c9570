"""Aggregate planning: many named expressions in few passes, value counts of many columns in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Above this many expressions generated code outgrows what the JIT compiles well, and its fields the limit of whole-stage code. Passes
#: take the expressions in order, so each reads only the columns that its own are about.
MAX_EXPRESSIONS = 40


def aggregate(df: DataFrame, expressions: dict[str, Column]) -> dict:
    """All expressions' values, in as many passes as ``MAX_EXPRESSIONS`` asks for."""
    out: dict = {}
    names = list(expressions)
    for k in range(0, len(names), MAX_EXPRESSIONS):
        part = names[k : k + MAX_EXPRESSIONS]
        row = df.agg(*[expressions[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[i] for i, n in enumerate(part)})
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each column's distinct non-null values, in one pass and one shuffle: ``column``, ``number``, ``text``, ``exact``, ``n``.

    Numbers, dates and booleans are in ``number`` (dates as days, times as microseconds), texts in ``text``; NaN
    and infinities are left out. Integers and wide decimals are told apart as they are, not as doubles, and have all
    their digits in ``exact``. Rows are expanded by column but counted map-side, so what is shuffled is bounded
    by the distinct values of each partition.
    """
    schema = "column string, number double, text string, exact string, n long"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    parts, wide = [], []
    for i, name in enumerate(columns):
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        number, whole, text = F.lit(None).cast("double"), as_whole(c, kind), F.lit(None).cast("string")
        if whole is None and isinstance(kind, T.DecimalType) and kind.precision > 15:
            text = c.cast("string")
            wide.append(i)
        elif whole is None:
            whole = F.lit(None).cast("long")
            number = as_number(c, kind)
            if number is None:
                number, text = F.lit(None).cast("double"), c.cast("string")
            else:
                number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
        parts.append(F.struct(F.lit(i).alias("i"), number.alias("number"), (F.lit(None).cast("long") if whole is None else whole).alias("whole"), text.alias("text")))
    long = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*")
    counted = long.where("number IS NOT NULL OR whole IS NOT NULL OR text IS NOT NULL").groupBy("i", "number", "whole", "text").agg(F.count("*").alias("n"))
    is_wide = F.col("i").isin(wide) if wide else F.lit(False)
    return counted.select(
        F.array(*[F.lit(c) for c in columns])[F.col("i")].alias("column"),
        F.coalesce("number", F.col("whole").cast("double"), F.when(is_wide, F.col("text")).cast("double")).alias("number"),
        F.when(~is_wide, F.col("text")).alias("text"),
        F.coalesce(F.col("whole").cast("string"), F.when(is_wide, F.col("text"))).alias("exact"),
        "n",
    )


def as_whole(column: Column, kind: T.DataType) -> Column | None:
    """A column as a 64-bit integer that tells all its values apart; None if it has no such form."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return column.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    return None


def as_number(column: Column, kind: T.DataType) -> Column | None:
    """A column as a double that keeps its order; None if it has no such form."""
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.BooleanType):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return None


#: Distinct values of a range that one task ranks.
RANGE_VALUES = 50_000


#: Cuts are searched by digits of this base. All steps are compiled into one method, which must stay small enough for the JIT compiler: with 1,080 cuts base 16 took nine times as long.
SEARCH_BASE = 2


def in_ranges(numbers: DataFrame, sizes: dict[str, tuple[int, int]], range_values: int = RANGE_VALUES) -> DataFrame:
    """``numbers`` (``column``, ``number``, ``n``) with the ``range`` of its column that a number is in: cuts come from a sketch, so that ranges have about ``range_values`` distinct values and grow in number with the data.

    The cuts are fetched once: a sketch depends on the order in which rows meet it, so each job that made it anew could place numbers otherwise.
    """
    ranges = max(1, -(-max(d for _, d in sizes.values()) // range_values))
    if ranges == 1:
        return numbers.withColumn("range", F.lit(0))
    sketch = F.percentile_approx("number", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))
    cuts = {r["column"]: r["cuts"] for r in numbers.groupBy("column").agg(sketch.alias("cuts")).collect()}
    return place(numbers, cuts)


def place(numbers: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """``numbers`` with ``range``: how many of its column's cuts, in order, are below a number, in a number of steps that is the logarithm of the cuts'."""
    steps = 1
    while SEARCH_BASE**steps <= max(map(len, cuts.values())):
        steps += 1
    padded = [(c, own + [float("inf")] * (SEARCH_BASE**steps - 1 - len(own))) for c, own in cuts.items()]
    known = numbers.sparkSession.createDataFrame(padded, "column string, _cuts array<double>")
    out = numbers.join(F.broadcast(known), "column").withColumn("range", F.lit(0))
    for stride in (SEARCH_BASE**k for k in reversed(range(steps))):
        out = out.withColumn("range", F.col("range") + stride * _search(F.col("_cuts"), F.col("number"), 0, SEARCH_BASE - 1, F.col("range"), stride))
    return out.select(*numbers.columns, "range")


def column_sizes(numbers: DataFrame) -> dict[str, tuple[int, int]]:
    """Each column's rows and distinct values."""
    return {r["column"]: (r["total"], r["d"]) for r in numbers.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("d")).collect()}


def ranks_of_counts(counts: DataFrame, range_values: int = RANGE_VALUES) -> DataFrame:
    """The average rank of each number in its column: ``column``, ``number``, ``rank``; no task sorts a whole column."""
    from pyspark.sql import Window

    numbers = counts.where("number IS NOT NULL").groupBy("column", "number").agg(F.sum("n").alias("n"))
    sizes = column_sizes(numbers)
    if not sizes:
        return counts.sparkSession.createDataFrame([], "column string, number double, rank double")
    placed = in_ranges(numbers, sizes, range_values)
    # as many rows as there are ranges
    sums = placed.groupBy("column", "range").agg(F.sum("n").alias("m"))
    before = sums.select("column", "range", (F.sum("m").over(Window.partitionBy("column").orderBy("range")) - F.col("m")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("column", "range").orderBy("number"))
    ranked = placed.withColumn("upto", upto).join(F.broadcast(before), ["column", "range"])
    return ranked.select("column", "number", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def quantiles_of_counts(counts: DataFrame, probabilities: list[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """Exact type-7 quantiles per column from ``value_counts``: ``column``, ``probability``, ``value``.

    A sketch gives cuts between ranges of about ``range_values`` distinct values; sums over the ranges tell which of
    them hold a wanted rank, and only those are ranked. So no task sorts a whole column, and the ranges grow in number
    and not in size with the data.
    """
    from pyspark.sql import Window

    numbers = counts.where("number IS NOT NULL").select("column", "number", "n")
    sizes, spark = column_sizes(numbers), counts.sparkSession
    if not sizes:
        return spark.createDataFrame([], "column string, probability double, value double")
    placed = in_ranges(numbers, sizes, range_values)
    # which ranges hold a wanted rank, and how many values stand before them
    ranks = {c: {p: p * (total - 1) for p in map(float, probabilities)} for c, (total, _) in sizes.items()}
    sums: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("column", "range").agg(F.sum("n").alias("m")).collect():
        sums.setdefault(r["column"], []).append((r["range"], r["m"]))
    wanted = []
    for column, own in sums.items():
        before = 0
        for k, m in sorted(own):
            if any(before <= at < before + m for h in ranks[column].values() for at in (int(h // 1), -int(-h // 1))):
                wanted.append((column, k, before))
            before += m
    held = spark.createDataFrame(wanted, "column string, range int, before long")
    within = Window.partitionBy("column", "range").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(F.broadcast(held), ["column", "range"]).withColumn("last", F.col("before") + F.sum("n").over(within) - 1)
    ranked = ranked.withColumn("first", F.col("last") - F.col("n") + 1)
    h = spark.createDataFrame([(c, p, h, int(h // 1), -int(-h // 1)) for c, own in ranks.items() for p, h in own.items()], "column string, probability double, h double, low long, high long")
    low, high = (F.col("first") <= F.col("low")) & (F.col("last") >= F.col("low")), (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("high"))
    hit = ranked.join(F.broadcast(h), "column").where(low | high)
    out = hit.groupBy("column", "probability", "h").agg(F.max(F.when(low, F.col("number"))).alias("a"), F.max(F.when(high, F.col("number"))).alias("b"))
    return out.select("column", "probability", (F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))).alias("value"))


def _search(cuts: Column, value: Column, low: int, high: int, start: Column, stride: int) -> Column:
    """How many of the cuts at the ends of strides ``low`` to ``high`` from ``start``, in order, are below a value: a binary search as one compiled expression."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(cuts[start + ((mid + 1) * stride - 1)] < value, _search(cuts, value, mid + 1, high, start, stride)).otherwise(_search(cuts, value, low, mid, start, stride))


def modes_of_counts(counts: DataFrame) -> DataFrame:
    """Per column: ``n_distinct``, and the most frequent value (``mode_number`` or ``mode_text``, and ``mode_exact``; ties to the smallest) with its frequency ``mode_n``."""
    most = counts.groupBy("column").agg(F.count("*").alias("n_distinct"), F.max("n").alias("mode_n"))
    tied = counts.join(F.broadcast(most), "column").where(F.col("n") == F.col("mode_n"))
    # where the doubles of large integers are equal, the integers decide
    digits = F.col("exact").cast("decimal(38,0)")
    smallest = F.min(F.struct("number", digits.alias("digits"), "text", "exact")).alias("m")
    return tied.groupBy("column", "n_distinct", "mode_n").agg(smallest).select(
        "column", "n_distinct", F.col("m.number").alias("mode_number"), F.col("m.text").alias("mode_text"), F.col("m.exact").alias("mode_exact"), "mode_n"
    )
