"""Missing values: real nulls, values that stand for one, and declared applicability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trimmed, lower-case texts that stand for a missing value.
TEXT_SENTINELS = ("", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "missing", "unknown", "s/d", "s/n", "sin dato", "sin datos", "no aplica", "no corresponde", "-", "--", "?", ".", "#n/a", "#null!", "<na>")
#: Numbers that stand for a missing value.
NUMBER_SENTINELS = (-9.0, -99.0, -999.0, -9999.0, 999.0)
#: A wider set of numbers, to opt in to.
WIDE_NUMBER_SENTINELS = (-1.0, -9.0, -99.0, -999.0, -9999.0, -98.0, -97.0, 99.0, 999.0, 9999.0, 99999.0, 66.0, 77.0, 88.0, 98.0)


def is_missing(column: Column, kind: T.DataType) -> Column:
    """Null or, for floating-point columns, NaN."""
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column.isNull()


def is_text_sentinel(column: Column, sentinels: tuple[str, ...] = TEXT_SENTINELS) -> Column:
    """Whether a text stands for a missing value; null for null."""
    return F.lower(F.trim(column)).isin(*sentinels)


def is_number_sentinel(column: Column, sentinels: tuple[float, ...] = NUMBER_SENTINELS) -> Column:
    """Whether a number (or a text that reads as one) stands for a missing value; null for null."""
    return F.coalesce(F.expr(f"try_cast({_sql(column)} as double)").isin(*sentinels), F.when(column.isNotNull(), False)) if isinstance(column, str) else column.cast("double").isin(*sentinels)


def _sql(column: Column | str) -> str:
    return f"`{column}`"


def applicability(predicate: str | Column | None, column: Column, kind: T.DataType) -> tuple[Column, Column, Column, Column]:
    """(applicable, not applicable, undetermined, present although not applicable) of a three-valued predicate."""
    p = F.lit(True) if predicate is None else F.expr(predicate) if isinstance(predicate, str) else predicate
    present = ~is_missing(column, kind)
    return F.coalesce(p, F.lit(False)), F.coalesce(~p, F.lit(False)), p.isNull(), F.coalesce(~p, F.lit(False)) & present
