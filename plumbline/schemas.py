"""Fixed schemas, enumerations and the granularity lattice."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITIES = ("ok", "suspicious", "error")
TRACE_STATES = ("available", "truncated", "not_applicable", "unavailable")
METRIC_STATES = ("computed", "estimated", "sample_observed", "unavailable", "not_requested", "not_applicable", "no_values", "omitted_for_privacy")
RESULT_TYPES = ("boolean", "real", "real_number", "integer", "duration")
ORIENTATIONS = ("conformity", "defect", "not_applicable")

GRANULARITIES = (
    "cell", "column", "column_set", "tuple", "table", "table_set", "database", "database_set", "organization", "organization_set",
)
GRANULARITY_EDGES = (
    ("cell", "column"), ("cell", "tuple"), ("tuple", "table"), ("column", "table"), ("table", "table_set"),
    ("table", "database"), ("database", "database_set"), ("database", "organization"), ("organization", "organization_set"),
)

TRACE = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("total", T.LongType()),
        T.StructField("shown", T.IntegerType()),
        T.StructField("limit", T.IntegerType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("finding", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("n_evaluated", T.LongType()),
        T.StructField("n_affected", T.LongType()),
        T.StructField("count_unit", T.StringType()),
        T.StructField("trace", TRACE),
    ]
)

COVERAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("diagnostic", "column", "reason", "remedy", "dependency")])

MEASURE = T.StructType(
    [
        T.StructField("measure_id", T.StringType()),
        T.StructField("measurement_id", T.StringType()),
        T.StructField("measured_at", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("specific_metric", T.StringType()),
        T.StructField("instance", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("factor", T.StringType()),
        T.StructField("orientation", T.StringType()),
        T.StructField("granularity", T.StringType()),
        T.StructField("result_type", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("result", T.DoubleType()),
        T.StructField("aggregation", T.StringType()),
    ]
)


def declared_type(kind: T.DataType) -> str:
    """The declared type's name for a Spark type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, T.DayTimeIntervalType):
        return "duration"
    return "composite"


NUMERIC = ("integer", "double")
TEMPORAL = ("date", "timestamp")
