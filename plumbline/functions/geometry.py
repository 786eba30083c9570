"""Geometry in text or binary columns, profiled without a geometry library: type family, dimensions, bounding box, domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.aggplan import aggregate

_TYPES = "POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION"
WKT = rf"^\s*(?i)(?:SRID=(\d+);)?\s*({_TYPES})\s*(ZM|Z|M)?\s*(EMPTY|\()"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def is_wkt(column: Column) -> Column:
    """A text that begins as well-known text does."""
    return column.rlike(WKT)


def is_wkb_hex(column: Column) -> Column:
    """A text that begins as hexadecimal well-known binary does."""
    return column.rlike(r"^(?:00(?:00|20|80|a0|A0)0000|01)[0-9A-Fa-f]{2}") & column.rlike(r"^(?:[0-9A-Fa-f]{2}){9,}$")


def coordinates(column: Column) -> Column:
    """The coordinate pairs of a well-known text."""
    return F.regexp_extract_all(column, F.lit(rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}"), F.lit(0))


def balanced(column: Column) -> Column:
    """Whether parentheses balance, and polygon rings have at least four points and are closed."""
    depth = F.length(F.regexp_replace(column, r"[^(]", "")) == F.length(F.regexp_replace(column, r"[^)]", ""))
    rings = F.regexp_extract_all(column, F.lit(r"\(([^()]+)\)"), F.lit(1))
    closed = F.forall(rings, lambda r: (F.size(F.split(r, ",")) >= 4) & (F.trim(F.element_at(F.split(r, ","), 1)) == F.trim(F.element_at(F.split(r, ","), -1))))
    return depth & F.when(F.upper(column).rlike(r"POLYGON\s*(?:ZM|Z|M)?\s*\("), closed).otherwise(True)


def profile_geometry(df: DataFrame, column: str, longlat: bool = True) -> dict:
    """One pass over a well-known text column: counts, types, dimensions, box, coordinates out of the longitude-latitude domain.

    Validity here is syntactic (parentheses, closed rings); topological validity needs a geometry library, and is
    reported as not measured.
    """
    c = F.col(f"`{column}`")
    pairs = F.transform(coordinates(c), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
    xs, ys = F.transform(pairs, lambda p: p["x"]), F.transform(pairs, lambda p: p["y"])
    outside = F.exists(pairs, lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90)) if longlat else F.lit(False)
    wkt = is_wkt(c)
    e = {
        "n": F.count(c), "n_wkt": F.count(F.when(wkt, 1)), "n_empty": F.count(F.when(wkt & F.upper(c).rlike(r"EMPTY\s*$"), 1)), "n_invalid": F.count(F.when(wkt & ~balanced(c), 1)), "n_outside": F.count(F.when(wkt & outside, 1)),
        "types": F.collect_set(F.upper(F.regexp_extract(c, WKT, 2))), "dimensions": F.collect_set(F.concat(F.lit("XY"), F.upper(F.regexp_extract(c, WKT, 3)))), "srids": F.collect_set(F.regexp_extract(c, WKT, 1)),
        "xmin": F.min(F.array_min(xs)), "xmax": F.max(F.array_max(xs)), "ymin": F.min(F.array_min(ys)), "ymax": F.max(F.array_max(ys)),
    }
    out = aggregate(df, e)
    findings = []
    if not [s for s in out["srids"] if s]:
        findings.append(("crs_not_declared", "error", out["n_wkt"]))
    for key, kind, severity in (("n_invalid", "invalid_geometry", "suspicious"), ("n_empty", "empty_geometry", "suspicious"), ("n_outside", "coordinate_outside_domain", "error")):
        if out[key]:
            findings.append((kind, severity, out[key]))
    if len([t for t in out["types"] if t]) > 1:
        findings.append(("mixed_geometry_types", "suspicious", out["n_wkt"]))
    return out | {"findings": [{"column": column, "finding": k, "severity": s, "n_evaluated": out["n_wkt"], "n_affected": n} for k, s, n in findings], "coverage": [{"diagnostic": "topological_validity", "column": column, "reason": "no geometry library", "remedy": "install one", "dependency": "shapely"}]}
