"""Findings: typed diagnostics derived on the driver from one profile row per column, with bounded traces on demand."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import missing, pii, text, types_dates
from plumbline.operators import structure
from plumbline.operators.profile import Profile, profile_columns, table_overview
from plumbline.operators.stats import top_values
from plumbline.plans.aggplan import aggregate, value_counts
from plumbline.schemas import NUMERIC, TEMPORAL, declared_type


def _finding(column, kind, severity, evidence, evaluated, affected, unit="rows") -> dict:
    return {"column": column, "finding": kind, "severity": severity, "evidence": evidence, "n_evaluated": evaluated, "n_affected": affected, "count_unit": unit}


def column_findings(row: dict, missing_suspicious: float = 0.1, missing_error: float = 0.4, high_cardinality: float = 0.5, forbid_zeros: bool = False, forbid_negatives: bool = False) -> list[dict]:
    """Findings that one column's profile row gives."""
    out, name = [], row["column"]
    n, valid = row["n_applicable"], row["n_applicable"] - row["n_missing"]

    def count(field, kind, severity="suspicious"):
        if row.get(field):
            out.append(_finding(name, kind, severity, f"{field}={row[field]}", valid, row[field]))

    if row["declared_type"] in ("composite", "binary"):
        return [_finding(name, "composite_type_not_analyzed", "suspicious", row["declared_type"], n, n)]
    distinct, rate = row.get("n_distinct"), row.get("distinct_rate")
    if distinct == 1 and valid > 1:
        out.append(_finding(name, "constant", "suspicious", f"value={row.get('mode')}", valid, valid))
    if rate is not None and rate >= 0.9 and (row.get("dense_sequence") or row.get("inferred_type") == "identifier"):
        out.append(_finding(name, "possible_identifier", "ok", f"distinct_rate={rate:.6f}", valid, distinct, "values"))
    if row["declared_type"] == "text" and rate is not None and high_cardinality < rate < 1 and distinct >= 10:
        out.append(_finding(name, "high_cardinality", "suspicious", f"distinct_rate={rate:.6f}", valid, distinct, "values"))
    if row.get("n_present_outside"):
        out.append(_finding(name, "value_outside_applicability", "suspicious", "", row["n_not_applicable"], row["n_present_outside"]))
    total = row.get("missing_total_rate")
    if total is not None and total > missing_suspicious:
        only_numbers = row["n_missing_total"] - (row.get("n_disguised_number") or 0) <= missing_suspicious * n
        out.append(_finding(name, "missing", "error" if total > missing_error and not only_numbers else "suspicious", f"rate={total:.6f}", n, row["n_missing_total"]))
    if row.get("n_disguised"):
        only_numbers = row["n_disguised"] == (row.get("n_disguised_number") or 0)
        out.append(_finding(name, "disguised_missing", "suspicious" if only_numbers else "error", "", valid, row["n_disguised"]))
    for field, kind, severity in (
        ("n_border_spaces", "border_spaces", "suspicious"), ("n_invisible_controls", "invisible_controls", "error"), ("n_html_entities", "html_entities", "suspicious"),
        ("n_field_separators", "field_separators", "suspicious"), ("n_broken_encoding", "broken_encoding", "error"), ("n_invisible_spaces", "invisible_spaces", "suspicious"),
        ("n_case_variants", "inconsistent_case", "suspicious"), ("n_outliers", "outliers", "suspicious"),
    ):
        count(field, kind, severity)
    infinite = sum(row.get(k) or 0 for k in ("n_nan", "n_pos_inf", "n_neg_inf"))
    if infinite:
        out.append(_finding(name, "not_finite", "error", "", n, infinite))
    if row.get("max_exact") is not None and max(abs(int(float(row["max_exact"]))), abs(int(float(row["min_exact"])))) > 2**53:
        out.append(_finding(name, "integer_beyond_double", "suspicious", f"{row['min_exact']}..{row['max_exact']}", valid, valid))
    if row["declared_type"] == "text" and valid and (row.get("n_number_text") or 0) / valid >= 0.8:
        out.append(_finding(name, "number_as_text", "suspicious", "", valid, row["n_number_text"]))
    if forbid_zeros:
        count("n_zeros", "zeros_not_allowed")
    if forbid_negatives:
        count("n_negatives", "negatives_not_allowed")
    inferred = row.get("inferred_type")
    if row["declared_type"] == "text" and inferred not in (None, "text", "unknown", "identifier"):
        out.append(_finding(name, "declared_type_differs", "suspicious", f"inferred={inferred}", valid, valid))
    formats = row.get("date_formats") or []
    units = {f["family"] for f in formats if f["state"] != "ambiguous"}
    if any(f["state"] == "ambiguous" for f in formats):
        out.append(_finding(name, "ambiguous_date_format", "suspicious", ",".join(f["format"] for f in formats), valid, max(f["n"] for f in formats)))
    if any(f["family"].endswith("2") for f in formats):
        out.append(_finding(name, "two_digit_year", "suspicious", "", valid, max(f["n"] for f in formats if f["family"].endswith("2"))))
    if len(units) > 1:
        out.append(_finding(name, "mixed_date_formats", "error", ",".join(f["format"] for f in formats), valid, sum(f["n"] for f in formats) - max(f["n"] for f in formats)))
    return out


def discover_patterns(df: DataFrame, column: str, distinguish_case: bool = True, expand: bool = False, max_patterns: int = 20, rare: float = 0.05) -> DataFrame:
    """A column's text shapes: ``pattern``, ``n``, ``share``, ``example`` and up to three ``examples`` (the smallest), ``rare``; most frequent first.

    Where there are more than ``max_patterns`` shapes, ``excluded`` tells how many rows the others have.
    """
    c = F.col(f"`{column}`").cast("string")
    # values are counted before shapes are made: shapes cost a few regular expressions each
    values = df.where(c.isNotNull()).groupBy(c.alias("text")).agg(F.count("*").alias("n")).withColumn("column", F.lit(column))
    return patterns_of_counts(values, distinguish_case, expand, max_patterns, rare).drop("column").orderBy(F.desc("n"), "pattern")


def patterns_of_counts(values: DataFrame, distinguish_case: bool = True, expand: bool = False, max_patterns: int = 20, rare: float = 0.05) -> DataFrame:
    """The shapes of several columns' counted values (``column``, ``text``, ``n``), as ``discover_patterns`` has them, with their ``column``."""
    shapes = values.where("text IS NOT NULL").select("column", text.pattern(F.col("text"), distinguish_case, expand).alias("pattern"), F.col("text").alias("v"), "n")
    least = F.slice(F.array_sort(F.collect_set(F.when(F.col("place") <= 3, F.col("v")))), 1, 3)
    place = Window.partitionBy("column", "pattern").orderBy("v")
    grouped = shapes.groupBy("column", "pattern").agg(F.sum("n").alias("n"), F.min("v").alias("example"))
    total = grouped.groupBy("column").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "pattern")
    best = grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_patterns)
    few = shapes.join(F.broadcast(best.select("column", "pattern")), ["column", "pattern"]).withColumn("place", F.row_number().over(place)).where("place <= 3")
    shown = few.groupBy("column", "pattern").agg(least.alias("examples"))
    held = best.groupBy("column").agg(F.sum("n").alias("held"))
    out = best.join(F.broadcast(total), "column").join(F.broadcast(held), "column").join(shown, ["column", "pattern"])
    share = F.col("n") / F.col("total")
    return out.select("column", "pattern", "n", share.alias("share"), "example", "examples", ((share < rare) & (F.col("n") < F.col("top"))).alias("rare"), (F.col("total") - F.col("held")).alias("excluded"))


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def deep_text_figures(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per text column what its values tell: variants in case and Unicode form, lists in cells, units and currencies, the implicit type, date formats and shapes.

    All columns' values are counted in one shuffle; each figure is one pass over these counts, however many columns there are.
    """
    counts = value_counts(df, columns).where("text IS NOT NULL").select("column", "text", "n").persist()
    try:
        c, n = F.col("text"), F.col("n")
        count = lambda flag: F.sum(F.when(flag, n).otherwise(0))
        number, parts = c.rlike(text.NUMBER_TEXT), text.number_parts(c)
        e = {f"n_{k}_lists": count(text.multivalued(c, sep)) for k, sep in (("comma", ","), ("semicolon", ";"), ("pipe", "|"))}
        e |= {k: F.array_sort(F.collect_set(F.when(number & (parts[p] != ""), parts[p]))) for k, p in (("units", "unit"), ("currencies", "currency"))}
        e |= {f"n_{k}": count(number & parts[k]) for k in ("ambiguous", "decimal_comma", "decimal_point")}
        e |= {f"type\0{k}": v for k, v in types_dates.type_expressions(c, n).items()} | {f"date\0{k}": v for k, v in types_dates.format_expressions(c, n).items()}
        keys = list(e)
        out: dict[str, dict] = {name: {} for name in columns}
        for r in counts.groupBy("column").agg(*[e[k].alias(f"e{i}") for i, k in enumerate(keys)]).collect():
            got = {k: r[f"e{i}"] for i, k in enumerate(keys)}
            own = {k: v for k, v in got.items() if "\0" not in k}
            inferred = types_dates.decide_type({k[5:]: v for k, v in got.items() if k.startswith("type\0")})
            own["inferred_type"] = inferred["type"]
            own["date_formats"] = types_dates.decide_formats({k[5:]: v for k, v in got.items() if k.startswith("date\0")}) if inferred["type"] in ("date", "timestamp", "text", "integer") else []
            out[r["column"]] = own
        # only values beyond ASCII can change, and each is normalized once
        for r in counts.where(c.rlike(r"[^\x00-\x7F]")).where(c != _nfc(c)).groupBy("column").agg(F.sum("n")).collect():
            out[r[0]]["n_unicode_variants"] = r[1]
        variants = counts.groupBy("column", F.lower("text").alias("l")).agg(F.count("*").alias("n")).where("n > 1").groupBy("column").agg(F.sum("n"))
        for r in variants.collect():
            out[r[0]]["n_case_variants"] = r[1]
        for r in sorted(patterns_of_counts(counts).collect(), key=lambda r: (-r["n"], r["pattern"])):
            out[r["column"]].setdefault("patterns", []).append(r.asDict())
    finally:
        counts.unpersist()
    for own in out.values():
        own.setdefault("n_unicode_variants", 0)
        own.setdefault("n_case_variants", 0)
        own.setdefault("patterns", [])
        own.setdefault("inferred_type", "unknown")
        own.setdefault("date_formats", [])
    return out


def deep_findings(row: dict, figures: dict, patterns: list[dict], rare: float = 0.05) -> list[dict]:
    """Findings of the text figures and of a column's shapes (most frequent first)."""
    out, name, valid = [], row["column"], row["n_applicable"] - row["n_missing"]
    if figures.get("n_unicode_variants"):
        out.append(_finding(name, "unicode_normalization", "suspicious", "", valid, figures["n_unicode_variants"]))
    lists = max(("comma", "semicolon", "pipe"), key=lambda k: figures.get(f"n_{k}_lists", 0))
    n = figures.get(f"n_{lists}_lists", 0)
    if n and n <= valid / 2:
        out.append(_finding(name, "multivalued_cells", "suspicious", lists, valid, n))
    if valid and (row.get("n_number_text") or 0) / valid >= 0.8:
        for k, kind in (("units", "mixed_units"), ("currencies", "mixed_currencies")):
            if len(figures.get(k) or []) > 1:
                out.append(_finding(name, kind, "suspicious", ",".join(figures[k]), valid, row["n_number_text"]))
    if patterns and patterns[0]["share"] >= 0.5:
        odd = [p for p in patterns[1:] if p["share"] < rare]
        if odd:
            classes = sorted({text.deviation_class(p["pattern"], patterns[0]["pattern"]) for p in odd})
            out.append(_finding(name, "rare_pattern", "suspicious", ",".join(classes), valid, sum(p["n"] for p in odd)))
    return out


def civil_date_shifts(df: DataFrame) -> list[dict]:
    """Timestamp columns with a time zone whose civil date differs between the session's zone and UTC."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    e = {}
    for n in names:
        c = F.col(f"`{n}`")
        e[f"{n}\0n"], e[f"{n}\0shift"] = F.count(c), F.count(F.when(F.to_date(c) != F.to_date(F.to_utc_timestamp(c, zone)), 1))
    got = aggregate(df, e) if e else {}
    return [_finding(n, "time_zone_shifts_date", "suspicious", zone, got[f"{n}\0n"], got[f"{n}\0shift"]) for n in names if got[f"{n}\0shift"]]


def structure_findings(df: DataFrame, rows: list[dict], p_value: float = 0.01, max_arithmetic: int = 8) -> list[dict]:
    """Near keys, arithmetic relations and departures from Benford's law."""
    out = []
    for k in structure.detect_keys(df, 1):
        if k["kind"] == "near_key":
            out.append(_finding(k["columns"][0], "near_key", "suspicious", f"rate={k['rate']:.6f}", k["n_rows"], k["n_rows"] - k["n_distinct"]))
    for r in structure.detect_arithmetic(df, max_columns=max_arithmetic):
        out.append(_finding(",".join(r["columns"]), "arithmetic_relation", "ok" if not r["n_affected"] else "suspicious", r["kind"], r["n_evaluated"], r["n_affected"]))
    wide = [row["column"] for row in rows if row["declared_type"] in NUMERIC and row["n_applicable"] - row["n_missing"] >= 100 and (row.get("min") or 0) > 0 and row["max"] / row["min"] >= 1000]
    for b in structure.benford_all(df, wide):
        if b["p"] is not None and b["p"] < p_value:
            out.append(_finding(b["column"], "benford_deviation", "suspicious", f"chi2={b['chi2']:.3f}", b["n"], b["n"]))
    return out


def _left_out(df: DataFrame, max_arithmetic: int) -> list[dict]:
    """Coverage rows of the columns that the limits of the relations' diagnostics leave out."""
    row = lambda d, c, reason: {"diagnostic": d, "column": c, "reason": reason, "remedy": "name the columns, or raise the limit", "dependency": None}
    of = lambda *kinds: [n for n in df.columns if declared_type(df.schema[n].dataType) in kinds]
    out = [row("arithmetic_relation", c, f"beyond the first {max_arithmetic} numeric columns") for c in of(*NUMERIC)[max_arithmetic:]]
    for kinds in (NUMERIC, TEMPORAL):
        out += [row("column_order", c, f"beyond the first {structure.MAX_ORDERED} columns of its family") for c in of(*kinds)[structure.MAX_ORDERED :]]
    out += [row("possible_structural_absence", c, f"beyond the first {structure.MAX_ABSENT} columns") for c in df.columns[structure.MAX_ABSENT :]]
    return out


def profile(df: DataFrame, name: str = "table", mode: str = "exact", key: list[str] | None = None, applicability: dict | None = None, dependencies: bool = True, protect: bool = True, deep_text: bool = True, forbid_zeros: tuple[str, ...] = (), forbid_negatives: tuple[str, ...] = (), max_arithmetic: int = 8, **options) -> Profile:
    """A whole profile: columns, table figures, findings, coverage of what was not measured; personal data masked.

    Zeros are a finding in the columns of ``forbid_zeros``, negative numbers in those of ``forbid_negatives``.
    """
    rows = profile_columns(df, mode, applicability=applicability, **options)
    coverage = []
    full = mode == "exact"
    general = table_overview(df) if full else {"n_rows": rows[0]["n"] if rows else 0, "n_columns": len(df.columns)}
    texts = [r["column"] for r in rows if r["declared_type"] == "text"]
    if full and deep_text and texts:
        figures = deep_text_figures(df, texts)
        for r in rows:
            if r["column"] in texts:
                r |= {k: v for k, v in figures[r["column"]].items() if k.startswith("n_") or k in ("inferred_type", "date_formats")}
    found = [f for r in rows for f in column_findings(r, forbid_zeros=r["column"] in forbid_zeros, forbid_negatives=r["column"] in forbid_negatives)]
    if full and deep_text:
        for r in rows:
            if r["column"] in texts:
                found += deep_findings(r, figures[r["column"]], figures[r["column"]]["patterns"])
    if full:
        found += civil_date_shifts(df) + structure_findings(df, rows, max_arithmetic=max_arithmetic)
        coverage += _left_out(df, max_arithmetic)
        if general["n_surplus"]:
            found.append(_finding(None, "duplicate_rows", "error", "", general["n_rows"], general["n_surplus"]))
        for a, b in structure.duplicate_columns(df):
            found.append(_finding(b, "duplicate_columns", "suspicious", f"equals {a}", general["n_rows"], general["n_rows"]))
        bad = [n for n, u in zip(df.columns, text.unique_names(df.columns)) if n != u]
        if bad:
            found.append(_finding(None, "problematic_column_names", "suspicious", ",".join(bad), len(df.columns), len(bad), "columns"))
        for r in structure.detect_order(df):
            found.append(_finding(f"{r['low']},{r['high']}", "column_order", "suspicious", f"{r['low']}<={r['high']}", r["n_evaluated"], r["n_affected"]))
        for r in structure.split_dates(df):
            found.append(_finding(",".join(r["columns"]), "split_date_columns", "suspicious", "", r["n_evaluated"], r["n_valid"]))
        for r in structure.structural_absence(df):
            found.append(_finding(r["column"], "possible_structural_absence", "ok", r["rule"], r["n_evaluated"], r["n_affected"]))
    else:
        coverage.append({"diagnostic": "table_structure", "column": None, "reason": f"mode {mode}", "remedy": "mode exact", "dependency": None})
    for r in rows:
        if r["state"] == "not_applicable":
            coverage.append({"diagnostic": "column_statistics", "column": r["column"], "reason": "composite type", "remedy": "explode the column", "dependency": None})
    personal = pii.classify(df) if full else []
    for p in personal:
        found.append(_finding(p["column"], "possible_personal_data", "suspicious", f"{p['kind']},{p['power']}", general["n_rows"], general["n_rows"]))
    if protect:
        rows = pii.mask_rows(rows, {p["column"] for p in personal if p["protect"]})
        hidden = {p["column"] for p in personal if p["protect"]}
        found = [f | {"evidence": ""} if f["column"] in hidden and f["finding"] == "constant" else f for f in found]
    return Profile(name, general, rows, found, coverage, {"mode": mode, "key": key, "personal": personal})


_CONDITIONS = {
    "missing": lambda c, k: missing.is_missing(c, k),
    "disguised_missing": lambda c, k: missing.is_text_sentinel(c) if declared_type(k) == "text" else c.cast("double").isin(*missing.NUMBER_SENTINELS),
    "border_spaces": lambda c, k: text.has_border_space(c),
    "invisible_controls": lambda c, k: c.rlike(text.CONTROLS),
    "invisible_spaces": lambda c, k: c.rlike(text.INVISIBLE_SPACES),
    "html_entities": lambda c, k: c.rlike(text.HTML_ENTITY),
    "field_separators": lambda c, k: c.rlike(text.LINE_SEPARATORS),
    "broken_encoding": lambda c, k: c.rlike(text.MOJIBAKE),
    "not_finite": lambda c, k: F.isnan(c) | (F.abs(c) == float("inf")),
}


def trace(df: DataFrame, finding: dict, key: list[str], limit: int = 20) -> dict:
    """The smallest keys of the rows that a finding means, at most ``limit`` of them, and how many there are."""
    make = _CONDITIONS.get(finding["finding"])
    if make is None or finding["column"] not in df.columns:
        return {"state": "not_applicable", "keys": [], "total": finding["n_affected"], "shown": 0, "limit": limit}
    c = F.col(f"`{finding['column']}`")
    rows = df.where(make(c, df.schema[finding["column"]].dataType))
    keys = [F.col(f"`{k}`") for k in key]
    shown = ["|".join(str(v) for v in r) for r in rows.select(*keys).orderBy(*keys).limit(limit).collect()]
    total = rows.count()
    return {"state": "truncated" if total > limit else "available", "keys": shown, "total": total, "shown": len(shown), "limit": limit}


def classify_variables(df: DataFrame, profile_rows: list[dict], metadata: dict[str, dict] | None = None, max_levels: int = 100) -> list[dict]:
    """A scale and role for each column: declared metadata first, then type, then cardinality."""
    out = []
    for r in profile_rows:
        given = (metadata or {}).get(r["column"], {})
        kind, distinct, rate = r["declared_type"], r.get("n_distinct") or 0, r.get("distinct_rate") or 0
        if kind == "boolean" or distinct == 2:
            scale = "binary"
        elif given.get("ordered") is not None:
            scale = "ordinal" if given["ordered"] else "nominal"
        elif kind in ("date", "timestamp"):
            scale = "interval"
        elif kind == "text":
            scale = "nominal"
        elif r.get("dense_sequence") and rate >= 0.9:
            scale = "nominal"
        elif kind in NUMERIC:
            scale = "ratio" if (r.get("min") or 0) >= 0 else "interval"
        else:
            scale = "unknown"
        role = "identifier" if rate >= 0.9 and (kind == "text" or r.get("dense_sequence")) else "constant" if distinct == 1 else "time" if scale == "interval" and kind in ("date", "timestamp") else "category" if scale in ("binary", "nominal", "ordinal") and distinct <= max_levels else "measure" if kind in NUMERIC else "text"
        out.append({"column": r["column"], "scale": given.get("scale", scale), "role": given.get("role", role), "source": "declared" if given else "inferred"})
    return out


def sample_values(df: DataFrame, column: str, k: int = 3) -> list[str]:
    """A column's most frequent values."""
    return [r["value"] for r in top_values(df, [column], k).orderBy("rank").collect()]
