"""Collections of tables: profiles with errors kept apart, costs before running, relations across tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.aggregate import Collection
from plumbline.operators.findings import profile
from plumbline.operators.profile import MODES, Profile
from plumbline.operators.structure import _family, detect_relations
from plumbline.schemas import declared_type
from plumbline.sources.tables import read_source


def profile_collection(spark: SparkSession, what: Collection, sources: dict[str, str | DataFrame] | None = None, mode: str = "exact", **options) -> tuple[dict[str, Profile], list[dict]]:
    """Profiles by table, and a row per table with its state; a table that fails doesn't stop the rest."""
    profiles, states = {}, []
    for name in what.tables:
        try:
            profiles[name] = profile(read_source(spark, (sources or {}).get(name, name)), name, mode, **options)
            p = profiles[name]
            states.append({"table": name, "state": "done", "n_rows": p.general["n_rows"], "n_columns": p.general["n_columns"], "n_findings": len(p.findings), "reason": None})
        except Exception as e:  # noqa: BLE001 - each table stands alone, by contract
            states.append({"table": name, "state": "failed", "n_rows": None, "n_columns": None, "n_findings": None, "reason": str(e)[:200]})
    return profiles, states


def estimate_collection_cost(tables: dict[str, DataFrame], pairs: list[tuple[str, str]] | None = None) -> list[dict]:
    """Column pairs that relations between tables would compare, from schemas alone."""
    out = []
    for a, b in pairs or list(combinations(sorted(tables), 2)):
        fa = [_family(f.dataType) for f in tables[a].schema.fields]
        fb = [_family(f.dataType) for f in tables[b].schema.fields]
        out.append({"left": a, "right": b, "n_pairs": sum(x == y != "composite" for x in fa for y in fb)})
    return out


def collection_relations(tables: dict[str, DataFrame], pairs: list[tuple[str, str]] | None = None, min_coverage: float = 0.9, candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """Inclusion relations between the tables' columns; with ``candidates`` only between those named."""
    out = None
    for a, b in pairs or list(combinations(sorted(tables), 2)):
        if a not in tables or b not in tables:
            raise ValueError(f"unknown pair {a}, {b}")
        columns = [(x, y) for x in (candidates or {}).get(a, tables[a].columns) for y in (candidates or {}).get(b, tables[b].columns)]
        found = detect_relations(tables[a], tables[b], columns, min_coverage).selectExpr(f"'{a}' AS left_table", f"'{b}' AS right_table", "*")
        out = found if out is None else out.unionByName(found)
    return out


def plan_profile(df: DataFrame, mode: str = "exact") -> list[dict]:
    """What a mode would run: each step with its scans and what it shuffles."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    groups = MODES[mode]
    numeric = sum(declared_type(f.dataType) in ("integer", "double") for f in df.schema.fields)
    steps = [{"step": "aggregates", "scans": 1, "shuffles": "one row a task", "columns": len(df.columns)}]
    if "distinct" in groups and mode != "approximate":
        steps.append({"step": "value counts", "scans": 1, "shuffles": "distinct values a task", "columns": len(df.columns)})
        steps.append({"step": "modes and quantiles", "scans": 0, "shuffles": "distinct values", "columns": numeric})
    if mode == "sampled":
        steps.insert(0, {"step": "count", "scans": 1, "shuffles": "one row a task", "columns": 0})
    return steps
