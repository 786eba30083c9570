"""Profiles that a database computes: few aggregate queries are pushed down, and only their results are read.

A connection is any function from SQL to rows (dicts), such as ``jdbc_runner``; every query that ran is in the log. Columns are
packed into queries of at most ``max_expressions`` figures, so the number of scans follows from the width and not from the figures.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Figures that each mode asks for, as SQL of one column; ``exact`` adds a query of modes for each column.
MODES = {
    "counts": ("n_present",),
    "safe": ("n_present", "min", "max", "mean", "stddev", "n_zeros", "n_negatives", "length_min", "length_max", "length_mean", "n_blanks"),
    "exact": ("n_present", "min", "max", "mean", "stddev", "n_zeros", "n_negatives", "length_min", "length_max", "length_mean", "n_blanks", "n_distinct"),
}
_SQL = {
    "n_present": ("*", "count({c})"), "n_distinct": ("*", "count(DISTINCT {c})"), "min": ("number", "min({c})"), "max": ("number", "max({c})"), "mean": ("number", "avg(CAST({c} AS DOUBLE PRECISION))"), "stddev": ("number", "stddev_samp(CAST({c} AS DOUBLE PRECISION))"),
    "n_zeros": ("number", "sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)"), "n_negatives": ("number", "sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END)"), "length_min": ("text", "min(char_length({c}))"), "length_max": ("text", "max(char_length({c}))"), "length_mean": ("text", "avg(CAST(char_length({c}) AS DOUBLE PRECISION))"),
    "n_blanks": ("text", "sum(CASE WHEN char_length(trim({c})) = 0 THEN 1 ELSE 0 END)"),
}


@dataclass
class Pushed:
    """A pushed-down profile: rows by column, the queries with their seconds, and what was not asked for."""

    columns: list[dict]
    log: list[dict] = field(default_factory=list)
    coverage: list[dict] = field(default_factory=list)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def plan(table: str, columns: dict[str, str], mode: str = "safe", max_expressions: int = 100) -> list[tuple[str, list[tuple[str, str]]]]:
    """The aggregate queries of a profile, and which column and figure each of their results is. ``columns`` has each column's family: number, text or other."""
    wanted = [(c, f) for c, family in columns.items() for f in MODES[mode] if _SQL[f][0] in ("*", family)]
    out = []
    for k in range(0, max(1, len(wanted)), max_expressions):
        part = wanted[k : k + max_expressions]
        parts = ["count(*) AS n", *(f"{_SQL[f][1].format(c=quoted(c))} AS f{i}" for i, (c, f) in enumerate(part))]
        out.append((f"SELECT {', '.join(parts)} FROM {table}", part))
    return out


def cost(table: str, columns: dict[str, str], mode: str = "safe", max_expressions: int = 100) -> dict:
    """What a profile would ask of the database: scans, distinct counts and grouped queries, before any runs."""
    queries = plan(table, columns, mode, max_expressions)
    distinct = sum(f == "n_distinct" for _, part in queries for _, f in part)
    groups = len(columns) if mode == "exact" else 0
    return {"mode": mode, "queries": len(queries) + groups, "scans": len(queries) + groups, "distinct_counts": distinct, "level": "high" if groups else "medium" if len(queries) > 5 else "low"}


def pushdown_profile(run: Callable[[str], list[dict]], table: str, columns: dict[str, str], mode: str = "safe", max_expressions: int = 100) -> Pushed:
    """A table's profile from the database's own aggregates. A query that fails leaves its figures out, with a coverage row; the rest go on."""
    out = Pushed([{"column": c, "family": f} for c, f in columns.items()])
    rows = {r["column"]: r for r in out.columns}

    def ask(sql: str, about: list[str]) -> list[dict] | None:
        began = time.perf_counter()
        try:
            got = run(sql)
            out.log.append({"sql": sql, "seconds": time.perf_counter() - began, "state": "done"})
            return got
        except Exception as e:  # noqa: BLE001 - a database may refuse any one query
            out.log.append({"sql": sql, "seconds": time.perf_counter() - began, "state": "failed"})
            out.coverage += [{"diagnostic": "column_statistics", "column": c, "reason": str(e)[:200], "remedy": "a lighter mode", "dependency": None} for c in about]
            return None

    for sql, part in plan(table, columns, mode, max_expressions):
        got = ask(sql, sorted({c for c, _ in part}))
        if got:
            for r in rows.values():
                r["n"] = int(got[0]["n"])
            for i, (c, f) in enumerate(part):
                v = got[0][f"f{i}"]
                rows[c][f] = int(v) if v is not None and (f.startswith("n_") or f in ("length_min", "length_max")) else v
    if mode == "exact":
        for c in columns:
            q = quoted(c)
            got = ask(f"SELECT {q} AS v, count(*) AS k FROM {table} WHERE {q} IS NOT NULL GROUP BY {q} ORDER BY k DESC, {q} LIMIT 1", [c])
            if got is not None:
                rows[c] |= {"mode": str(got[0]["v"]), "mode_n": int(got[0]["k"])} if got else {"mode": None, "mode_n": 0}
    for r in out.columns:
        if r.get("n_present") is not None:
            r["n_missing"] = r["n"] - r["n_present"]
    return out


def jdbc_runner(spark: SparkSession, url: str, **options) -> Callable[[str], list[dict]]:
    """Runs SQL in a database behind JDBC: the query is the database's, and its few result rows are read."""
    return lambda sql: [{k.lower(): v for k, v in r.asDict().items()} for r in spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()]
