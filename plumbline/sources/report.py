"""A self-contained HTML report of profiles, measures and plans. Rows are bounded before they are collected."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame

from plumbline.operators.profile import Profile

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}th{background:#eee}.note{color:#666}"


def _cell(value) -> str:
    return "" if value is None else html.escape(f"{value:.6g}" if isinstance(value, float) else str(value))


def html_table(rows: list[dict], limit: int = 100, total: int | None = None) -> str:
    """A table of dicts; a note says how many rows are not shown."""
    if not rows:
        return '<p class="note">none</p>'
    names = [n for n in dict.fromkeys(k for r in rows for k in r) if any(r.get(n) is not None for r in rows)]
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{_cell(r.get(n))}</td>" for n in names) + "</tr>" for r in rows[:limit])
    hidden = (total if total is not None else len(rows)) - min(limit, len(rows))
    note = f'<p class="note">{hidden} more rows</p>' if hidden > 0 else ""
    return f"<table><tr>{head}</tr>{body}</table>{note}"


def report(*parts: Profile | DataFrame | tuple[str, DataFrame], title: str = "Data quality report", max_rows: int = 100) -> str:
    """The report's HTML. DataFrames are cut to ``max_rows`` rows, with a note."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>"]
    for p in parts:
        if isinstance(p, Profile):
            out.append(f"<h2>{html.escape(p.name)}</h2>" + html_table([p.general]) + "<h3>Columns</h3>" + html_table(p.columns, max_rows))
            out.append("<h3>Findings</h3>" + html_table(p.findings, max_rows) + "<h3>Not measured</h3>" + html_table(p.coverage, max_rows))
        else:
            name, df = p if isinstance(p, tuple) else ("Table", p)
            rows = [r.asDict(recursive=True) for r in df.limit(max_rows + 1).collect()]
            more = '<p class="note">more rows not shown</p>' if len(rows) > max_rows else ""
            out.append(f"<h2>{html.escape(name)}</h2>" + html_table(rows[:max_rows], max_rows) + more)
    return "".join(out) + "</body></html>"


def write_report(path: str, *parts, overwrite: bool = False, **options) -> None:
    """The report as a file; an existing one stays unless ``overwrite``."""
    target = Path(path)
    if target.exists() and not overwrite:
        raise FileExistsError(path)
    target.write_text(report(*parts, **options), encoding="utf-8")
