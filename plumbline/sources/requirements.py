"""What reading from an engine needs, as a static table."""

from __future__ import annotations

ENGINES = {
    "parquet": ("built in", "a path ending in .parquet", "column pruning, filters and min/max push-down"),
    "orc": ("built in", "a path ending in .orc", "column pruning and filters"),
    "csv": ("built in", "a path ending in .csv, with a header", "none"),
    "json": ("built in", "a path ending in .json", "none"),
    "catalog": ("built in", "a qualified table name", "that of the table's format"),
    "postgresql": ("org.postgresql:postgresql", "url jdbc:postgresql://host/db", "filters, limits and aggregates"),
    "mysql": ("com.mysql:mysql-connector-j", "url jdbc:mysql://host/db", "filters, limits and aggregates"),
    "oracle": ("com.oracle.database.jdbc:ojdbc11", "url jdbc:oracle:thin:@host:port/service", "filters, limits and aggregates"),
    "sqlserver": ("com.microsoft.sqlserver:mssql-jdbc", "url jdbc:sqlserver://host", "filters, limits and aggregates"),
    "sqlite": ("org.xerial:sqlite-jdbc", "url jdbc:sqlite:file", "filters"),
}


def engine_requirements(engine: str | None = None) -> list[dict]:
    """Per engine its driver, how to name a source, and what is pushed down to it."""
    if engine is not None and engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}; one of {sorted(ENGINES)}")
    return [{"engine": k, "driver": v[0], "source": v[1], "push_down": v[2]} for k, v in ENGINES.items() if engine in (None, k)]
