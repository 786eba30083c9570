"""Implicit types of text, and date formats. Proportions come from one aggregate; decisions are made on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.aggplan import aggregate

LOGICAL = ("true", "false", "yes", "no", "si", "sí", "verdadero", "falso", "t", "f", "y", "n")
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|set|dic"

#: Date formats: name, regular expression, Spark pattern, order family.
DATE_FORMATS = [
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", "ymd"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd", "ymd"),
    ("yyyy.MM.dd", r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.MM.dd", "ymd"),
    ("yyyyMMdd", r"^(?:19|20)\d{6}$", "yyyyMMdd", "ymd"),
    ("dd/MM/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", "dmy"),
    ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "mdy"),
    ("dd-MM-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy", "dmy"),
    ("MM-dd-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", "mdy"),
    ("dd.MM.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy", "dmy"),
    ("dd/MM/yy", r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy", "dmy2"),
    ("MM/dd/yy", r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy", "mdy2"),
    ("dd MMM yyyy", rf"^(?i)\d{{1,2}} (?:{_MONTHS})[a-z]*\.? \d{{4}}$", "d MMM yyyy", "name"),
    ("MMM dd, yyyy", rf"^(?i)(?:{_MONTHS})[a-z]*\.? \d{{1,2}}, \d{{4}}$", "MMM d, yyyy", "name"),
    ("yyyy-MM", r"^(?:19|20)\d{2}-(?:0[1-9]|1[0-2])$", "yyyy-MM", "month"),
    ("MM/yyyy", r"^(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}$", "M/yyyy", "month"),
]
#: Times of day that may follow a date.
TIME_SUFFIXES = {
    "": "", "HH:mm": r"[ T]\d{2}:\d{2}", "HH:mm:ss": r"[ T]\d{2}:\d{2}:\d{2}", "HH:mm:ss.S": r"[ T]\d{2}:\d{2}:\d{2}\.\d{1,6}", "HH:mmZ": r"[ T]\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})",
    "HH:mm:ssZ": r"[ T]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})", "HH:mm:ss.SZ": r"[ T]\d{2}:\d{2}:\d{2}\.\d{1,6}(?:Z|[+-]\d{2}:?\d{2})", "hh:mm a": r" \d{1,2}:\d{2} ?[AaPp][Mm]", "hh:mm:ss a": r" \d{1,2}:\d{2}:\d{2} ?[AaPp][Mm]",
}
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)? ?(?:Z|[+-]\d{2}:?\d{2}|[AaPp][Mm])?)?$"


def _date_part(column: Column) -> Column:
    return F.regexp_replace(F.trim(column), _TIME, "")


def parse_with(column: Column, regex: str, pattern: str) -> Column:
    """A date of one format; null if the text has another form or isn't in the calendar."""
    part = _date_part(column)
    if pattern in ("yyyy-MM", "M/yyyy"):
        part, pattern = F.concat(F.lit("01 "), part), "dd " + pattern
    if "MMM" in pattern:
        for es, en in (("ene", "jan"), ("abr", "apr"), ("ago", "aug"), ("set", "sep"), ("dic", "dec")):
            part = F.regexp_replace(part, rf"(?i)\b{es}[a-z]*", en)
        part = F.initcap(F.regexp_replace(F.lower(part), r"\b([a-z]{3})[a-z]*\.?", "$1"))
    # texts of another form are nulled before parsing, so the parser never sees them
    return F.try_to_timestamp(F.when(_date_part(column).rlike(regex), part), F.lit(pattern)).cast("date")


def date_format_counts(df: DataFrame, column: str) -> dict:
    """Per format the texts that have it, of the non-blank ones; and rows that only one order of day and month explains."""
    return aggregate(df, format_expressions(F.col(f"`{column}`")))


def format_expressions(c: Column, n: Column | None = None) -> dict[str, Column]:
    """The figures of ``date_format_counts``; ``n`` is the number of rows that a value stands for."""
    count = lambda flag: F.sum(F.when(flag, F.lit(1) if n is None else n).otherwise(0))
    e = {"\0n": count(F.length(F.trim(c)) > 0)}
    for name, regex, pattern, _ in DATE_FORMATS:
        e[name] = count(parse_with(c, regex, pattern).isNotNull())
    first = _date_part(c)
    e["\0day_first"] = count(first.rlike(r"^(?:1[3-9]|2\d|3[01])[/.-]\d{1,2}[/.-]\d{2,4}$"))
    e["\0month_first"] = count(first.rlike(r"^\d{1,2}[/.-](?:1[3-9]|2\d|3[01])[/.-]\d{2,4}$"))
    for name, regex in TIME_SUFFIXES.items():
        if name:
            e["\0time\0" + name] = count(F.trim(c).rlike(regex + "$"))
    return e


def detect_date_formats(df: DataFrame, column: str) -> list[dict]:
    """Formats in a text column: ``format``, ``n``, ``share`` and ``state`` (confirmed, candidate, ambiguous)."""
    return decide_formats(date_format_counts(df, column))


def decide_formats(got: dict) -> list[dict]:
    """Formats from ``date_format_counts``.

    Day-month order is settled by rows that only one order explains; with both kinds of them the column is mixed,
    with neither it is ambiguous. Two-digit years stay candidates.
    """
    n = got["\0n"]
    out = []
    day, month = got["\0day_first"] > 0, got["\0month_first"] > 0
    for name, _, _, family in DATE_FORMATS:
        if not got[name]:
            continue
        if family in ("dmy", "mdy", "dmy2", "mdy2") and "." not in name:
            own, other = (day, month) if family.startswith("d") else (month, day)
            if other and not own:
                continue
            state = "confirmed" if own else "ambiguous"
        else:
            state = "confirmed"
        if family.endswith("2"):
            state = "candidate" if state == "confirmed" else state
        out.append({"format": name, "family": family, "n": got[name], "share": got[name] / n if n else None, "state": state})
    return out


def parse_dates(column: Column, formats: list[str]) -> Column:
    """A date by the first of the confirmed formats that fits."""
    by = {f[0]: f for f in DATE_FORMATS}
    return F.coalesce(*[parse_with(column, by[f][1], by[f][2]) for f in formats])


def type_flags(column: Column) -> dict[str, Column]:
    """What a trimmed non-empty text could be."""
    t = F.trim(column)
    lower = F.lower(t)
    date = F.lit(False)
    for _, regex, pattern, family in DATE_FORMATS:
        if family != "month":
            date = date | parse_with(t, regex, pattern).isNotNull()
    return {
        "logical": lower.isin(*LOGICAL, "0", "1"),
        "logical_word": lower.isin(*LOGICAL),
        "date": date,
        "timestamp": date & t.rlike(r"\d{1,2}:\d{2}"),
        "time": t.rlike(r"^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"),
        "identifier_shape": t.rlike(r"^0\d+$") | (t.rlike(r"[A-Za-z]") & t.rlike(r"\d") & t.rlike(r"^[A-Za-z0-9_.#/-]+$")),
        "integer": t.rlike(r"^[+-]?\d+$"),
        "double": t.rlike(r"^[+-]?(?:\d+[.,]?\d*|[.,]\d+)(?:[eE][+-]?\d+)?$"),
        "thousands": t.rlike(r"^\d+\.\d{3}$"),
        "comma": t.rlike(","),
    }


def type_expressions(c: Column, n: Column | None = None) -> dict[str, Column]:
    """The figures that ``decide_type`` needs; ``n`` is the number of rows that a value stands for."""
    there = F.length(F.trim(c)) > 0
    count = lambda flag: F.sum(F.when(flag, F.lit(1) if n is None else n).otherwise(0))
    e = {"n": count(there), "distinct": F.approx_count_distinct(F.when(there, F.trim(c)))}
    return e | {k: count(there & f) for k, f in type_flags(c).items()}


def infer_type(df: DataFrame, column: str, threshold: float = 0.8, identifier_rate: float = 0.9) -> dict:
    """The implicit type of a text column and the share of values that agree."""
    return decide_type(aggregate(df, type_expressions(F.col(f"`{column}`"))), threshold, identifier_rate)


def decide_type(got: dict, threshold: float = 0.8, identifier_rate: float = 0.9) -> dict:
    """The implicit type from the figures of ``type_expressions``."""
    flags = [k for k in got if k not in ("n", "distinct")]
    n = got["n"]
    if not n:
        return {"type": "unknown", "share": None, "n": 0}
    share = {k: got[k] / n for k in flags}
    if share["logical"] >= threshold and got["logical_word"]:
        kind = "logical"
    elif share["date"] >= threshold:
        kind = "timestamp" if share["timestamp"] >= threshold else "date"
    elif share["time"] >= threshold:
        kind = "time"
    elif min(1.0, got["distinct"] / n) >= identifier_rate and share["identifier_shape"] >= threshold:
        kind = "identifier"
    elif share["integer"] >= threshold:
        kind = "integer"
    elif share["double"] >= threshold and not (share["thousands"] >= threshold and not got["comma"]):
        kind = "double"
    else:
        kind = "text"
    return {"type": kind, "share": share.get({"identifier": "identifier_shape"}.get(kind, kind), 1.0), "n": n}
