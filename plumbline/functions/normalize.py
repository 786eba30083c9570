"""Normalization for comparison, in a fixed order of steps, over distinct values."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTES = {ord(c): "'" for c in "‘’‚‛′´`"} | {ord(c): '"' for c in "“”„‟«»″"}
_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st", 0xE6: "ae", 0xC6: "AE", 0x153: "oe", 0x152: "OE"}
_INVISIBLE = {c: None for c in (*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0), 0xAD, 0x200B, 0x2060, 0xFEFF)}
_SPACES = {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}


@dataclass(frozen=True)
class Normalization:
    """Which steps apply; characters in ``protect`` keep their accent."""

    lower: bool = True
    spaces: bool = True
    accents: bool = True
    quotes: bool = True
    punctuation: bool = False
    ligatures: bool = False
    width: bool = False
    protect: tuple[str, ...] = ("ñ", "ü", "g̃")

    def apply(self, text: str | None) -> str | None:
        """One text, normalized."""
        if text is None:
            return None
        text = text.translate(_INVISIBLE | _SPACES)
        if self.width:
            text = "".join(unicodedata.normalize("NFKC", c) if 0xFF00 <= ord(c) <= 0xFFEF else c for c in text)
        if self.ligatures:
            text = text.translate(_LIGATURES)
        if self.quotes:
            text = text.translate(_QUOTES)
        if self.punctuation:
            text = "".join(" " if unicodedata.category(c).startswith("P") else c for c in text)
        text = unicodedata.normalize("NFD", text)
        if self.accents:
            keep = {unicodedata.normalize("NFD", x) for p in self.protect for x in (p, p.upper())}
            out, i = [], 0
            while i < len(text):
                j = i + 1
                while j < len(text) and unicodedata.combining(text[j]):
                    j += 1
                cluster = text[i:j]
                out.append(cluster if cluster in keep else cluster[:1] if unicodedata.combining(cluster[-1]) and j > i + 1 else cluster)
                i = j
            text = "".join(out)
        text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.lower()
        return " ".join(text.split()) if self.spaces else text


def normalize(column: Column, how: Normalization = Normalization()) -> Column:
    """A column, normalized (a pandas UDF; apply it to distinct values)."""

    @F.pandas_udf("string")
    def over(values: pd.Series) -> pd.Series:
        return values.map(how.apply, na_action="ignore")

    return over(column)


def normalize_column(df: DataFrame, column: str, out: str, how: Normalization = Normalization()) -> DataFrame:
    """``df`` with a normalized copy of a column; each distinct value is normalized once and joined back."""
    values = df.select(F.col(f"`{column}`").alias("_raw")).where("_raw IS NOT NULL").distinct().withColumn(out, normalize(F.col("_raw"), how))
    return df.join(values, F.col(f"`{column}`") == F.col("_raw"), "left").drop("_raw")


def merge_report(df: DataFrame, column: str, how: Normalization = Normalization()) -> list[dict]:
    """Per step the number of distinct values that it alone merges: those without it minus those with all steps."""
    steps = [s for s in ("lower", "spaces", "accents", "quotes", "punctuation", "ligatures", "width") if getattr(how, s)]
    values = df.select(F.col(f"`{column}`").alias("v")).where("v IS NOT NULL").distinct()
    whole = values.select(normalize(F.col("v"), how).alias("all"), *[normalize(F.col("v"), replace(how, **{s: False})).alias(s) for s in steps])
    r = whole.agg(*[F.countDistinct(c).alias(c) for c in ("all", *steps)]).first()
    return [{"step": s, "n_merged": r[s] - r["all"]} for s in steps]
