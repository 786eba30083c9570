"""Personal data: classification by column name and by the shape of values, and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import validators
from plumbline.plans.aggplan import aggregate
from plumbline.schemas import declared_type

NAMES = {
    "name": r"(^|_)(first_?name|last_?name|full_?name|surname|nombre|apellido)", "email": r"e_?mail|correo", "phone": r"phone|telefono|celular|mobile", "address": r"address|domicilio|direccion|street",
    "document": r"(^|_)(ssn|passport|cedula|documento|dni|ci|tax_?id|rut)($|_)", "birth_date": r"birth|nacimiento", "ip": r"(^|_)ip(_?address)?($|_)", "card": r"card_?(no|number)|tarjeta",
}
POWER = ("weak", "medium", "high", "verified")


def shapes(column: Column) -> dict[str, Column]:
    """Whether a value has the shape of a kind of personal data."""
    t = F.trim(column)
    digits = F.regexp_replace(t, r"[ .\-]", "")
    return {
        "email": validators.is_email(t),
        "hidden_email": t.rlike(r"(?i)^[a-z0-9._-]+\s*[\[(]\s*(?:at|arroba)\s*[\])]\s*[a-z0-9.-]+"),
        "ip": t.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"),
        "phone": t.rlike(r"^\+?\d[\d ().-]{6,16}\d$"),
        "card": digits.rlike(r"^\d{13,19}$") & validators.is_luhn(digits),
        "iban": validators.is_iban(t),
        "document": validators.is_ci_uy(t),
    }


def shape_shares(df: DataFrame, columns: list[str] | None = None) -> list[dict]:
    """Per text column and shape the values that have it, of the present ones, in one pass."""
    names = columns or [n for n in df.columns if declared_type(df.schema[n].dataType) == "text"]
    e = {}
    for n in names:
        c = F.col(f"`{n}`")
        e[f"{n}\0n"], e[f"{n}\0distinct"] = F.count(c), F.approx_count_distinct(c)
        e |= {f"{n}\0{k}": F.count(F.when(s, 1)) for k, s in shapes(c).items()}
    got = aggregate(df, e) if e else {}
    return [{"column": n, "shape": k, "n": got[f"{n}\0n"], "n_distinct": got[f"{n}\0distinct"], "n_matching": got[f"{n}\0{k}"]} for n in names for k in shapes(F.lit(""))]


def classify(df: DataFrame, threshold: float = 0.9, min_distinct: int = 3) -> list[dict]:
    """Columns that seem personal: kind, power (weak by name, high by shape, verified by check digits or both) and whether to protect."""
    by_shape = shape_shares(df)
    out = []
    for n in df.columns:
        named = next((k for k, p in NAMES.items() if re.search(p, n.lower())), None)
        best = max((r for r in by_shape if r["column"] == n and r["n"] and r["n_matching"] / r["n"] >= threshold and r["n_distinct"] >= min_distinct), key=lambda r: r["n_matching"], default=None)
        if best is None and named is None:
            continue
        verified = best is not None and best["shape"] in ("card", "iban", "document")
        power = "verified" if verified else "high" if best is not None else "medium" if named in ("document", "email", "birth_date", "card") else "weak"
        out.append({"column": n, "kind": best["shape"] if best else named, "share": best["n_matching"] / best["n"] if best else None, "power": power, "protect": power != "weak"})
    return out


def mask_rows(rows: list[dict], protected: set[str], fields: tuple[str, ...] = ("mode", "min", "max", "mean", "median", "q1", "q3", "min_exact", "max_exact", "min_date", "max_date")) -> list[dict]:
    """Profile rows without what would show values of protected columns."""
    return [{k: (None if k in fields else v) for k, v in r.items()} | {"state": "omitted_for_privacy"} if r["column"] in protected else r for r in rows]


def mask_column(df: DataFrame, column: str, keep_last: int = 0) -> DataFrame:
    """A column with every character but the last ones starred."""
    c = F.col(f"`{column}`").cast("string")
    shown = F.substring(c, -keep_last, keep_last) if keep_last else F.lit("")
    return df.withColumn(column, F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - keep_last, F.lit(0))), shown))
