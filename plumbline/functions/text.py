"""Text functions: pattern generalisation, hygiene flags, numbers as text, q-grams. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters other than tab, line feed and carriage return, and characters without width that can go.
CONTROLS = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{80}-\x{9F}\x{AD}\x{200B}\x{2060}\x{FEFF}]"
#: Spaces that look like a space but are another character.
INVISIBLE_SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Joiners and direction marks, which may carry meaning.
MEANINGFUL_INVISIBLES = r"[\x{200C}\x{200D}\x{200E}\x{200F}\x{202A}-\x{202E}]"
LINE_SEPARATORS = r"[\n\r\t\x{2028}\x{2029}]"
HTML_ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
#: UTF-8 read as Latin-1 or Windows-1252: a lead byte's character followed by a continuation byte's.
MOJIBAKE = r"[\x{C2}\x{C3}][\x{80}-\x{BF}\x{20AC}\x{201A}\x{192}\x{201E}\x{2026}\x{2020}\x{2021}\x{2C6}\x{2030}\x{160}\x{2039}\x{152}\x{17D}\x{2018}\x{2019}\x{201C}\x{201D}\x{2022}\x{2013}\x{2014}\x{2DC}\x{2122}\x{161}\x{203A}\x{153}\x{17E}\x{178}]|\x{E2}\x{20AC}|\x{FFFD}"


def pattern(column: Column, distinguish_case: bool = True, expand: bool = False) -> Column:
    """A text's shape: digits to 9, lower-case letters to a, upper-case ones to A; runs collapse to 9+, a+, A+ unless ``expand``."""
    more = "" if expand else "+"
    out = F.regexp_replace(column, rf"\p{{Nd}}{more}", "9" + more)
    if distinguish_case:
        out = F.regexp_replace(out, rf"\p{{Lu}}{more}", "\x01")
        out = F.regexp_replace(out, rf"[\p{{L}}]{more}", "a" + more)
        return F.regexp_replace(out, "\x01", "A" + more)
    return F.regexp_replace(out, rf"\p{{L}}{more}", "a" + more)


def pattern_to_regex(shape: str) -> str:
    """The regular expression that a shape stands for."""
    out, i = [], 0
    classes = {"9": "[0-9]", "a": r"\p{Ll}", "A": r"\p{Lu}"}
    while i < len(shape):
        c = shape[i]
        if c in classes:
            out.append(classes[c])
            if shape[i + 1 : i + 2] == "+":
                out.append("+")
                i += 1
        else:
            out.append("\\" + c if c in r"\.[]{}()*+-?^$|/" else c)
        i += 1
    return "^" + "".join(out) + "$"


def is_blank(column: Column) -> Column:
    """Only white space."""
    return F.length(F.trim(column)) == 0


def has_border_space(column: Column) -> Column:
    """White space before or after a text that isn't blank."""
    return column.rlike(r"^\s+\S|\S\s+$")


def hygiene_flags(column: Column) -> dict[str, Column]:
    """The text diagnostics that one pass can count, by name."""
    return {
        "blanks": is_blank(column),
        "border_spaces": has_border_space(column),
        "invisible_controls": column.rlike(CONTROLS),
        "invisible_spaces": column.rlike(INVISIBLE_SPACES),
        "meaningful_invisibles": column.rlike(MEANINGFUL_INVISIBLES),
        "html_entities": column.rlike(HTML_ENTITY),
        "field_separators": column.rlike(LINE_SEPARATORS),
        "broken_encoding": column.rlike(MOJIBAKE),
    }


#: A number with optional sign, currency before or after, and unit; groups: currency, sign, digits, unit, currency.
NUMBER_TEXT = r"^\s*(U\$S|[A-Z]{3}|\p{Sc})?\s*([+-]?)\s*(\d[\d.,' ]*\d|\d)\s*(%|[a-z]{1,4})?\s*([A-Z]{3}|\p{Sc})?\s*$"


def number_parts(column: Column) -> dict[str, Column]:
    """Parts of a number written as text; empty where absent."""
    part = lambda k: F.regexp_extract(column, NUMBER_TEXT, k)
    digits = part(3)
    currency = F.when(part(1) != "", part(1)).otherwise(part(5))
    decimal_comma = digits.rlike(r",\d{1,2}$|,\d{4,}$|\d\.\d{3}.*,\d+$")
    decimal_point = digits.rlike(r"\.\d{1,2}$|\.\d{4,}$|\d,\d{3}.*\.\d+$")
    ambiguous = digits.rlike(r"^\d{1,3}[.,]\d{3}$")
    return {"digits": digits, "sign": part(2), "unit": part(4), "currency": currency, "decimal_comma": decimal_comma & ~ambiguous, "decimal_point": decimal_point & ~ambiguous, "ambiguous": ambiguous}


def regional_number(column: Column, convention: str) -> Column:
    """A number from text under a convention (decimal_comma or decimal_point); percentages are divided by 100."""
    digits = F.regexp_extract(column, NUMBER_TEXT, 3)
    sign = F.regexp_extract(column, NUMBER_TEXT, 2)
    plain = F.regexp_replace(F.regexp_replace(digits, r"[. ']", ""), ",", ".") if convention == "decimal_comma" else F.regexp_replace(digits, r"[, ']", "")
    value = F.concat(F.when(sign == "-", "-").otherwise(""), plain).try_cast("double")
    return F.when(F.regexp_extract(column, NUMBER_TEXT, 4) == "%", value / 100).otherwise(value)


def qgrams(column: Column, q: int = 3) -> Column:
    """Distinct q-grams; a shorter text is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - q + 1, F.lit(1))), lambda i: F.substring(column, i, F.lit(q)))
    return F.when(F.length(column) < q, F.array(column)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def snake_case(name: str) -> str:
    """A column name in snake case, of ASCII letters, digits and underscores."""
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)
    plain = re.sub(r"[^0-9A-Za-z]+", "_", plain).strip("_").lower()
    return plain if plain and not plain[0].isdigit() else "x_" + plain if plain else "x"


def unique_names(names: list[str], snake: bool = False) -> list[str]:
    """Usable and distinct column names, in order; later repeats get a number."""
    import re

    out: list[str] = []
    for name in names:
        base = snake_case(name) if snake else re.sub(r"[^0-9A-Za-z_]", "_", name) or "x"
        if not snake and base[0].isdigit():
            base = "x" + base
        new, k = base, 1
        while new in out:
            k += 1
            new = f"{base}_{k}"
        out.append(new)
    return out


def multivalued(column: Column, separator: str) -> Column:
    """Whether a text is a list of two or more parts of one kind (all numbers, or all single words) under a separator."""
    parts = F.transform(F.split(column, "\\" + separator), lambda p: F.trim(p))
    numbers = F.forall(parts, lambda p: p.rlike(r"^[+-]?\d+(?:\.\d+)?$"))
    words = F.forall(parts, lambda p: p.rlike(r"^[\p{L}\d_-]{1,30}$") & p.rlike(r"\p{L}"))
    # a number with a decimal comma is no list
    lone = column.rlike(r"^\s*[+-]?\d{1,3}(?:,\d{3})*(?:,\d+)?\s*$") if separator == "," else F.lit(False)
    return column.contains(separator) & (numbers | words) & ~lone


def deviation_class(shape: str, main: str) -> str:
    """How a rare shape differs from the main one: in length only, within a token, or in its tokens."""
    import re

    tokens = lambda s: re.findall(r"9\+?|a\+?|A\+?|[^9aA+]|\+", s)
    a, b = tokens(shape), tokens(main)
    if [t.rstrip("+") for t in a] == [t.rstrip("+") for t in b]:
        return "length_only"
    if len(a) == len(b):
        return "single_token" if sum(x != y for x, y in zip(a, b)) == 1 else "several_tokens"
    return "tokens_added" if len(a) > len(b) else "tokens_removed"
