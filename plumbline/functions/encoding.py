"""Repair of text that was decoded with the wrong character set, over distinct values.

A text that looks broken is re-encoded in a single-byte character set and decoded as UTF-8, as often as that makes
it less broken. Codecs are Python's own.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "mac_roman", "cp437", "cp850")
STATES = ("repaired", "partly_repaired", "failed", "not_broken")
_BAD = re.compile(
    "[ÂÃÄÅÎÏÐÑ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
    "|â[\u0080-¿€œ][\u0080-¿™œ\u009d“”˜¦¢š]|ï¿½|�|├[─-╿¡-ÿ]|√[¡-ÿ©]"
)


def badness(text: str) -> int:
    """Signs of a wrong decoding."""
    return len(_BAD.findall(text)) + sum(0x80 <= ord(c) < 0xA0 for c in text)


def repair(text: str, rounds: int = 20) -> tuple[str, str]:
    """A text, repaired as far as that helps, and its state."""
    start = badness(text)
    if not start:
        return text, "not_broken"
    best = text
    for _ in range(rounds):
        now, found = badness(best), None
        for codec in CODECS:
            try:
                tried = _encode(best, codec).decode("utf-8")
            except (UnicodeError, ValueError):
                continue
            score = badness(tried)
            if tried != best and score < now:
                found, now = tried, score
        if found is None:
            break
        best = found
    if best == text:
        return text, "failed"
    return best, "repaired" if badness(best) == 0 else "partly_repaired"


def _encode(text: str, codec: str) -> bytes:
    """Bytes in a codec; control characters, which Windows code pages leave undefined, stand for themselves."""
    if codec == "cp1252":
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode(codec) for c in text)
    return text.encode(codec)


def repair_column(column: Column) -> Column:
    """A struct of the repaired ``text`` and its ``state`` (apply it to distinct values)."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("state", T.StringType())])

    @F.pandas_udf(kind)
    def over(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else repair(v) for v in values], columns=["text", "state"])

    return over(column)
