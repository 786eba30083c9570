"""Structure discovery: keys, dependencies, inclusion relations, order, arithmetic, Benford, absence, redundant signals."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.missing import is_missing
from plumbline.plans.aggplan import aggregate, as_number, value_counts
from plumbline.schemas import NUMERIC, TEMPORAL, declared_type


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


#: Columns of a family that are compared for order, and columns whose absence is explained; profiles tell which ones are left out.
MAX_ORDERED, MAX_ABSENT = 20, 40


def _fingerprint(names: list[str]) -> Column:
    """A 128-bit row fingerprint of some columns, in which null is a value of its own."""
    values = [_col(n) for n in names]
    nulls = F.concat(*[v.isNull().cast("string") for v in values])
    return F.struct(F.xxhash64(nulls, *values), F.xxhash64(F.lit(1), nulls, *values))


def detect_keys(df: DataFrame, max_size: int = 3, columns: list[str] | None = None, near_min_rows: int = 100, near_rate: float = 0.9, near_share: float = 0.5) -> list[dict]:
    """Minimal unique column combinations without nulls, and single columns that are nearly unique.

    Per size one pass: all candidate combinations' fingerprints are expanded and counted together. Combinations
    that contain a found key are not tried. A double column is a candidate only if it is integral.
    """
    names = [n for n in (columns or df.columns) if declared_type(df.schema[n].dataType) not in ("composite", "binary")]
    checks = {"n": F.count(F.lit(1))}
    for n in names:
        checks[f"lost\0{n}"] = F.count(F.when(is_missing(_col(n), df.schema[n].dataType), 1))
        if declared_type(df.schema[n].dataType) == "double":
            d = _col(n).cast("double")
            checks[f"fraction\0{n}"] = F.count(F.when(d != F.floor(d), 1))
    seen = aggregate(df, checks)
    total = seen["n"]
    if not total:
        return []
    names = [n for n in names if not seen[f"lost\0{n}"] and not seen.get(f"fraction\0{n}")]
    found: list[tuple[str, ...]] = []
    out = []
    for size in range(1, max_size + 1):
        tries = [c for c in combinations(names, size) if not any(set(k) <= set(c) for k in found)]
        if not tries:
            continue
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), _fingerprint(list(c)).alias("f")) for i, c in enumerate(tries)])).alias("v")).select("v.*")
        groups = long.groupBy("c", "f").agg(F.count("*").alias("n"))
        stats = groups.groupBy("c").agg(F.count("*").alias("distinct"), F.max("n").alias("top"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("surplus"))
        for r in sorted(stats.collect(), key=lambda r: r["c"]):
            combo = tries[r["c"]]
            if r["distinct"] == total:
                found.append(combo)
                out.append({"columns": list(combo), "size": size, "kind": "key", "n_rows": total, "n_distinct": r["distinct"], "rate": 1.0})
            elif size == 1 and total >= near_min_rows and r["distinct"] / total >= near_rate and declared_type(df.schema[combo[0]].dataType) not in TEMPORAL and (r["top"] - 1) / r["surplus"] >= near_share:
                out.append({"columns": list(combo), "size": 1, "kind": "near_key", "n_rows": total, "n_distinct": r["distinct"], "rate": r["distinct"] / total})
    return out


def detect_dependencies(
    df: DataFrame, threshold: float = 0.995, columns: list[str] | None = None, near_constant: float = 0.95, near_key: float = 0.8, min_rows: int = 10, include_keys: bool = False, max_pairs: int = 200_000
) -> DataFrame:
    """Functional dependencies x to y by compliance (sum over x of its most frequent y's count, over complete rows).

    All pairs are counted in one expanded pass. Columns that are nearly constant or nearly a key don't determine.
    """
    names = [n for n in (columns or df.columns) if declared_type(df.schema[n].dataType) not in ("composite", "binary")]
    counts = value_counts(df, names)
    stats = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.max("n").alias("top")).collect()}
    able = [n for n in names if n in stats and stats[n]["n"] >= min_rows and stats[n]["top"] / stats[n]["n"] < near_constant and (include_keys or (stats[n]["d"] < stats[n]["n"] and stats[n]["d"] / stats[n]["n"] < near_key))]
    pairs = [(x, y) for x in able for y in names if x != y and y in stats and stats[y]["d"] > 1][:max_pairs]
    schema = "determinant string, dependent string, compliance double, n long, violations long"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    hashed = df.select(*[F.when(~is_missing(_col(n), df.schema[n].dataType), F.xxhash64(_col(n))).alias(f"h{i}") for i, n in enumerate(names)])
    at = {n: F.col(f"h{i}") for i, n in enumerate(names)}
    long = hashed.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), at[x].alias("x"), at[y].alias("y")) for k, (x, y) in enumerate(pairs)])).alias("p")).select("p.*")
    both = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    best = both.groupBy("pair", "x").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    out = best.groupBy("pair").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).where(F.col("n") >= min_rows)
    name = df.sparkSession.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "pair int, determinant string, dependent string")
    out = out.join(F.broadcast(name), "pair").select("determinant", "dependent", (F.col("m") / F.col("n")).alias("compliance"), "n", (F.col("n") - F.col("m")).alias("violations"))
    return out.where(F.col("compliance") >= threshold).orderBy(F.desc("compliance"), F.desc("n"), "determinant", "dependent")


def _family(kind: T.DataType) -> str:
    declared = declared_type(kind)
    return "number" if declared in NUMERIC else declared


def detect_relations(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]] | None = None, min_coverage: float = 0.9, prune: bool = True) -> DataFrame:
    """Inclusion relations between columns of two tables: coverage of rows both ways, common values, cardinality.

    Both tables' value counts are made in one pass each and joined once for all pairs. Pairs of other families, and
    with ``prune`` pairs of disjoint ranges, are not compared. ``min_coverage`` is the least of the larger coverage.
    """
    if pairs is None:
        pairs = [(a, b) for a in left.columns for b in right.columns if _family(left.schema[a].dataType) == _family(right.schema[b].dataType) != "composite"]
    else:
        for a, b in pairs:
            if a not in left.columns or b not in right.columns:
                raise ValueError(f"unknown pair {a}, {b}")
        pairs = [(a, b) for a, b in pairs if _family(left.schema[a].dataType) == _family(right.schema[b].dataType)]
    schema = "left string, right string, n_common long, coverage_left double, coverage_right double, cardinality string"
    spark = left.sparkSession
    if not pairs:
        return spark.createDataFrame([], schema)
    a_counts, b_counts = value_counts(left, sorted({a for a, _ in pairs})), value_counts(right, sorted({b for _, b in pairs}))
    if prune:
        span = lambda c: {r["column"]: r for r in c.groupBy("column").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.min("text").alias("tlo"), F.max("text").alias("thi")).collect()}
        sa, sb = span(a_counts), span(b_counts)

        def apart(x: str, y: str) -> bool:
            p, q = sa.get(x), sb.get(y)
            if p is None or q is None:
                return True
            return any(p[lo] is not None and q[lo] is not None and (p[hi] < q[lo] or q[hi] < p[lo]) for lo, hi in (("lo", "hi"), ("tlo", "thi")))

        pairs = [(x, y) for x, y in pairs if not apart(x, y)]
        if not pairs:
            return spark.createDataFrame([], schema)
    wanted = F.broadcast(spark.createDataFrame(pairs, "left string, right string"))
    # integers beyond the exact doubles are compared by their digits
    value = F.struct(F.col("number"), F.col("text"), F.when(F.abs("number") >= 2.0**53, F.col("exact")).alias("exact"))
    a_side = a_counts.select(F.col("column").alias("left"), F.to_json(value).alias("v"), F.col("n").alias("an")).join(wanted, "left")
    b_side = b_counts.select(F.col("column").alias("right"), F.to_json(value).alias("v"), F.col("n").alias("bn")).join(wanted, "right")
    met = a_side.join(b_side, ["left", "right", "v"], "full")
    sums = met.groupBy("left", "right").agg(
        F.count(F.when(F.col("an").isNotNull() & F.col("bn").isNotNull(), 1)).alias("n_common"),
        F.sum("an").alias("a_rows"),
        F.sum("bn").alias("b_rows"),
        F.sum(F.when(F.col("bn").isNotNull(), F.col("an"))).alias("a_in"),
        F.sum(F.when(F.col("an").isNotNull(), F.col("bn"))).alias("b_in"),
        F.max("an").alias("a_max"),
        F.max("bn").alias("b_max"),
    )
    one_left, one_right = F.col("a_max") == 1, F.col("b_max") == 1
    kind = F.when(F.col("n_common") == 0, "no_match").when(one_left & one_right, "1:1").when(one_left, "1:m").when(one_right, "m:1").otherwise("m:m")
    out = sums.select(
        "left", "right", "n_common",
        (F.coalesce("a_in", F.lit(0)) / F.col("a_rows")).alias("coverage_left"),
        (F.coalesce("b_in", F.lit(0)) / F.col("b_rows")).alias("coverage_right"),
        kind.alias("cardinality"),
    )
    return out.where(F.greatest("coverage_left", "coverage_right") >= min_coverage)


def _ordered(df: DataFrame, columns: list[str] | None, families: tuple[str, ...], limit: int) -> list[str]:
    return [n for n in (columns or df.columns) if declared_type(df.schema[n].dataType) in families][:limit]


def detect_order(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95, overlap: float = 0.1, max_columns: int = MAX_ORDERED) -> list[dict]:
    """Pairs of columns with a at most b in nearly all complete rows, though not all; compared only if their middle halves overlap."""
    out = []
    for families in (NUMERIC, TEMPORAL):
        names = _ordered(df, columns, families, max_columns)
        if len(names) < 2:
            continue
        number = {n: as_number(_col(n), df.schema[n].dataType) for n in names}
        finite = {n: F.when(~F.isnan(c), c) for n, c in number.items()}
        quart = aggregate(df, {n: F.percentile_approx(c, [0.25, 0.75], 10_000) for n, c in finite.items()})
        pairs = []
        for a, b in combinations([n for n in names if quart[n]], 2):
            (p, q), (r, s) = quart[a], quart[b]
            width = min(q - p, s - r)
            share = (min(q, s) - max(p, r)) / width if width > 0 else 1.0
            if share >= overlap:
                pairs += [(a, b), (b, a)]
        if not pairs:
            continue
        e = {}
        for a, b in pairs:
            both = finite[a].isNotNull() & finite[b].isNotNull()
            e[f"{a}\0{b}\0n"] = F.count(F.when(both, 1))
            e[f"{a}\0{b}\0bad"] = F.count(F.when(both & (finite[a] > finite[b]), 1))
        got = aggregate(df, e)
        for a, b in pairs:
            n, bad = got[f"{a}\0{b}\0n"], got[f"{a}\0{b}\0bad"]
            if n and bad and (bad <= n * (1 - threshold) if n >= 20 else bad == 1 and n > 2):
                out.append({"low": a, "high": b, "n_evaluated": n, "n_affected": bad, "compliance": 1 - bad / n})
    return out


def detect_arithmetic(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.9, min_rows: int = 3, max_columns: int = 20, tolerance: float = 1e-8) -> list[dict]:
    """Additive identities x + y = z and proportions y = k x that hold in at least ``threshold`` of the complete rows."""
    names = _ordered(df, columns, NUMERIC, max_columns)
    if len(names) < 2:
        return []
    c = {n: _col(n).cast("double") for n in names}
    spread = aggregate(df, {n: F.min(c[n]) != F.max(c[n]) for n in names})
    names = [n for n in names if spread[n]]
    e, triples = {}, []
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    for trio in combinations(names, 3):
        for z in trio:
            x, y = (n for n in trio if n != z)
            good = near(c[x] + c[y], c[z])
            e[f"{x}\0{y}\0{z}\0n"], e[f"{x}\0{y}\0{z}\0ok"] = F.count(good), F.count(F.when(good, 1))
            triples.append((x, y, z))
    got = aggregate(df, e) if e else {}
    out, implied = [], set()
    by_set: dict[frozenset, list[dict]] = {}
    for x, y, z in triples:
        n, ok = got[f"{x}\0{y}\0{z}\0n"], got[f"{x}\0{y}\0{z}\0ok"]
        if n >= min_rows and ok / n >= threshold:
            by_set.setdefault(frozenset((x, y, z)), []).append({"kind": "additive", "columns": [x, y, z], "factor": None, "n_evaluated": n, "n_affected": n - ok, "compliance": ok / n})
    for group in by_set.values():
        best = min(group, key=lambda r: (r["n_affected"], r["columns"]))
        out.append(best)
        implied |= set(combinations(sorted(best["columns"]), 2))
    pairs = [(a, b) for a, b in combinations(names, 2) if tuple(sorted((a, b))) not in implied]
    if pairs:
        ratio = lambda a, b: F.when(c[a] != 0, c[b] / c[a])
        k = aggregate(df, {f"{a}\0{b}": F.percentile_approx(ratio(a, b), 0.5, 10_000) for a, b in pairs})
        chosen = []
        for a, b in pairs:
            f = k[f"{a}\0{b}"]
            if f is None or f == 0 or abs(f) == 1 or not math.isfinite(f):
                continue
            chosen.append((a, b, f) if abs(f) <= 1 else (b, a, 1 / f))
        e = {}
        for a, b, f in chosen:
            good = near(c[a] * f, c[b])
            e[f"{a}\0{b}\0n"], e[f"{a}\0{b}\0ok"] = F.count(good), F.count(F.when(good, 1))
        got = aggregate(df, e) if e else {}
        for a, b, f in chosen:
            n, ok = got[f"{a}\0{b}\0n"], got[f"{a}\0{b}\0ok"]
            if n >= min_rows and ok / n >= threshold:
                out.append({"kind": "proportional", "columns": [a, b], "factor": f, "n_evaluated": n, "n_affected": n - ok, "compliance": ok / n})
    return out


def first_digit(column: Column) -> Column:
    """The first significant digit of a number's absolute value; null for 0 and for what isn't finite."""
    d = F.abs(column.cast("double"))
    usable = (d > 0) & (d < float("inf"))
    return F.when(usable, F.regexp_extract(F.format_string("%.15e", F.when(usable, d)), r"^([1-9])", 1).try_cast("int"))


def benford(df: DataFrame, column: str, min_positive: int = 100, min_orders: float = 3.0) -> dict:
    """Leading digits against Benford's law: chi-square (8 degrees of freedom) and its p-value, if the preconditions hold."""
    return benford_all(df, [column], min_positive, min_orders)[0]


def benford_all(df: DataFrame, columns: list[str], min_positive: int = 100, min_orders: float = 3.0) -> list[dict]:
    """``benford`` of several columns at once."""
    got = aggregate(df, {f"{n}\0{k}": v for n in columns for k, v in _digit_expressions(n).items()}) if columns else {}
    return [_benford_of(n, {k.partition("\0")[2]: v for k, v in got.items() if k.startswith(f"{n}\0")}, min_positive, min_orders) for n in columns]


def _digit_expressions(column: str) -> dict[str, Column]:
    c = _col(column).cast("double")
    digit = first_digit(c)
    e = {"n": F.count(c), "positive": F.count(F.when(c > 0, 1)), "low": F.min(F.when(c > 0, c)), "high": F.max(c), "distinct": F.approx_count_distinct(c), "whole": F.count(F.when(c == F.floor(c), 1))}
    return e | {f"d{k}": F.count(F.when(digit == k, 1)) for k in range(1, 10)}


def _benford_of(column: str, r: dict, min_positive: int, min_orders: float) -> dict:
    out = {"column": column, "n": r["n"], "digits": [r[f"d{k}"] for k in range(1, 10)], "chi2": None, "p": None, "reason": None}
    if r["n"] < 50 or r["positive"] < min_positive:
        out["reason"] = "too_few_values"
    elif r["positive"] != r["n"]:
        out["reason"] = "not_all_positive"
    elif r["low"] == r["high"]:
        out["reason"] = "no_variation"
    elif math.log10(r["high"] / r["low"]) < min_orders:
        out["reason"] = "too_few_orders_of_magnitude"
    elif r["whole"] == r["n"] and r["distinct"] / r["n"] > 0.9 and r["distinct"] / (r["high"] - r["low"] + 1) >= 0.8:
        out["reason"] = "consecutive_numbers"
    else:
        n = sum(out["digits"])
        chi2 = sum((out["digits"][k - 1] - n * math.log10(1 + 1 / k)) ** 2 / (n * math.log10(1 + 1 / k)) for k in range(1, 10))
        out |= {"chi2": chi2, "p": math.exp(-chi2 / 2) * sum((chi2 / 2) ** k / math.factorial(k) for k in range(4)) if chi2 < 1400 else 0.0}
    return out


def structural_absence(
    df: DataFrame, columns: list[str] | None = None, determination: float = 0.99, max_levels: int = 20, min_per_level: int = 5, min_rows: int = 30, min_missing: int = 10, min_missing_rate: float = 0.05, max_columns: int = MAX_ABSENT, max_determinants: int = 30, exclusive_coverage: float = 0.95, exclusive_overlap: float = 0.01
) -> list[dict]:
    """Columns whose absence another column's level determines, and pairs of columns that exclude each other.

    One pass counts presence per determinant level for all candidates together.
    """
    names = (columns or df.columns)[:max_columns]
    there = {n: ~is_missing(_col(n), df.schema[n].dataType) for n in names}
    base = aggregate(df, {"n": F.count(F.lit(1))} | {n: F.count(F.when(p, 1)) for n, p in there.items()})
    total = base["n"]
    if total < min_rows:
        return []
    gaps = [n for n in names if total - base[n] >= min_missing and (total - base[n]) / total >= min_missing_rate and base[n]]
    plain = [n for n in df.columns if declared_type(df.schema[n].dataType) in ("text", "boolean", "integer")]
    sizes = aggregate(df, {n: F.approx_count_distinct(_col(n)) for n in plain}) if plain else {}
    determinants = [n for n in plain if 1 < sizes[n] <= max_levels * 1.2][:max_determinants]
    out = []
    if gaps and determinants:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("determinant"), _col(d).cast("string").alias("level")) for d in determinants])).alias("d"), *[there[g].cast("int").alias(f"p{i}") for i, g in enumerate(gaps)])
        counted = long.groupBy("d.determinant", "d.level").agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(gaps))]).collect()
        for i, g in enumerate(gaps):
            best = None
            for d in determinants:
                rows = [r for r in counted if r["determinant"] == d and r["level"] is not None]
                if d == g or not 1 < len(rows) <= max_levels or min(r["n"] for r in rows) < min_per_level:
                    continue
                n = sum(r["n"] for r in rows)
                agree = sum(max(r[f"p{i}"], r["n"] - r[f"p{i}"]) for r in rows)
                on = sorted(r["level"] for r in rows if r[f"p{i}"] * 2 > r["n"])
                if agree / n >= determination and 0 < len(on) < len(rows) and (best is None or agree / n > best["compliance"]):
                    best = {"kind": "determined", "column": g, "determinant": d, "levels": on, "rule": f"`{d}` IN ({', '.join(repr(x) for x in on)})", "n_evaluated": n, "n_affected": total - base[g], "compliance": agree / n}
            if best:
                out.append(best)
    pairs = list(combinations(gaps, 2))
    if pairs:
        e = {}
        for a, b in pairs:
            e[f"{a}\0{b}\0any"] = F.count(F.when(there[a] | there[b], 1))
            e[f"{a}\0{b}\0both"] = F.count(F.when(there[a] & there[b], 1))
        got = aggregate(df, e)
        for a, b in pairs:
            any_, both = got[f"{a}\0{b}\0any"], got[f"{a}\0{b}\0both"]
            if any_ / total >= exclusive_coverage and both / total <= exclusive_overlap:
                out.append({"kind": "exclusive", "column": a, "determinant": b, "levels": [], "rule": f"`{b}` IS NULL", "n_evaluated": total, "n_affected": total - base[a], "compliance": 1 - both / total})
    return out


@dataclass(frozen=True)
class RedundantSignal:
    """Columns that say the same, within a window; text is compared as it is, or transformed."""

    columns: tuple[str, ...]
    window: float = 0.0
    transform: object = None
    name: str | None = None

    def __post_init__(self) -> None:
        if len(self.columns) < 2 or len(set(self.columns)) != len(self.columns) or self.window < 0:
            raise ValueError("a signal has two or more distinct columns and a window of at least 0")


def detect_discordances(df: DataFrame, signals: list[RedundantSignal], key: list[str] | None = None) -> list[dict]:
    """Per signal the complete rows whose columns disagree, with the smallest key among them as the example."""
    e, conditions = {}, []
    for i, s in enumerate(signals):
        cols = [s.transform(_col(c)) if s.transform else _col(c) for c in s.columns]
        whole = F.lit(True)
        for c in cols:
            whole = whole & c.isNotNull()
        numeric = s.transform is None and all(declared_type(df.schema[c].dataType) in (*NUMERIC, *TEMPORAL) for c in s.columns)
        if numeric:
            numbers = [as_number(_col(c), df.schema[c].dataType) for c in s.columns]
            bad = F.greatest(*numbers) - F.least(*numbers) > s.window
        else:
            bad = F.lit(False)
            for c in cols[1:]:
                bad = bad | (c != cols[0])
        e[f"n{i}"], e[f"bad{i}"] = F.count(F.when(whole, 1)), F.count(F.when(whole & bad, 1))
        if key:
            e[f"ex{i}"] = F.min(F.when(whole & bad, F.concat_ws("|", *[_col(k).cast("string") for k in key])))
        conditions.append(whole & bad)
    got = aggregate(df, e)
    return [
        {"signal": s.name or "=".join(s.columns), "columns": list(s.columns), "n_evaluated": got[f"n{i}"], "n_affected": got[f"bad{i}"], "example": got.get(f"ex{i}"), "condition": conditions[i]}
        for i, s in enumerate(signals)
    ]


def duplicate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of columns of one type that are equal in every row, nulls included; pre-selected by a checksum of each."""
    names = [n for n in df.columns if declared_type(df.schema[n].dataType) != "composite"]
    sums = aggregate(df, {n: F.sum(F.xxhash64(F.coalesce(_col(n).cast("string"), F.lit("\0"))).cast("decimal(38,0)")) for n in names})
    pairs = [(a, b) for a, b in combinations(names, 2) if sums[a] is not None and sums[a] == sums[b] and df.schema[a].dataType == df.schema[b].dataType]
    if not pairs:
        return []
    differ = aggregate(df, {f"{a}\0{b}": F.count(F.when(~_col(a).eqNullSafe(_col(b)), 1)) for a, b in pairs})
    return [(a, b) for a, b in pairs if differ[f"{a}\0{b}"] == 0]


def split_dates(df: DataFrame, min_valid: float = 0.8) -> list[dict]:
    """Year, month and day columns (by name) that make valid dates together."""
    import re

    role = lambda n: next((r for r, p in (("year", r"(^|_)(year|anio|ano|yr|yyyy)"), ("month", r"(^|_)(month|mes|mm)"), ("day", r"(^|_)(day|dia|dd)")) if re.search(p, n.lower())), None)
    by: dict[str, list[str]] = {"year": [], "month": [], "day": []}
    for n in df.columns:
        if role(n) and declared_type(df.schema[n].dataType) in (*NUMERIC, "text"):
            by[role(n)].append(n)
    trios = [(y, m, d) for y in by["year"] for m in by["month"] for d in by["day"]]
    if not trios:
        return []
    e = {}
    for y, m, d in trios:
        parts = [_col(x).try_cast("int") for x in (y, m, d)]
        whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
        made = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", *parts), F.lit("yyyy-MM-dd"))
        e[f"{y}\0{m}\0{d}\0n"], e[f"{y}\0{m}\0{d}\0ok"] = F.count(F.when(whole, 1)), F.count(F.when(whole & made.isNotNull(), 1))
    got = aggregate(df, e)
    return [{"columns": list(t), "n_evaluated": n, "n_valid": ok, "rate": ok / n} for t in trios if (n := got["\0".join((*t, "n"))]) and (ok := got["\0".join((*t, "ok"))]) / n >= min_valid]
