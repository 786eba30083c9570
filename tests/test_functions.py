"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import distances, encoding, geometry, text, types_dates, validators
from plumbline.functions.normalize import Normalization, merge_report
from plumbline.operators import fuzzy
from plumbline.sources.tables import parse_identifier


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "validator, good, bad",
    [
        (validators.is_luhn, ["4111111111111111", "0"], ["4111111111111112", "41 11", ""]),
        (validators.is_mod97, ["3214282912345698765432161182"], ["3214282912345698765432161183", "a b"]),
        (validators.is_iban, ["GB82 WEST 1234 5698 7654 32"], ["GB83 WEST 1234 5698 7654 32"]),
        (validators.is_email, ["a.b@example.com"], ["a b@example.com", "@example.com", "a@b", "x" * 65 + "@example.com", "a@b..com"]),
        (validators.is_url, ["http://example.com", "https://1.2.3.4:80/a?b#c", "http://[::1]/"], ["example.com", "http://", "http://256.1.1.1", "http://a b", "ftp://example.com", "http://a.com:70000", "http://a.com/%zz"]),
        (validators.is_iso3166, ["UY", "de"], ["XX", "URY"]),
        (validators.is_iso4217, ["USD", "uyu"], ["ABC"]),
        (validators.is_ci_uy, ["1.234.567-2", "12345672"], ["12345678", "123"]),
        (validators.is_rut_uy, ["211003420017"], ["211003420018", "231003420017", "21100342"]),
    ],
)
def test_validators(spark, validator, good, bad):
    assert apply(spark, validator, [*good, *bad, None]) == [True] * len(good) + [False] * len(bad) + [None]


def test_country_forms(spark):
    assert apply(spark, lambda c: validators.is_iso3166(c, "numeric"), ["8", "858", "999"]) == [True, True, False]
    assert apply(spark, lambda c: validators.is_iso3166(c, "alpha3"), ["URY", "UY"]) == [True, False]


def test_patterns(spark):
    assert apply(spark, text.pattern, ["Abc-12", "ABÑ é9", "", None]) == ["A+a+-9+", "A+ a+9+", "", None]
    assert apply(spark, lambda c: text.pattern(c, False, True), ["Ab1"]) == ["aa9"]
    assert apply(spark, lambda c: c.rlike(text.pattern_to_regex("A+a+-9+")), ["Abc-12", "abc-12"]) == [True, False]


def test_regional_numbers(spark):
    assert apply(spark, lambda c: text.regional_number(c, "decimal_comma"), ["$ 1.234,50", "-5", "12,5%", "x"]) == [1234.5, -5.0, 0.125, None]
    assert apply(spark, lambda c: text.regional_number(c, "decimal_point"), ["USD 1,234.50"]) == [1234.5]


def test_dates(spark):
    df = spark.createDataFrame([("31/12/2020",), ("2020-02-30",), ("2021-03-04",), ("01/02/2020",), (None,)], "d string")
    found = {f["format"]: (f["n"], f["state"]) for f in types_dates.detect_date_formats(df, "d")}
    assert found == {"yyyy-MM-dd": (1, "confirmed"), "dd/MM/yyyy": (2, "confirmed")}
    vague = spark.createDataFrame([("01/02/2020",)], "d string")
    assert {f["state"] for f in types_dates.detect_date_formats(vague, "d")} == {"ambiguous"}
    got = [str(r[0]) for r in df.select(types_dates.parse_dates(F.col("d"), ["yyyy-MM-dd", "dd/MM/yyyy"])).collect()]
    assert got == ["2020-12-31", "None", "2021-03-04", "2020-02-01", "None"]


@pytest.mark.parametrize("values, kind", [(["1", "2", "30"], "integer"), (["1.5", "2", "3e4"], "double"), (["yes", "no"], "logical"), (["10:30", "23:59"], "time"), (["2020-01-01", "2021-01-02"], "date"), (["2020-01-01 10:00", "2021-01-02 11:30"], "timestamp"), (["A1", "B2", "C3"], "identifier"), (["hello", "world"], "text"), (["", None], "unknown"), (["1.234", "5.678"], "text")])
def test_implicit_types(spark, values, kind):
    assert types_dates.infer_type(spark.createDataFrame([(v,) for v in values], "v string"), "v")["type"] == kind


def test_normalization():
    n = Normalization()
    assert n.apply("  Ñandú  “x” ") == 'ñandu "x"' and n.apply("Ü é") == "ü e" and n.apply(None) is None
    assert Normalization(ligatures=True, width=True, punctuation=True).apply("ﬁn, Ａ") == "fin a"


def test_merge_report(spark):
    df = spark.createDataFrame([("Río",), ("rio",), ("RIO ",)], "v string")
    assert {r["step"]: r["n_merged"] for r in merge_report(df, "v")} == {"lower": 2, "spaces": 1, "accents": 1, "quotes": 0}


@pytest.mark.parametrize("good", ["café", "naïve “quotes” — ok", "Ñandú", "日本語", "größer"])
def test_encoding_repair(good):
    assert encoding.repair(good) == (good, "not_broken")
    if not good.isascii():
        once = "".join(c if len(c) else "" for c in good.encode("utf-8").decode("latin-1"))
        fixed, state = encoding.repair(once)
        assert (fixed, state) == (good, "repaired")


def test_distances(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("abcd", "acbd"), ("same", "same")], "a string, b string")
    of = lambda m: [round(r[0], 4) for r in df.select(distances.distance(F.col("a"), F.col("b"), m)).collect()]
    assert of("jw") == [0.0389, 0.075, 0.0] and of("lv") == [2, 2, 0] and of("osa") == [1, 1, 0] and of("hamming") == [2, 2, 0] and of("lcs") == [2, 2, 0]
    assert all(of(m)[2] == 0 for m in distances.METHODS)


def test_jaro_winkler_against_duckdb():
    import random

    import duckdb

    rng, con = random.Random(1), duckdb.connect()
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(2))
        want = con.execute("SELECT jaro_similarity(?, ?)", [a, b]).fetchone()[0]
        assert abs(distances.jaro_winkler(a, b, 0.0) - want) < 1e-9


def test_near_records(spark):
    df = spark.createDataFrame([("maria perez",), ("María  Pérez",), ("maria peres",), ("juan lopez",), (None,)], "name string")
    pairs = [(r.a, r.b) for r in fuzzy.detect_near_duplicates(df, ["name"]).collect()]
    assert pairs == [("maria peres", "maria perez")]
    assert fuzzy.exact_duplicates(df, ["name"]) == {"exact": 0, "exact_normalized": 1}
    assert fuzzy.lsh_guarantee(0.9) > 0.99
    with pytest.raises(ValueError):
        fuzzy.near_pairs(df, "name", max_pairs=1)


def test_geometry(spark):
    df = spark.createDataFrame([("POINT (1 2)",), ("POINT (200 2)",), ("POLYGON ((0 0, 1 0, 1 1, 0 0))",), ("POLYGON ((0 0, 1 0, 1 1))",), ("POINT EMPTY",), (None,)], "g string")
    r = geometry.profile_geometry(df, "g")
    assert (r["n_wkt"], r["n_invalid"], r["n_empty"], r["n_outside"], r["xmax"]) == (5, 1, 1, 1, 200.0)
    assert {f["finding"] for f in r["findings"]} == {"crs_not_declared", "invalid_geometry", "empty_geometry", "coordinate_outside_domain", "mixed_geometry_types"}


@pytest.mark.parametrize("name, parts", [("a.b", ["a", "b"]), ('"a.b".c', ["a.b", "c"]), ("`x``y`", ["x`y"]), ("[my table]", ["my table"])])
def test_identifiers(name, parts):
    assert parse_identifier(name) == parts


@pytest.mark.parametrize("name", ["", "a.", "a b.c d"])
def test_bad_identifiers(name):
    with pytest.raises(ValueError):
        parse_identifier(name)


def test_registered_lsh_compares_the_whole_table(spark, tmp_path):
    import __spark_entry__ as entry

    names = [("large ring",)] * 2500 + [("large rings",)] * 2500
    spark.createDataFrame(names, "p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = entry.queries()["near_duplicates_lsh"](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.n_a, r.n_b) for r in got] == [("large ring", "large rings", 2500, 2500)]
