"""Profiles, findings, plans and cleaning on small tables with planted defects."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, findings, frameworks, structure
from plumbline.operators.profile import profile_by, profile_columns, table_overview
from plumbline.plans.aggplan import quantiles_of_counts, value_counts


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"P{i:03d}", ["a", "b", None][i % 3], float(i), " x" if i % 4 == 0 else "x", "constant") for i in range(1, 41)]
    rows += [(40, "P040", "b", 40.0, " x", "constant"), (41, "N/A", "", -99.0, "X", "constant"), (42, "P042", "b", 9_999_999.0, "a&amp;b\n", "constant")]
    return spark.createDataFrame(rows, "id int, code string, kind string, amount double, note string, fixed string")


def test_zero_means_measured_and_none_means_not(people):
    by = {r["column"]: r for r in profile_columns(people, mode="counts")}
    assert by["amount"]["n_missing"] == 0 and by["amount"].get("mean") is None and by["amount"].get("n_zeros") is None
    assert {r["column"]: r for r in profile_columns(people, mode="safe")}["amount"]["n_zeros"] == 0


def test_exact_profile(people):
    by = {r["column"]: r for r in profile_columns(people)}
    assert by["kind"]["n_missing"] == 13 and by["kind"]["mode"] == "b" and by["kind"]["n_blanks"] == 1
    assert by["amount"]["n_outliers"] == 2 and by["amount"]["n_disguised_number"] == 1 and by["amount"]["n_negatives"] == 1
    assert by["note"]["n_border_spaces"] == 12 and by["note"]["n_html_entities"] == 1 and by["note"]["n_field_separators"] == 1
    assert by["id"]["dense_sequence"] and by["id"]["sequence_gaps"] == 0


def test_floats_that_are_not_finite_are_counted_apart(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    r = profile_columns(df)[0]
    assert (r["n_nan"], r["n_pos_inf"], r["mean"], r["median"], r["n_distinct"], r["n_missing"]) == (1, 1, 2.0, 2.0, 2, 2)


def test_every_type_and_empty_tables(spark):
    df = spark.range(3).selectExpr("id", "cast(id AS string) s", "id % 2 = 0 AS b", "date '2024-01-01' + cast(id AS int) AS d", "timestamp '2024-01-01 10:00:00' AS t", "array(id) AS a", "cast(id AS decimal(10,2)) AS m", "cast('x' AS binary) AS bin")
    by = {r["column"]: r for r in profile_columns(df)}
    assert by["a"]["state"] == by["bin"]["state"] == "not_applicable" and by["d"]["min_date"] == "2024-01-01" and by["b"]["mode"] == "true" and by["m"]["max"] == 2.0
    for mode in ("exact", "safe", "counts", "sampled", "approximate"):
        rows = profile_columns(df.limit(0), mode)
        assert all(r["n"] == 0 and r["missing_rate"] is None for r in rows)
    assert table_overview(df.limit(0))["n_rows"] == 0


def test_row_order_does_not_matter(people):
    rows = lambda df: [{k: f"{v:.10g}" if isinstance(v, float) else v for k, v in r.items()} for r in profile_columns(df)]
    assert rows(people.repartition(5)) == rows(people.orderBy(F.desc("id")))


def test_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=3000), np.repeat(0.5, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    p = [0, 0.01, 0.25, 0.5, 0.77, 1]
    got = {r["probability"]: r["value"] for r in quantiles_of_counts(value_counts(df, ["x"]), p).collect()}
    assert all(abs(got[q] - np.quantile(x, q)) < 1e-9 for q in p)


def test_overview_counts_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (2, 2)], "a int, b int")
    assert table_overview(df) == {"n_rows": 4, "n_columns": 2, "n_cells": 8, "n_complete": 1, "n_surplus": 1, "n_in_duplicates": 2}


def test_profile_by_names_the_null_group(spark):
    df = spark.createDataFrame([(None, 1)] * 30 + [("g", None)] * 30 + [("small", 1)], "k string, v int")
    assert [(r.group, r.n) for r in profile_by(df, "k").collect()] == [("(missing)", 30)]


def test_findings_plan_and_cleaning(people):
    p = findings.profile(people, "people", protect=False)
    kinds = {(f["column"], f["finding"]) for f in p.findings}
    assert {(None, "duplicate_rows"), ("fixed", "constant"), ("kind", "missing"), ("amount", "outliers"), ("note", "border_spaces"), ("note", "html_entities"), ("code", "disguised_missing"), ("note", "inconsistent_case")} <= kinds
    assert all(f["n_affected"] <= f["n_evaluated"] for f in p.findings)
    plan = clean.plan_cleaning(p)
    done = clean.apply_cleaning(plan, people)
    out = {r["id"]: r for r in done.data.collect()}
    assert out[41]["code"] is None and out[4]["note"] == "x" and done.removed is None
    assert people.where("note = ' x'").count() == 11
    assert any(e["state"] == "done" and e["strategy"] == "trim" for e in done.log)
    refused = clean.apply_cleaning(plan.choose("drop_constant_column", "fixed"), people)
    assert "fixed" in refused.data.columns and any(e["state"] == "refused" for e in refused.log)
    assert "fixed" not in clean.apply_cleaning(plan.choose("drop_constant_column", "fixed"), people, allow_removal=True).data.columns
    assert {e["state"] for e in clean.apply_cleaning(plan.choose("convert_number", "amount", convention="nonsense") if any(a.strategy == "convert_number" for a in plan.actions) else plan, people).log} <= {"done", "failed", "blocked"}


def test_trace_is_bounded(people):
    f = {"column": "note", "finding": "border_spaces", "n_affected": 12}
    assert findings.trace(people, f, ["id"], 3) == {"state": "truncated", "keys": ["4", "8", "12"], "total": 12, "shown": 3, "limit": 3}


def test_personal_data_is_masked(spark):
    df = spark.createDataFrame([(f"user{i}@mail.example.com", i) for i in range(20)], "contact string, n int")
    p = findings.profile(df)
    assert p.column("contact")["mode"] is None and p.column("contact")["state"] == "omitted_for_privacy" and p.column("n")["mode"] is not None


def test_keys_and_dependencies(spark):
    df = spark.createDataFrame([(i, i // 10, i % 10, f"name{i // 10}") for i in range(100)], "id int, g int, k int, name string")
    keys = structure.detect_keys(df, 2)
    assert [k["columns"] for k in keys] == [["id"], ["g", "k"], ["k", "name"]]
    fds = {(r.determinant, r.dependent) for r in structure.detect_dependencies(df).collect()}
    assert ("g", "name") in fds and ("name", "g") in fds and ("k", "g") not in fds


def test_relation_cardinality(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([(1,), (1,), (3,), (4,)], "fk int")
    r = structure.detect_relations(left, right, min_coverage=0).first()
    assert (r.cardinality, r.n_common, round(r.coverage_left, 3), r.coverage_right) == ("1:m", 2, 0.667, 0.75)


def test_signal_order_and_arithmetic(spark):
    df = spark.createDataFrame([(2020 + i, 2020 + i + (i == 2), float(i), float(2 * i + 1), float(3 * i + 1), float(i) * 0.21) for i in range(40)], "a int, b int, x double, y double, z double, tax double")
    got = structure.detect_discordances(df, [structure.RedundantSignal(("a", "b"))], ["a"])[0]
    assert (got["n_evaluated"], got["n_affected"], got["example"]) == (40, 1, "2022")
    rules = structure.detect_arithmetic(df.select("x", "y", "z", "tax"))
    assert {(r["kind"], tuple(r["columns"])) for r in rules} >= {("additive", ("x", "y", "z")), ("proportional", ("x", "tax"))}


def test_proposed_model_is_used_only_when_confirmed(people):
    p = findings.profile(people, "people", protect=False)
    proposal = frameworks.propose_model(p)
    with pytest.raises(ValueError):
        frameworks.model_from_proposal(proposal, "people")
    assert len(frameworks.model_from_proposal([x | {"confirmed": True} for x in proposal if x["metric"] == "not_null"], "people").instances) > 0


def test_deep_text_findings(spark):
    rows = [(f"AB-{i:03d}", "5 kg" if i % 2 else "7 lb", "one;two" if i < 10 else "plain words", "e\u0301" if i == 0 else "x", float(i + 1) ** 3) for i in range(120)] + [("AB-1-2", "5 kg", "plain words", "x", 2.0)]
    df = spark.createDataFrame(rows, "code string, weight string, tags string, mark string, cube double")
    kinds = {(f["column"], f["finding"]) for f in findings.profile(df, protect=False).findings}
    assert {("code", "rare_pattern"), ("weight", "mixed_units"), ("tags", "multivalued_cells"), ("mark", "unicode_normalization")} <= kinds


def test_deviation_classes():
    from plumbline.functions.text import deviation_class

    assert deviation_class("A+-99", "A+-9+9") == "length_only" or deviation_class("A-9+", "A+-9+") == "length_only"
    assert deviation_class("A+/9+", "A+-9+") == "single_token" and deviation_class("A+-9+-9+", "A+-9+") == "tokens_added"


def test_time_zone_shift(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Montevideo")
        df = spark.sql("SELECT timestamp '2024-01-01 23:30:00' AS t UNION ALL SELECT timestamp '2024-01-01 10:00:00'")
        found = findings.civil_date_shifts(df)
        assert [(f["n_evaluated"], f["n_affected"]) for f in found] == [(2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def jobs(spark, run):
    """The Spark jobs that a call starts."""
    spark.sparkContext.setJobGroup(group := f"count-{id(run)}", "")
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_text_figures_take_as_many_jobs_for_any_width(spark):
    from plumbline.operators import findings

    df = spark.createDataFrame([(f"v{i % 5}", f"{i}.5", "2024-01-0" + str(i % 9 + 1)) for i in range(40)], "a string, b string, c string")
    wide = df.select(*[F.col(c).alias(f"{c}{i}") for i in range(6) for c in df.columns])
    assert jobs(spark, lambda: findings.deep_text_figures(df, df.columns)) == jobs(spark, lambda: findings.deep_text_figures(wide, wide.columns))


def test_limits_have_coverage_rows_and_rules_reach_the_findings(spark):
    from plumbline.operators import findings

    df = spark.range(50).selectExpr("id % 7 - 3 AS z", *[f"id * {k} AS n{k}" for k in range(2, 12)])
    p = findings.profile(df, forbid_zeros=("z",), forbid_negatives=("z",))
    assert {r["column"] for r in p.coverage if r["diagnostic"] == "arithmetic_relation"} == {"n9", "n10", "n11"}
    assert {"zeros_not_allowed", "negatives_not_allowed"} <= {f["finding"] for f in p.findings if f["column"] == "z"}


def test_patterns_show_three_examples_and_what_is_left_out(spark):
    from plumbline.operators import findings

    df = spark.createDataFrame([(v,) for v in ["aa1", "ab2", "ac3", "ad4", "X", "9", "9"]], "v string")
    rows = findings.discover_patterns(df, "v", max_patterns=2).collect()
    assert rows[0]["examples"] == ["aa1", "ab2", "ac3"] and rows[0]["example"] == "aa1" and {r["excluded"] for r in rows} == {1}


def test_figures_that_can_not_be(spark):
    from plumbline.operators.evidence import guard_impossible

    row = {"column": "x", "declared_type": "integer", "n_applicable": 5, "n_missing": 1, "n_distinct": 6, "distinct_rate": 1.5, "mode": "1", "mode_n": 9, "min": 3.0, "max": 1.0, "min_exact": "3", "max_exact": "1"}
    out, why = guard_impossible(row)
    assert all(out[k] is None for k in ("n_distinct", "mode_n", "min", "max")) and {w["reason"] for w in why} == {"more_distinct_than_valid", "mode_more_frequent_than_valid", "greatest_under_least"}


def test_ranges_of_any_size_give_the_same_ranks_and_quantiles(spark):
    from plumbline.plans.aggplan import ranks_of_counts

    df = spark.range(400).selectExpr("(id * 7919) % 100 AS x", "id % 3 AS y")
    counts = value_counts(df, ["x", "y"])
    for fn in (lambda k: ranks_of_counts(counts, k), lambda k: quantiles_of_counts(counts, [0.0, 0.1, 0.5, 1.0], k)):
        assert sorted(map(tuple, fn(10**6).collect())) == sorted(map(tuple, fn(7).collect())) == sorted(map(tuple, fn(1).collect()))


def test_quantiles_when_rows_come_in_another_order_each_time(spark):
    import numpy as np

    def mixed(batches):
        import pandas as pd

        rows = pd.concat(list(batches))
        yield rows.iloc[np.random.default_rng().permutation(len(rows))]

    counts = spark.range(0, 150_000, 1, 1).selectExpr("'x' AS column", "cast(id AS double) AS number", "1L AS n")
    counts = counts.mapInPandas(mixed, counts.schema)
    p = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["probability"]: r["value"] for r in quantiles_of_counts(counts, p).collect()}
    assert got == {q: pytest.approx(q * 149_999) for q in p}


def test_numbers_find_their_range_among_any_number_of_cuts(spark):
    from plumbline.plans.aggplan import place

    numbers = spark.range(0, 700).selectExpr("explode(array('one', 'few', 'many', 'equal')) AS column", "id / 2.0D AS number", "1L AS n")
    for size in (1, 15, 16, 255, 256, 300):
        cuts = {"one": [7.0], "few": [float(k) for k in range(min(size, 9))], "many": [float(k) for k in range(size)], "equal": [7.0] * size}
        got = {(r["column"], r["number"]): r["range"] for r in place(numbers, cuts).collect()}
        assert len(got) == 2800 and all(k == sum(c < v for c in cuts[name]) for (name, v), k in got.items())


def test_a_number_is_not_compared_with_every_cut(spark):
    from plumbline.plans.aggplan import in_ranges

    numbers = spark.range(0, 2000).selectExpr("'x' AS column", "cast(id AS double) AS number", "1L AS n")
    placed = in_ranges(numbers, {"x": (2000, 2000)}, 10)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    # each of the steps reads the array of cuts as often as its base allows, whatever the cuts' number
    assert "lambda" not in plan and plan.count("_cuts") < 100
    assert placed.agg(F.countDistinct("range")).first()[0] == 200


def _running(rows, budget):
    """Brute force: rows (order, cost) with their running cost, nulls adding nothing, where it is at most the budget."""
    import decimal

    rows, out = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]), []
    with decimal.localcontext(prec=80):
        for at, cost in rows:
            upto = [c for a, c in rows if a <= at and c is not None]
            if upto and sum(upto) <= budget:
                out.append((at, cost, sum(upto)))
    return sorted(out, key=str)


def test_budget_of_odd_costs_and_orders(spark):
    import random
    from decimal import Decimal

    from plumbline.operators.evidence import within_budget

    rng = random.Random(5)
    costs = [rng.choice([None, 0, 3, 8, 40, -35]) for _ in range(160)]
    cases = [
        ("long", "long", [(i % 90 if i % 11 else None, c) for i, c in enumerate(costs)]),
        # neighbours that doubles don't tell apart
        ("long", "long", [(2**53 + i, 1) for i in range(60)]),
        # ranges without any cost
        ("int", "long", [(i, None if 20 <= i < 60 else 1) for i in range(90)]),
        ("double", "decimal(30,2)", [(i / 4 - 9, None if c is None else Decimal(c) + Decimal("12345678901234567890123456.25")) for i, c in enumerate(costs)]),
    ]
    for order, cost, rows in cases:
        df = spark.createDataFrame(rows, f"at {order}, range {cost}")
        for budget, size in ((25, 7), (1e30, 10**6)):
            assert sorted(map(tuple, within_budget(df, "at", "range", budget, size).collect()), key=str) == _running(rows, budget), (order, cost, budget, size)


def test_budget_sums_only_ranges_within_its_reach():
    from plumbline.operators.evidence import _within_reach

    sums = [(k, 10, None) for k in range(1000)]
    assert _within_reach(sums, 25) == [(0, None), (1, 10), (2, 20)]
    # negative costs can come back to the budget, within a range and from range to range
    assert _within_reach([(0, 30, None), (1, None, None), (2, 5, -20), (3, -30, -30), (4, 99, None), (5, 0, -1)], 25) == [(0, None), (2, 30), (3, 35), (4, 5)]
