"""Samples, saved analyses, collections, reports and streams."""

import pytest

from plumbline.operators import aggregate as A
from plumbline.operators import collection, findings
from plumbline.operators import metrics as M
from plumbline.sources import report, requirements, tables
from plumbline.streaming import monitor


def test_systematic_sample(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "k").repartition(5)
    got = sorted(r.k for r in tables.systematic_sample(df, ["k"], 10).collect())
    assert got == sorted({round(1 + i * 999 / 9) for i in range(10)})
    assert tables.systematic_sample(df.where("k < 5"), ["k"], 10).count() == 4


def test_hash_sample_is_stable(spark):
    df = spark.range(100)
    pick = lambda d: sorted(r.id for r in tables.hash_sample(d, ["id"], 10).collect())
    assert pick(df) == pick(df.repartition(7)) and len(pick(df)) == 10


def test_analysis_round_trip(spark, tmp_path):
    p = findings.profile(spark.range(5).toDF("x"), "t")
    tables.save_analysis(spark, p, f"{tmp_path}/a")
    assert tables.load_analysis(spark, f"{tmp_path}/a").columns == p.columns
    with pytest.raises(Exception):
        tables.save_analysis(spark, p, f"{tmp_path}/a")


def test_readable_columns_isolate_failures(spark):
    df = spark.range(1).selectExpr("id AS good", "id AS bad")

    def probe(d):
        if "bad" in d.columns:
            raise RuntimeError("no")

    assert tables.readable_columns(df, probe) == (["good"], {"bad": "no"})


def test_collection_keeps_errors_apart(spark, sf):
    what = A.collection("c", ["nation", "none"])
    profiles, states = collection.profile_collection(spark, what, {"nation": f"{sf}/nation.parquet", "none": f"{sf}/none.parquet"})
    assert set(profiles) == {"nation"} and [s["state"] for s in states] == ["done", "failed"]
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("nation", "region")}
    found = collection.collection_relations(t, candidates={"nation": ["n_regionkey"], "region": ["r_regionkey"]}).first()
    assert (found.left, found.right, found.cardinality) == ("n_regionkey", "r_regionkey", "m:1")
    assert collection.estimate_collection_cost(t)[0]["n_pairs"] > 0


def test_report_escapes_and_bounds(spark, tmp_path):
    p = findings.profile(spark.createDataFrame([("<b>",)] * 3, "x string"), "a<b")
    text = report.report(p, ("rows", spark.range(500)), max_rows=10)
    assert "&lt;b&gt;" in text and "<b>" not in text and "more rows not shown" in text
    report.write_report(f"{tmp_path}/r.html", p)
    with pytest.raises(FileExistsError):
        report.write_report(f"{tmp_path}/r.html", p)


def test_requirements():
    assert requirements.engine_requirements("postgresql")[0]["driver"] == "org.postgresql:postgresql"
    with pytest.raises(ValueError):
        requirements.engine_requirements("abacus")


def test_monitor_counts_each_batch_once(spark, tmp_path, sf):
    source = spark.read.parquet(f"{sf}/nation.parquet")
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = monitor.monitor(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == len(source.columns) and got.first()["n"] == 25


def test_windowed_quality(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(ts AS timestamp) ts", "value")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = monitor.windowed_quality(stream, "ts", ["value"]).writeStream.format("memory").queryName("wq").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("wq").agg({"n": "sum"}).first()[0] == events.count()


def test_aggregation_checks_the_lattice(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    cells = M.measure(M.bind(M.CORE_METRICS["not_null"], "t", ["v"], key=["id"]), {"t": df}, "m")
    assert A.aggregate_measures(cells, "column").first().result == 0.5
    with pytest.raises(ValueError):
        A.aggregate_measures(cells, "cell")
    with pytest.raises(ValueError):
        A.aggregate_measures(cells, "database")
    with pytest.raises(ValueError):
        A.aggregate_measures(A.aggregate_measures(cells, "column"), "table", "weighted_mean", weights={"v": 0.5})


def test_entity_duplicates_with_a_key_take_null_as_anything(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", "y"), (2, "a", "b"), (2, "a", "c"), (3, None, None)], "id int, p string, q string")
    got = M.measure(M.bind(M.specialize(M.CORE_METRICS["duplicate_entity"], key=["id"]), "t", key=["id", "q"]), {"t": df}, "m")
    assert sorted((r.row, r.result) for r in got.collect()) == [("1|", 1.0), ("1|y", 1.0), ("2|b", 0.0), ("2|c", 0.0), ("3|", 0.0)]


def test_history_is_idempotent(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    e = A.evaluate(M.measure(M.bind(M.CORE_METRICS["not_null"], "t", ["v"]), {"t": df}, "m"), A.evaluation_profile("p", A.evaluation_rule("r", "result = 1")))
    h = A.quality_history(("m", "2024-01-01", e))
    assert A.append_history(h, h).count() == h.count() == 2


def test_pushed_down_profiles_equal_those_of_the_engine(spark, sf):
    import duckdb

    from plumbline.operators.profile import profile_columns
    from plumbline.sources import pushdown

    con = duckdb.connect()
    con.execute(f"CREATE VIEW t AS SELECT o_orderkey, o_totalprice, o_orderpriority FROM '{sf}/orders.parquet'")

    def run(sql):
        cursor = con.execute(sql)
        return [dict(zip([d[0] for d in cursor.description], r)) for r in cursor.fetchall()]

    columns = {"o_orderkey": "number", "o_totalprice": "number", "o_orderpriority": "text"}
    got = pushdown.pushdown_profile(run, "t", columns, "exact")
    want = {r["column"]: r for r in profile_columns(spark.read.parquet(f"{sf}/orders.parquet").select(*columns))}
    for r in got.columns:
        w = want[r["column"]]
        for f in ("n", "n_missing", "n_distinct", "mode_n", "min", "max", "mean", "stddev", "n_zeros", "length_min", "length_max", "length_mean", "n_blanks"):
            assert r.get(f) == w.get(f) or abs(float(r[f]) - float(w[f])) < 1e-6 * abs(float(w[f])), (r["column"], f)
    assert len(got.log) == 4 == pushdown.cost("t", columns, "exact")["queries"] and not got.coverage
    # the number of queries follows from the width only
    wide = {f"c{i}": "number" for i in range(40)}
    assert pushdown.cost("t", wide, "counts")["queries"] == 1 and pushdown.cost("t", wide, "safe")["queries"] <= 14
    # a refused query is told, and the rest go on
    bad = pushdown.pushdown_profile(run, "t", columns | {"nowhere": "number"}, "safe", max_expressions=7)
    assert {r["column"] for r in bad.coverage} >= {"nowhere"} and bad.columns[0]["n_present"] == want["o_orderkey"]["n"]


def test_table_reader_reads_once_within_its_budget(spark, sf):
    reader = tables.TableReader(spark, {"nation": f"{sf}/nation.parquet", "orders": f"{sf}/orders.parquet"}, budget_bytes=20_000)
    assert reader.read("nation").count() == reader.read("nation").count() == 25 and reader.read("orders").count()
    assert [(r["table"], r["read"]) for r in reader.log] == [("nation", "source, kept"), ("nation", "kept"), ("orders", "source")]
    reader.close()
    with pytest.raises(KeyError):
        reader.read("none")
