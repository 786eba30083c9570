"""The pipeline: its stages' contract, and planted cases through all of it."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.bpe import encoder
from plumbline.llm.common import materialize


#: Names that the operators use for columns of their own.
HELPERS = ["_gone", "_row", "_row2", "_key", "_text", "_first", "_trusted", "block", "key", "keep", "row", "ids", "stream", "band", "m"]


def corpus(tmp_path, spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows = [[i, text(rng.randint(40, 120)) + "\n" + text(20), "en", f"s{i % 12}", 0] for i in range(150)]
    for i in range(20):
        rows[i][1] += "\nsubscribe to our letter and share this page"
    rows += [[200, rows[50][1], "en", "s1", 0], [201, rows[51][1] + " more", "en", "s2", 0], [202, text(30) + " " + item + " " + text(30), "en", "s3", 0], [203, "#$% QQQ ||| @@@ " * 30, "en", "s4", 0], [204, None, "en", "s5", 0], [205, "", None, None, 0], [None, text(50), "en", "s6", 0], [206, text(30_000), "en", "s7", 0], list(rows[52]), [207, text(60), None, None, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_and_planted_cases(spark, tmp_path):
    docs, sf = corpus(tmp_path, spark), str(tmp_path)
    columns, kept = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test")
        if name != "packing":
            assert docs.columns == columns
            assert docs.where(" OR ".join(f"{c} <> concat('{c}', doc_id)" for c in HELPERS)).count() == 0
            kept.append({r.doc_id for r in docs.select("doc_id").collect()})
            if name == "decontamination":
                texts = {r.doc_id: r.text for r in docs.collect()}
                assert docs.where("doc_id = 52").count() == 2
            if name == "lines":
                left = [r.doc_id for r in docs.collect() if "subscribe to our letter" in r.text]
                assert left == [0]
    assert not {203, 204, 205} & kept[0] and len(set(range(150)) - kept[0]) <= 2
    assert kept[1] == kept[0]
    assert kept[1] - kept[2] == {200, 201} & kept[1]
    assert kept[2] - kept[3] == {202}
    sequences = docs.collect()
    packed = {d for r in sequences for d in r.doc_ids}
    assert packed == kept[3] and {None, 206, 207} <= packed
    # the written sequences hold the texts: pieces of one row have one key
    pieces = {}
    for r in sequences:
        at = 0
        for d, k, start, n in zip(r.doc_ids, r["keys"], r.starts, r.lengths):
            pieces.setdefault((d, k), {})[start] = r.input_ids[at : at + n]
            at += n
        assert at == r.n_tokens == sum(r.mask)
    decode = encoder().encoding.decode
    assert all(decode([x for s in sorted(p) for x in p[s]]) == texts[d] for (d, _), p in pieces.items()) and len(pieces) == len(texts)
    again = {d for r in corpus_pipeline.run(spark, sf).collect() for d in r.doc_ids}
    assert again == packed


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}
    assert set(entry.oracle_sql()) <= names


def test_empty_tables_pass_all_stages(spark, tmp_path):
    full = corpus(tmp_path, spark)
    sf = str(tmp_path / "none")
    full.limit(0).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    import pytest

    from plumbline.llm.common import shared_dir

    class Session:
        conf = type("conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Session)
