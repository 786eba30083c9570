"""Secret scans: held-out accuracy and defined cases."""

import hashlib
import re

import pytest

from plumbline.llm import secret_scan as S


@pytest.fixture(scope="module")
def model(spark):
    return S.train(S.labelled_findings(spark, 3000), trees=20)


def test_held_out_accuracy(spark, model):
    held_out = S.synthetic_findings(1500, seed=99)
    rows = [(k, S.features(v, b, a, p, model.transitions), y) for k, (v, b, a, p, y) in enumerate(held_out)]
    scored = model.probability(spark.createDataFrame(rows, "k int, features array<double>, label int")).collect()
    right = sum((r.probability >= S.THRESHOLD) == bool(r.label) for r in scored) / len(scored)
    missed = sum(r.label and r.probability < S.THRESHOLD for r in scored) / sum(r.label for r in scored)
    assert right > 0.95 and missed < 0.05


def test_feature_count(model):
    assert len(S.features("abc", "", "", "", model.transitions)) == S.FEATURES


def test_table(spark, model):
    key = "9f2c4e1ab07d58c3e6f4a19b2d7c80e5f3a6b1c4"
    text = f'some words\ntoken = "{key}" and more'
    rows = [(1, text, "src"), (1, text, "src"), (None, text, None), (2, None, "x"), (3, "", "x"), (4, "clean words only", "x"), (5, "card number 4111111111111111 here", "x"), (6, f"commit {key} fixes it", "x"), (7, "pad " * 100_000 + f"secret: {key}", "x"), (8, "password = your_token_here_1", "x")]
    docs = spark.createDataFrame([(d, t, s, 0.5, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, probability double, features int, _vector int")
    got = S.secret_scan(docs, model).collect()
    assert sorted((str(r.doc_id), r.start) for r in got) == sorted([("1", text.index(key))] * 2 + [("None", text.index(key)), ("7", 400_008)])
    assert {r.sha256 for r in got} == {hashlib.sha256(key.encode()).hexdigest()} and {r.length for r in got} == {40}
    assert S.secret_scan(docs.limit(0), model).count() == 0


def test_training_needs_both_labels(spark):
    with pytest.raises(ValueError):
        S.train(spark.createDataFrame([("abc", "", "", "", 1)], "value string, before string, after string, path string, label int"))


def test_candidates_and_coverage():
    assert [v for _, v in S.candidates("a1b2c3d4e5f6a7b8 plain password: hunter22 x")] == ["a1b2c3d4e5f6a7b8", "hunter22"]
    assert S.coverage("example_secret_key") > 0.8 > 0.2 > S.coverage("9f2c4e1ab07d58c3")


@pytest.mark.parametrize(
    "line, value",
    [
        ("export API_KEY=04db9f2c4e1ab07d58c3e6f4a19bf962", "04db9f2c4e1ab07d58c3e6f4a19bf962"),
        ("db_password=hunter2!", "hunter2!"),
        ("password: P@ssw0rd!LongSecret1234567890abc", "P@ssw0rd!LongSecret1234567890abc"),
        ("see http://h/?token=9f2c4e1ab07d58c3&user=17", "9f2c4e1ab07d58c3"),
        ("the secret: 9f2c4e1ab07d58c3e6f4.", "9f2c4e1ab07d58c3e6f4"),
        ("data QUJDREVGR0hJSktMTU5PUFFSU1Q3OQ== x", "QUJDREVGR0hJSktMTU5PUFFSU1Q3OQ=="),
    ],
)
def test_assigned_values_are_cut_exactly(line, value):
    assert S.candidates(line) == [(line.index(value), value)]


def test_env_files_and_query_strings_give_the_secret_itself(spark, model):
    key = "04db9f2c4e1ab07d58c3e6f4a19b2d7c80e5f962"
    texts = [f"export API_KEY={key}", f"get /x?token={key}&page=2 now"]
    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.start, r.length, r.sha256) for r in S.secret_scan(docs, model).collect()}
    assert got == {i: (t.index(key), 40, hashlib.sha256(key.encode()).hexdigest()) for i, t in enumerate(texts)}


def by_regex(text):
    """Candidates by two regular expressions over the whole text."""
    names = r"token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|credential|auth"
    found = {}
    for m in re.finditer(rf"""(?:{names})[\w-]*["']?\s*(?::=|[:=])\s*["']?([^\s"'<>,;]{{6,}})""", text, re.I):
        value = S._assigned(m.group(1))
        if len(value) >= 6:
            found[m.start(1)] = value
    taken = [(s, s + len(v)) for s, v in found.items()]
    for m in S._LONG.finditer(text):
        value = m.group().strip("=-/_") if not m.group().endswith("=") else m.group().lstrip("=-/_")
        start = m.start() + m.group().find(value)
        if len(value) >= 16 and re.search(r"[0-9]", value) and not any(a < start + len(value) and start < b for a, b in taken):
            found[start] = value
    return sorted(found.items())


def test_scan_of_the_documents_against_plain_python(spark):
    """Every candidate of every document, scored one by one by the same forest, with the registered query's parameters."""
    from pyspark.ml.linalg import Vectors

    model = S.train(S.labelled_findings(spark))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, want, planted = docs.collect(), [], set()
    for r in rows:
        found = by_regex(r.text or "")
        assert found == S.candidates(r.text or "")
        for start, value in found:
            f = S.features(value, r.text[max(0, start - 48) : start], r.text[start + len(value) : start + len(value) + 32], r.source or "", model.transitions)
            p = float(model.forest.predictProbability(Vectors.dense(f))[1])
            if p >= S.THRESHOLD:
                want.append((r.doc_id, start, len(value), hashlib.sha256(value.encode()).hexdigest(), round(p, 9)))
        planted |= {(r.doc_id, m.start(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    got = [(r.doc_id, r.start, r.length, r.sha256, round(r.probability, 9)) for r in S.secret_scan(docs, model).collect()]
    assert sorted(got) == sorted(want)
    # the keys that the documents assign to a token are told, and little else is
    told = {(d, s) for d, s, *_ in got}
    assert planted and len(planted & told) >= 0.95 * len(planted) and len(told - planted) <= 0.05 * len(told)


def test_runs_of_token_characters():
    import pyarrow as pa

    from plumbline.llm import tokens

    texts = ["é" * 3 + "abcdefgh12345678", "ijklmnop12345678 x", "", "aaaaaaaaaaaaaaaaaaaa", "bbbbbbbbbbbbbbbbbbbb", "日本 ABCDEFGHIJKLMNOP99==", "short a-b"]
    runs = S.long_runs(*tokens.texts_of(pa.array(texts)))
    assert runs == {k: [m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t)] for k, t in enumerate(texts) if re.search(r"[A-Za-z0-9+/_-]{16,}", t)}
