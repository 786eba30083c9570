"""Token files: exact round trip and zero-copy access."""

import numpy as np

from plumbline.llm import token_output as O
from plumbline.llm.bpe import encoder


def test_round_trip(spark, tmp_path):
    rows = [(i, f"document {i} " + "with words " * (i % 90)) for i in range(120)] + [(None, "no id"), (200, None), (201, ""), (202, "very long " * 40_000), (203, "twice"), (203, "twice")]
    docs = spark.createDataFrame([(d, t, "f", 7) for d, t in rows], "doc_id long, text string, file string, start int").repartition(3)
    index = O.write_tokens(docs, f"file://{tmp_path}/out", length=64, batch_rows=4).collect()
    own = encoder()
    files = {f: O.Sequences(f) for f in {r.file for r in index}}
    assert len(index) == len(rows)
    want = sorted(((d is None, d or 0, own.encoding.encode_ordinary(t or "")) for d, t in rows), key=str)
    got = sorted(((r.doc_id is None, r.doc_id or 0, files[r.file].document(r.start, r.n_tokens).tolist()) for r in index), key=str)
    assert got == want
    for f in files.values():
        ids, mask = f[len(f) - 1]
        assert len(ids) == len(mask) == 64 and not ids[mask == 0].any()
        assert all(f[k][1].all() for k in range(len(f) - 1))
    ends = sum(int(f[k][1].sum()) for f in files.values() for k in range(len(f)))
    assert ends == sum(r.n_tokens for r in index) + sum(r.n_tokens > 0 for r in index)


def test_access_makes_no_copy(spark, tmp_path):
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "some words " * 500)], "doc_id long, text string")
    file = O.write_tokens(docs, f"file://{tmp_path}/one", length=32, batch_rows=8).first().file
    sequences = O.Sequences(file)
    before = pa.total_allocated_bytes()
    views = [sequences[k][0] for k in range(len(sequences))]
    assert pa.total_allocated_bytes() == before and not any(v.flags.owndata for v in views)
    assert sequences.reader.schema.field("input_ids").type == pa.list_(pa.uint16(), 32)
    assert np.concatenate(views).dtype == np.uint16


def test_empty_table(spark):
    assert O.write_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
