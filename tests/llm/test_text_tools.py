"""Tokens, hash tables and BPE against plain Python."""

import os
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, tokens

TEXTS = ["", "Hello, world", "a", " ", "  two  spaces ", "x\n\ny z", "naïve “quoted” — text", "日本語 です。", "tab\tand nbsp", "It's 42% — don't", "  line", "end "]


def words_of(texts):
    data, offsets = tokens.texts_of(pa.array(texts, pa.string()))
    return tokens.words(data, offsets)


def test_words_match_a_regular_expression():
    texts = ["The cat, the DOG.", "", "one", "a-b_c d", None, "é è"]
    hashes, before, _ = words_of(texts)
    plain = [re.findall(r"[A-Za-z0-9éè]+", t or "") for t in texts]
    assert list(np.diff(before)) == [len(p) for p in plain]
    flat = [w.lower() if w.isascii() else w for p in plain for w in p]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_neighbouring_texts_do_not_join():
    assert list(np.diff(words_of(["ab", "cd"])[1])) == [1, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_bpe_by_segments_equals_whole_texts(texts):
    own = bpe.encoder()
    data, offsets = tokens.texts_of(pa.array(texts, pa.string()))
    ids, before = own.encode(data, offsets)
    for k, text in enumerate(texts):
        assert ids[before[k] : before[k + 1]].tolist() == own.encoding.encode_ordinary(text)
    assert own.counts(data, offsets).tolist() == np.diff(before).tolist()


def test_bpe_of_awkward_texts_and_a_small_cache():
    own = bpe.Encoder(bpe.VOCABULARY, cache_segments=1)
    for _ in range(2):
        data, offsets = tokens.texts_of(pa.array(TEXTS, pa.string()))
        ids, before = own.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [own.encoding.encode_ordinary(t) for t in TEXTS]


def test_hash_table_against_a_dict():
    rng = np.random.default_rng(1)
    table, plain = tokens.HashTable(4), {}
    for _ in range(5):
        new = np.setdiff1d(rng.integers(0, 1 << 62, 3000).astype(np.uint64), np.array(list(plain), dtype=np.uint64))
        table.add(new, np.arange(len(plain), len(plain) + len(new)))
        plain.update(zip(new.tolist(), range(len(plain), len(plain) + len(new))))
    keys = np.array([*plain, 5, 7, 0], dtype=np.uint64)
    assert table.get(keys).tolist() == [plain.get(k, -1) for k in keys.tolist()]


def test_groups_cover_all_texts_even_a_huge_one():
    offsets = np.array([0, 10, 10, 5_000_000, 5_000_001])
    assert [x for i, j in tokens.groups(offsets, 100) for x in range(i, j)] == [0, 1, 2, 3]


def test_texts_on_which_polynomial_hashes_fail():
    """A Thue-Morse string and its complement have equal polynomial sums modulo 2^64, whatever the base."""
    flip = str.maketrans("ab", "ba")
    one = "a"
    for _ in range(11):
        one += one.translate(flip)
    two = one.translate(flip)
    data, offsets = tokens.texts_of(pa.array([one, two]))
    hashes, _, _ = tokens.words(data, offsets)
    assert hashes[0] != hashes[1]
    own = bpe.Encoder(bpe.VOCABULARY)
    ids, before = own.encode(data, offsets)
    assert [own.encoding.decode(ids[a:b].tolist()) for a, b in zip(before, before[1:])] == [one, two]


def test_equal_hashes_do_not_share_ids(monkeypatch):
    monkeypatch.setattr(tokens, "hash_chunks", lambda chunks, first, size: np.full(len(size), 5, np.uint64))
    own = bpe.Encoder(bpe.VOCABULARY)
    for texts in (["alpha beta gamma", "beta beta"], ["gamma delta", "alpha"], ["alpha", "", "a much longer segment"]):
        data, offsets = tokens.texts_of(pa.array(texts))
        ids, before = own.encode(data, offsets)
        assert [own.encoding.decode(ids[a:b].tolist()) for a, b in zip(before, before[1:])] == texts


def test_workers_give_memory_back():
    """What a task freed goes back to the system at its end, though a small object above it lives on."""
    code = """
import re, types
import numpy as np
from plumbline.llm.common import map_text

def own():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

kept = []
def task(batches):
    held = [np.ones(1 << 11) for _ in range(8000)]
    kept.append(np.ones(1 << 11))
    del held
    yield from batches

conf = types.SimpleNamespace(get=lambda name: "1024")
df = types.SimpleNamespace(sparkSession=types.SimpleNamespace(conf=conf), mapInArrow=lambda f, schema: f)
before = own()
list(map_text(df, task, "")(iter([])))
print(own() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 40, out.stdout
