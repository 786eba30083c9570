"""License scans against a recursive parser and plain searches."""

import random
import re

import pytest

from plumbline.llm import license_scan as L


def recursive(text):
    """A recursive-descent evaluation of a well-formed expression."""
    tokens = re.findall(r"[()]|[a-z0-9.+\-]+", text.lower())

    def atom():
        t = tokens.pop(0)
        if t == "(":
            value = either()
            tokens.pop(0)
            return value
        value = L.category_of(t)
        if tokens and tokens[0] == "with":
            tokens.pop(0)
            if tokens.pop(0) in L.EXCEPTIONS and value == "copyleft":
                value = "weak-copyleft"
        return value

    def both():
        value = atom()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            value = max(value, atom(), key=L.CATEGORIES.index)
        return value

    def either():
        value = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            value = min(value, both(), key=L.CATEGORIES.index)
        return value

    return either()


def random_expression(rng, depth=0):
    if depth > 3 or rng.random() < 0.4:
        one = rng.choice(["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1+", "Unlicense", "Strange-1.0", "CC-BY-NC-4.0"])
        return one + (" WITH Classpath-exception-2.0" if one.startswith("GPL") and rng.random() < 0.4 else "")
    return f"({random_expression(rng, depth + 1)} {rng.choice(['AND', 'OR'])} {random_expression(rng, depth + 1)})" if rng.random() < 0.5 else f"{random_expression(rng, depth + 1)} {rng.choice(['and', 'or'])} {random_expression(rng, depth + 1)}"


def test_shunting_yard_against_recursive_descent():
    rng = random.Random(8)
    for _ in range(500):
        text = random_expression(rng)
        assert L.evaluate(text) == recursive(text), text


@pytest.mark.parametrize("text", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT Apache-2.0", "MIT OR OR MIT", "()", "MIT & GPL-2.0", "(MIT OR GPL-2.0) WITH llvm-exception"])
def test_invalid_expressions(text):
    assert L.evaluate(text) == "invalid"


def by_regex(text):
    """Licenses of notices by one regular expression for each phrase, over the words of the text."""
    text = re.sub(r"(?m)^[^\S\n]*(?:[#*;%|>!]+|//+|--+|/\*+|<!--)(?![a-z0-9])", " ", text.lower())
    found = []
    for phrase, license_id in L.PHRASES.items():
        body = r"[\s\-/,_\"'“”`]+".join(map(re.escape, phrase.split(" ")))
        found += [(m.start(), m.end(), license_id) for m in re.finditer(rf"(?<![^\W_]){body}(?![^\W_])(?!\.\d)", text)]
    return {i for s, e, i in found if not any((a, b) != (s, e) and a <= s and e <= b for a, b, _ in found)}


def test_scan_against_plain_search():
    machine, rng = L.automaton(), random.Random(9)
    phrases = [p for p in L.PHRASES]
    for k in range(300):
        parts = [rng.choice([rng.choice(phrases), "some words", "permit license", "x", "version 2.7"]) for _ in range(rng.randint(0, 6))]
        text = rng.choice([". ", "; ", " foo "]).join(parts)
        # wrapped at random words, with a comment's leader
        text = "".join(rng.choice(["\n# ", "\n * ", "\n", "  ", "\n// "]) if c == " " and rng.random() < 0.3 else c for c in text)
        assert set((L.scan(text, machine) or ([], [], ""))[0]) == by_regex(text), text


@pytest.mark.parametrize(
    "text, license_id",
    [
        ("permission is hereby granted,\nfree of charge", "mit"), ("/* redistribution and use in source and binary\n *  forms */", "bsd-3-clause"), ("apache license,\n   version 2.0", "apache-2.0"), ("under the bsd-3-clause license", "bsd-3-clause"),
        ("this is gplv3 code", "gpl-3.0"), ("# gnu general public\n# license version 2\n", "gpl-2.0"), ("gnu lesser general public license version 2.1", "lgpl-2.1"), ("// licensed under cc by-nc 4.0.", "cc-by-nc-4.0"), ("see mpl-2.0", "mpl-2.0"), ("gpl-2.0-or-later", "gpl-2.0"), ("the 'mit' license", "mit"),
    ],
)
def test_wrapped_and_spelled_notices(text, license_id):
    assert L.scan(text, L.automaton())[0] == [license_id]


def test_slash_is_or():
    assert L.evaluate("MIT/Apache-2.0") == "permissive" and L.evaluate("GPL-2.0/MIT AND Zlib") == "permissive"


def test_many_tags_in_a_long_text():
    text = "spdx-license-identifier: mit\n" * 50_000 + "x" * 1_000_000
    assert L.scan(text, L.automaton()) == ([], ["mit"], "permissive")


def test_table(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, "clean text"), (None, "# SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode"), (5, "a " * 200_000 + "\n/* SPDX-License-Identifier: (MIT */"), (6, "All rights reserved. MIT License")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, category string")
    got = sorted(((r.doc_id, r.licenses, r.expressions, r.category) for r in L.license_scan(docs).collect()), key=str)
    assert got == sorted(
        [(1, ["apache-2.0"], [], "permissive")] * 2 + [(None, [], ["mit or gpl-3.0-only"], "permissive"), (5, [], ["(mit"], "invalid"), (6, ["mit", "proprietary"], [], "proprietary")], key=str
    )
    assert L.license_scan(docs.limit(0)).count() == 0
