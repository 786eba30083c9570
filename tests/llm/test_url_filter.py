"""Temporal URL filter against replaying the list's history for each capture."""

import datetime as dt
import random

from plumbline.llm import url_filter as U


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(url, when, entries):
    import re

    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)", (url or "").lower())
    if not m or when is None:
        return None
    host, parts = m[1], [p for p in m[2].split("/") if p]
    labels = host.split(".")
    keys = {("domain", ".".join(labels[i:])) for i in range(max(1, len(labels) - 1))} | {("prefix", host + "/" + "/".join(parts[: k + 1])) for k in range(len(parts))}
    state = {}
    for kind, value, action, category, at in sorted((e for e in entries if None not in (e[1], e[2], e[4])), key=lambda e: (e[4], e[2])):
        if at <= when:
            state[(kind, value.lower(), category)] = action == "add"
    hits = [k for k, on in state.items() if on and k[:2] in keys]
    return max((len(v), v) for _, v, _ in hits)[1] if hits else None


def judge(spark, captures, entries):
    pages = spark.createDataFrame([(*c, "x", True) for c in captures], "page_id long, url string, fetched_at timestamp_ntz, value string, blocked boolean")
    listed = spark.createDataFrame(entries, "kind string, value string, action string, category string, listed_at timestamp_ntz")
    return U.judge_captures(pages, listed).collect()


def test_against_replay(spark):
    rng = random.Random(7)
    hosts = ["a.example.com", "example.com", "m.b.example.net", "b.example.net", "c.org"]
    entries = [(rng.choice(["domain", "prefix"]), None, rng.choice(["add", "remove"]), rng.choice("xy"), day(rng.randrange(60))) for _ in range(80)]
    entries = [(k, rng.choice(hosts) + ("/p" + rng.choice(["", "/q"]) if k == "prefix" else ""), a, c, t) for k, _, a, c, t in entries]
    entries += [entries[0], ("domain", None, "add", "x", day(1)), ("domain", "c.org", None, "x", day(1)), ("domain", "c.org", "add", "x", None)]
    captures = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u@'])}{rng.choice(hosts).upper() if i % 9 == 0 else rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p', '/p/q?x=1', '/z#p'])}", day(rng.randrange(70))) for i in range(200)]
    captures += [(900, None, day(1)), (901, "not a url", day(1)), (902, "http://c.org/", None), (903, "", day(2)), (None, "http://example.com", day(30)), (0, *captures[0][1:])]
    got = sorted(((str(r.page_id), r.value) for r in judge(spark, captures, entries)), key=str)
    assert got == sorted(((str(i), brute(u, t, entries)) for i, u, t in captures), key=str)


def test_an_interval_holds_from_its_start_until_its_end(spark):
    entries = [("domain", "x.com", "add", "c", day(10)), ("domain", "x.com", "remove", "c", day(20))]
    got = {r.page_id: r.blocked for r in judge(spark, [(n, "http://x.com/", day(n)) for n in (9, 10, 19, 20)], entries)}
    assert got == {9: False, 10: True, 19: True, 20: False}


def test_empty_tables(spark):
    assert judge(spark, [], [("domain", "x.com", "add", "c", day(1))]) == []
    assert [r.blocked for r in judge(spark, [(1, "http://x.com/" + "a/" * 2000, day(1))], [])] == [False]
