"""Line dedup against counting by hand."""

from collections import defaultdict

from plumbline.llm.line_dedup import drop_lines, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _pos string, _h1 string"


def brute(rows, limit):
    sites, first = defaultdict(set), {}
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[0]) for r in rows}, key=lambda x: x[:3])
    for _, _, text, doc in order:
        for pos, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (doc, text, pos))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[3] is not None:
                sites[line.strip(" ")].add(r[3])
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], 0, None))
            continue
        kept = [line for pos, line in enumerate(r[1].split("\n")) if not line.strip(" ") or len(sites[line.strip(" ")]) < limit or first[line.strip(" ")] == (r[0], r[1], pos)]
        out.append((r[0], len(r[1].split("\n")) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "x", "y") for d, t, _, s in rows], SCHEMA)


def test_against_brute_force(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"only {i}\nshared by all\n  padded \n\nshared by few" if i % 10 == 0 else f"own {i}\nshared by all\npadded\nshared by all", None, f"s{i % 12}"))
    rows += [(100, None, None, "s1"), (101, "", None, "s2"), (102, "\n\n", None, None), (None, "shared by all\nnull id", None, "s3"), (3, rows[3][1], None, "s3"), (103, "x" * 300_000 + "\nshared by all", None, None)]
    got = sorted([tuple(r) for r in line_dedup(frame(spark, rows)).collect()], key=str)
    assert got == brute(rows, 8)


def test_near_the_limit_is_exact(spark):
    rows = [(i, f"seven\nown {i}" if i < 7 else "x", None, f"s{i}") for i in range(9)] + [(20 + i, f"eight\nown {i}", None, f"s{i}") for i in range(8)]
    out = {r.doc_id: r.text for r in line_dedup(frame(spark, rows)).collect()}
    assert all("seven" in out[i] for i in range(7)) and "eight" in out[20] and not any("eight" in out[20 + i] for i in range(1, 8))


def test_null_sites_do_not_count(spark):
    rows = [(i, "line", None, f"s{i}" if i < 7 else None) for i in range(12)]
    assert all(r.n_removed == 0 for r in line_dedup(frame(spark, rows)).collect())


def test_columns_stay_and_emptied_documents_go(spark):
    rows = [(i, "all the same", None, f"s{i}") for i in range(10)] + [(50, "", None, "s1"), (51, None, None, "s1")]
    out = drop_lines(frame(spark, rows), drop_emptied=True)
    assert out.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 50, 51]


def test_empty_table(spark):
    assert line_dedup(frame(spark, [])).count() == 0
