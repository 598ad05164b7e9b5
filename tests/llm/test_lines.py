"""Line dedup against a plain loop with dynamic programming."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_automaton_matches_dynamic_programming(spark, most):
    r = random.Random(most)
    rows = []
    for _ in range(400):
        a = [r.choice("abé😀") for _ in range(r.randint(0, 9))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.choice("abé😀")] * r.randint(0, 1)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.select("a", "b", lines.within_edits(F.col("a"), F.col("b"), most).alias("near")).collect():
        assert x.near == (edits(x.a, x.b) <= most)


def plain(rows, ties, max_edits, min_chars, near_chars):
    """Removed line numbers of each (doc_id, text)."""
    top = (1 << 63) - 1
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda d: (top if d[0] is None else d[0], ties[d]))
    firsts, out = {}, {}
    for i, t in docs:
        gone = []
        for n, line in enumerate(t.split("\n")):
            line = line.strip(lines.BLANKS)
            if len(line) < min_chars:
                continue
            if line in firsts:
                gone.append(n)
                continue
            near = len(line) >= near_chars and any(
                len(o) >= near_chars and abs(len(o) - len(line)) <= max_edits and edits(o, line) <= max_edits for o in firsts
            )
            firsts[line] = True
            if near:
                gone.append(n)
        out[i, t] = gone
    return out


@pytest.mark.parametrize("most", [1, 2])
def test_documents_match_brute_force(spark, corpus, corpus_rows, most):
    rows = [(i, t) for i, t in corpus_rows if i != 505]
    ties = {(r.doc_id, r.text): r.tie for r in corpus.selectExpr("doc_id", "text", "xxhash64(text) AS tie").collect()}
    want = plain(rows, ties, most, 10, 20)
    df = corpus.where("doc_id IS NULL OR doc_id <> 505")
    got = lines.line_report(df, max_edits=most, min_chars=10, near_chars=20).collect()
    assert sorted((r.doc_id or -1, r.n_repeats, r.removed_lines) for r in got) == sorted(
        (i or -1, len(want.get((i, t), [])), want.get((i, t), [])) for i, t in rows
    )
    assert sum(r.n_near for r in got) > 5
    left = lines.without_repeats(df, max_edits=most, min_chars=10, near_chars=20)
    assert left.columns == df.columns
    expected = sorted(
        (i or -1, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i, t])) for i, t in rows if t is not None
    )
    assert sorted((r.doc_id or -1, r.text) for r in left.collect() if r.text is not None) == expected


def test_empty_table(nothing):
    assert lines.line_report(nothing).count() == 0
    assert lines.without_repeats(nothing).count() == 0


def test_main_path_is_native(corpus):
    plan = lines.line_report(corpus)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_registered_limits_cover_lines_of_every_length(spark):
    r = random.Random(6)
    texts = ["x", "ab", "}"] + ["".join(r.choice("abcdefghij ") for _ in range(n)).strip().ljust(n, "k") for n in range(3, 60)]
    rows = []
    for i in range(12):
        found = []
        for text in texts:
            line = list(text)
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(line))
                line[at : at + r.randint(0, 1)] = [r.choice("abcdefghij")] * r.randint(0, 1)
            found.append("".join(line))
        rows.append((i, "\n".join([*found, "", " \t", "x", "y" * 19])))
    firsts, want = set(), {}
    for i, text in rows:
        want[i] = [[], 0]
        for n, line in enumerate(text.split("\n")):
            line = line.strip(lines.BLANKS)
            if not line:
                continue
            near = any(
                abs(len(o) - len(line)) <= 2 and edits(o, line) <= min(2, min(len(o), len(line)) // 10) for o in firsts
            )
            if line in firsts or near:
                want[i][0].append(n)
                want[i][1] += line not in firsts
            firsts.add(line)
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: [x.removed_lines, x.n_near] for x in got} == want


def test_columns_with_clashing_names_are_kept(spark):
    rows = [(1, "one line that repeats\nx", "a", 5, 0.5), (2, "y\none line that repeats", "b", 6, 1.5), (None, None, "c", 7, 2.5)]
    for names in (("_doc", "_tie", "_removed"), ("doc", "tie", "removed"), ("Doc", "tie_", "removed")):
        df = spark.createDataFrame(rows, "doc_id long, text string, {} string, {} int, {} double".format(*names))
        left = lines.without_repeats(df)
        assert left.dtypes == df.dtypes
        assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[0], (2, "y", "b", 6, 1.5), rows[2]], key=repr)
