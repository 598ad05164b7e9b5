"""Decontamination against a search for every window in every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reelspark.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(rows, items, window):
    """n_words, hit places and items of each text."""
    out = []
    listed = [(i, split(t)) for i, t in items]
    for doc_id, text in rows:
        own, hit, named = split(text), set(), set()
        for item, w in listed:
            size = min(window, len(w))
            held = {tuple(w[s : s + size]) for s in range(len(w) - size + 1)} if w else set()
            for s in range(len(own) - size + 1 if w else 0):
                if tuple(own[s : s + size]) in held:
                    hit.update(range(s, s + size))
                    named |= {str(item)} - {"None"}
        out.append((doc_id, len(own), len(hit), sorted(named)))
    return sorted(out, key=repr)


def made(seed):
    r = random.Random(seed)
    vocabulary = ["Ab", "b1", "c", "é", "D", "x9", "ÉT", "漢字", "z"]
    marks = [" ", ", ", "\n", "-", "  ", "\u007f", "_", "'"]
    prose = lambda n: "".join(r.choice(vocabulary) + r.choice(marks) for _ in range(n))
    items = [(i, prose(r.choice([1, 3, 7, 9, 10, 11, 25, 40]))) for i in range(25)]
    items += [(30, items[0][1]), (30, prose(12)), (31, ""), (32, None), (33, "... !"), (None, prose(15))]
    rows = [(i, prose(r.randint(0, 60))) for i in range(40)]
    for i in range(40):
        passage = split(r.choice(items)[1])
        a = r.randrange(len(passage) + 1)
        rows.append((100 + i, prose(r.randint(0, 9)) + "; ".join(passage[a:]).upper() + " " + prose(r.randint(0, 9))))
    rows += [(7, None), (8, ""), (8, rows[50][1]), (8, rows[50][1]), (None, rows[51][1]), (9, prose(3000) + items[20][1])]
    return rows, items


@pytest.mark.parametrize("window, gram", [(10, 5), (4, 4), (6, 1)])
def test_hits_match_brute_force(spark, window, gram):
    for seed in range(2):
        rows, items = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
            {"row": F.lit("x"), "size": F.lit(2), "words": F.lit(3), "n_words": F.lit(None).cast("string")}
        )
        bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit("h"))
        got = decontamination.find(docs.repartition(5), bench, window, gram).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(rows, items, window)
        for r in got:
            edges = [e for s in r.spans for e in (s.start, s.end)]
            assert edges == sorted(set(edges)) and sum(s.end - s.start for s in r.spans) == r.n_hit


def test_empty_tables(spark, corpus, corpus_rows, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.report(corpus, none).collect()
    assert len(got) == len(corpus_rows) and not any(r.contaminated or r.n_items for r in got)
    assert {r.n_words for r in got} == {len(split(t)) for _, t in corpus_rows}
    assert decontamination.report(nothing, none).count() == 0


def test_equal_windows_keep_equal_grams():
    r = random.Random(3)
    shared = [b"%d" % r.randrange(5) for _ in range(10)]
    kept = set()
    for _ in range(50):
        text = [b"%d" % r.randrange(5) for _ in range(r.randrange(30))] + shared + [b"q"] * r.randrange(9)
        at = next(i for i in range(len(text)) if text[i : i + 10] == shared)
        places, hashes = decontamination.winnowed(decontamination.Hashed(text), 10, 5)
        kept.add((int(places[at]) - at, int(hashes[at])))
    assert len(kept) == 1
