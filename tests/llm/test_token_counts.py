"""Token counts against offsets found token by token."""

import pytest
from pyspark.sql import functions as F

from reelspark.llm import token_counts
from reelspark.llm.vocabulary import byte_pairs, public_path

RANKS = public_path("byte_bpe_50k.tiktoken")


def plain(text, spans, rule):
    """Tokens and crossing tokens of code-point spans, by walking the bytes."""
    encoding, _ = byte_pairs(RANKS)
    ids = encoding.encode_ordinary(text)
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    tokens, at = [], 0
    for i in ids:
        size = len(encoding.decode_single_token_bytes(i))
        tokens.append((at, at + size))
        at += size
    place = {"first": lambda a, b: a, "middle": lambda a, b: (a + b - 1) // 2, "last": lambda a, b: b - 1}[rule]
    out = []
    for start, end in spans:
        first = next((k for k, c in enumerate(char_of) if c >= start), len(char_of))
        last = next((k for k, c in enumerate(char_of) if c >= end), len(char_of))
        own = [(a, b) for a, b in tokens if first <= place(a, b) < last]
        out.append((len(own), sum(a < first or b > last for a, b in own)))
    return out, len(ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_match_brute_force(spark, rule):
    texts = ["one two\nthree é😀x\n\nfour", "no break", "\n", "😀" * 9 + "\n" + "ab " * 40, "x\n\n\ny  z"]
    rows = [(i, t, [0, 3, 2, 5, 4, 400, 7, 3]) for i, t in enumerate(texts)] + [(8, "", None), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<long>")
    got = token_counts.section_tokens(df, RANKS, rule).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in got if r.doc_id == i)
        spans, at = [], 0
        for line in t.splitlines(keepends=True):
            spans.append((at, at + len(line)))
            at += len(line)
        want, total = plain(t, spans, rule)
        assert mine == [(k, *s, *w) for k, (s, w) in enumerate(zip(spans, want, strict=True))]
        assert sum(m[3] for m in mine) == total
    assert {r.doc_id for r in got} == set(range(5))
    given = token_counts.section_tokens(df, RANKS, rule, spans="spans").collect()
    for i, t in enumerate(texts):
        spans = [(min(a, len(t)), min(b, len(t))) for a, b in ((0, 3), (2, 5), (4, 400))]
        want, _ = plain(t, spans, rule)
        mine = sorted((r.section, r.n_tokens) for r in given if r.doc_id == i and r.section < 3)
        assert mine == [(k, w[0]) for k, w in enumerate(want)]


def test_all_tokens_are_shared_out(corpus, corpus_rows, nothing):
    got = token_counts.section_tokens(corpus, RANKS)
    sums = got.groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(r.n % r.doc_tokens == 0 for r in sums)
    assert token_counts.section_tokens(nothing, RANKS).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(nothing, RANKS, "none")


def test_very_long_white_space(spark):
    encoding, _ = byte_pairs(RANKS)
    for text in ("a" + " " * 12_000 + "b", "a" + "\n" * 12_000, " " * 12_000 + "\u3000 x" + "\t" * 11_000 + "y 1", "q" * 10_000 + " \u0085" * 9_000 + "z"):
        assert token_counts.encode(encoding, text) == encoding.encode_ordinary(text)
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a" * 1_000_000)], "doc_id long, text string")
    got = token_counts.section_tokens(df, RANKS).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(got) == 3 and all(r.n == r.m > 0 for r in got)
