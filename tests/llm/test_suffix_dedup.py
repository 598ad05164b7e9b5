"""Suffix-array dedup against sets of strings, and induced sorting against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from reelspark.llm import induced, suffix_dedup


def plain(rows, length, order):
    docs = sorted({(i, t or "") for i, t in rows}, key=order)
    seen, out = set(), {}
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            piece = b[s : s + length]
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, t] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"HOT_RECORDS": 1, "SHARD_BYTES": 3000, "CHUNK": 700}])
def test_documents_match_brute_force(spark, corpus, corpus_rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    ties = {
        (r.doc_id, r.text or ""): r.tie
        for r in corpus.selectExpr("doc_id", "text", "xxhash64(text) AS tie").collect()
    }
    top = (1 << 63) - 1
    want = plain(corpus_rows, 100, lambda d: (top if d[0] is None else d[0], ties[d]))
    texts = {(i, t or "") for i, t in corpus_rows}
    got = suffix_dedup.without_repeats(corpus).collect()
    assert len(got) == len(corpus_rows)
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    expected = sorted(((i or -1), *want[i, t or ""]) for i, t in corpus_rows)
    assert texts and found == expected
    assert sum(r.n_removed > 0 for r in got) > 20


def test_hot_anchors_give_the_same(spark, corpus):
    keyed = suffix_dedup._keyed(corpus.where("doc_id < 500"))

    def starts(**limits):
        return {
            (r.doc, r.tie, s)
            for r in suffix_dedup.repeated_spans(keyed, 100, **limits).collect()
            for s in range(r.start, r.start + r["count"])
        }

    assert starts(hot=1) == starts() != set()


def test_empty_table(nothing):
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_suffix_arrays_match_sorting():
    r = random.Random(1)
    for _ in range(600):
        k = r.choice([1, 2, 3, 5, 200])
        text = [r.randint(1, k) for _ in range(r.randint(0, 60))] + [0]
        assert induced.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_permuted_prefixes():
    data = b"abracadabra abracadabra banana bananas"
    text = np.frombuffer(data, np.uint8)
    order = induced.suffix_array(np.append(text.astype(np.int64) + 1, 0))[1:]
    got = induced.permuted_prefixes(np.append(text, np.zeros(40, np.uint8)), order, 30)
    for a, b in zip(order, order[1:], strict=False):
        common = next((n for n in range(60) if data[a : a + n + 1] != data[b : b + n + 1] or b + n >= len(data)), 60)
        assert got[b] == min(common, 30)
