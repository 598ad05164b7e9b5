"""Fill-in-the-middle against plain string cutting, and exact round trips."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from reelspark.llm import fill_middle


def plain(doc_id, text, rate=90, spm_rate=20, seed=1):
    """form, cuts and output by Python strings."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["é", "😀" * 7, "a😀é漢b" * 50, "<P> held", "x<M>", "ab<S", "<", "P>x" * 9, "\n", " " * 40, "ñ" * 3001 + "z" * 5000]


def test_output_matches_plain_cutting(spark, corpus, corpus_rows, nothing):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD * 6)], "doc_id long, text string")
    rows = [*corpus_rows, *((1000 + i, t) for i, t in enumerate(ODD * 6))]
    both = corpus.select("doc_id", "text").union(extra)
    for rate, spm in ((90, 20), (100, 50), (0, 0)):
        out = fill_middle.transform(both, rate, spm).withColumn(
            "back", fill_middle.restored(F.col("form"), F.col("output"))
        )
        got = sorted(
            ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr
        )
        assert got == sorted(((i, *plain(i, t or "", rate, spm), t or "") for i, t in rows), key=repr)
        forms = {g[2] for g in got}
        assert forms == ({"plain"} if not rate else {"plain", "psm", "spm"})
    assert fill_middle.transform(nothing).count() == 0


def test_columns_with_clashing_names_are_ignored(corpus):
    odd = corpus.withColumns({"h1": F.lit("x"), "form": F.lit(1), "output": F.lit(2.0), "n": F.lit(None).cast("int")})
    assert sorted(map(tuple, fill_middle.transform(odd).collect()), key=repr) == sorted(
        map(tuple, fill_middle.transform(corpus).collect()), key=repr
    )


def test_cuts_in_bytes():
    texts = ["", "abc", "é", "a😀b漢é", "", "x" * 9 + "é"]
    data = b"".join(t.encode() for t in texts)
    starts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    index = fill_middle.ExceptionIndex(np.frombuffer(data, np.uint8), starts)
    assert index.lengths().tolist() == [len(t) for t in texts]
    for share in (0, 0.3, 0.5, 0.9, 1):
        cuts = np.array([int(share * len(t)) for t in texts])
        assert index.bytes_at(cuts).tolist() == [len(t[:c].encode()) for t, c in zip(texts, cuts, strict=True)]
