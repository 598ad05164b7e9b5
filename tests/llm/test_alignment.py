"""Alignment against groups and counts found token by token."""

import hashlib
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import alignment
from reelspark.llm.vocabulary import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")


def brute(rows):
    """The result rows, from offsets in bytes and counters of pairs."""
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    # The byte-level alphabet: visible Latin-1 characters, then the others from 256 on.
    visible = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte_of = {chr(c): c for c in visible}
    byte_of |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible)}

    def bytes_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    docs, pairs = [], Counter()
    for doc_id, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        of_a = [bytes(byte_of[c] for c in whole.id_to_token(i)) for i in a]
        of_b = [bytes_b(i) for i in b]
        if not text or not b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (of_a, of_b))
        place_b = {e: k for k, e in enumerate(ends_b)}
        groups, links, at, bt = [], [], 0, 0
        for k, e in enumerate(ends_a):
            if e in place_b:
                m = place_b[e]
                groups.append(",".join(map(str, a[at : k + 1])) + "|" + ",".join(map(str, b[bt : m + 1])))
                links.append((a[k], b[m]))
                at, bt = k + 1, m + 1
        pairs.update(links)
        docs.append((doc_id, a, b, groups, links))
    top = Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    return sorted(
        (
            (
                i, len(a), len(b), len(g), len(k), sum(pairs[p] == top[p[1]] for p in k), sum(pairs[p] for p in k),
                ";".join(g),
            )
            for i, a, b, g, k in docs
        ),
        key=repr,
    )


ODD = [
    "two  spaces", " lead", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "\ttab\r\n", "😀👍🏽 漢字 é", "x" * 400,
    " " * 300, "\n" * 300, "\u0000\u007f\u0085 ", "ﬁ ½ Å", "A",
]


def test_rows_match_brute_force(spark, corpus, corpus_rows, nothing):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in corpus_rows]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"block": F.lit("x"), "pair": F.lit(1), "same": F.lit(2.0)}
    )
    want = brute(rows)
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups".split()
    for size in (alignment.BLOCK_SIZE, 1000):
        got = alignment.align(docs.repartition(3), A, B, block_size=size)
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
    hashed = alignment.align(docs, A, B, hashed=True).select("doc_id", "groups_sha256").collect()
    assert sorted(map(tuple, hashed), key=repr) == sorted(
        ((w[0], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in want), key=repr
    )
    assert alignment.align(nothing, A, B).count() == 0


def test_ranks_give_the_tokens_of_the_file(data_dir):
    import duckdb

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    found = duckdb.sql(f"SELECT text FROM '{data_dir}/documents.parquet' UNION ALL SELECT html FROM '{data_dir}/pages.parquet'")
    texts = [t for (t,) in found.fetchall()] + ODD + ["a" * 20_000 + " " * 9_000, "\u0085 \n" * 12_000, "x" + "\n" * 10_001]
    for text in texts:
        assert alignment.byte_level(A).encode(text).tolist() == whole.encode(" " + text, add_special_tokens=False).ids


def test_long_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_groups > 0 for r in alignment.align(docs, A, B).collect()} == {1: True, 2: True}
