"""Packing against encoding of whole texts, and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from reelspark.llm import packing
from reelspark.llm.vocabulary import _WordIds, public_path, word_encoder

WORDS = public_path("word_bpe_49k.json")


def test_pieces_cover_each_document_once(corpus, corpus_rows, nothing):
    whole = Tokenizer.from_file(WORDS)
    got = packing.pack(corpus, WORDS, context=64).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r.length == 1 << r.bucket <= 64 and r.offset == 0
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert len({r.sequence_id for r in got}) == len(got)
    want = defaultdict(list)
    for i, t in corpus_rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for length in packing.binary_pieces(len(ids), 64):
            want[i].append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
            start += length
        assert start == len(ids)
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    assert packing.pack(nothing, WORDS).count() == 0


def test_words_in_turn_equal_whole_texts():
    whole, encode = Tokenizer.from_file(WORDS), word_encoder(WORDS)
    for text in (
        "It's DON'T we'll x'RE '' a1b2 12.5 <|endoftext|> a<|startoftext|>b <| é é ́x ΑΣ ſK naïve",
        "tabs\tand\nlines\r\n\x0b\x0c \x1c \x85 \xa0x y zero​width 😀👍🏽 ½ ²",
        "a_b-c/d \\ ^~` \x00\x01 'S's 'VE",
        "",
        " ",
    ):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_share_the_ids_of_their_parts():
    whole, known = Tokenizer.from_file(WORDS), _WordIds(WORDS)
    words = "Thorat thorat, THORAT*** Ähnlich ähnlich. ähnlich&&& Ærø's ÿÞßÀ À´b ×÷ a×b «é» µª² d'été 3é4 e\u0301 ﬁé Āé é<|endoftext|>".split()
    for word in words:
        assert np.frombuffer(known[word.encode()], "<u4").tolist() == whole.encode(word, add_special_tokens=False).ids, word
    parts = set(known.parts)
    assert {"thorat", ",", "***", "ähnlich", ".", "&&&", "ærø", "'s"} <= parts
    assert not {"Thorat", "thorat,", "Ähnlich", "ähnlich."} & parts
    letters = [chr(c) for c in range(0xC0, 0x100)]
    for word in (*letters, "".join(letters), *(c + "x1" for c in letters)):
        assert np.frombuffer(known[word.encode()], "<u4").tolist() == whole.encode(word, add_special_tokens=False).ids, word


def test_binary_pieces():
    assert packing.binary_pieces(1, 4096) == [1]
    assert packing.binary_pieces(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]
    assert sum(packing.binary_pieces(12345, 4096)) == 12345
