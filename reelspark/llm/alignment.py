"""Alignment of two tokenizers: where tokens of both end together, and how often their ids are linked in the corpus.

A byte-level vocabulary (A) encodes a space and the text; a SentencePiece vocabulary (B), which adds that space itself,
encodes the text.  Byte offsets where tokens of both end cut the tokens into groups; the last tokens of a group end
together and are a link.  A pair of ids counts as many links as the corpus holds of it.

* Identity-map fast path: an array gives for every id of A the id of B with the same bytes.  A group of one token each
  that follows the map is counted in a vector as long as A's vocabulary; such a vector per task is all that moves.
* Only links that the map does not tell enter the shuffle of pairs.  They are counted per block of documents first, and
  a block asks for a pair once, so a pair that every document holds is a row per block.
* The answers meet the documents of their block again (a block is bounded by ``block_size`` of text).

What goes to the driver has the length of a vocabulary: links per identity pair, and the highest count per id of B.

Defined results: texts that are null, empty or that a vocabulary does not give back byte by byte have no tokens: zeros
and an empty ``groups``; a repeated row is a document of its own and counts again; null ids stay null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.rows import slices, stored, texts

#: Text of the documents that ask for pairs together, in characters.
BLOCK_SIZE = 8 << 20

SPACE = "\u2581"

#: White space in a row that the rank encoder is not given.
BLANKS = 10_000
_BLANKS = re.compile(rf"\s{{{BLANKS}}}")

_DOCUMENT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups {}, same binary, other array<bigint>"
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups {}"


def _byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class _Vocabulary:
    """Bytes of every id, their lengths, decimal ids before a comma and a mark, and how a text becomes ids."""

    def __init__(self, tokens: list[bytes], encode, mark: bytes):
        self.tokens, self.encode = tokens, encode
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.printed = [b"%d%s" % (i, end) for end in (b",", mark) for i in range(len(tokens))]


@cache
def byte_level(path: str) -> _Vocabulary:
    """A: byte-level vocabulary file, for a space and a text; special tokens in texts are plain text.

    The file's merges stand in the order of its ids, so ids are ranks, and the faster rank encoder gives the same tokens.  It
    cannot take very long runs of white space; texts that hold one go to the file's own encoder.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    of = _byte_level()
    tokens = [b""] * whole.get_vocab_size()
    for token, i in whole.get_vocab().items():
        tokens[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [model["vocab"][x + y] for x, y in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("the merges of the vocabulary do not stand in the order of its ids")
    special = set(whole.get_added_tokens_decoder())
    ranks = tiktoken.Encoding(
        "ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special}, special_tokens={}
    )

    def encode(text: str) -> np.ndarray:
        if len(text) > BLANKS and _BLANKS.search(text):
            return np.array(whole.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return np.array(ranks.encode_ordinary(" " + text), np.int64)

    return _Vocabulary(tokens, encode, b"|")


@cache
def pieces(path: str) -> _Vocabulary:
    """B: SentencePiece file; U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [
        bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode()
        for i, name in enumerate(names)
    ]
    return _Vocabulary(tokens, lambda text: np.array(model.encode(text, num_threads=1), np.int64), b";")


def identity_map(a: _Vocabulary, b: _Vocabulary) -> np.ndarray:
    """For every id of A the smallest id of B with the same bytes, or -1."""
    of: dict[bytes, int] = {}
    for i, token in enumerate(b.tokens):
        of.setdefault(token, i)
    return np.array([of.get(t, -1) if t else -1 for t in a.tokens], np.int64)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the tokens that end together; both sequences end at the same byte."""
    at = np.searchsorted(ends_a, ends_b)
    last_b = np.flatnonzero(ends_a[at] == ends_b)
    return at[last_b], last_b


class Aligner:
    """Groups of whole texts; everything about a vocabulary is made once for a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a), pieces(path_b)
        self.same = identity_map(self.a, self.b)
        self.printed = self.a.printed + self.b.printed

    def printed_groups(self, ids_a, ids_b, last_a, last_b) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        before_a, before_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # Tokens of A move up by the tokens of B in earlier groups, tokens of B by those of A up to their own group.
        up_a = np.repeat(np.cumsum(before_b) - before_b, before_a)
        up_b = np.repeat(np.cumsum(before_a), before_b)
        # What is printed for a token: its id in a group, or its id at the end of its side of a group.
        own = np.empty(len(ids_a) + len(ids_b), np.int64)
        place_a, place_b = np.arange(len(ids_a)) + up_a, np.arange(len(ids_b)) + up_b
        own[place_a], own[place_b] = ids_a, ids_b + len(self.a.printed)
        own[place_a[last_a]] += len(self.a.tokens)
        own[place_b[last_b]] += len(self.b.tokens)
        return b"".join(map(self.printed.__getitem__, own.tolist()))[:-1]

    def document(self, text: str):
        """n_a, n_b, n_groups, printed groups, ids of A of identity links, numbers of the other pairs."""
        none = 0, 0, 0, b"", b"", b""
        if not text:
            return none
        ids_a, ids_b, whole = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        for vocabulary, ids in ((self.a, ids_a), (self.b, ids_b)):
            if b"".join(map(vocabulary.tokens.__getitem__, ids.tolist())) != whole:
                return none
        last_a, last_b = common_ends(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))
        link_a, link_b = ids_a[last_a], ids_b[last_b]
        # Tokens of equal bytes that end together also begin together, so they are a group of their own.
        told = self.same[link_a] == link_b
        others = link_a[~told] * len(self.b.tokens) + link_b[~told]
        return (
            len(ids_a), len(ids_b), len(last_a), self.printed_groups(ids_a, ids_b, last_a, last_b),
            link_a[told].astype("<u4").tobytes(), others.astype("<i8").tobytes(),
        )


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _as_text(groups: bytes) -> str:
    return groups.decode()


def _as_sha256(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest() if groups else ""


def _encoded(documents: DataFrame, path_a: str, path_b: str, digest, name: str, block_size: int) -> DataFrame:
    """A row per document: its block, counts, groups, ids of identity links and numbers of the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, filled = TaskContext.get().partitionId(), 0, 0
        known = _aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch):
                blocks, own = [], texts(part.column(1))
                for text in own:
                    if filled >= block_size:
                        block, filled = block + 1, 0
                    filled += len(text) + 64
                    blocks.append((task << 32) + block)
                found = [known.document(text) for text in own]
                n_a, n_b, n, groups, told, others = zip(*found, strict=True)
                ends = np.cumsum([0, *map(len, others)], dtype=np.int64) // 8
                pairs = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(others), "<i8"))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks), part.column(0), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n)),
                        pa.array([digest(g) for g in groups], pa.string()), pa.array(told, pa.binary()), pairs,
                    ],
                    names=["block", "doc_id", "n_a", "n_b", "n_groups", name, "same", "other"],
                )

    schema = "block bigint, " + _DOCUMENT.replace("groups {}", f"{name} string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _identity_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """Links per id of A that follow the identity map; a vector per task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                np.add(total, np.bincount(np.frombuffer(value, "<u4"), minlength=size), out=total)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["a", "n"])

    counted = encoded.select("same").mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in counted.collect():  # at most as many rows as ids
        out[row.a] = row.n
    return out


def align(
    documents: DataFrame,
    path_a: str,
    path_b: str,
    hashed: bool = False,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every document.

    n_best are the links whose pair is linked most often among the pairs of its id of B (ties included); count_sum adds the
    counts of the pairs of all links.  With ``hashed`` the groups come as ``groups_sha256``; no tokens give '' either way.
    """
    spark = documents.sparkSession
    name = "groups_sha256" if hashed else "groups"
    encoded = stored(
        _encoded(documents, path_a, path_b, _as_sha256 if hashed else _as_text, name, block_size), "aligned"
    )
    a, b = byte_level(path_a), pieces(path_b)
    size_b, same = len(b.tokens), identity_map(a, b)
    identity = _identity_counts(encoded, len(a.tokens))

    asked = stored(
        encoded.select("block", F.explode("other").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n")),
        "aligned-asked",
    )
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("total")), "aligned-counts")
    highest = np.zeros(size_b, np.int64)
    for row in counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("total").alias("n")).collect():
        highest[row.b] = row.n  # at most as many rows as ids
    mapped = same >= 0
    np.maximum.at(highest, same[mapped], identity[mapped])
    best = np.zeros(len(identity), bool)
    best[mapped] = identity[mapped] == highest[same[mapped]]
    shared = spark.sparkContext.broadcast((identity, best, highest))  # of the vocabularies' lengths

    def settle(docs: pa.Table, told: pa.Table) -> pa.Table:
        identity, best, highest = shared.value
        order = np.argsort(known := told.column("pair").to_numpy())
        known, total = known[order], told.column("total").to_numpy()[order]
        top = total == highest[known % size_b]
        n_best, sums, links = [], [], []
        for value, pairs in zip(docs.column("same"), docs.column("other"), strict=True):
            own = np.frombuffer(value.as_py(), "<u4")
            at = np.searchsorted(known, pairs.values.to_numpy())
            links.append(len(own) + len(at))
            n_best.append(int(best[own].sum() + top[at].sum()))
            sums.append(int(identity[own].sum() + total[at].sum()))
        kept = [docs.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups")]
        made = [pa.array(c, pa.int64()) for c in (links, n_best, sums)]
        return pa.table(
            [*kept, *made, docs.column(name).combine_chunks()],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", name],
        )

    answers = asked.select("block", "pair").join(counts, "pair")
    return (
        encoded.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(settle, _RESULT.replace("groups {}", f"{name} string"))
    )
