"""Token counts of fields and sections, by offset-mapped attribution.

A document is encoded once, as a whole.  The byte lengths of its ids give the character span of every token, since a
byte-level vocabulary loses nothing; the spans are then joined to the sections.  A token that crosses a boundary is
given whole to the section that holds one character of it: its first, middle or last, as ``rule`` says.  Sections that
do not overlap therefore never share a token, and sections that cover a text share out all its tokens.

Defined results: null and empty texts have no sections by lines (given spans count no tokens); null spans count as none;
spans outside the text are cut to it; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspark.llm.rows import map_slices, raw_texts
from reelspark.llm.vocabulary import byte_pairs

RULES = ("first", "middle", "last")


#: White space in a row (the Unicode property) that is encoded on its own: the pattern of the vocabulary fails on much more.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def encode(encoding, text: str) -> list[int]:
    """Ids of a whole text.

    A run of white space is one token's text up to its last character, which goes to what follows.  So a very long run is
    handed over as a piece, and the text goes on at its last character.
    """
    if len(text) < 10_000 or not (runs := list(_BLANKS.finditer(text))):
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in runs:
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def line_sections(text: bytes) -> np.ndarray:
    """Byte spans of the lines of a text, each with its line break: they cover the text."""
    if not text:
        return np.zeros((0, 2), np.int64)
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def attribute(ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each byte span, and how many of those reach over its edges; ``ends`` are the tokens' ends."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    point = {"first": starts, "middle": (starts + ends - 1) // 2, "last": ends - 1}[rule]
    a, b = np.searchsorted(point, spans[:, 0]), np.searchsorted(point, spans[:, 1])
    inside_a, inside_b = np.searchsorted(starts, spans[:, 0]), np.searchsorted(ends, spans[:, 1], side="right")
    return b - a, (b - a) - np.maximum(np.minimum(b, inside_b) - np.maximum(a, inside_a), 0)


def section_tokens(documents: DataFrame, vocabulary: str, rule: str = "first", spans: str | None = None) -> DataFrame:
    """One row per section: span in code points, n_tokens, n_crossing, and doc_tokens of the whole document.

    ``spans`` names a column array<bigint> of starts and ends in code points, in turn; without it, lines are sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = "doc_id section start end n_tokens n_crossing doc_tokens".split()
    schema = ", ".join(f"{n} bigint" for n in names)

    def rows(batch: pa.RecordBatch) -> dict:
        encoding, lengths = byte_pairs(vocabulary)
        out: dict[str, list] = {n: [] for n in names}
        given = batch.column(2).to_pylist() if spans else [None] * batch.num_rows
        for doc_id, text, own in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), given, strict=True):
            # Code points before each byte, needed only where bytes and code points differ.
            chars = None if text.isascii() else np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            if spans:
                size = len(text) if chars is None else int(chars[-1])
                points = np.clip(np.array(own or [], np.int64).reshape(-1, 2), 0, size)
                places = points if chars is None else np.searchsorted(chars, points, side="right")
                places = np.minimum(places, len(text))
            else:
                places = line_sections(text)
                points = places if chars is None else np.concatenate([[0], chars])[places]
            if not len(places):
                continue
            ids = np.array(encode(encoding, text.decode()), np.int64)
            ends = np.cumsum(lengths[ids])
            own_tokens, crossing = attribute(ends, places, rule)
            k = len(places)
            for name, values in zip(
                names,
                ([doc_id] * k, range(k), points[:, 0], points[:, 1], own_tokens, crossing, [len(ids)] * k),
                strict=True,
            ):
                out[name].extend(values)
        return out

    return map_slices(documents.select("doc_id", "text", *([spans] if spans else [])), schema, rows)
