"""Secret scan: patterns for known shapes, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few characters per token on random strings and many on words.  Runs of key characters
with letters and digits whose characters per token fall below a limit are reported as kind ``token``, unless their
shape says what they are: digests in hexadecimal, UUIDs, numbers and dates, identifiers made of words.  A run is cut
where ``= / _ - +`` stand: known shapes among its parts are left out, and the least efficient stretches of the other
parts are judged and reported, so that words joined to a random string do not hide it.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive; matches of one
kind never overlap, those of different kinds may; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from reelspark.llm.rows import edit_slices, map_slices, texts
from reelspark.llm.vocabulary import byte_pairs

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "token")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_KNOWN = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE),
    re.compile(r"[0-9+/_=-]+"),
)
_PART = re.compile(r"[A-Za-z0-9]+")
_WALL = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}"
    r"|[0-9a-f]{96}|[0-9a-f]{128})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    found = []
    lower = text.lower()
    if any(key in lower for key in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _identifier(run: str) -> bool:
    """Made of words: long alphabetic parts, digits only in short groups at their ends."""
    parts = _PARTS.findall(run)
    letters = [p for p in parts if not p.isdigit()]
    digits = [p for p in parts if p.isdigit()]
    return all(len(p) <= 4 for p in digits) and len(digits) <= 2 and sum(map(len, letters)) >= 4 * max(len(letters), 1)


def _stretches(parts: list[tuple[int, int]], scores: list[float]) -> list[tuple[int, int]]:
    """Start and end of the maximal stretches of parts by sum of scores (Ruzzo and Tompa, 1999)."""
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    total = 0.0
    for (start, end), score in zip(parts, scores, strict=True):
        before, total = total, total + score
        if score <= 0:
            continue
        after, waiting = total, []
        while True:
            while kept and kept[-1][0] >= before:
                waiting.append(kept.pop())
            if not kept or kept[-1][1] >= after:
                kept += [*reversed(waiting), (before, after, start, end)]
                break
            before, _, start, _ = kept.pop()
            waiting = []
    return [(start, end) for _, _, start, end in kept]


def token_spans(text: str, encode, shortest: int, most_chars_per_token: float) -> list[tuple[str, int, int]]:
    """Spans of stretches of at least ``shortest`` key characters that the vocabulary encodes poorly."""
    if not any(len(word) >= shortest for word in text.split()):
        return []

    def opaque(run: str) -> bool:
        return (
            len(run) >= shortest
            and any(c.isdigit() for c in run)
            and any(c.isalpha() for c in run)
            and not any(known.fullmatch(run) for known in _KNOWN)
            and not _identifier(run)
            and len(run) < most_chars_per_token * len(encode(run))
        )

    found = []
    for m in _RUN.finditer(text):
        if len(m[0]) < shortest or m[0].isalpha():
            continue
        walls = [(w.start(), w.end()) for w in _WALL.finditer(m[0])]
        for at, to in zip([0, *(w[1] for w in walls)], [*(w[0] for w in walls), len(m[0])], strict=True):
            run = m[0][at:to]
            if len(run) < shortest:
                continue
            parts = [p.span() for p in _PART.finditer(run)]
            spans = []
            if len(parts) > 1:
                scores = [most_chars_per_token * len(encode(run[a:b])) - (b - a) for a, b in parts]
                spans = [s for s in _stretches(parts, scores) if opaque(run[slice(*s)])]
            if not spans and opaque(run):
                spans = [(0, len(run))]
            for start, end in spans:
                while end < len(run) and run[end] == "=":  # padding
                    end += 1
                found.append(("token", m.start() + at + start, m.start() + at + end))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def scan(
    documents: DataFrame, vocabulary: str, shortest: int = 20, most_chars_per_token: float = 2.0
) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans of each document."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_token bigint, base_sha256 string, spans string"

    def rows(batch: pa.RecordBatch) -> dict:
        encode = byte_pairs(vocabulary)[0].encode_ordinary
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            base = base_spans(text)
            more = token_spans(text, encode, shortest, most_chars_per_token)
            kinds = [kind for kind, _, _ in base]
            out["doc_id"].append(doc_id)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["n_token"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
        return out

    return map_slices(documents.select("doc_id", "text"), schema, rows)


def without_secrets(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every found span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(
    documents: DataFrame, vocabulary: str, shortest: int = 20, most_chars_per_token: float = 2.0
) -> DataFrame:
    """The documents with secrets replaced in ``text`` and ``n_chars`` set anew where a text changed."""

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = byte_pairs(vocabulary)[0].encode_ordinary
        values, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
        for i, text in enumerate(values):
            spans = base_spans(text or "") + token_spans(text or "", encode, shortest, most_chars_per_token)
            if spans:
                values[i] = without_secrets(text, spans)
                sizes[i] = len(values[i])
        for name, new in (("text", values), ("n_chars", sizes)):
            k = batch.schema.get_field_index(name)
            batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
        return batch

    return edit_slices(documents, edit)
