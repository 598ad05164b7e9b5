"""Public tokenizers, loaded once per Python worker.  The vocabulary file is always a parameter."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable
from functools import cache

import numpy as np

from reelspark.llm.rows import MEMORIES

#: Words, and their bytes, whose ids a worker remembers, and as many parts of words; beyond either the memory is emptied
#: and filled again.
REMEMBERED, REMEMBERED_BYTES = 400_000, 96 << 20

#: Words that the word vocabulary only lower-cases: printable ASCII and the letters of Latin-1.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: How it splits them once they are lower-case (a fixed value of that vocabulary).
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def public_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _PartIds(dict):
    """Ids as bytes of a lower-case part of a Latin word; words with other capitals or marks share their parts."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        spelled = tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = str.maketrans({c: spelled(c)[0][0] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"})
        self.held = 0
        MEMORIES.append(self)

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED or self.held > REMEMBERED_BYTES:
            self.clear()
        text = part if part.isascii() else part.translate(self.spelling)
        found = _packed([t.id for t in self.model.tokenize(text)])
        size = 180 + len(part) + len(found)
        if size < REMEMBERED_BYTES >> 10:
            self.held += size
            self[part] = found
        return found


class _WordIds(dict):
    """Ids of a word as bytes, by word.

    The vocabulary drops white space and never merges across it, so a text has the ids of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.parts = _PartIds(self.whole)
        self.held = 0
        MEMORIES.append(self)

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED or self.held > REMEMBERED_BYTES:
            self.clear()
        text = word.decode()
        if ((text.isascii() and text.isprintable()) or _LATIN.fullmatch(text)) and "<|" not in text:
            text = text.lower()
            if text.isalpha():
                found = self.parts[text]
            else:
                found = b"".join([self.parts[part] for part in _PARTS.findall(text)])
        else:
            found = _packed(self.whole.encode(text, add_special_tokens=False).ids)
        size = 180 + len(word) + len(found)
        if size < REMEMBERED_BYTES >> 10:
            self.held += size
            self[word] = found
        return found


@cache
def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """Encoder of a vocabulary with word ends, equal to encoding the whole text."""
    known = _WordIds(path)
    return lambda text: b"".join(map(known.__getitem__, text.split()))


@cache
def byte_pairs(path: str):
    """Byte-level encoder of a rank file, and the byte length of every id."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
