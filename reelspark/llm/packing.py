"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n (long documents: as many
full contexts as fit, then the digits of the rest).  Every piece is a sequence of its own with a power of two as
its length, so no sequence crosses documents and none is padded.  Sequences of equal length share a bucket, from
which batches of one shape are drawn.

Defined results: a null or empty text has the end token only; a row that repeats is packed again; a null doc_id
stays null; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.rows import map_slices, raw_texts
from reelspark.llm.vocabulary import word_encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int"


def binary_pieces(n: int, context: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, longest first; ``context`` is a power of two."""
    rest = n % context
    return [context] * (n // context) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    documents: DataFrame,
    vocabulary: str,
    context: int = 4096,
    end_id: int = 2,
    encoder: Callable[[str], Callable[[bytes], bytes]] = word_encoder,
) -> DataFrame:
    """Pieces of all documents: span in the document, checksum, sequence and bucket (log2 of the length).

    ``encoder(vocabulary)`` gives a function from a UTF-8 text to its ids as little-endian 32-bit integers.
    """
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> dict:
        encode = encoder(vocabulary)
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket")}
        for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            ids = memoryview(encode(text) + end)
            n, start = len(ids) // 4, 0
            for length in binary_pieces(n, context):
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                out["doc_tokens"].append(n)
                out["bucket"].append(length.bit_length() - 1)
                start += length
        return out

    pieces = map_slices(documents.select("doc_id", "text"), SCHEMA, rows)
    # Partition and row number: unique, and the same again when a lost task is run anew.
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
