"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put in another order, with a sparse byte index.

Cuts are drawn in code points, texts are UTF-8 bytes.  The index holds only the characters of more than one byte: where
they are, and the bytes they have beyond one, added up.  A code point's byte is its number plus the excess bytes before
it, found by ``searchsorted`` among the exceptions; between exceptions it is plain arithmetic, and an ASCII text has none.
One index serves all texts of a batch, so a cut costs one search whatever the length of its text.

Draws come from ``sha256(f"{seed}:{doc_id}")``: its first four groups of eight hex digits are h1 to h4.  Of n + 1 places,
h1 and h2 give the cuts.  A text is plain if it is empty, holds a mark, or h3 % 100 >= ``rate``; else it is
suffix-first (spm) if h4 % 100 < ``spm_rate``, else prefix-first (psm).

Defined results: a null text is empty; a null doc_id draws as an empty number; a repeated row is cut alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.rows import map_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SCHEMA = """doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint,
    prefix_bytes bigint, middle_bytes bigint, output string"""


class ExceptionIndex:
    """Code points and bytes of consecutive UTF-8 texts, from the characters of more than one byte alone."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """``starts`` are the first bytes of the texts in ``data`` and the end of the last one."""
        leads = np.flatnonzero(data >= 0xC0)
        first = data[leads]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        #: Excess bytes of the first k exceptions, and the code point of each exception.
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.points = leads - self.excess[:-1]
        self.starts = starts
        self.first_points = starts - self.excess[np.searchsorted(leads, starts)]

    def lengths(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.first_points)

    def bytes_at(self, cuts: np.ndarray) -> np.ndarray:
        """The byte, counted from the text's start, of one cut in code points for each text."""
        points = self.first_points[:-1] + cuts
        return points + self.excess[np.searchsorted(self.points, points)] - self.starts[:-1]


def _text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of a column in a row, and the first byte of each with the end of the last; null is empty."""
    values = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
    return b"".join(values), np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])


def transform(documents: DataFrame, rate: int = 90, spm_rate: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (code points), form, prefix and middle in code points and bytes (null if plain), and the output."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def rows(batch: pa.RecordBatch) -> dict:
        data, starts = _text_bytes(batch.column(1))
        index = ExceptionIndex(np.frombuffer(data, np.uint8), starts)
        n = index.lengths()
        h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
        x, y = h1 % (n + 1), h2 % (n + 1)
        cuts = np.minimum(x, y), np.maximum(x, y)
        low, high = (index.bytes_at(c) for c in cuts)
        marked = np.array([any(k in data[a:b] for k in marks) for a, b in zip(starts, starts[1:], strict=False)], bool)
        plain = (n == 0) | marked | (h3 % 100 >= rate)
        forms = np.where(plain, "plain", np.where(h4 % 100 < spm_rate, "spm", "psm"))
        outputs = []
        for form, start, end, a, b in zip(forms, starts, starts[1:], low, high, strict=False):
            text = data[start:end]
            if form == "psm":
                text = b"".join((p, text[:a], s, text[b:], m, text[a:b]))
            elif form == "spm":
                text = b"".join((s, text[b:], p, text[:a], m, text[a:b]))
            outputs.append(text)
        return {
            "doc_id": batch.column(0),
            "n": n,
            "form": forms.tolist(),
            "prefix_chars": pa.array(cuts[0], mask=plain),
            "middle_chars": pa.array(cuts[1] - cuts[0], mask=plain),
            "prefix_bytes": pa.array(low, mask=plain),
            "middle_bytes": pa.array(high - low, mask=plain),
            "output": pa.array(outputs, pa.binary()).cast(pa.string()),
        }

    doc_id = F.col("doc_id").cast("long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return map_slices(documents.select(doc_id.alias("doc_id"), "text", *draws), _SCHEMA, rows)


def restored(form: Column, output: Column) -> Column:
    """The text, from its output and form alone; no part of a text that is not plain holds a mark."""
    before_middle = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(
        F.substring_index(F.substring_index(before_middle, SUFFIX, 1), PREFIX, -1),
        middle,
        F.substring_index(before_middle, SUFFIX, -1),
    )
    spm = F.concat(
        F.substring_index(before_middle, PREFIX, -1),
        middle,
        F.substring_index(F.substring_index(before_middle, PREFIX, 1), SUFFIX, -1),
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """Forms and cuts of all documents, with SHA-256 of the output and of the text rebuilt from it."""
    out = transform(documents)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


#: DuckDB SQL for ``digests``.
ORACLE_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, t, n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
           n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
               OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 AS plain,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 AS suffix_first
    FROM d
), cut AS (
    SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) - least(x, y) AS b,
           CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
           substr(t, 1, least(x, y)) AS pre, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid,
           substr(t, greatest(x, y) + 1) AS suf
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b END AS middle_chars,
       CAST(CASE WHEN form <> 'plain' THEN strlen(pre) END AS BIGINT) AS prefix_bytes,
       CAST(CASE WHEN form <> 'plain' THEN strlen(mid) END AS BIGINT) AS middle_bytes,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
