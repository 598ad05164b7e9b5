"""Benchmark decontamination by winnowing.

Texts are words: A-Z lower-cased, runs of bytes other than ASCII marks and white space.  Every benchmark window of
``window`` words (an item of fewer words is one window) is to be found in every document.

* Fingerprints: of the ``window - gram + 1`` word grams of a window the one with the least hash is kept.  Equal windows keep
  equal grams, so a document that shares a window shares its fingerprint: every span of ``window`` words or more is met.
  Hashes are prefix sums of a rolling polynomial, a few array operations for a text of any length.
* A bitmap of fixed size (``1 << BITS`` bits) of the benchmark's fingerprints drops nearly all of the documents' in the map
  tasks that make them; it never grows, and what passes it by chance finds no partner in the join.
* Join of fingerprints; a hit is extended to the windows that kept the fingerprint, compared word by word, and hit
  windows that touch grow into spans.  A window of a document equals one distinct window of the benchmark at most, so
  no pairs of places are listed.  The benchmark's side is repeated ``SALTS`` times, so that a passage that a third of
  all documents holds is spread.

Defined results: null and empty texts have no words; an item without words is no window; items without item_id mark words
but are not listed; repeated rows are rows of their own, repeated items one; null doc_ids stay null; empty tables
give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.rows import raw_texts, slices, stored

#: Size of the bitmap, and copies of the benchmark's side of the join.
BITS, SALTS = 23, 16

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Bytes of words are kept (A-Z lower-cased), all others become a space.
_FOLDED = bytes(ord(chr(c).lower()) if c < 128 and chr(c).lower().encode() in _WORD else c if c in _WORD else 32 for c in range(256))

#: Odd factor of the rolling hash and of its mixing (own choices).
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_FOLDED).split()


class _Powers:
    """Powers of the factor and of its inverse modulo 2 ** 64, as many as the longest text so far has bytes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            size = max(size, 2 * len(cls.up), 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls.up, cls.down = np.full((2, size), [[_BASE], [inverse]], np.uint64)
                cls.up[0] = cls.down[0] = 1
                cls.up, cls.down = np.cumprod(cls.up), np.cumprod(cls.down)
        return cls.up, cls.down


class Hashed:
    """Words of a text, and the hash of any run of them."""

    def __init__(self, own: list[bytes]):
        data = np.frombuffer(b" ".join(own), np.uint8)
        up, self.down = _Powers.of(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum((data + np.uint64(1)) * up[: len(data)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        breaks = np.flatnonzero(data == 32)
        self.starts = np.concatenate([[0], breaks + 1])
        self.ends = np.append(breaks, len(data))

    def grams(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words."""
        starts, ends = self.starts[: len(self.starts) - size + 1], self.ends[size - 1 :]
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            h = (h ^ (h >> np.uint64(32)) ^ np.uint64(size)) * np.uint64(_MIX)
        return h ^ (h >> np.uint64(29))


def winnowed(hashed: Hashed, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` words the place and the hash of the gram that it keeps."""
    grams = hashed.grams(min(gram, size))
    view = np.lib.stride_tricks.sliding_window_view(grams, size - min(gram, size) + 1)
    places = np.arange(len(view)) + view.argmin(axis=1)
    return places, grams[places]


def _seen(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << BITS) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """item, size, hash and words of all windows of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for item, text in zip(part.column(0).to_pylist(), raw_texts(part.column(1)), strict=True):
                    own = words(text)
                    if not own:
                        continue
                    size = min(window, len(own))
                    _, hashes = winnowed(Hashed(own), size, gram)
                    for at, h in enumerate(hashes.view(np.int64).tolist()):
                        out.append((item, size, h, b" ".join(own[at : at + size]).decode()))
                yield _batch(out, _ITEM)

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "item string, size int, hash bigint, words string")


_ITEM = {"item": pa.string(), "size": pa.int32(), "hash": pa.int64(), "words": pa.string()}
_FOUND = {
    "row": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "size": pa.int32(), "hash": pa.int64(),
    "start": pa.int64(), "words": pa.list_(pa.string()),
}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
    )


def _fingerprints(documents: DataFrame, bitmap: bytes, sizes: list[int], gram: int) -> DataFrame:
    """A row per document (size is null), and one per fingerprint that the bitmap holds.

    A fingerprint brings the words of the windows that kept it: the first starts at ``start``, the last ends with the words.
    """
    held = documents.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), raw_texts(part.column(1)), strict=True):
                    own = words(text)
                    out.append((row, doc_id, len(own), None, None, None, None))
                    hashed = Hashed(own) if own and sizes else None
                    for size in sizes:
                        if len(own) < size:
                            continue
                        places, hashes = winnowed(hashed, size, gram)
                        starts = np.flatnonzero(_seen(bits, hashes))
                        if not len(starts):
                            continue
                        # Windows that keep one gram follow each other.
                        new = np.flatnonzero(np.diff(places[starts], prepend=-1))
                        lasts = np.append(new[1:], len(starts)) - 1
                        for a, b in zip(starts[new].tolist(), starts[lasts].tolist(), strict=True):
                            held_words = [w.decode() for w in own[a : b + size]]
                            out.append((row, None, None, size, int(hashes[a].view(np.int64)), a, held_words))
                    row += 1
                yield _batch(out, _FOUND)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row bigint, doc_id bigint, n_words bigint, size int, hash bigint, start bigint, words array<string>"
    )


def _bitmap(windows: DataFrame) -> bytes:
    """The bits of all fingerprints: 4,096 bytes for each of ``1 << BITS - 15`` groups at most."""
    place = F.col("hash").bitwiseAND(F.lit((1 << BITS) - 1))
    parts = (
        windows.select(F.shiftright(place, 15).cast("int").alias("group"), place.bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("group")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = bytearray(1 << BITS - 3)
    for part in parts.collect():
        out[part.group << 12 : part.group + 1 << 12] = part.bits
    return bytes(out)


def find(documents: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end in words, apart from each other) and items of every document."""
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    listed = stored(_item_windows(benchmark, window, gram), "benchmark-windows")
    bitmap = _bitmap(listed)
    sizes = sorted(r.size for r in listed.select("size").distinct().collect())  # at most ``window`` of them
    distinct = listed.select("size", "hash", "words").distinct()
    known = stored(distinct.withColumn("window", F.monotonically_increasing_id()), "benchmark-distinct")
    of_item = listed.where("item IS NOT NULL").join(known, ["size", "hash", "words"]).select("window", "item").distinct()

    found = stored(_fingerprints(documents, bitmap, sizes, gram), "fingerprints")
    met = (
        found.where("size IS NOT NULL")
        .select(
            "row", "size", "hash", "start", "words",
            F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"),
        )
        .select(
            "row", "size", "hash", (F.col("start") + F.col("at")).alias("start"),
            F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("words"),
            F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).alias("salt"),
        )
    )
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = stored(
        met.join(salted, ["size", "hash", "words", "salt"]).select(
            "row", "window", "start", (F.col("start") + F.col("size")).alias("end")
        ),
        "benchmark-hits",
    )

    along = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        hits.select("row", "start", "end")
        .withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy("row", "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row")
        .agg(
            F.sum(F.col("end") - F.col("start")).alias("n_hit"),
            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        )
    )
    items = (
        hits.select("row", "window").distinct().join(of_item, "window").groupBy("row").agg(F.collect_set("item").alias("items"))
    )
    return (
        found.where("size IS NULL")
        .select("row", "doc_id", "n_words")
        .join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")).alias("spans"),
            F.array_sort(F.coalesce("items", F.expr("CAST(array() AS array<string>)"))).alias("items"),
        )
    )


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words and items of every document, the items as a digest."""
    return find(documents, benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB SQL for ``report``: every window of every document against every window of the benchmark.
ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), i AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), iw AS (
    SELECT DISTINCT item, least(len(w), 10) AS size,
           array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT size FROM iw
), dw AS (
    SELECT r, size, s, array_to_string(w[s : s + size - 1], ' ') AS words
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hit AS (
    SELECT dw.r, dw.s, dw.size, iw.item FROM dw JOIN iw ON dw.size = iw.size AND dw.words = iw.words
), covered AS (
    SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT r, s, size FROM hit))
    GROUP BY r
), named AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.r = d.r LEFT JOIN named ON named.r = d.r
"""
