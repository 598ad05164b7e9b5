"""Suffix-array dedup: removal of every byte covered by a string of ``length`` bytes that also starts earlier.

A suffix array of the whole corpus would pass through one task.  It is cut into independent shards without losing a match:

1. Each string of ``length`` bytes chooses an anchor, the byte string of ``gram`` bytes in it with the smallest hash
   (winnowing: Schleimer et al., 2003).  Equal strings choose equal anchors, so all places of a string fall on one anchor.
   Neighbouring starts with one anchor form a record: the bytes they cover.
2. Equal records are classes; all places but a class's earliest repeat it.  Map tasks reduce their own records to
   classes first, so a passage that a third of the corpus shares leaves each batch once.
3. Records that are alone on their anchor have no repeats.  The others, one per class, are gathered in shards of bounded
   size by anchor.  In a shard, induced sorting orders all suffixes of the records, and the permuted common prefixes of
   neighbours tell which starts share ``length`` bytes; of those the earliest stays.  The records of an anchor that very
   many different ones share (the edges of a common passage) are cut again with anchors nearly as long as the strings,
   so that they spread over many shards; this loses nothing either.

Earlier means a smaller doc_id, or the same document and an earlier start.  Strings are judged on the input.

Defined results: a null text counts as empty; rows with a null doc_id come last in the order; of rows that share a doc_id,
the one whose text has the smaller hash is earlier, and equal rows are one document and have equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.induced import permuted_prefixes, suffix_array
from reelspark.llm.rows import raw_texts, slices, stored

#: Bytes of text whose hashes a task computes at once.
CHUNK = 1 << 20
#: Bytes of records in a shard, on average.
SHARD_BYTES = 1 << 21
#: Different records on one anchor beyond which they are cut again.
HOT_RECORDS = 10_000
#: Bytes by which the anchors of that second cut are shorter than the strings.
FINE = 7
#: Stands for a null doc_id: the last place in the order.
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone modulo 2**64

RECORDS = pa.schema(
    [(n, pa.int64()) for n in ("doc", "tie", "start")] + [("count", pa.int32()), ("anchor", pa.int64()), ("rec", pa.int64()), ("kind", pa.int32())]
)
COVERED, FIRST = 0, 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, np.uint64)
    undo = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = undo[0] = 1
    return np.cumprod(base), np.cumprod(undo)


def gram_hashes(data: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` bytes that begin at each place."""
    n = len(data) - gram + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers[1][:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    least, span = values, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - span :]) if span < width else least


def chunk_records(data: bytes, ends: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """Start, count, anchor and content hash of the records of texts that are joined in ``data`` and end at ``ends``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram, powers)
    places = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | places  # ties: the leftmost
    chosen = (window_minima(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    edges = np.zeros(len(data) + 1, np.int64)
    long = ends - begins >= length
    np.add.at(edges, begins[long], 1)
    np.add.at(edges, ends[long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edges[: len(chosen)]) > 0)
    if not len(starts):
        return none, none, none, none
    at = chosen[starts]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    counts = np.diff(np.append(first, len(starts)))
    starts, at = starts[first], at[first]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    spans = zip(starts.tolist(), (starts + counts + length - 1).tolist(), (at - starts).tolist(), strict=True)
    content = np.fromiter((digest(view[a:b], o) for a, b, o in spans), np.uint64, len(starts)).view(np.int64)
    return starts, counts, hashes[at].view(np.int64), content


def _batch_records(batch: pa.RecordBatch, length: int, gram: int) -> pa.RecordBatch:
    """Records of a batch of documents, those that repeat within the batch marked as covered."""
    powers = _powers(CHUNK + length)
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]

    def flush(parts: list[bytes], owners: list[tuple[int, int, int]]) -> None:
        if not parts:
            return
        ends = np.cumsum([len(p) for p in parts])
        start, count, anchor, content = chunk_records(b"".join(parts), ends, length, gram, powers)
        owner = np.searchsorted(ends, start, side="right")
        doc, tie, base = np.array(owners, np.int64).T
        begins = np.concatenate([[0], ends[:-1]])
        for column, values in zip(
            columns,
            (doc[owner], tie[owner], start - begins[owner] + base[owner], count, anchor, content),
            strict=True,
        ):
            column.append(values)

    parts: list[bytes] = []
    owners: list[tuple[int, int, int]] = []
    size = 0
    for doc, tie, text in zip(*(c.to_pylist() for c in batch.columns[:2]), raw_texts(batch.column(2)), strict=True):
        step = CHUNK - length
        for at in range(0, max(len(text) - length + 1, 0), step):  # long texts: starts of ``step`` bytes at a time
            part = text[at : at + step + length - 1]
            if size + len(part) > CHUNK:
                flush(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append((doc, tie, at))
            size += len(part)
    flush(parts, owners)
    doc, tie, start, count, anchor, content = (
        np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns
    )
    order = np.lexsort((start, tie, doc, content, anchor))
    doc, tie, start, count, anchor, content = (c[order] for c in (doc, tie, start, count, anchor, content))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    itself = (doc == doc[head]) & (tie == tie[head]) & (start == start[head])
    keep = new | ~itself  # an equal row of one document is no repeat of itself
    # What is covered already needs no partner any more: it is dealt out evenly instead of by anchor.
    spread = np.where(new, anchor, content ^ (start * 0x5851F42D4C957F2D) ^ doc)
    arrays = (doc, tie, start, count.astype(np.int32), spread, content, new.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a[keep], f.type) for a, f in zip(arrays, RECORDS, strict=True)], schema=RECORDS)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order kind, anchor, rec, doc, tie, start: repeats become COVERED, firsts that share an anchor stay."""
    last: np.ndarray | None = None  # the last first: its row, not yet given out, and whether it shares its anchor
    shares = False
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        done = rows[6] == COVERED
        out = [rows[:, done]]
        rows = rows[:, ~done]
        if rows.shape[1]:
            fresh = last is None
            rows = rows if fresh else np.concatenate([last[:, None], rows], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[4, 1:] != rows[4, :-1]) | (rows[5, 1:] != rows[5, :-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            repeats = rows[:, ~new & ~(rows[:3] == rows[:3, head]).all(axis=0)]
            repeats[6] = COVERED
            out.append(repeats)
            firsts = rows[:, new]
            same = firsts[4, 1:] == firsts[4, :-1]
            with_left = np.concatenate([[shares and not fresh], same])
            with_right = np.append(same, False)
            out.append(firsts[:, :-1][:, (with_left | with_right)[:-1]])
            last, shares = firsts[:, -1], bool(with_left[-1])
        yield _as_batch(np.concatenate(out, axis=1))
    if last is not None and shares:
        yield _as_batch(last[:, None])


def _as_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(r, pa.int64()).cast(f.type) for r, f in zip(rows, RECORDS, strict=True)], schema=RECORDS
    )


#: Columns of the rows that shards sort; rows without bytes are known to be repeats already.
BODIES = {n: pa.int64() for n in ("shard", "anchor", "doc", "tie", "start", "count")} | {"bytes": pa.binary()}


def _finer(parts: list[bytes], owners: list[tuple[int, int, int]], length: int) -> Iterator[tuple]:
    """anchor, doc, tie, start, count, bytes of records with long anchors; equal ones but the earliest without bytes."""
    powers = _powers(CHUNK + length)
    earliest: dict[tuple[int, int], tuple] = {}
    rows = []
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and size + len(parts[end]) <= CHUNK:
            size += len(parts[end])
            end += 1
        data, ends = b"".join(parts[at:end]), np.cumsum([len(p) for p in parts[at:end]])
        start, count, anchor, content = chunk_records(data, ends, length, length - FINE, powers)
        owner = np.searchsorted(ends, start, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        for s, k, a, c, o in zip(*(x.tolist() for x in (start, count, anchor, content, owner)), strict=True):
            doc, tie, base = owners[at + o]
            place = (doc, tie, s - int(begins[o]) + base)
            rows.append((a, c, *place, k, data[s : s + k - 1 + length]))
            if (a, c) not in earliest or place < earliest[a, c]:
                earliest[a, c] = place
        at = end
    for a, c, doc, tie, start, count, body in rows:
        first = earliest[a, c] == (doc, tie, start)
        yield (a if first else start, doc, tie, start, count, body if first else None)


def shard_repeats(records: pd.DataFrame, length: int) -> pd.DataFrame:
    """doc, tie, start, count of the starts in the records of one shard whose string also starts earlier in the shard."""
    spans = ["doc", "tie", "start", "count"]
    known = records.loc[records["bytes"].isna(), spans]
    records = records[records["bytes"].notna() & records.duplicated("anchor", keep=False)]
    if records.empty:
        return known
    parts = records["bytes"].tolist()
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\0".join([*parts, b"\0" * (length + 8)]), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n = int(begins[-1] + sizes[-1] + 1)
    text = joined[:n].astype(np.int64) + 2
    text[begins + sizes] = 1  # between records
    text = np.append(text, 0)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(n) - begins[owner]
    valid = offset < records["count"].to_numpy()[owner]  # places where a string begins that the record stands for
    order = suffix_array(text, length)[1:]
    order = order[valid[order]]
    shared = permuted_prefixes(joined, order, length)[order] >= length
    shared[:1] = False
    group = np.cumsum(~shared)
    # Strings that occur once are done.
    often = np.bincount(group)[group] > 1
    places, group = order[often], group[often]
    doc, tie, start = (records[c].to_numpy()[owner[places]] for c in ("doc", "tie", "start"))
    start = start + offset[places]
    ranked = np.lexsort((start, tie, doc, group))
    doc, tie, start, group, places = (a[ranked] for a in (doc, tie, start, group, places))
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    later = ~((doc == doc[head]) & (tie == tie[head]) & (start == start[head]))
    found = np.sort(places[later])
    run = np.ones(len(found), bool)
    run[1:] = (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]])
    first = np.flatnonzero(run)
    repeats = pd.DataFrame(
        {
            "doc": records["doc"].to_numpy()[owner[found[first]]],
            "tie": records["tie"].to_numpy()[owner[found[first]]],
            "start": records["start"].to_numpy()[owner[found[first]]] + offset[found[first]],
            "count": np.diff(np.append(first, len(found))),
        }
    )
    return pd.concat([known, repeats], ignore_index=True)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, doc, tie, text; ``tie`` tells rows of one doc_id apart and is zero where doc_ids do not repeat."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    repeated = documents.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count()
    tie = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return documents.select(F.col("doc_id").cast("long"), doc.alias("doc"), tie.alias("tie"), "text")


def _packed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its texts compressed one by one, for the joins that move all of them: less than half of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            for part in slices(batch):
                packed = [press(t) if t else b"" for t in raw_texts(part.column(3))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(packed, pa.binary())], names=["doc_id", "doc", "tie", "packed"]
                )

    return keyed.select("doc_id", "doc", "tie", "text").mapInArrow(run, "doc_id bigint, doc bigint, tie bigint, packed binary")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    """The texts of a compressed column, one at a time."""
    press = zstandard.ZstdDecompressor().decompress
    for value in column:
        yield press(value.as_py()) if len(value.as_buffer()) else b""


def repeated_spans(keyed: DataFrame, length: int = 100, gram: int = 32, hot: int = HOT_RECORDS) -> DataFrame:
    """doc, tie, start, count: every start, in runs, whose string of ``length`` bytes also starts earlier."""
    schema = "doc bigint, tie bigint, start bigint, count int, anchor bigint, rec bigint, kind int"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                yield _batch_records(batch.slice(at, 5000), length, gram)

    found = stored(
        keyed.select("doc", "tie", "text")
        .mapInArrow(records, schema)
        .repartition("anchor")
        .sortWithinPartitions("kind", "anchor", "rec", "doc", "tie", "start")
        .mapInArrow(_classes, schema),
        "suffix-records",
    )
    firsts = found.where(F.col("kind") == FIRST)
    size = firsts.agg(F.sum(F.col("count") + length)).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    many = firsts.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    wanted = (
        firsts.join(many, "anchor", "left")
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("start", "count", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in BODIES]
            hot_parts, hot_owners = [], []
            columns = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for doc, tie, spans, text in zip(*columns, _unpacked(batch.column(2)), strict=True):
                for span in spans:
                    at, count = span["start"], span["count"]
                    body = text[at : at + count - 1 + length]
                    if span["hot"]:
                        hot_parts.append(body)
                        hot_owners.append((doc, tie, at))
                    else:
                        anchor = span["anchor"]
                        for column, value in zip(out, (anchor % shards, anchor, doc, tie, at, count, body), strict=True):
                            column.append(value)
            for row in _finer(hot_parts, hot_owners, length):
                for column, value in zip(out, (row[0] % shards, *row), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, BODIES.values(), strict=True)], names=list(BODIES))

    bodies = (
        _packed(keyed).join(wanted, ["doc", "tie"])
        .select("doc", "tie", "packed", "spans")
        .mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'bytes' else 'bigint'}" for n in BODIES))
    )

    def run(records: pd.DataFrame) -> pd.DataFrame:
        return shard_repeats(records, length)

    sorted_out = bodies.groupBy("shard").applyInPandas(run, "doc bigint, tie bigint, start bigint, count bigint")
    covered = found.where(F.col("kind") == COVERED).select("doc", "tie", "start", F.col("count").cast("long"))
    return covered.unionByName(sorted_out)


def without_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of each document, its repeated bytes removed."""
    keyed = _keyed(documents)
    spans = (
        repeated_spans(keyed, length)
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    )
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, found, text in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), _unpacked(batch.column(1)), strict=True
            ):
                kept, removed, runs = without_spans(text, found or [], length)
                for column, value in zip(
                    out, (doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest()), strict=True
                ):
                    column.append(value)
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return (
        _packed(keyed).join(spans, ["doc", "tie"], "left").select("doc_id", "packed", "spans").mapInArrow(rows, schema)
    )


def without_spans(text: bytes, found: list, length: int) -> tuple[bytes, int, int]:
    """The text without the bytes that strings at the found starts cover; bytes and runs removed."""
    if not found:
        return text, 0, 0
    edges = np.zeros(len(text) + 1, np.int64)
    for span in found:
        edges[span["start"]] += 1
        edges[span["start"] + span["count"] - 1 + length] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs
