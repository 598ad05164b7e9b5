"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a score are the words of the whole text (hashed), statistics of its structure and the stored length n_chars;
labels, language, source and doc_id never are.  The pairwise term is computed in linear time as
half of (sum of v x)^2 - sum of (v x)^2 per factor.  Training takes a bounded sample of the labelled rows (``sample``
rows, chosen by a hash of doc_id): their features are made in many tasks and meet in one, so that the driver gets the model only,
which has a fixed size.  Scoring reads every document.

Defined results: null and empty texts are scored from their statistics alone; a null n_chars counts as missing, a feature
of its own; labels that disagree for one doc_id are averaged and rounded; null labels are ignored; with labels of one
class, or none, every score is the share of label 1 (0.5 without labels); repeated rows repeat; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.rows import begin, edit_slices, end, map_slices, raw_texts

#: Statistics of structure and metadata, in the order of ``_statistics``.
STATISTICS = (
    "chars words word_length word_spread longest_word upper digits symbols commas stops exclaims other_bytes distinct "
    "short_words capital_words lines line_length repeated_lines repeated_pairs bars length_gap length_missing"
).split()


@dataclass
class Model:
    """Weights of the factorisation machine; ``mean`` and ``scale`` standardise the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _statistics(text: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    n, w = max(len(text), 1), max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    present = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = max(int(present[65:91].sum() + present[97:123].sum()), 1)
    chars = len(text) - int(present[128:192].sum())
    return [
        np.log1p(chars),
        np.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        np.log1p(sizes.max()),
        present[65:91].sum() / letters,
        present[48:58].sum() / n,
        (present[[35, 42, 36, 37, 38, 60, 62, 64, 94, 126, 95, 61, 43]].sum()) / n,
        present[44] / w,
        present[46] / w,
        present[33] / w,
        present[128:].sum() / n,
        len(counts) / w,
        float((sizes <= 3).mean()),
        sum(x[:1].isupper() for x in words) / w,
        np.log1p(len(lines)),
        np.log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - pairs / max(len(words) - 1, 1),
        present[124] / w,
        0.0 if n_chars is None else min(abs(np.log1p(max(n_chars, 0)) - np.log1p(chars)), 5.0),
        float(n_chars is None),
    ]


def _features(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and values of all rows in turn, rows' ends, statistics: columns doc_id, text, n_chars, ..."""
    index, value, ends, stats = [], [], [], []
    done = 0
    for text, n_chars in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
        words = text.split()
        counts = Counter(words)
        stats.append(_statistics(text, words, counts, n_chars))
        folded = Counter()
        for word, count in counts.items():
            folded[zlib.crc32(word.lower()) % buckets] += count
        weights = np.log1p(np.fromiter(folded.values(), np.float64, len(folded)))
        index.append(np.fromiter(folded, np.int64, len(folded)))
        value.append(weights / max(np.sqrt((weights**2).sum()), 1e-9))
        done += len(folded)
        ends.append(done)
    none = np.zeros(0)
    return (
        np.concatenate(index or [none]).astype(np.int64),
        np.concatenate(value or [none]),
        np.array(ends, np.int64),
        np.array(stats, np.float64).reshape(-1, len(STATISTICS)),
    )


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows' stretches of ``values``, which may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _raw_scores(model: Model, index, value, ends, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds; standardised statistics; factor sums of each row."""
    z = np.clip((stats - model.mean) / model.scale, -4, 4) / np.sqrt(len(STATISTICS))
    words = len(model.linear) - len(STATISTICS)
    v, v_stats = model.factors[:words], model.factors[words:]
    weighted = v[index] * value[:, None]
    sums = _row_sums(weighted, ends) + z @ v_stats
    squares = _row_sums(weighted**2, ends) + z**2 @ v_stats**2
    flat = _row_sums(model.linear[index] * value, ends) + z @ model.linear[words:]
    return model.bias + flat + 0.5 * (sums**2 - squares).sum(axis=1), z, sums


def fit(rows: list, buckets: int, rank: int = 8, epochs: int = 12, rate: float = 0.02, seed: int = 7) -> Model:
    """Model of feature rows (index, value, stats as bytes; label), by mini-batches of adaptive gradient steps."""
    size = buckets + len(STATISTICS)
    random = np.random.default_rng(seed)
    labels = np.array([r["label"] for r in rows], np.float64)
    share = labels.mean() if len(labels) else 0.5
    stats = np.array([np.frombuffer(r["stats"]) for r in rows]).reshape(-1, len(STATISTICS))
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if len(rows) else (np.zeros(len(STATISTICS)),) * 2
    model = Model(0.0, np.zeros(size), random.normal(0, 0.02, (size, rank)), mean, np.maximum(scale, 1e-6))
    if share in (0.0, 1.0) or not len(rows):
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.bias, model.factors = float(np.log(share / (1 - share))), np.zeros((size, rank))
        return model
    model.bias = float(np.log(share / (1 - share)))
    held_linear, held_factors, held_bias = np.full(size, 1e-8), np.full((size, rank), 1e-8), 1e-8
    arrays = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows]
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            index = np.concatenate([arrays[i][0] for i in pick])
            value = np.concatenate([arrays[i][1] for i in pick])
            counts = np.array([len(arrays[i][0]) for i in pick])
            raw, z, sums = _raw_scores(model, index, value, np.cumsum(counts), stats[pick])
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            each = np.repeat(error, counts)
            used, place = np.unique(index, return_inverse=True)
            at_all = np.concatenate([used, np.arange(buckets, size)])
            linear = np.concatenate([np.bincount(place, each * value, len(used)), z.T @ error])
            linear += 1e-6 * model.linear[at_all]
            factors = np.empty((len(at_all), rank))
            by_row = np.repeat(sums, counts, axis=0)
            for f in range(rank):
                v = model.factors[:, f]
                words = each * value * (by_row[:, f] - v[index] * value)
                factors[: len(used), f] = np.bincount(place, words, len(used))
                factors[len(used) :, f] = z.T @ (error * sums[:, f]) - v[buckets:] * ((z**2).T @ error)
            factors += 1e-5 * model.factors[at_all]
            held_linear[at_all] += linear**2
            held_factors[at_all] += factors**2
            held_bias += error.sum() ** 2
            model.linear[at_all] -= 5 * rate * linear / np.sqrt(held_linear[at_all])
            model.factors[at_all] -= rate * factors / np.sqrt(held_factors[at_all])
            model.bias -= 5 * rate * error.sum() / np.sqrt(held_bias)
    return model


def train(labelled: DataFrame, buckets: int = 1 << 16, rank: int = 8) -> Model:
    """Model of labelled documents (doc_id, text, n_chars, label), all of which are used: pass a bounded sample.

    It is fitted in one task, to which the rows come in the order of their places.
    """
    # Arrays travel as bytes: as lists of Python numbers they would take many times the memory.
    schema = "index binary, value binary, stats binary, label double"

    def rows(batch: pa.RecordBatch) -> dict:
        index, value, ends, stats = _features(batch, buckets)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        spans = list(zip(starts, ends, strict=True))
        return {
            "index": [index[a:b].astype(np.int32).tobytes() for a, b in spans],
            "value": [value[a:b].astype(np.float32).tobytes() for a, b in spans],
            "stats": [row.tobytes() for row in stats],
            "label": batch.column(3),
        }

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(learn)
        found = list(batches)
        if found:
            rows = pa.Table.from_batches(found).sort_by("place").drop_columns("place").to_pylist()
            model = fit(rows, buckets, rank)
            arrays = {n: [getattr(model, n).tobytes()] for n in ("linear", "factors", "mean", "scale")}
            yield pa.RecordBatch.from_pydict({"bias": [float(model.bias)], **arrays})
        end()

    columns = labelled.select("doc_id", "text", "n_chars", F.col("label").cast("double"))
    features = map_slices(columns, schema, rows).withColumn("place", F.monotonically_increasing_id())
    made = "bias double, linear binary, factors binary, mean binary, scale binary"
    found = features.repartition(1).mapInArrow(learn, made).collect()
    if not found:
        return fit([], buckets, rank)
    linear, factors, mean, scale = (np.frombuffer(found[0][n]) for n in ("linear", "factors", "mean", "scale"))
    return Model(found[0].bias, linear, factors.reshape(-1, rank), mean, scale)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int) -> DataFrame:
    """doc_id, text, n_chars, label of at most ``sample`` usable labelled documents, chosen by a hash of doc_id.

    ``usable`` is a condition on doc_id.  The chosen ids are at most ``sample`` rows, hence broadcast.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.round(F.avg(label)).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    return documents.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fold(key: Column) -> Column:
    """Fold 0, 1 or 2 of a key, by the CRC32 of its text."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def _scores(model: Model, batch: pa.RecordBatch, buckets: int) -> np.ndarray:
    raw, _, _ = _raw_scores(model, *_features(batch, buckets))
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each document."""
    buckets = len(model.linear) - len(STATISTICS)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: (buckets + statistics) x (rank + 1)

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": _scores(shared.value, batch, buckets)}

    columns = (F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("long"))
    return map_slices(documents.select(*columns), "doc_id bigint, score double", rows)


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; rows of fold 1 are never learnt from."""
    model = train(labelled_sample(documents, labels, label, fold(F.col("doc_id")) != 1, sample))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(
    documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 12_000, least: float = 0.5
) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns; no row is shuffled."""
    model = train(labelled_sample(documents, labels, label, fold(F.col("doc_id")) != 1, sample))
    buckets = len(model.linear) - len(STATISTICS)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.select(["doc_id", "text", "n_chars"])
        return batch.filter(pa.array(_scores(shared.value, columns, buckets) >= least))

    return edit_slices(documents, edit)
