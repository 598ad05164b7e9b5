"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order.  Vectors that share pivots are near: an inverted
list is kept per label and pair of pivots among the nearest ``near``, so meeting in a list means at least two shared
pivots.  Lists are read in bounded cells: a long list is dealt into blocks, and each pair of blocks is one cell.  In a cell
cosines are computed at once in double precision.  A pair is counted in its first common list only, and a cell returns
counts per vector and one link per vector and group found, so the output is linear in the vectors however large a group is.

Equal vectors of one label collapse to one class first; each member is linked to all others.  Pivots are a bounded sample
(``SAMPLED`` rows per pivot by a hash of vec_id, thinned to distant ones); every vector is indexed.

Defined results: rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link
with nothing and stay alone; vectors of different lengths never link; rows with a null vec_id link with nothing and have
a null component; repeated rows are equal vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.components import components
from reelspark.llm.rows import map_slices, stored

#: Bound of the number of pivots, and vectors sampled for each.
MOST_PIVOTS, SAMPLED = 2048, 16
#: Vectors in a block; a cell holds two blocks at most.
BLOCK = 512


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit vectors, each the one farthest from those before it."""
    unit = unit_vectors(np.asarray(vectors, float))
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def usable(column: str = "embedding"):
    """Whether a vector may link at all."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def _postings(classes: DataFrame, pivots: dict[int, np.ndarray], near: int) -> DataFrame:
    """label, list, dim and node of each inverted list that a class is in, with its pivots in ascending order."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most ``pivots`` vectors of each length

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("label", "node", "list", "pivots", "copies", "embedding")}
        for label, node, copies, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            points = shared.value[len(vector)]
            order = np.argsort(-(points @ unit_vectors(np.array([vector], float))[0]), kind="stable")[:near]
            own = sorted(map(int, order))
            for p, q in combinations(own, 2) if len(own) > 1 else [(own[0], own[0])]:
                for name, value in zip(out, (label, node, p << 32 | q, own, copies, vector), strict=True):
                    out[name].append(value)
        return out

    kind = classes.schema["embedding"].dataType.simpleString()
    schema = f"label string, node bigint, list bigint, pivots array<int>, copies bigint, embedding {kind}"
    return map_slices(classes.select("label", "node", "copies", "embedding"), schema, rows)


def _groups(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric link matrix."""
    found = np.arange(len(linked))
    while True:
        least = np.minimum(found, np.where(linked, found[None, :], len(linked)).min(axis=1, initial=len(linked)))
        least = least[least]
        if (least == found).all():
            return found
        found = least


def _cell(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """node, links and head of the classes of one cell: copies linked here for the first time, and a link to a group."""
    x = unit_vectors(np.stack(rows["embedding"].to_numpy()).astype(float))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    low, high = int(rows["list"].iloc[0]) >> 32, int(rows["list"].iloc[0]) & 0xFFFFFFFF
    below = np.zeros((len(rows), high), np.float32)
    for i, own in enumerate(rows["pivots"]):
        below[i, [p for p in own if p < high]] = 1
    # The first common list of two classes is named by their two smallest common pivots.
    first = (below @ below.T == (1 if low < high else 0)) & linked
    block = rows["block"].to_numpy()
    if block.min() != block.max():  # pairs within one block are counted in the block's own cell
        first &= block[:, None] != block[None, :]
    nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    links = first.astype(np.float64) @ copies
    heads = nodes[_groups(linked)]
    some = (links > 0) | (heads != nodes)
    return pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "head": heads[some]})


def _cells(postings: DataFrame, block: int) -> DataFrame:
    """Postings dealt into cells: the list's pairs of blocks, which are as many as its measured length needs."""
    keys = ["label", "dim", "list"]
    postings = postings.withColumn("dim", F.size("embedding"))
    lengths = postings.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    return (
        postings.join(lengths, keys)
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"row": F.least("block", "other"), "column": F.greatest("block", "other")})
        .drop("blocks", "other", "n")
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    pivots: int | None = None,
    near: int = 6,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label).

    ``pivots`` is by default half the square root of the number of classes, between 32 and ``MOST_PIVOTS``, so that lists
    stay short as the table grows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("string"),
        "embedding",
    ).withColumn("usable", F.coalesce(usable() & F.col("label").isNotNull(), F.lit(False)))
    classes = (
        rows.where("usable AND vec_id IS NOT NULL")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    )
    classes = stored(classes, "pivot-classes")
    count = pivots or int(min(max(classes.count() ** 0.5 / 2, 32), MOST_PIVOTS))
    points = {}
    for dim, *_ in classes.select(F.size("embedding")).distinct().collect():  # the lengths of vectors, usually one
        picked = classes.where(F.size("embedding") == dim).orderBy(F.xxhash64("node")).limit(SAMPLED * count).toPandas()
        points[dim] = choose_pivots(np.stack(picked["embedding"].to_numpy()), count)
    cells = _cells(_postings(classes, points, near), block)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _cell(part, threshold)

    found = stored(
        cells.groupBy("label", "dim", "list", "row", "column").applyInPandas(
            run, "node bigint, links bigint, head bigint"
        ),
        "pivot-cells",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    group = components(found.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
    placed = (
        classes.join(links, "node", "left")
        .join(group, "node", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    return (
        rows.withColumn("label", F.when(F.col("usable") & F.col("vec_id").isNotNull(), F.col("label")))
        .join(placed, ["label", "embedding"], "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
        )
    )


def brute_force_links(ids: Iterator[int], vectors: np.ndarray, labels: np.ndarray, threshold: float) -> set:
    """All linked pairs of a small table, to measure the recall of the index against."""
    ids = np.array(list(ids))
    unit = unit_vectors(vectors)
    held = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    return {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.triu(held, 1)), strict=True)}
