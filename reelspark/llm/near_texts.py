"""Near copies of whole texts: SimHash by Golay-code keys, MinHash bands for the rest, Jaccard similarity decides.

A text is the set of its shingles of ``width`` words (A-Z lower-cased; a shorter text is one shingle of all its words).
Two texts are near copies if their sets have a Jaccard similarity of at least ``least``.

* First candidates: the SimHash of a set (64 bits, each set if it is in over half of the set's hashes).  Fingerprints at
  ``BITS`` or fewer differing bits meet through the Golay-code keys of ``simhash.near_links``.
* A similarity of 0.8 allows many more differing bits (10 on average), so texts that are still apart go on to ``BANDS`` MinHash keys,
  each of ``ROWS`` minima of the set under as many hash functions.  Two sets of similarity s share a key with probability
  1 - (1 - s ** ROWS) ** BANDS: 0.99994 at 0.8, more above.
* Decision: the sets of a candidate pair are compared as a whole, shingle by shingle (64-bit hashes).  Nothing is
  removed for a shared key or a fingerprint.
* Equal sets collapse to one node first, and their sizes must allow the similarity before texts move.  A text that is still apart
  from it is compared to the smallest one that any of its buckets holds (of texts that share a passage, the one with the least
  beside it); then to the smallest and the largest of each of its buckets.  What is still apart then is decided by prefixes
  (``_prefix_pairs``), not by all pairs of a bucket.

Defined results: null and empty texts have one empty shingle, so they are copies of each other; rows without doc_id are
compared like any other; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.components import components
from reelspark.llm.rows import map_slices, raw_texts, stored
from reelspark.llm.simhash import majority_bits, near_links

#: Bits in which fingerprints that make a candidate pair may differ (what the Golay-code keys find).
BITS = 3

#: Minima that make a key, and keys of a text.
ROWS, BANDS = 6, 32

#: Stands for a null doc_id: the last place in the order.
LAST = (1 << 63) - 1

#: Shingles of a prefix that its rows carry.
KNOWN = 256

#: Shingles whose hashes are taken at once.
_HASHED = 1 << 11


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words))], np.uint64)
    return np.unique(
        np.array([digest(b" ".join(s)) for s in zip(*(words[i:] for i in range(width)), strict=False)], np.uint64)
    )


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """What is mixed in and the odd factor of each hash function (fixed values)."""
    r = np.random.default_rng(42)
    mixed, factor = r.integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64)
    return mixed, factor | np.uint64(1)


def band_keys(values: np.ndarray) -> list[int]:
    """The signed 64-bit keys of a set of shingles, one for each band."""
    mixed, factor = _functions()
    least = np.full(ROWS * BANDS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), _HASHED):
        np.minimum(least, ((values[at : at + _HASHED] ^ mixed) * factor).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _placed(documents: DataFrame) -> DataFrame:
    """The documents with doc (doc_id, null as the last place) and tie (hash of the text)."""
    return documents.withColumns(
        {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tie": F.xxhash64("text")}
    )


def _prints(documents: DataFrame, width: int) -> DataFrame:
    """doc, tie, node (hash of the set of shingles), size, fp (SimHash of the set) and keys of each document."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, width) for t in raw_texts(batch.column(2))]
        return {
            "doc": batch.column(0),
            "tie": batch.column(1),
            "node": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
            "size": [len(s) for s in sets],
            "fp": [majority_bits(s) for s in sets],
            "keys": [band_keys(s) for s in sets],
        }

    return map_slices(
        _placed(documents.select("doc_id", "text")).select("doc", "tie", "text"),
        "doc bigint, tie bigint, node bigint, size bigint, fp bigint, keys array<bigint>",
        rows,
    )


def _similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are near copies."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        last, known = None, None
        names = (batch.column(i).to_pylist() for i in range(2))
        for a, b, x, y in zip(*names, raw_texts(batch.column(2)), raw_texts(batch.column(3)), strict=True):
            if a != last:
                last, known = a, shingles(x, width)
            if similarity(known, shingles(y, width)) >= least:
                out["a"].append(a)
                out["b"].append(b)
        return out

    a, b = (texts.select(F.col("node").alias(s), F.col("text").alias(f"{s}_text")) for s in ("a", "b"))
    return map_slices(
        pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text"), "a bigint, b bigint", rows
    )


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (node, other) of nodes (node, fp) that join all whose fingerprints differ in at most ``BITS`` bits."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    equal = nodes.select("node", "fp").join(first.select("fp", F.col("node").alias("other")), "fp")
    return equal.where("node <> other").select("node", "other").union(
        near_links(first, BITS).select(F.col("b").alias("node"), F.col("a").alias("other"))
    )


def _links(nodes: DataFrame, documents: DataFrame, width: int, least_similarity: float) -> DataFrame:
    """Links (a, b) that join all nodes (node, size, fp, keys, at) that are near copies; not all pairs."""
    alike = stored(_fingerprint_pairs(nodes), "near-alike")
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    me = F.struct("size", "node")
    ends = (
        keyed.groupBy("band", "key")
        .agg(F.min(me).alias("h"), F.max(me).alias("t"))
        .where("h < t")
        .select("band", "key", F.col("h.node").alias("head"), F.col("h.size").alias("head_size"), F.col("t.node").alias("tail"))
    )
    shared = stored(keyed.join(ends, ["band", "key"]), "near-buckets")
    wanted = shared.select("node").union(alike.select("node")).union(alike.select("other")).distinct()
    met = nodes.join(wanted, "node").select("node", "at.*")
    texts = stored(
        _placed(documents)
        .select("doc", "tie", "text")
        .join(met, ["doc", "tie"])
        .select("node", "text")
        .dropDuplicates(["node"]),
        "near-texts",
    )
    sizes = nodes.select(F.col("node").alias("other"), F.col("size").alias("other_size"))

    def fits(size, other):
        return F.least(size, other) >= least_similarity * F.greatest(size, other) - 1e-9

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs (node, size, other) whose sizes allow the similarity, as a and b."""
        return (
            pairs.join(sizes, "other")
            .where(fits(F.col("size"), F.col("other_size")))
            .select(F.col("other").alias("a"), F.col("node").alias("b"))
        )

    def placed(group: DataFrame) -> DataFrame:
        return stored(
            shared.join(group, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"),
            "near-placed",
        )

    def apart_from(parts: DataFrame, end: str) -> DataFrame:
        """Pairs of a node and the ``end`` of one of its buckets that are still in different parts."""
        ends = parts.where(F.col("node") == F.col(end)).select("band", "key", F.col("part").alias("end_part"))
        return (
            parts.join(ends, ["band", "key"])
            .where("part <> end_part")
            .select("node", "size", F.col(end).alias("other"))
            .distinct()
        )

    def also(group: DataFrame, pairs: DataFrame) -> DataFrame:
        """The groups with those of the pairs that are near copies; what is joined already comes as stars, not link by link."""
        links.append(stored(_similar(pairs, texts, width, least_similarity), "near-links"))
        return components(stars(group).union(links[-1]))

    def stars(group: DataFrame) -> DataFrame:
        return group.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))

    first = sized(alike.join(nodes.select("node", "size"), "node"))
    links = [stored(_similar(first, texts, width, least_similarity), "near-links")]
    group = components(links[0])
    # The smallest set that a text meets in any of its buckets next: one pair for each text, also in a very large group.
    parts = placed(group)
    hubs = (
        parts.where("head <> node")
        .groupBy("node", "size", "part")
        .agg(F.min(F.struct("head_size", "head")).alias("hub"))
        .select("node", "size", "part", F.col("hub.head").alias("other"))
    )
    own = parts.where("node = head").select(F.col("node").alias("other"), F.col("part").alias("other_part")).distinct()
    far = hubs.join(own, "other").where("part <> other_part").select("node", "size", "other")
    group = also(group, sized(far))
    for end in ("head", "tail"):
        group = also(group, sized(apart_from(placed(group), end)))
    parts = placed(group)
    mixed = parts.groupBy("band", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    apart = parts.join(mixed.select("band", "key"), ["band", "key"], "left_semi").select("node", "part", "size").distinct()
    left = _prefix_pairs(stored(apart, "near-apart"), texts, width, least_similarity)
    return reduce(DataFrame.union, [*links, _similar(left, texts, width, least_similarity)])


def _prefix_pairs(apart: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different parts among which are all that are near copies.

    Two sets of similarity ``least`` share one of their first ``size - ceil(least * size) + 1`` shingles, if all are put in one
    order.  In the order of how many of the nodes hold them, rarest first, texts that were edited in many places begin with
    what is theirs alone and meet nobody.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        return {
            "node": batch.column(0),
            "part": batch.column(1),
            "size": batch.column(2),
            "shingles": [shingles(t, width).view(np.int64) for t in raw_texts(batch.column(3))],
        }

    held = stored(
        map_slices(
            apart.join(texts, "node").select("node", "part", "size", "text"),
            "node bigint, part bigint, size bigint, shingles array<bigint>",
            rows,
        ).select("node", "part", "size", F.explode("shingles").alias("shingle")),
        "near-shingles",
    )
    often = held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("node").orderBy("n", "shingle")
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    met = (
        held.join(often, "shingle", "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumns({"at": F.row_number().over(order), "met": F.count_if(F.col("n") > 1).over(Window.partitionBy("node"))})
        .where((F.col("at") <= first) & (F.col("n") > 1))
    )
    # A row knows the other shingles of its prefix, so that a pair is made for the least of those it shares; prefixes of
    # very long texts go without, and their pairs are made for each.
    of_node = Window.partitionBy("node")
    firsts = F.when(F.count("*").over(of_node) <= KNOWN, F.collect_list("shingle").over(of_node))
    prefixes = stored(met.select("shingle", "node", "part", "size", "met", firsts.alias("firsts")), "near-prefixes")
    x, y = (
        prefixes.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "part", "size", "met", "firsts")))
        for s in "xy"
    )
    once = F.coalesce(F.col("shingle") == F.array_min(F.array_intersect("x_firsts", "y_firsts")), F.lit(True))
    both = F.ceil((F.col("x_size") + F.col("y_size")) * (least / (1 + least)) - 1e-9)
    # What no other node holds cannot be shared: the sizes and the rest bound what two nodes have in common.
    return (
        x.join(y, "shingle")
        .where((F.col("x_part") < F.col("y_part")) & (F.least("x_met", "y_met") >= both) & once)
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
        .distinct()
    )


def first_of_each(documents: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, one for each group of near copies: that of the smallest doc_id (null is the last), then text hash.

    A group is what is connected by near copies.  A document is told by its doc_id and its text: of rows that share a
    doc_id only those go whose own text is a copy, and of rows that share both one stays.
    """
    prints = stored(_prints(documents, width), "near-prints")
    nodes = stored(
        prints.groupBy("node").agg(
            F.min(F.struct("doc", "tie")).alias("at"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")
        ),
        "near-nodes",
    )
    group = stored(components(_links(nodes, documents, width, least)), "near-groups")
    placed = prints.select("doc", "tie", "node").join(group, "node", "left").withColumn(
        "part", F.coalesce("component", "node")
    )
    me = F.struct("doc", "tie")
    firsts = placed.groupBy("part").agg(F.min(me).alias("first"))
    own = stored(
        placed.join(firsts, "part").groupBy("doc", "tie").agg(F.bool_or(me > F.col("first")).alias("later"), F.count("*").alias("n")),
        "near-decided",
    )
    taken = {c.lower() for c in documents.columns}
    doc, tie = (next(n for n in (f"{name}{'_' * k}" for k in count()) if n not in taken) for name in ("doc", "tie"))
    key = [doc, tie]
    named = documents.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), tie: F.xxhash64("text")})
    decided = own.select(F.col("doc").alias(doc), F.col("tie").alias(tie), "later", "n")
    kept = named.join(decided.where("later").select(*key), key, "left_anti")
    repeated = decided.where("NOT later AND n > 1").select(*key)
    if not repeated.isEmpty():  # rows that are there several times
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates(key))
    return kept.select(*documents.columns)
