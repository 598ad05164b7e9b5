"""Near copies of whole texts against a plain loop over all pairs."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from reelspark.llm import near_texts


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_groups(rows):
    """Smallest doc_id of the group of each row."""
    sets = [plain_shingles(t) for _, t in rows]
    found = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                if found[x] != found[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                    found[x] = found[y] = min(found[x], found[y])
                    changed = True
    return found


def edited_rows():
    """Originals, copies with some words replaced, and texts alike in less than that."""
    r = random.Random(8)
    words = ["".join(r.choice("aeiou") + r.choice("bcdfgh") for _ in range(3)) for _ in range(2000)]
    rows = [(i, None if i == 3 else "" if i == 4 else " ".join(r.choice(words) for _ in range(r.randint(100, 400)))) for i in range(40)]
    for i in range(5, 40):
        for k in range(4):
            copy = rows[i][1].split()
            for at in r.sample(range(len(copy)), max(1, len(copy) * (k + 1) // 120)):
                copy[at] = r.choice(words)
            rows.append((100 * (k + 1) + i, " ".join(copy)))
    return rows


def test_pipeline_stage_finds_near_copies_and_keeps_others(spark):
    rows = edited_rows()
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs.repartition(4), "")
    assert left.columns == docs.columns
    want = sorted(i for (i, _), first in zip(rows, plain_groups(rows), strict=True) if i == first)
    assert sorted(r.doc_id for r in left.collect()) == want
    assert 40 < len(want) < 140
    assert near_texts.first_of_each(docs.limit(0)).count() == 0


def test_bands_meet_at_the_least_similarity():
    r = random.Random(9)
    met = 0
    for _ in range(300):
        both = [r.getrandbits(64) for _ in range(160)]
        a, b = (near_texts.np.array(sorted(both + [r.getrandbits(64) for _ in range(20)]), near_texts.np.uint64) for _ in "ab")
        assert near_texts.similarity(a, b) == 0.8
        met += bool({*enumerate(near_texts.band_keys(a))} & {*enumerate(near_texts.band_keys(b))})
    assert met == 300


def test_a_document_is_its_id_and_its_text(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "tuvw"}
    rows = [(1, "t"), (2, "t"), (2, "u"), (None, "t"), (3, "v"), (3, "v"), (3, "v"), (None, "w"), (None, "w"), (4, None), (5, ""), (5, "u")]
    docs = spark.createDataFrame([(i, texts.get(k, k), 1, 2) for i, k in rows], "doc_id long, text string, doc int, tie int")
    left = near_texts.first_of_each(docs.repartition(3))
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(1, texts["t"]), (2, texts["u"]), (3, texts["v"]), (None, texts["w"]), (4, None)], key=repr)


def test_golay_keys_of_fingerprints_link_near_copies_without_bands(spark):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = near_texts.stored(near_texts._prints(docs, 5), "test-prints")
    first = [F.first(c).alias(c) for c in ("size", "fp")]
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc", "tie")).alias("at"), *first)
    nodes = near_texts.stored(nodes.withColumn("keys", F.array().cast("array<bigint>")), "test-nodes")
    held = {r.node: (r.fp, plain_shingles(dict(rows)[r["at"].doc])) for r in nodes.collect()}

    def close(a, b):
        (x, s), (y, t) = held[a], held[b]
        return ((x ^ y) & (1 << 64) - 1).bit_count() <= 3 and len(s & t) >= 0.8 * len(s | t)

    want = {frozenset((a, b)) for a in held for b in held if a < b and close(a, b)}
    links = {frozenset((r.a, r.b)) for r in near_texts._links(nodes, docs, 5, 0.8).collect()}
    assert want and links <= want
    assert set().union(*links) == set().union(*want)
