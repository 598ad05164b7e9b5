"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from reelspark.llm import pivots


def table(spark, seed=1, groups=25, size=12, dim=64):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(groups):
        centre = r.normal(size=dim)
        for _ in range(size if g else 300):
            v = centre / np.linalg.norm(centre) + r.normal(size=dim) * 0.02
            rows.append((i, [float(np.float32(x)) for x in v], int(g % 3)))
            i += 1
    rows += [(i + k, rows[k][1], rows[k][2]) for k in range(0, 40, 2)]
    rows += [(5000 + k, [float(np.float32(x)) for x in r.normal(size=dim)], k % 4) for k in range(150)]
    return rows


def brute(rows, threshold):
    ids = [r[0] for r in rows]
    pairs = pivots.brute_force_links(ids, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), threshold)
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if component[a] != component[b]:
                component[a] = component[b] = min(component[a], component[b])
                changed = True
    return pairs, component


@pytest.mark.parametrize("block", [512, 40])
def test_links_and_recall(spark, block):
    rows = table(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    pairs, component = brute(rows, 0.93)
    got = {r.vec_id: r for r in pivots.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    links = dict.fromkeys(got, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert all(got[i].n_links <= links[i] for i in got)  # no link below the threshold, none counted twice
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    same = sum(got[i].component_id == component[i] for i in got)
    assert same >= 0.98 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark, nothing):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1),
        (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2), (11, [1.0, 2.0], 1),
        (11, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (12, [1.0, 2.0, 3.0], 1), (13, [-1.0, -2.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()]
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 12, 13)]
    near = [(8, 3, 8, True), (9, 3, 8, False), (11, 3, 8, False), (11, 3, 8, False)]
    assert sorted(g for g in got if g[0] is not None) == sorted(alone + near)
    assert [g[:3] for g in got if g[0] is None] == [(None, 0, None)]
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_extreme_lengths_and_labels_of_any_type(spark):
    rows = [(1, [1e200, 2e200], "a"), (2, [1.0, 2.0], "a"), (3, [1e-200, 2e-200], "a"), (4, [2e200, -1e200], "a"), (5, [1.0, 2.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_recall_with_very_many_pivots(spark):
    r = pivots.np.random.default_rng(1)
    base = r.normal(size=(1200, 64))
    near = base[:600] + r.normal(size=(600, 64)) * 0.3
    x = pivots.np.concatenate([base, near])
    links = pivots.brute_force_links(range(len(x)), x, pivots.np.zeros(len(x)), 0.93)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sum(row.n_links for row in pivots.near_duplicates(df, pivots=pivots.MOST_PIVOTS).collect())
    assert len(links) > 300 and got >= 0.9 * 2 * len(links)
