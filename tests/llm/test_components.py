"""Components of link tables against plain union, and the tables that are stored for them."""

import random

from reelspark.llm import components as module


def plain(links):
    least = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            group = {n for n in (a, b)} | {n for n, m in least.items() if m in (least.get(a, a), least.get(b, b))}
            least.update(dict.fromkeys(group, min(group)))
    return least


def found(spark, links):
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    rows = module.components(table).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_components_of_odd_tables(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    mixed = [(r.randint(-60, 60), r.randint(-60, 60)) for _ in range(70)]
    for links in (chain, mixed, [(7, i) for i in range(20)], [(1, 1), (None, 2), (3, None), (5, 4), (4, 5)], []):
        assert found(spark, links) == plain(links)


def test_no_round_is_run_for_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(module, "stored", lambda df, label, f=module.stored: written.append(label) or f(df, label))
    assert found(spark, [(1, i) for i in range(2, 9)] + [(20, 21)]) == {**dict.fromkeys(range(1, 9), 1), 20: 20, 21: 20}
    assert written == ["links"]
