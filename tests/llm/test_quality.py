"""Held-out accuracy of the classifier and the rules; statistics against plain loops."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import quality_model, rule_lists


@pytest.fixture(scope="module")
def tables(spark, data_dir):
    folder = data_dir.replace("sf0.001", "sf0.01")
    return tuple(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))


def test_classifier_on_rows_it_never_saw(tables):
    documents, labels = tables
    got = quality_model.classify(documents, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert above > 0.95
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.97


def test_the_driver_gets_the_model_only(tables, monkeypatch):
    documents, labels = tables
    frame, got = type(documents), []
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: got.append(f(self)) or got[-1])
    sample = quality_model.labelled_sample(documents, labels, "quality", F.lit(True), 400)
    model = quality_model.train(sample, 1 << 10)
    assert sample.count() > 100
    assert [len(rows) for rows in got] == [1]
    assert model.factors.shape == ((1 << 10) + len(quality_model.STATISTICS), 8) and model.linear.any()
    assert len(model.linear) == len(model.factors) and len(model.mean) == len(model.scale) == len(quality_model.STATISTICS)


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    k = 6 + len(quality_model.STATISTICS)
    model = quality_model.Model(
        0.3, r.normal(size=k), r.normal(size=(k, 4)), np.zeros(k - 6), np.ones(k - 6)
    )
    index, value, stats = np.array([0, 2, 5, 1]), np.array([0.5, 1.0, -1.0, 2.0]), r.normal(size=(3, k - 6))
    got, z, _ = quality_model._raw_scores(model, index, value, np.array([3, 3, 4]), stats)
    for row, (a, b) in enumerate(((0, 3), (3, 3), (3, 4))):
        x = np.zeros(k)
        x[index[a:b]] = value[a:b]
        x[6:] = z[row]
        pairs = sum(
            x[i] * x[j] * (model.factors[i] @ model.factors[j]) for i in range(k) for j in range(i + 1, k)
        )
        assert abs(got[row] - (0.3 + model.linear @ x + pairs)) < 1e-9


def test_classifier_odd_tables(spark, corpus, corpus_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1), (6, 0)], "doc_id long, quality int")
    got = quality_model.classify(corpus, labels).collect()
    assert len(got) == len(corpus_rows) and all(0 <= r.score <= 1 for r in got)
    assert not [r for r in got if r.doc_id is None and r.held_out]
    assert {round(r.score, 6) for r in quality_model.classify(corpus, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(nothing, labels).count() == 0
    kept = quality_model.accepted(corpus, labels.limit(0))
    assert kept.columns == corpus.columns and kept.count() == len(corpus_rows)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


def test_counts_match_plain_loops(spark, corpus, corpus_rows):
    rows = [*corpus_rows, (900, "a b c d e f g h i " * 6), (901, "x " * 30), (902, "a b c\x1fd\n \n#|\n#|\n ")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    got = rule_lists.judge(extra, []).collect()
    mine = sorted((r.doc_id or -1, *(r[c] for c in rule_lists.COUNTS), r.base_failed, r.kept) for r in got)
    want = []
    for i, t in rows:
        c = plain_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((i or -1, *c, failed, not failed))
    assert mine == sorted(want)


def test_rules_separate_labels_they_never_saw(tables):
    documents, labels = tables
    rules = rule_lists.learn_from(documents, labels)
    assert rules and all(1 <= len(rule) <= 4 for rule in rules)
    got = rule_lists.judge(documents, rules).join(labels, "doc_id").where(
        quality_model.fold(F.col("doc_id")) == 1
    ).where("NOT base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98
    assert np.mean([not r.kept for r in got if r.quality == 0]) > 0.6


def test_rules_without_labels(corpus, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_lists.learn_from(corpus, none) == []
    assert rule_lists.judge(nothing, []).count() == 0


def test_decision_list_is_ordered(spark):
    a = (rule_lists.Condition("x", True, 2.0),)
    b = (rule_lists.Condition("x", True, 1.0), rule_lists.Condition("y", False, 5.0))
    df = spark.createDataFrame([(3.0, 1.0), (1.5, 1.0), (1.5, 9.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(rule_lists.first_rule([a, b])).collect()] == [1, 2, None, None]
    assert str(a[0]) == "x >= 2"
