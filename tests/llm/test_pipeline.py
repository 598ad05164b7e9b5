"""The pipeline against its stages done by hand, and the registry of the subpackage."""

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from reelspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def left(spark, data_dir):
    """What each stage leaves, by name."""
    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir).cache()
        out[name] = docs
    return out


def test_stages_keep_the_columns_of_documents(spark, data_dir, left):
    want = spark.read.parquet(f"{data_dir}/documents.parquet")
    for name in list(left)[:-1]:
        assert left[name].columns == want.columns
        assert [t for _, t in left[name].dtypes] == [t for _, t in want.dtypes]


def test_decisions_take_effect(spark, data_dir, left):
    n = [df.count() for df in left.values()]
    assert spark.read.parquet(f"{data_dir}/documents.parquet").count() > n[0] > n[2] > 0
    assert n[0] == n[1] and n[2] == n[3]
    seen = set()
    lines = sorted((r.doc_id, r.text) for r in left["line_dedup"].collect())
    for line in (x.strip() for _, t in lines for x in t.split("\n") if len(x.strip()) >= 20):
        assert line not in seen
        seen.add(line)
    pieces = left["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left["secret_scan"].collect()}


def test_run_gives_the_last_stage(spark, data_dir, left):
    got = corpus_pipeline.run(spark, data_dir)
    assert sorted(map(tuple, got.drop("sequence_id").collect())) == sorted(
        map(tuple, left["packing"].drop("sequence_id").collect())
    )


def test_every_operator_is_registered():
    names = set(entry_point.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
