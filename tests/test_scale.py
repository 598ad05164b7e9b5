"""Plans and results under skew: one key with a third of all rows, no cross joins, bounded shuffles."""

import io
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions import scan
from reelspark.operators import fusion as FU
from reelspark.operators import rollup as R
from reelspark.operators import tasks as K
from reelspark.plans.catalog import QUERIES, _marks
from reelspark.session import keyed_session, materialize, materialize_by


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def hot_log(spark):
    """Task 0 owns a third of the rows, with ties in time."""
    n = F.col("id")
    return spark.range(9000).select(
        F.when(n % 3 == 0, F.lit(0)).otherwise(n % 40).cast("long").alias("task_id"),
        F.timestamp_seconds(F.floor(n / 2) * 7).alias("ts"), n.alias("seq"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("")), (F.pmod(F.xxhash64(n), F.lit(4)) + 1).cast("int")).alias("stage"),
        (F.pmod(F.xxhash64(n, F.lit(1)), F.lit(10000)) / 100).alias("percent"), (n > 8900).alias("done"),
    )


@pytest.fixture(params=[100, 1_000_000])
def slicing(request, monkeypatch):
    """Once with slices far smaller than the hot key, once as configured."""
    monkeypatch.setattr(scan, "ROWS_PER_SLICE", request.param)


@pytest.mark.usefixtures("slicing")
def test_progress_on_a_hot_task(spark, hot_log):
    got = K.monotone_progress(hot_log.withColumnRenamed("task_id", "op_id")).select("op_id", "seq").collect()
    before = Window.partitionBy("task_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("percent").over(before)
    want = hot_log.select("task_id", "seq", (best.isNull() | (F.col("percent") > best)).alias("k")).where("k").select("task_id", "seq").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.usefixtures("slicing")
def test_steps_on_a_hot_task(spark, hot_log):
    got = {}
    for r in K.task_steps(hot_log).orderBy("task_id", "step_no").collect():
        got.setdefault(r["task_id"], []).append(r["stage"])
    want = {}
    current = {}
    for r in hot_log.orderBy("task_id", "ts", "seq").collect():
        t, before = r["task_id"], current.get(r["task_id"])
        if r["stage"] and r["stage"] != before:
            if before:
                want.setdefault(t, []).append(before)
            current[t] = r["stage"]
        if r["done"]:
            want.setdefault(t, []).append(current.get(t) or "")
    assert got == want


@pytest.mark.usefixtures("slicing")
def test_hot_project_in_fusion_and_suppression(spark):
    n = F.col("id")
    visual = spark.range(6000).select(
        F.when(n % 3 == 0, F.lit(0)).otherwise(n % 50).cast("long").alias("project_id"), n.alias("ord"), F.lit("v").alias("label"), (n % 700).cast("double").alias("start_s"),
        (n % 700 + 5).cast("double").alias("end_s"), F.lit("e").alias("evidence"), (F.pmod(F.xxhash64(n), F.lit(100)) / 100).alias("score"), F.lit("other").alias("kind"),
    )
    text = visual.where("ord < 100").withColumn("kind", F.lit("text"))
    fused = FU.fuse_evidence(text, visual)
    assert fused.groupBy("project_id").count().where("count > 6").count() == 0
    assert fused.where("project_id = 0").count() == 6
    kept = FU.suppress_near_duplicates(visual.withColumn("draft_id", F.col("ord").cast("string")))
    assert kept.groupBy("project_id").count().agg(F.max("count")).first()[0] == 6
    digest = lambda df: sorted(map(tuple, df.collect()))
    results.setdefault("fused", digest(fused))
    results.setdefault("kept", digest(kept))
    assert digest(fused) == results["fused"] and digest(kept) == results["kept"]


results: dict = {}


def test_fusion_lists_no_pairs(spark):
    """Entries of the cell index grow with the rows of a project, and no row meets another but in order."""
    def candidates(n, width):
        i = F.col("id")
        return spark.range(n).select(F.lit(1).cast("long").alias("project_id"), i.alias("ord"), (F.pmod(F.xxhash64(i), F.lit(60000)) / 100).alias("start_s")).withColumn("end_s", F.col("start_s") + width)

    homes = FU.earliest_within(candidates(500, 3.0), candidates(700, 8.0), 2.0)
    assert "Join" not in plan(homes)
    t = [(r["ord"], r["start_s"], r["end_s"]) for r in candidates(700, 8.0).collect()]
    want = {}
    for v in candidates(500, 3.0).collect():
        near = [o for o, a, b in t if v["start_s"] <= b + 2 and a <= v["end_s"] + 2]
        if near:
            want[v["ord"]] = min(near)
    assert {r["v_ord"]: r["home"] for r in homes.collect()} == want and len(want) > 400


def test_slices_and_salts(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    sliced = scan.slice_hot_keys(df, ["k"], ["i"], rows=100)
    sizes = {(r["k"], r["__b"]): r["count"] for r in sliced.groupBy("k", "__b").count().collect()}
    assert {b for k, b in sizes if k == 0} == set(range(6)) and max(sizes.values()) <= 200
    assert all(b == 0 for k, b in sizes if k != 0)
    salted = scan.salt_hot_keys(df, ["k"], ["i"], scan.hot_key_parts(df, ["k"], rows=100))
    assert salted.where("k = 0").select("__salt").distinct().count() == 6 and salted.where("k != 0 and __salts != 1").count() == 0
    assert salted.count() == 1000


def test_slices_of_a_burst(spark):
    """A third of all rows within one second, in one key: slices follow rank, not time."""
    n = F.col("id")
    df = spark.range(9000).select(
        F.when(n % 3 == 0, F.lit(0)).otherwise(n).alias("k"), F.when(n < 8990, F.floor(n / 4000)).otherwise(n * 1000).alias("ts"), n.alias("seq")
    )
    sliced = scan.slice_hot_keys(df, ["k"], ["ts", "seq"], rows=300).where("k = 0")
    sizes = {r["__b"]: r["count"] for r in sliced.groupBy("__b").count().collect()}
    assert sorted(sizes) == list(range(10)) and max(sizes.values()) <= 600
    ordered = [r["__b"] for r in sliced.orderBy("ts", "seq").collect()]
    assert ordered == sorted(ordered)


def test_ranking_is_cut_before_the_shuffle(spark, data_dir):
    for name in ("evidence_fusion", "playable_topk", "select_candidates"):
        text = plan(QUERIES[name](spark, data_dir))
        assert "WindowGroupLimit" in text, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark, data_dir):
    text = plan(QUERIES["playable_topk"](spark, data_dir))
    schema = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schema and all("props" not in line for line in schema)
    text = plan(QUERIES["silence_gate"](spark, data_dir))
    assert all("l_extendedprice" not in line for line in text.splitlines() if "ReadSchema" in line)


def test_workspace_rows_hold_every_child(spark):
    projects = spark.createDataFrame([(0, "hot"), (1, "small"), (2, "empty")], "project_id long, name string")
    kids = spark.range(3000).select(F.when(F.col("id") < 2990, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("project_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("body"))
    snap = R.workspace_snapshot(projects, {"drafts": kids, "tasks": kids.limit(0)}).collect()
    assert sorted(r["seq"] for r in snap if r["project_id"] == 0) == list(range(2990))
    assert {(r["n_drafts"], r["n_tasks"]) for r in snap if r["project_id"] == 0} == {(2990, 0)}
    assert [(r["n_drafts"], r["section"]) for r in snap if r["project_id"] == 2] == [(0, None)]


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    stored = materialize(df, "t")
    assert stored.columns == df.columns and sorted(map(tuple, stored.select("id").collect())) == sorted(map(tuple, df.select("id").collect()))


def test_prompts_move_no_inputs(spark, data_dir):
    """Requests that share one of the few stages are not brought together in a task."""
    for name in ("prompt_table", "prompt_resolve"):
        text = plan(QUERIES[name](spark, data_dir))
        assert "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_marks_are_made_where_cues_are_read(spark):
    """Forty rows of every project come from the tasks that read the cues, not from the few that a distinct leaves."""
    cues = materialize(
        spark.createDataFrame([(p, i) for p in (3, 8, 9) for i in range(p)], "project_id long, cue_idx int"), "cues"
    )
    marks = _marks(cues)
    assert "Exchange" not in plan(marks)
    assert sorted(map(tuple, marks.select("project_id", "id").collect())) == sorted((p, f"text-{n}") for p in (3, 8, 9) for n in range(1, 41))


def test_tables_dealt_out_by_a_key_are_not_moved_again(spark):
    rows = [(k, i % 5, f"t{i}") for i in range(60) for k in (i % 7, None)] * 2
    own = keyed_session(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored = materialize_by(own.createDataFrame(rows, "k long, i int, t string"), "k", "dealt-out")
    assert sorted(map(str, stored.collect())) == sorted(map(str, own.createDataFrame(rows, "k long, i int, t string").collect()))
    assert not [t for t in own.catalog.listTables() if t.name.startswith("dealt_out")]
    pairs = stored.groupBy("k", "i").agg(F.count("t").alias("n")).join(stored, ["k", "i"])
    assert "hashpartitioning" not in plan(pairs)
    want = spark.createDataFrame(rows, "k long, i int, t string")
    want = want.groupBy("k", "i").agg(F.count("t").alias("n")).join(want, ["k", "i"])
    assert sorted(map(str, pairs.collect())) == sorted(map(str, want.select(pairs.columns).collect()))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_timelines_are_checked_where_their_cues_lie(spark):
    """No table of the check is shuffled: neither texts nor evidence move once cues are stored."""
    texts = [(p, "\n".join(f"line {n} of {p}" for n in range(13))) for p in range(1, 27)]
    folder = f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/tables"
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = QUERIES["timeline_check"](spark, folder)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    text = plan(checked)
    assert "SortMergeJoin" in text and "hashpartitioning" not in text
    got = {r["project_id"]: r["reason"] for r in checked.collect()}
    want = {1: "id", 2: "label", 3: "not_grounded", 4: "not_grounded", 5: "evidence", 6: "kind", 7: "kind", 8: "count", 9: "over_tier"}
    assert len(got) == 26 and {p: r for p, r in got.items() if p < 10} == want
