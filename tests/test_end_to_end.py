"""Cues to titled candidates and drafts, with a deterministic local function as the model."""

import json

import pandas as pd
from pyspark.sql import functions as F

from reelspark.functions.media_time import parse_timestamp
from reelspark.operators import cues as C
from reelspark.operators import drafts as D
from reelspark.operators import export as X
from reelspark.operators import selection as SE
from reelspark.plans import highlights as H
from reelspark.sources import replies as RP

# A baking show: fourteen cues of eight seconds, and what a model might say about it.
ANSWERS = {
    "outline": [{"title": "Kneading the dough", "subtopics": ["flour", "rest"]}, {"title": "Firing the oven", "subtopics": ["wood"]}],
    "timeline": [{"topic_id": "topic-2", "start": "00:01:03,900", "end": 95.8}, {"topic_id": "topic-1", "start": 7.2, "end": "00:47,100"}],
    "scoring": [{"id": "text-1", "score": 72, "reason": "clear hands"}, {"id": "text-2", "score": 0.95, "reason": "flames"}],
    "titles": [{"id": "text-2", "title": "Flames!", "hook": "Hot"}, {"id": "text-1", "title": "Soft dough", "hook": "Push and fold"}],
}


def local_model(answers):
    def model(batches):
        for pdf in batches:
            stages = [p.split(chr(10), 1)[0].removeprefix("STAGE: ") for p in pdf["prompt"]]
            raw = [f"```json\n{json.dumps(answers[s])}\n```" for s in stages]
            yield pd.DataFrame({"project_id": pdf["project_id"], "stage": pdf["stage"], "raw": raw})

    return model


def test_text_highlights(spark, tmp_path):
    raw = spark.range(3).select(
        F.col("id").alias("project_id"), F.posexplode(F.sequence(F.lit(0), F.lit(104), F.lit(8))).alias("seq", "a")
    ).select("project_id", "seq", F.col("a").cast("double").alias("start_s"), (F.col("a") + 8.0).alias("end_s"), F.concat(F.lit("Baker, step "), F.col("seq")).alias("text"))
    cues, rejects = C.normalize_cues(raw)
    assert rejects.count() == 0
    chunked = C.chunk_cues(cues)
    chunks = chunked.groupBy("project_id", "chunk").agg(F.min("start_s").alias("chunk_start"), F.max("end_s").alias("chunk_end"))
    profile = SE.duration_profile(cues.groupBy("project_id").agg(F.max("end_s").alias("duration")).withColumn("target", F.lit(30)))

    stages = spark.createDataFrame([(s,) for s in ANSWERS], "stage string")
    templates = stages.select(F.lit("").alias("category"), "stage", F.lit("Watch the baker.").alias("template"))
    asks = cues.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.explode(F.array(*[F.lit(s) for s in ANSWERS]))).select(
        "project_id", "stage", F.lit("").alias("category"), F.lit("").alias("instruction"), F.struct("n").alias("input"))
    prompts = RP.build_prompts(RP.resolve_prompts(asks, templates))
    assert prompts.where("oversize").count() == 0
    replies = RP.run_model(prompts, local_model(ANSWERS), "project_id long, stage string, raw string")

    def rows(stage, schema):
        ok, bad = RP.ingest_replies(replies.where(F.col("stage") == stage), schema, "project_id")
        assert bad.count() == 0
        return ok

    outline = rows("outline", RP.OUTLINE).select("project_id", F.lit(0).alias("chunk"), F.col("reply").alias("items"))
    timeline = rows("timeline", RP.TIMELINE).select("project_id", F.lit(0).alias("chunk"), F.posexplode("reply").alias("row_no", "x")).select(
        "project_id", "chunk", "row_no", "x.topic_id", parse_timestamp(F.col("x.start"))["seconds"].alias("start_s"), parse_timestamp(F.col("x.end"))["seconds"].alias("end_s"))
    scores = rows("scoring", RP.SCORES).select("project_id", F.inline("reply"))
    titles = rows("titles", RP.TITLES).select("project_id", F.inline("reply"))

    titled, report = H.text_highlights(cues, chunks, profile, outline, timeline, scores, titles)
    got = [(r["id"], r["start_s"], r["end_s"], r["score"], r["title"], r["hook"], r["label"]) for r in titled.where("project_id = 1").orderBy("ord").collect()]
    assert got == [
        ("text-1", 8.0, 48.0, 0.72, "Soft dough", "Push and fold", "Kneading the dough"),
        ("text-2", 64.0, 96.0, 0.95, "Flames!", "Hot", "Firing the oven"),
    ]
    assert {r["reason"] for r in report.collect()} == {None}

    plans = titled.select(
        "project_id", F.concat(F.lit("wf-"), F.col("project_id")).alias("workflow_id"), (F.col("ord") - 1).alias("i"), "id", "label", "start_s", "end_s", "evidence", "title", "hook",
        F.lit("highlight").alias("goal"), F.lit("subtitle").alias("route"), F.lit("portrait").alias("aspect"), F.lit(True).alias("burn_subtitles"))
    drafts, exports = H.produce(plans, spark.createDataFrame([(f"wf-{i}", i == 2) for i in range(3)], "workflow_id string, auto_export boolean"))
    assert drafts.count() == 6 and exports.count() == 2
    checked = D.validate_drafts(drafts, spark.createDataFrame([(i, 112.0) for i in range(3)], "project_id long, duration double"))
    assert checked.where("reason is not null").count() == 0
    timed = X.timeline_cues(drafts.select("project_id", "draft_id", "scenes"), cues)
    assert sorted(r["count"] for r in timed.groupBy("draft_id").count().collect()) == [4, 4, 4, 5, 5, 5]
    X.write_documents(X.to_srt(timed, key="draft_id", order="out_idx")[0], str(tmp_path / "srt"))
    assert spark.read.parquet(str(tmp_path / "srt")).count() == 6
