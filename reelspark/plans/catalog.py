"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media_time import duration_label, parse_timestamp, scene_frames
from ..functions.scores import rescale_score
from ..operators import cues as C
from ..operators import drafts as D
from ..operators import export as X
from ..operators import fusion as FU
from ..operators import options as O
from ..operators import rollup as R
from ..operators import sampling as S
from ..operators import selection as SE
from ..operators import tasks as K
from ..operators import timeline as TL
from ..operators import visual as V
from ..sources import entities as E
from ..sources import media as M
from ..sources import replies as RP
from ..sources import srt as SRT
from ..sources import urls as U
from ..session import keyed_session, materialize, materialize_by
from ..streaming import tasks as ST
from ..streaming.run import refresh_expired, run_available, run_updates, stream_session
from . import adapters as A
from .highlights import fused_highlights
from .highlights import fused_production as fused_production_path
from .highlights import text_highlights as text_path
from .highlights import visual_highlights as visual_path
from .highlights import visual_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


# --- sources and sinks ------------------------------------------------------------------------


@query
def srt_ingest(spark, d):
    return SRT.parse_srt_rows(A.srt_docs(spark, d), "doc_id", "content")


def _some_bad(cues):
    """Captions of which one in every seventh project ends before it starts."""
    bad = (F.col("project_id") % 7 == 3) & (F.col("cue_idx") == 0)
    return cues.withColumn("end_s", F.when(bad, F.col("start_s") - 1).otherwise(F.col("end_s")))


@query
def srt_export(spark, d):
    cues = A.short_cues(spark, d).withColumnRenamed("seq", "cue_idx")
    docs, rejects = X.to_srt(_some_bad(cues))
    return docs.unionByName(rejects, allowMissingColumns=True)


@query
def ass_export(spark, d):
    cues = A.short_cues(spark, d).withColumnRenamed("seq", "cue_idx")
    known = F.col("project_id") % 11 != 5
    dims = cues.select("project_id").distinct().select(
        "project_id",
        F.when(known, F.when(F.col("project_id") % 2 == 0, F.lit(1080)).otherwise(F.lit(1920))).alias("out_w"),
        F.when(known, F.when(F.col("project_id") % 2 == 0, F.lit(1920)).otherwise(F.lit(1080))).alias("out_h"),
    )
    docs, rejects = X.to_ass(_some_bad(cues), dims)
    return docs.unionByName(rejects, allowMissingColumns=True)


def raw_replies(spark, d):
    """Conversation turns as score replies; some shapes are broken on purpose."""
    body = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("c-"), F.col("turn")).alias("id"),
                (F.char_length("text") % 100 / 100).alias("score"),
                F.col("text").alias("reason"),
            )
        )
    )
    k = (F.col("conv_id") * 3 + F.col("turn")) % 8
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k == 1, F.concat(body, F.lit(" trailing")))
        .when(k == 2, F.regexp_replace(body, '"score"', '"ID":"x","score"'))
        .when(k == 3, F.regexp_replace(body, '"score"', '"rating"'))
        .otherwise(body)
    )
    return A.table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query
def reply_ingest(spark, d):
    rows = RP.ingest_reply_rows(raw_replies(spark, d), RP.SCORES)
    first = F.try_element_at("reply", F.lit(1))
    return rows.select(
        "conv_id", "turn", first["id"].alias("id"), first["score"].alias("score"), first["reason"].alias("text"), "reason"
    )


@query
def completion_extract(spark, d):
    k = F.col("turn") % 8
    finish = F.when(k == 2, F.lit("length")).when(k == 3, F.lit(" Content_Filter ")).otherwise(F.lit("stop"))
    message = F.struct(F.when(k != 4, F.col("text")).alias("content"), F.when(k == 5, F.lit("no")).alias("refusal"))
    body = F.to_json(F.struct(F.array(F.struct(finish.alias("finish_reason"), message.alias("message"))).alias("choices")))
    tail = (
        F.when(F.col("conv_id") % 5 == 0, F.lit(',"error":{}}'))
        .when((F.col("conv_id") % 5 == 1) & (k == 1), F.lit(',"error":{"code":"x"}}'))
        .when((F.col("conv_id") % 5 == 2) & (k == 1), F.lit(',"error":[}'))
        .otherwise(F.lit("}"))
    )
    log = A.table(spark, d, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.regexp_replace(body, "\\}\\z", ""), tail).alias("body"),
    )
    return RP.extract_completions(log)


@query
def prompt_table(spark, d):
    stages = F.array(*[F.lit(x) for x in ("outline", "timeline", "scoring", "titles")])
    docs = A.table(spark, d, "documents").select(
        "doc_id",
        F.element_at(stages, (F.col("doc_id") % 4 + 1).cast("int")).alias("stage"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("speech")).otherwise(F.lit("")).alias("category"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit(" ")).alias("instruction"),
        F.struct("doc_id", "lang", F.split("text", "\n").alias("cues")).alias("input"),
    )
    out = RP.build_prompts(RP.resolve_prompts(docs, _templates(spark)))
    return out.select("doc_id", "stage", "prompt", "oversize")


def _templates(spark):
    rows = [("", s, f"Shared instructions for {s}.") for s in ("outline", "timeline", "scoring", "titles")]
    rows += [("speech", "outline", "Speech outline instructions."), ("speech", "titles", "Speech title instructions.")]
    return spark.createDataFrame(rows, "category string, stage string, template string")


@query
def prompt_resolve(spark, d):
    stages = F.array(*[F.lit(x) for x in ("outline", "timeline", "scoring", "titles")])
    docs = A.table(spark, d, "documents").select(
        "doc_id",
        F.element_at(stages, (F.col("n_chars") % 4 + 1).cast("int")).alias("stage"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("speech")).otherwise(F.col("lang")).alias("category"),
    )
    return RP.resolve_prompts(docs, _templates(spark)).select("doc_id", "stage", "category", "template")


@query
def probe_parse(spark, d):
    p = A.table(spark, d, "part")
    k = F.col("p_partkey") % 9
    width, height = F.col("p_size") * 77, F.col("p_partkey") % 2200
    stream = F.concat(
        F.lit('{"codec_type":"video","width":'), width, F.lit(',"height":'), height,
        F.lit(',"duration":"'), F.col("p_size"), F.lit('.5"'),
        F.when(k == 1, F.lit(',"tags":{"rotate":"90"}')).otherwise(F.lit("")),
        F.when(k == 2, F.lit(',"side_data_list":[{"rotation":-90}]')).otherwise(F.lit("")),
        F.when(k == 3, F.lit(',"disposition":{"attached_pic":1}')).otherwise(F.lit("")),
        F.lit("}"),
    )
    audio = F.when(k != 4, F.lit('{"codec_type":"audio"},')).otherwise(F.lit(""))
    total = F.when(k == 5, F.lit('"N/A"')).otherwise(F.concat(F.lit('"'), F.col("p_retailprice") * 5, F.lit('"')))
    raw = p.select(
        F.col("p_partkey").alias("project_id"),
        F.concat(F.lit('{"streams":['), audio, stream, F.lit('],"format":{"duration":'), total, F.lit("}}")).alias("probe"),
    )
    return M.parse_probe(raw)


@query
def engine_events(spark, d):
    v, t = F.col("value"), F.col("event_type")
    line = (
        F.when((t == "signup") & (v < 2), F.lit('{"type":"note"}'))
        .when((t == "error") & (v < 3), F.lit('{"type":"error","message":"boom"}'))
        .when((t == "error") & (v < 5), F.lit('{"type":"error"}'))
        .when(t == "purchase", F.lit('{"type":"result","output":"x"}'))
        .when((t == "view") & (v < 1), F.lit("{broken"))
        .otherwise(F.concat(F.lit('{"type":"progress","stage":"'), t, F.lit('","percent":'), v / 4, F.lit("}")))
    )
    log = A.table(spark, d, "events").select(
        F.floor(F.col("event_id") / 8).alias("job_id"), F.col("event_id").alias("seq"), line.alias("line")
    )
    return M.fold_engine_events(log)


@query
def engine_candidates(spark, d):
    e = A.table(spark, d, "events")
    start = F.floor(A._event_ms() / 360)
    results = e.select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id")).alias("id"),
        (start / 1000).alias("start_s"), ((start + 100 + F.floor(F.col("value") * 100)) / 1000).alias("end_s"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")).alias("title"),
        F.col("value").alias("score"), F.col("props").alias("reason"),
    )
    projects = e.groupBy(F.col("user_id").alias("project_id")).agg(F.lit(7200.0).alias("duration"))
    rows, rejected = M.engine_candidates(results, projects)
    cols = rows.columns
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected, allowMissingColumns=True
    ).select(*cols, "reason")


@query
def engine_drafts(spark, d):
    """Drafts of engine candidates with their words; some projects have a bad boundary, a path outside or no candidate."""
    e, start, user = A.table(spark, d, "events"), F.floor(A._event_ms() / 360), F.col("user_id")
    span = [(start / 1000).alias("start_s"), ((start + 100 + F.floor(F.col("value") * 100)) / 1000).alias("end_s")]
    up = F.when(F.col("event_id") % 797 == 5, F.lit("../../x")).otherwise(F.concat(F.lit("./crop//"), F.lit("a/../"), F.col("event_id")))
    results = e.select(
        user.alias("project_id"), F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id")).alias("id"), *span,
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")).alias("title"), F.col("value").alias("score"),
        F.col("props").alias("reason"), F.concat(F.lit("Hook "), F.col("event_id")).alias("hook"),
        F.concat(F.when(user % 2 == 0, F.lit("/work/engine/")).otherwise(F.lit("")), up).alias("crop_path"),
    )
    projects = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 40 == 7, F.lit(6000.0)).otherwise(F.lit(7300.0)).alias("duration"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("portrait")).otherwise(F.lit("original")).alias("aspect"),
    )
    words = e.select(user.alias("project_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), *span, F.lit(None).cast("string").alias("speaker"))
    drafts, rejects = M.engine_drafts(results, projects, "/work/engine")
    drafts = materialize(drafts, "engine-drafts")
    said = M.draft_words(drafts, words).groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_words"))
    flat = drafts.join(said, "draft_id", "left").select(
        "project_id", "draft_id", "title", "hook", F.col("scenes")[0]["id"].alias("scene_id"), "start_s", "end_s", "aspect", "subtitles", "origin",
        "crop_path", "ratio", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"),
    )
    return flat.unionByName(rejects, allowMissingColumns=True)


@query
def entity_scan(spark, d):
    body = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_custkey").cast("string").alias("draft_id"),
            F.length("o_orderpriority").alias("revision"), F.col("o_orderpriority").alias("title"),
            F.col("o_orderdate").alias("created_at"),
        )
    )
    raw = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), _some_broken(body, F.col("o_orderkey")).alias("body"))
    out = E.read_entities(raw, "export")
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


def _some_broken(body, n):
    """JSON bodies, one in eleven of which breaks off and one in thirteen of which is missing."""
    return F.when(n % 13 == 5, F.lit(None)).when(n % 11 == 3, F.substring(body, 1, 9)).otherwise(body)


@query
def entity_project(spark, d):
    n = F.col("c_custkey")
    body = F.to_json(F.struct(
        n.cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("duration"),
        (n % 1920).cast("int").alias("width"), (n % 2 == 0).alias("has_audio"),
    ))
    raw = A.table(spark, d, "customer").select(n.alias("seq"), _some_broken(body, n).alias("body"))
    return E.read_entities(raw, "project").select("seq", "id", "name", "status", "duration", "width", "has_audio", "reason")


@query
def entity_task(spark, d):
    n = F.col("event_id")
    body = F.to_json(F.struct(
        n.cast("string").alias("id"), F.col("user_id").cast("string").alias("project_id"), F.col("event_type").alias("stage"),
        F.col("value").alias("progress"), F.array(F.lit("probe"), F.col("event_type")).alias("completed_steps"), (n % 3 == 0).alias("retryable"),
    ))
    raw = A.table(spark, d, "events").select(n.alias("seq"), _some_broken(body, n).alias("body"))
    out = E.read_entities(raw, "task")
    return out.select("seq", "id", "project_id", "stage", "progress", F.array_join("completed_steps", ",").alias("steps"), "retryable", "reason")


@query
def entity_draft(spark, d):
    n = F.col("p_partkey")
    scene = F.struct(F.lit("s0").alias("id"), F.col("p_brand").alias("label"), F.lit(0.5).alias("start"), (F.col("p_size") + 1.0).alias("end"))
    body = F.to_json(F.struct(n.cast("string").alias("id"), F.col("p_brand").alias("title"), F.array(scene).alias("scenes"), F.col("p_size").cast("int").alias("revision")))
    raw = A.table(spark, d, "part").select(n.alias("seq"), _some_broken(body, n).alias("body"))
    out = E.read_entities(raw, "draft")
    return out.select("seq", "id", "title", F.size("scenes").alias("n_scenes"), F.col("scenes")[0]["end"].alias("first_end"), "revision", "reason")


@query
def entity_workflow(spark, d):
    n = F.col("o_orderkey")
    goal = F.struct(F.lit("content").alias("goal"), F.col("o_orderstatus").alias("status"), F.array(F.lit("d1"), F.lit("d2")).alias("draft_ids"))
    body = F.to_json(F.struct(
        n.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("project_id"), (n % 2 == 0).alias("auto_export"), F.array(goal).alias("goals"),
    ))
    raw = A.table(spark, d, "orders").select(n.alias("seq"), _some_broken(body, n).alias("body"))
    g = F.col("goals")[0]
    out = E.read_entities(raw, "workflow")
    return out.select("seq", "id", "project_id", "auto_export", g["status"].alias("goal_status"), F.size(g["draft_ids"]).alias("n_drafts"), "reason")


@query
def keyed_upsert(spark, d):
    base = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("tag"))
    delta = A.table(spark, d, "orders").select(
        (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", F.lit(1_000_000)).otherwise(F.lit(0))).alias("id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("tag"), "o_orderdate", "o_orderkey",
    )
    return E.upsert(base, delta, ["id"], ["o_orderdate", "o_orderkey"], "replace")


@query
def insert_ignore(spark, d):
    base = A.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    delta = A.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("value"), "source")
    return E.upsert(base, delta, ["doc_id"], ["source"], "ignore")


def raw_urls(spark, d):
    """Page URLs restated in the shapes a user may paste."""
    u = F.col("url")
    path = F.regexp_extract(u, "^[a-z]+://[^/]*(/[^?#]*)", 1)
    tail = F.regexp_extract(u, "([?#].*)\\z", 1)
    digits = F.regexp_extract(path, "([0-9]+)", 1)
    code = F.substring(F.md5(u), 1, 11)
    k = F.col("page_id") % 12
    yt = "https://www.youtube.com/watch?v="
    raw = (
        F.when(k == 0, u)
        .when(k == 1, F.concat(F.lit(yt), code, F.lit("&list=a")))
        .when(k == 2, F.concat(F.lit("https://youtu.be/"), code, tail))
        .when(k == 3, F.concat(F.lit("https://m.youtube.com/shorts/"), code))
        .when(k == 4, F.concat(F.lit("https://www.bilibili.com/video/av1"), digits, F.lit("/?p="), digits))
        .when(k == 5, F.concat(F.lit("https://b23.tv/a"), digits, F.lit("bc"), tail))
        .when(k == 6, F.concat(F.lit("http://youtu.be/"), code))
        .when(k == 7, F.concat(F.lit(yt), code, F.lit("&v="), code))
        .when(k == 8, F.concat(F.lit("https://user@youtu.be/"), code))
        .when(k == 9, F.concat(F.lit("https://youtu.be/%41"), code))
        .when(k == 10, F.concat(F.lit(" https://youtu.be/"), code))
        .otherwise(F.concat(F.lit("HTTPS://YouTube.com/watch?v="), F.substring(code, 1, 10)))
    )
    return A.table(spark, d, "pages").select("page_id", raw.alias("url"))


@query
def url_canonical(spark, d):
    return U.canonicalize_urls(raw_urls(spark, d))


@query
def url_distinct(spark, d):
    return U.distinct_sources(U.canonicalize_urls(raw_urls(spark, d)).drop("url"))


@query
def subtitle_track_pick(spark, d):
    tracks = A.table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 3).alias("project_id"),
        F.concat(F.lit("source."), F.col("lang"), F.lit("."), F.col("doc_id")).alias("file"), "lang",
        (F.col("n_chars") % 5).alias("n_cues"),
    )
    return M.pick_track(tracks)


@query
def transcript_resolve(spark, d):
    docs = A.table(spark, d, "documents")
    projects = docs.select(F.col("doc_id").alias("project_id"), (F.col("n_chars") / 5).alias("duration"))
    kind = F.element_at(F.array(F.lit("platform"), F.lit("uploaded"), F.lit("asr")), (F.col("doc_id") % 3 + 1).cast("int"))
    tracks = docs.select(F.col("doc_id").alias("project_id"), kind.alias("source")).unionByName(
        A.table(spark, d, "conversations").select(F.col("conv_id").alias("project_id"), F.lit("existing").alias("source"))
    )
    platform = A.long_cues(spark, d).withColumn("source", F.when(F.col("project_id") % 3 == 0, F.lit("platform")).otherwise(F.lit("uploaded")))
    existing = A.short_cues(spark, d).withColumn("source", F.lit("existing"))
    return M.resolve_transcripts(tracks, platform.unionByName(existing), projects)


@query
def media_manifest(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".mkv", ".txt", "", ".ts")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    files = A.table(spark, d, "part").select(
        F.concat(F.lit("/media/"), F.translate("p_name", " ", "_"), F.lit("-"), F.col("p_partkey"), ext).alias("path"),
        ((F.col("p_partkey") % 50) * 100_000_000).alias("size"),
        ((F.col("p_size") - 2) * 160.0).alias("duration"),
    )
    return M.media_manifest(files)


# --- projections and predicates -----------------------------------------------------------------


@query
def cue_normalize(spark, d):
    kept, rejects = C.normalize_cues(A.long_cues(spark, d))
    return kept.unionByName(rejects, allowMissingColumns=True)


@query
def cue_validate(spark, d):
    projects = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("project_id")).agg(
        (F.max("turn") * 15 + 20.0).alias("duration")
    )
    return C.validate_cues(A.short_cues(spark, d), projects).drop("text")


def _plans(spark, d):
    n = F.col("o_orderkey")
    goals = F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), (n % 4).cast("int")), lambda i: A.goal_of(i + n % 3))
    )
    return A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("plan_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("subtitle", "auto", "visual", "fused", "", "loud")]), (n % 6 + 1).cast("int")).alias("mode"),
        (n % 130).cast("int").alias("duration"),
        F.element_at(F.array(*[F.lit(x) for x in ("original", "portrait", "landscape", "", "square")]), (n % 5 + 1).cast("int")).alias("aspect"),
        F.when(n % 8 == 0, F.lit("speech")).when(n % 8 == 1, F.lit("sports")).otherwise(F.lit("")).alias("category"),
        F.col("o_orderpriority").alias("instruction"), goals.alias("goals"), (F.col("o_orderstatus") == "F").alias("allow_visual"),
    )


@query
def options_validate(spark, d):
    plans = _plans(spark, d)
    # both forms in one pass over the rows
    both = O.validate_options(plans.withColumns({"a0": F.col("aspect"), "g0": F.col("goals")})).withColumnsRenamed(
        {"reason": "loose_reason", "aspect": "aspect_out", "goals": "goals_out", "a0": "aspect", "g0": "goals"}
    )
    return O.validate_options(both, strict=True).select(
        "plan_id", F.col("aspect_out").alias("aspect"), F.array_join("goals_out", ",").alias("goals"), "loose_reason",
        F.col("reason").alias("strict_reason"),
    )


@query
def score_rescale(spark, d):
    return A.table(spark, d, "events").select("event_id", rescale_score(F.col("value")).alias("score"))


@query
def timestamp_parse(spark, d):
    ms = A._event_ms()
    k = F.col("event_id") % 8
    two = lambda c: F.format_string("%02d", c)
    h, m, s = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    clock = F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s))
    token = (
        F.when(k == 0, F.concat(F.lit('"'), clock, F.lit(","), F.format_string("%03d", ms % 1000), F.lit('"')))
        .when(k == 1, F.concat(F.lit('"'), two(m), F.lit(":"), two(s), F.lit('.5"')))
        .when(k == 2, F.concat(s, F.lit(".25")))
        .when(k == 3, F.concat(F.lit('"'), h, F.lit(":99:00"), F.lit('"')))
        .when(k == 4, F.lit("null"))
        .when(k == 5, F.concat(F.lit("-"), s))
        .when(k == 6, F.concat(F.lit("1e"), m * 8))
        .otherwise(F.concat(F.lit('"'), clock, F.lit('.1234"')))
    )
    out = A.table(spark, d, "events").select("event_id", token.alias("token")).withColumn("t", parse_timestamp(F.col("token")))
    return out.select("event_id", "token", "t.seconds", "t.reason")


@query
def duration_profile(spark, d):
    projects = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("project_id"), (F.col("n_chars") / 3).alias("duration"), ((F.col("doc_id") % 5) * 25).cast("int").alias("target")
    )
    return SE.duration_profile(projects)


def _shapes(spark, d):
    aspects = F.array(*[F.lit(x) for x in ("original", "portrait", "landscape", "round")])
    return A.table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 77).alias("width"), (F.col("p_partkey") % 2200).cast("int").alias("height"),
        F.when(F.col("p_partkey") % 7 < 4, F.lit("original")).otherwise(F.element_at(aspects, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("aspect"),
    )


@query
def output_dimensions(spark, d):
    return O.output_dimensions(_shapes(spark, d))


@query
def q_scene_frames(spark, d):
    start, length = F.col("l_discount") * 100, F.col("l_quantity") / 7
    frames = scene_frames(start, start + length)
    return A.table(spark, d, "lineitem").select(A.task_key().alias("scene_id"), frames.alias("frames"), (frames / 30).alias("seconds"))


@query
def draft_validate(spark, d):
    return D.validate_drafts(A.drafts(spark, d), A.draft_projects(spark, d)).select("draft_id", "reason")


@query
def promo_input(spark, d):
    groups = A.stored_text(spark, d).withColumn(
        "kind", F.when(F.col("ord") % 3 == 0, F.lit("menu")).otherwise(F.lit("content"))
    )
    kept, rejects = SE.promo_inputs(groups)
    out = kept.select("project_id", "id", "score").withColumn("reason", F.lit(None).cast("string"))
    return out.unionByName(rejects, allowMissingColumns=True)


@query
def error_classify(spark, d):
    n = F.col("event_id")
    codes = F.array(*[F.lit(x) for x in (401, 403, 404, 408, 429, 500, 503, 504, 400)])
    labels = F.array(*[F.lit(x) for x in ("invalid_model", "invalid_api_key", "insufficient_quota", "other", "rate_limit_exceeded")])
    body = F.when(n % 4 == 0, F.lit("not json")).when(n % 4 == 1, F.lit('{"error":{"param":"model"}}')).otherwise(
        F.concat(F.lit('{"error":{"'), F.when(n % 4 == 2, F.lit("code")).otherwise(F.lit("type")), F.lit('":"'),
                 F.element_at(labels, (n % 5 + 1).cast("int")), F.lit('"}}'))
    )
    log = A.table(spark, d, "events").select(
        F.floor(n / 3).alias("request_id"), (n % 3 + 1).cast("int").alias("attempt"),
        F.when(F.col("event_type") != "view", F.element_at(codes, (n % 9 + 1).cast("int"))).alias("status"),
        ((F.col("event_type") == "view") & (F.col("value") > 20)).alias("network"),
        (F.col("value") > 60).alias("timed_out"), body.alias("body"),
    )
    return O.classify_errors(log).drop("body")


@query
def silence_gate(spark, d):
    samples = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(F.col("l_linestatus") == "O", -F.floor(F.col("l_tax") * 500)).otherwise(F.floor(F.col("l_tax") * 400)).alias("sample"),
    )
    return O.silence_gate(samples)


@query
def project_search(spark, d):
    projects = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("project_id"), F.initcap("p_name").alias("name"), (F.col("p_retailprice")).alias("updated_at")
    )
    return O.search_projects(projects, " RiNg ")


@query
def plan_recommend(spark, d):
    docs = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id", "left")
    projects = docs.select(
        F.col("doc_id").alias("project_id"),
        F.when(F.col("quality") == 1, F.lit("available")).otherwise(F.lit("missing")).alias("subtitle_status"),
        (F.col("toxic") == 0).alias("has_audio"),
    )
    return O.recommend_plan(projects).select("project_id", "mode", F.array_join("goals", ",").alias("goals"), "plan_status", "plan_reason")


@query
def q_duration_label(spark, d):
    return A.table(spark, d, "events").select("event_id", duration_label(F.col("value") * 20 - 30).alias("label"))


# --- joins ---------------------------------------------------------------------------------------


@query
def timeline_cues(spark, d):
    return X.timeline_cues(A.drafts(spark, d), A.stored_cues(spark, d))


@query
def evidence_excerpt(spark, d):
    cues = A.stored_cues(spark, d)
    spans = A.text_candidates(cues).select("project_id", F.col("ord").alias("span_id"), "start_s", (F.col("end_s") + 1).alias("end_s"))
    return TL.evidence_excerpt(spans, cues)


def _snap_points(spark, d):
    v = A.visual_candidates(spark, d)
    sides = F.array(
        F.struct(F.lit("start").alias("side"), (F.col("start_s") / 6).alias("t")), F.struct(F.lit("end").alias("side"), (F.col("end_s") / 6).alias("t"))
    )
    return v.select("project_id", F.col("ord").alias("point_id"), F.inline(sides))


@query
def cue_snap(spark, d):
    return C.snap_to_cues(_snap_points(spark, d), A.stored_cues(spark, d))


@query
def cue_grounded(spark, d):
    cues = A.stored_cues(spark, d)
    spans = A.text_candidates(cues).select(
        "project_id", F.col("ord").alias("span_id"),
        (F.col("start_s") + F.when(F.col("ord") % 4 == 0, F.lit(0.001)).otherwise(F.lit(0.0))).alias("start_s"),
        (F.col("end_s") + F.when(F.col("ord") % 5 == 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("end_s"),
    )
    return C.cue_grounded(spans, cues)


def _frames(spark, d):
    return A.table(spark, d, "events").select(
        F.col("user_id").alias("project_id"), (F.floor(A._event_ms() / 360) / 1000).alias("time_s")
    )


@query
def frame_snap(spark, d):
    cites = A.table(spark, d, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("citation_id"),
        ((F.floor(A._event_ms() / 360) + F.col("event_id") % 160 - 80) / 1000).alias("t"),
    )
    return V.snap_to_frames(cites, _frames(spark, d))


@query
def review_frames(spark, d):
    best = A.visual_candidates(spark, d).groupBy("project_id").agg(
        F.max_by(F.struct("start_s", "end_s"), F.struct(F.col("score"), -F.col("ord"))).alias("b")
    ).select("project_id", (F.col("b.start_s") - 300).alias("start_s"), (F.col("b.end_s") + 2000).alias("end_s"), F.lit(7200.0).alias("duration"))
    return V.review_frames(best, _frames(spark, d))


@query
def evidence_fusion(spark, d):
    return FU.fuse_evidence(A.stored_text(spark, d), A.visual_candidates(spark, d))


def _first_scenes(spark, d):
    return A.visual_candidates(spark, d).select(
        "project_id", "ord", F.concat(F.lit("d-"), F.col("ord")).alias("draft_id"), "start_s", (F.col("end_s") + 20).alias("end_s")
    )


@query
def fused_drafts(spark, d):
    candidates = A.text_candidates(A.cues(spark, d)).select("project_id", "id", "start_s", "end_s")
    return FU.match_drafts(candidates, _first_scenes(spark, d))


@query
def fused_highlight_drafts(spark, d):
    fused = fused_highlights(A.stored_text(spark, d), A.visual_candidates(spark, d), _first_scenes(spark, d))
    return fused.select("project_id", "rank", "id", "draft_id", "overlap", "new_draft_id")


@query
def fused_production(spark, d):
    """Fusion to drafts, with failed branches, drafts without scenes and projects without candidates."""
    text, k = A.stored_text(spark, d), F.col("project_id")
    visual = A.visual_candidates(spark, d).withColumn("batch", F.floor(F.col("start_s") / 60) + 1)
    branches = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), F.concat(F.lit("wf-"), F.col("c_custkey")).alias("workflow_id"),
        (F.col("c_custkey") % 3 == 0).alias("burn_subtitles"), (F.col("c_custkey") % 10 != 3).alias("text_ok"),
        F.when(F.col("c_custkey") % 4 == 1, F.lit(60)).alias("failed_batch"),
    )
    scene = F.when((k + F.col("ord")) % 3 != 0, F.array(F.struct("id", "label", "start_s", (F.col("end_s") + 20).alias("end_s"), "evidence")))
    style = [F.concat(F.lit("Hook "), F.col("ord")).alias("hook"), F.when(F.col("ord") % 2 == 0, F.lit("portrait")).otherwise(F.lit("landscape")).alias("aspect"),
             F.lit("crop").alias("layout"), ((F.col("ord") % 9) / 10).alias("crop_x"), F.lit("card").alias("title_style"), F.lit(1).alias("title_template_version"),
             F.lit(False).alias("title_motion"), F.lit(0.8).alias("title_scale"), F.lit(0.2).alias("title_y"), F.lit(True).alias("original_audio"), (F.col("ord") % 4 + 1).cast("int").alias("revision")]
    # drafts of the text branch come before those of the visual one
    made = lambda c, side, batch, first: c.select(
        "project_id", (F.col("ord") + first).alias("ord"), F.concat(F.lit("d-"), F.col("id")).alias("draft_id"), scene.alias("scenes"),
        *style, F.lit(side).alias("side"), batch.alias("batch"),
    )
    originals = made(text, "text", F.lit(0).cast("long"), 0).unionByName(made(visual, "visual", F.col("batch"), 1_000_000_000))
    drafts, rejects = fused_production_path(text, visual, originals, branches)
    flat = drafts.select(
        "project_id", "rank", "draft_id", "source_draft_id", "overlap", "title", F.col("scenes")[0]["id"].alias("scene_id"),
        F.col("scenes")[0]["start_s"].alias("start_s"), F.col("scenes")[0]["end_s"].alias("end_s"), "hook", "aspect", "layout", "crop_x",
        "title_style", "title_motion", "title_scale", "title_y", "revision", "subtitles", "origin",
    )
    return flat.unionByName(rejects, allowMissingColumns=True)


def _score_replies(candidates):
    """Replies with gaps, repeats, unknown ids and odd scales, derived from the candidates."""
    k = (F.col("project_id") + F.col("ord")) % 6
    scale = F.when(F.col("project_id") % 3 == 0, F.lit(100)).when(F.col("project_id") % 3 == 1, F.lit(10)).otherwise(F.lit(1))
    copies = F.when(k == 0, F.array(F.lit(1), F.lit(2))).when(k == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return candidates.select(
        "project_id", F.when(k == 2, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("id"),
        F.when(k != 3, F.col("score") * scale).alias("score"), F.when(k == 4, F.lit(" ")).otherwise(F.col("label")).alias("reason"),
        F.when(k == 5, F.col("evidence")).otherwise(F.col("label")).alias("title"), F.col("evidence").alias("hook"),
        F.explode(copies).alias("copy"),
    )


@query
def score_align(spark, d):
    c = A.stored_text(spark, d)
    return SE.align_scores(c.select("project_id", "ord", "id"), _score_replies(c))


@query
def title_align(spark, d):
    c = A.stored_text(spark, d)
    return SE.align_titles(c.select("project_id", "ord", "id", F.col("evidence").alias("label")), _score_replies(c))


def _topic_tables(cues, first=0):
    """Two topics per chunk of eight cues, numbered from ``first``, and reply rows that name them loosely."""
    chunk = F.floor(F.col("cue_idx") / 8).cast("int")
    chunks = cues.groupBy("project_id", chunk.alias("chunk")).agg(F.min("start_s").alias("chunk_start"), F.max("end_s").alias("chunk_end"))
    n = F.col("n")
    topics = chunks.select("project_id", "chunk", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("n")).select(
        "project_id", "chunk", F.concat(F.lit("topic-"), F.col("chunk") * 2 + n + first).alias("topic_id"), F.concat(F.lit("T"), F.col("chunk"), F.lit("."), n).alias("title")
    )
    k = (F.col("project_id") + F.col("chunk")) % 5
    rows = chunks.select(
        "*", F.explode(F.when(k == 0, F.sequence(F.lit(0), F.lit(2))).when(k == 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.lit(1)))).alias("n")
    ).withColumn("k", k)
    replies = rows.select(
        "project_id", "chunk", F.col("n").alias("row_no"),
        F.concat(F.lit("topic-"), first + F.col("chunk") * 2 + F.when(F.col("k") == 2, F.lit(1)).when((F.col("k") == 3) & (n == 1), F.lit(77)).otherwise(n)).alias("topic_id"),
        (F.col("chunk_start") + n * 3 - 5).alias("start_s"),
        F.when((F.col("k") == 2) & (n == 0), F.col("chunk_start") - 9).otherwise(F.col("chunk_end") + n * 7 - 6).alias("end_s"),
    )
    return topics, replies, chunks


@query
def topic_place(spark, d):
    topics, replies, chunks = _topic_tables(A.stored_cues(spark, d))
    placed, rejected = TL.place_topics(topics, replies, chunks)
    return placed.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected, allowMissingColumns=True)


def _exports(spark, d):
    t = A.lineitem_tasks(spark, d)
    return t.select(
        "task_id", F.col("part_id").alias("draft_id"), (F.col("seq") % 3 + 1).cast("int").alias("revision"), "created_at", "seq", "kind", "status"
    )


@query
def completed_exports(spark, d):
    tasks = A.lineitem_tasks(spark, d)
    return R.completed_exports(_exports(spark, d).where(F.col("kind") == "export").drop("kind", "status", "created_at"), tasks)


@query
def draft_export_state(spark, d):
    drafts = A.table(spark, d, "part").select(F.col("p_partkey").alias("draft_id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("revision"))
    x = _exports(spark, d)
    done = x.where((F.col("status") == "completed") & (F.col("kind") == "export")).select("task_id", "draft_id", "revision", "created_at")
    return R.draft_export_state(drafts, done, x)


@query
def candidate_merge(spark, d):
    o = A.table(spark, d, "orders")
    mode = F.when(F.col("l_returnflag") == "A", F.lit("visual")).otherwise(F.lit("subtitle"))
    previous = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("workflow_id"), F.concat_ws("-", mode, A.task_key()).alias("id"), F.col("l_linenumber").alias("ord")
    )
    incoming = o.select(
        F.col("o_orderkey").alias("workflow_id"),
        F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("visual-")).otherwise(F.lit("subtitle-")), F.col("o_custkey")).alias("id"), F.lit(0).alias("ord"),
    )
    return R.merge_candidates(previous, incoming)


@query
def evidence_ownership(spark, d):
    drafts = A.drafts(spark, d)
    workflows = A.table(spark, d, "documents").select(
        F.concat(F.lit("w"), F.col("doc_id")).alias("workflow_id"),
        F.when(F.col("doc_id") % 10 == 0, F.floor(F.col("doc_id") / 20) * 20).otherwise(F.col("doc_id")).alias("project_id"),
        F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("draft-"), F.col("doc_id")))).alias("draft_ids"),
    )
    scenes = drafts.select("project_id", F.explode("scenes").alias("s")).select(
        "project_id", F.concat(F.when(F.col("project_id") % 2 == 0, F.lit("visual-")).otherwise(F.lit("text-")), F.col("s.id")).alias("id"),
        (F.col("s.start_s") + F.when(F.col("project_id") % 6 == 4, F.lit(0.5)).otherwise(F.lit(0.0))).alias("start_s"), F.col("s.end_s").alias("end_s"),
    )
    return R.evidence_ownership(workflows, drafts, scenes)


@query
def claimable_tasks(spark, d):
    return K.claimable_tasks(A.lineitem_tasks(spark, d), ("workflow_id",))


@query
def busy_projects(spark, d):
    return K.busy_projects(A.project_tasks(spark, d))


@query
def promo_plans(spark, d):
    # every four candidates of a project stand for one reply
    c = A.stored_text(spark, d).withColumns(
        {"project_id": F.col("project_id") * 1000 + F.floor((F.col("ord") - 1) / 4), "ord": (F.col("ord") - 1) % 4 + 1}
    )
    k = F.col("project_id") % 5
    replies = c.select(
        "project_id", "ord",
        F.when((k == 0) & (F.col("ord") == 2), F.lit("nobody")).otherwise(F.col("id")).alias("candidate_id"),
        F.when(k == 1, F.lit("Same  Title ")).otherwise(F.col("label")).alias("title"),
        F.when((k == 2) & (F.col("ord") == 1), F.lit(" ")).otherwise(F.concat(F.lit("Hook "), F.when(k == 1, F.lit(1).cast("long")).otherwise(F.col("ord")))).alias("hook"),
    )
    plans, rejects = SE.promo_plans(replies, c)
    flat = plans.select("project_id", "ord", "candidate_id", "title", "hook", F.col("scene.start_s").alias("start_s"), F.col("scene.end_s").alias("end_s"))
    return flat.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


# --- aggregates and folds ------------------------------------------------------------------------


@query
def cue_chunks(spark, d):
    return C.chunk_cues(A.stored_cues(spark, d), max_seconds=240.0, max_bytes=6000).select("project_id", "cue_idx", "chunk")


@query
def speech_coverage(spark, d):
    cues = A.stored_cues(spark, d)
    spans = A.timeline_items(cues).select("project_id", F.col("ord").alias("span_id"), "start_s", "end_s").where(F.col("end_s") > F.col("start_s"))
    return TL.speech_coverage(spans, cues)


@query
def outline_merge(spark, d):
    lines = F.transform(
        F.split("text", "\n"),
        lambda t: F.struct(F.when(F.char_length(t) > 110, F.concat(F.lit("len "), F.char_length(t) % 40)).otherwise(t).alias("title"), F.split(t, "\\. ").alias("subtopics")),
    )
    replies = A.table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("project_id"), (F.col("doc_id") % 4).cast("int").alias("chunk"),
        F.when(F.col("n_chars") % 6 == 0, F.slice(lines, 1, 0)).otherwise(lines).alias("items"),
    )
    topics, report = TL.merge_outlines(replies)
    return topics.select("project_id", "chunk", "topic_id", "title", F.size("subtopics").alias("n_subtopics")).unionByName(
        report.select("project_id", F.col("skipped"), "reason"), allowMissingColumns=True
    )


@query
def timeline_overlap(spark, d):
    cues = A.stored_cues(spark, d)
    snapped, _ = TL.snap_items(A.timeline_items(cues), C.speech_edges(cues))
    r = TL.resolve_overlaps(snapped)
    return r.select("project_id", "snapped", "merged", "shifted", F.posexplode("items").alias("n", "x")).select(
        "project_id", "n", "x.start_s", "x.end_s", "x.label", "snapped", "merged", "shifted"
    )


@query
def timeline_extend(spark, d):
    cues = A.stored_cues(spark, d)
    edges = C.speech_edges(cues)
    resolved = TL.resolve_overlaps(TL.snap_items(A.timeline_items(cues), edges)[0]).where(~F.col("bad"))
    spans = TL.extend_short(resolved, edges, A.profiles(spark, d, cues))
    return spans.select("project_id", "n", "start_s", "end_s", "extended")


@query
def timeline_refine(spark, d):
    cues = A.stored_cues(spark, d)
    return TL.refine_timeline(A.timeline_items(cues), cues, A.profiles(spark, d, cues))[0]


@query
def quality_report(spark, d):
    cues = A.stored_cues(spark, d)
    items = A.timeline_items(cues)
    orphans = items.where((F.col("ord") == 0) & (F.col("project_id") % 9 == 0)).withColumn("project_id", -1 - F.col("project_id"))
    return TL.quality_report(items.unionByName(orphans), cues, A.profiles(spark, d, cues))


def _marks(cues):
    """Forty replies with a score and a title for each project.

    Projects are named by their first cue: a distinct would leave them in very few tasks, each making forty rows of all its projects.
    """
    n = F.col("n")
    projects = cues.where(F.col("cue_idx") == 0)
    return projects.select("project_id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("n")).select(
        "project_id", F.concat(F.lit("text-"), n).alias("id"),
        F.when(n % 9 != 4, (F.col("project_id") * 31 + n * 17) % 101 / 100).alias("score"), F.concat(F.lit("because "), n).alias("reason"),
        F.when(n % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit("Title "), n)).alias("title"), F.concat(F.lit("Hook "), n).alias("hook"),
    )


@query
def text_highlights(spark, d):
    """The text path in one plan: outline, placement, refinement, scores, selection, titles."""
    cues = A.stored_cues(spark, d)
    _, replies, chunks = _topic_tables(cues, first=1)
    topic = lambda i: F.struct(
        F.concat(F.lit("T"), F.col("chunk"), F.lit(f".{i}")).alias("title"), F.array(F.lit("detail")).alias("subtopics")
    )
    outline = chunks.select("project_id", "chunk", F.array(topic(0), topic(1)).alias("items"))
    marks = _marks(cues)
    titled, _ = text_path(cues, chunks, A.profiles(spark, d, cues), outline, replies, marks, marks)
    return titled.select("project_id", "ord", "id", "label", "start_s", "end_s", "evidence", "score", "reason", "rank", "title", "hook")


@query
def highlight_nms(spark, d):
    drafts = A.visual_candidates(spark, d).select(
        "project_id", F.col("id").alias("draft_id"), "ord", "start_s", (F.col("end_s") + 120).alias("end_s"),
        F.when(F.col("label") != "view", F.floor(F.col("score") * 40) / 40).alias("score"),
    )
    return FU.suppress_near_duplicates(drafts)


@query
def workflow_rollup(spark, d):
    return R.rollup_workflows(A.workflow_goals(spark, d), A.lineitem_tasks(spark, d))


@query
def project_status(spark, d):
    return R.project_status(A.project_tasks(spark, d))


@query
def workspace_snapshot(spark, d):
    projects = A.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    orders = A.table(spark, d, "orders")
    flows = orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("body"))
    tasks = A.project_tasks(spark, d).select("project_id", "seq", F.col("task_id").alias("body"))
    # parts, order lines and events of the same keys stand in for drafts, exports and candidates
    drafts = A.table(spark, d, "part").select((F.col("p_partkey") * 7).alias("project_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("body"))
    exports = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("project_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_linestatus").alias("body")
    )
    candidates = A.table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("body"))
    return R.workspace_snapshot(
        projects, {"workflows": flows, "tasks": tasks, "drafts": drafts, "exports": exports, "candidates": candidates}
    )


@query
def disable_subtitles(spark, d):
    drafts = A.drafts(spark, d).withColumn("project_id", F.floor(F.col("project_id") / 5))
    updated, counts = D.disable_subtitles(drafts)
    return updated.select("project_id", "draft_id", "revision", "subtitles").join(counts, "project_id")


@query
def draft_duration(spark, d):
    return D.draft_durations(A.drafts(spark, d))


@query
def goal_failures(spark, d):
    return R.goal_failures(A.workflow_goals(spark, d).withColumn(
        "status", F.when(F.col("n_drafts") == 1, F.lit("failed")).otherwise(F.col("status"))))


# --- windows and ranking --------------------------------------------------------------------------


@query
def select_candidates(spark, d):
    cues = A.stored_cues(spark, d)
    return SE.select_candidates(A.text_candidates(cues), A.profiles(spark, d, cues)).select("project_id", "id", "rank", "score")


@query
def playable_topk(spark, d):
    events = A.visual_candidates(spark, d).select(F.floor(F.col("ord") / 10).alias("reply_id"), "ord", "kind", "score")
    return V.playable(events, key="reply_id")


@query
def task_steps(spark, d):
    log = A.event_log(spark, d).select(
        "task_id", "ts", "seq", F.when(F.col("event_type") == "view", F.lit("queued")).when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("stage"),
        (F.col("value") > 250).alias("done"),
    )
    return K.task_steps(log)


@query
def monotone_progress(spark, d):
    return K.monotone_progress(_progress_lines(spark, d)).select("op_id", "seq", "percent")


def _progress_lines(spark, d):
    v = F.col("value")
    line = (
        F.when(F.col("event_type") == "view", F.lit("out_time_us=N/A"))
        .when(F.col("event_type") == "error", F.concat(F.lit("whisper: progress = "), F.floor(v).cast("int"), F.lit("%")))
        .otherwise(F.concat(F.lit("out_time_us="), F.floor(v * 100000).cast("long")))
    )
    log = A.event_log(spark, d).select(F.col("task_id").alias("op_id"), "ts", "seq", line.alias("line"))
    return log.withColumn("percent", K.line_percent(F.col("line"), F.lit(40.0), F.lit(98.0)))


@query
def snapshot_changes(spark, d):
    log = A.event_log(spark, d).select(
        "task_id", "ts", "seq", F.when(F.col("value") > 300, F.lit("completed")).otherwise(F.lit("running")).alias("status"),
        F.floor(F.col("value") / 60).alias("percent"),
    )
    return K.snapshot_changes(log, ("status", "percent")).select("task_id", "seq", "status", "percent")


def _arrivals(spark, d):
    v = F.col("value")
    return A.event_log(spark, d).select(
        "task_id", "ts", "seq", (F.col("ts") - F.make_dt_interval(hours=(F.col("seq") % 40).cast("int"))).alias("updated_at"),
        F.when(v > 350, F.lit("failed")).when(v < 1, F.lit("lost")).otherwise(F.lit("running")).alias("status"),
        F.when(F.col("event_type") != "view", v / 3).alias("percent"),
    )


@query
def latest_snapshot(spark, d):
    return K.latest_snapshot(_arrivals(spark, d)).select("task_id", "seq", "status", "percent")


@query
def accepted_snapshots(spark, d):
    return K.accepted_snapshots(_arrivals(spark, d)).select("task_id", "seq")


@query
def edl_position(spark, d):
    positions = A.table(spark, d, "events").select(
        F.col("event_id").alias("position_id"), F.concat(F.lit("draft-"), F.col("user_id")).alias("draft_id"), F.col("value").alias("position_s")
    )
    return D.edl_position(A.drafts(spark, d), positions)


@query
def revision_merge(spark, d):
    base = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4 + 1).cast("int").alias("revision"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    edits = A.table(spark, d, "orders").select(
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, F.lit(10_000_000)).otherwise(F.lit(0))).alias("id"),
        F.col("o_orderkey").alias("edit_no"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("base_revision"), F.col("o_orderpriority").alias("title"),
    )
    merged, conflicts = D.merge_revisions(base, edits, ("title",))
    return merged.withColumn("part", F.lit("merged")).unionByName(conflicts.withColumn("part", F.lit("conflict")), allowMissingColumns=True)


# --- generators -----------------------------------------------------------------------------------


def _durations(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("project_id"), ((F.col("n_chars") - 200) / 37).alias("duration"))


@query
def second_samples(spark, d):
    return S.second_samples(_durations(spark, d))


@query
def sparse_samples(spark, d):
    return S.sparse_samples(_durations(spark, d))


@query
def sample_request(spark, d):
    lengths = F.transform(F.split("text", "\n"), lambda t: F.char_length(t) / 7 - 1)
    reqs = A.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), (F.col("n_chars") / 9).alias("duration"), lengths.alias("times"))
    out = S.validate_samples(reqs)
    return out.select("request_id", "reason", F.size("normalized").alias("n"), F.aggregate("normalized", F.lit(0).cast("long"), lambda a, t: a + F.round(t * 1000).cast("long")).alias("sum_ms"))


@query
def screening_request(spark, d):
    """The four frames by which a source is screened, as a sample request; sources that are too short are refused."""
    duration = F.when(F.col("doc_id") % 20 == 3, (F.col("n_chars") % 3) / 20).otherwise(F.col("n_chars") / 9)
    reqs = A.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), duration.alias("duration"), S.screening_times(duration).alias("times"))
    out = S.validate_samples(reqs)
    at = lambda i: F.get("normalized", i)
    return out.select("request_id", "reason", at(1).alias("second_s"), at(2).alias("third_s"), at(3).alias("last_s"))


@query
def even_downsample(spark, d):
    return S.even_downsample(_frames(spark, d), 25)


@query
def review_times(spark, d):
    windows = A.visual_candidates(spark, d).select(F.col("ord").alias("window_id"), "start_s", "end_s", (F.col("end_s") - F.col("ord") % 3).alias("duration"))
    return S.review_times(windows)


@query
def add_context(spark, d):
    c = A.visual_candidates(spark, d).select("project_id", "id", "start_s", "end_s", F.lit(30.0).alias("target"), (F.col("end_s") + F.col("ord") % 4 - 1).alias("duration"))
    return V.add_context(c)


@query
def trim_event(spark, d):
    v = A.visual_candidates(spark, d)
    spread = F.col("ord") % 5 * 2.5
    events = v.select(
        "id", "start_s", "end_s", F.array(F.col("start_s") + spread, F.col("start_s") + spread * 3).alias("frame_times"),
        F.greatest(F.lit(0.0), F.col("start_s") - 2).alias("win_start"), (F.col("end_s") + 2).alias("win_end"), F.lit(6.0).alias("max_s"),
    )
    return V.trim_events(events).drop("frame_times")


# --- visual replies, identity, edits --------------------------------------------------------------


def _visual_replies(spark, d):
    """Ten consecutive events as one visual reply; a reply is one row."""
    start = F.floor(A._event_ms() / 360)
    n = F.col("event_id")
    e = A.table(spark, d, "events").withColumn("s", (start / 1000)).withColumn("len", F.floor(F.col("value") * 100) / 1000)
    event = F.struct(
        n.alias("n"),
        F.struct(
            F.when(n % 97 == 0, F.lit("bad id")).when(n % 89 == 1, F.lit("e")).otherwise(F.concat(F.lit("e"), n)).alias("id"),
            F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("event_type")).alias("label"),
            F.col("s").alias("start_s"), (F.col("s") + F.col("len")).alias("end_s"), F.col("props").alias("evidence"),
            F.when(F.col("event_type") == "view", F.lit("")).when(n % 113 == 0, F.lit("party")).otherwise(F.lit("gameplay")).alias("kind"),
            F.when(F.col("event_type") != "error", F.when(F.col("value") > 300, F.lit(100.5)).otherwise(F.least(F.col("value"), F.lit(100.0)))).alias("score"),
            F.lit("").alias("selection_reason"),
            F.array(F.col("s") + 0.02, F.col("s") + F.col("len")).alias("frame_times"),
        ).alias("e"),
    )
    return (
        e.groupBy(F.floor(n / 10).alias("reply_id"))
        .agg(
            F.array_sort(F.collect_list(event)).alias("xs"), F.array_sort(F.concat(F.collect_list("s"), F.collect_list(F.col("s") + F.col("len")))).alias("frames"),
            F.min("s").alias("win_start"), F.max(F.col("s") + F.col("len")).alias("win_end"),
        )
        .select("reply_id", F.col("xs.e").alias("events"), "frames", "win_start", "win_end", F.lit(9.0).alias("max_s"))
    )


@query
def visual_validate(spark, d):
    events, rejects = V.validate_visual(_visual_replies(spark, d))
    flat = events.select("reply_id", "ord", "id", "label", "start_s", "end_s", "kind", "score", F.size("frame_times").alias("n_cited"), F.element_at("frame_times", 1).alias("first_cited"))
    return flat.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


@query
def visual_highlights(spark, d):
    """The visual path in one plan: replies, playable events, review, context, drafts."""
    replies = _visual_replies(spark, d)
    scan = materialize(visual_scan(replies)[0], "visual-scan")
    k = F.col("project_id")
    refine = scan.where(F.col("rank") == 1).select(
        "project_id", (k % 3 != 0).alias("ok"), F.when(k % 5 == 0, F.lit("other")).otherwise(F.col("id")).alias("id"),
        (F.col("start_s") + 0.5).alias("start_s"), (F.col("end_s") + 0.25).alias("end_s"), (F.col("score") / 2).alias("score"),
        F.when(k % 4 == 0, F.lit("loading")).otherwise(F.lit("gameplay")).alias("kind"),
    )
    projects = replies.select(F.col("reply_id").alias("project_id"), F.lit(30.0).alias("target"), F.col("win_end").alias("duration"))
    return visual_path(scan, refine, projects)


@query
def frame_sets(spark, d):
    """Frames of every user; some times repeat, some lie behind the end, some projects have no frames or are unknown."""
    start, user, k = F.floor(A._event_ms() / 36000), F.col("user_id"), F.col("c_custkey")
    owner = F.when(user % 17 == 4, -user).otherwise(user)  # no project has a negative id
    frames = A.table(spark, d, "events").select(owner.alias("project_id"), (start / 10).alias("time_s"), F.col("props").alias("content"))
    projects = A.table(spark, d, "customer").select(k.alias("project_id"), F.when(k % 5 == 0, F.lit(5000.0)).otherwise(F.lit(1e6)).alias("duration"))
    sets, rejects = V.prepare_frames(frames, projects, max_frames=100)
    return sets.unionByName(rejects, allowMissingColumns=True)


@query
def refine_apply(spark, d):
    events = A.visual_candidates(spark, d).select(F.floor(F.col("ord") / 10).alias("project_id"), "ord", "id", "start_s", "end_s", "score", "kind")
    ranks = V.playable(events).select("project_id", "ord", "rank")
    scan = events.join(ranks, ["project_id", "ord"], "left")
    refine = scan.where(F.col("rank") == 1).select(
        "project_id", (F.col("project_id") % 3 != 0).alias("ok"),
        F.when(F.col("project_id") % 5 == 0, F.lit("other")).otherwise(F.col("id")).alias("id"),
        (F.col("start_s") + 0.5).alias("start_s"), (F.col("end_s") + 0.25).alias("end_s"), (F.col("score") / 2).alias("score"),
        F.when(F.col("project_id") % 4 == 0, F.lit("loading")).otherwise(F.lit("gameplay")).alias("kind"),
    )
    return V.apply_refinement(scan, refine)


@query
def draft_ids(spark, d):
    rows = A.lineitem_tasks(spark, d).select("task_id", F.col("workflow_id").cast("string").alias("workflow_id"), "goal", F.col("task_id").alias("draft_id"), (F.col("seq") % 10).alias("i"))
    return D.draft_ids(rows)


@query
def checkpoint_lineage(spark, d):
    c = A.table(spark, d, "conversations")
    stages = c.select(F.col("conv_id").alias("run_id"), F.col("turn").cast("int").alias("n"), F.concat(F.lit("stage-"), F.col("turn")).alias("stage"), F.col("role").alias("input"), F.col("text").alias("data"))
    k = (F.col("conv_id") + F.col("turn")) % 5
    saved = c.select(
        F.col("conv_id").alias("run_id"), F.concat(F.lit("stage-"), F.col("turn")).alias("stage"),
        F.when(k == 0, F.lit("old")).otherwise(F.lit(K.VERSION)).alias("version"),
        F.sha2(F.when(k == 1, F.lit("x")).otherwise(F.col("role")), 256).alias("input_hash"), F.lit("").alias("previous"),
        F.sha2(F.when(k == 2, F.lit("y")).otherwise(F.col("text")), 256).alias("data_hash"),
    )
    return K.checkpoint_lineage(stages, saved)


def _titled(spark, d):
    c = A.text_candidates(A.cues(spark, d))
    return c.select(
        "project_id", F.concat(F.lit("wf-"), F.col("project_id")).alias("workflow_id"), (F.col("ord") - 1).cast("int").alias("i"), "id", "label",
        "start_s", "end_s", "evidence", F.concat(F.lit("Title "), F.col("label")).alias("title"), F.concat(F.lit("Hook "), F.col("ord")).alias("hook"),
        A.goal_of(F.col("ord")).alias("goal"), F.lit("subtitle").alias("route"),
        F.when(F.col("project_id") % 2 == 0, F.lit("portrait")).otherwise(F.lit("original")).alias("aspect"), (F.col("project_id") % 3 == 0).alias("burn_subtitles"),
        F.when(F.col("ord") % 10 == 7, F.lit("python-engine")).alias("origin"),
    )


@query
def draft_assemble(spark, d):
    return D.assemble_drafts(_titled(spark, d)).select(
        "project_id", "workflow_id", "goal", "draft_id", "title", "hook", F.col("scenes")[0]["id"].alias("scene_id"), F.col("scenes")[0]["start_s"].alias("start_s"),
        "aspect", "layout", "title_enabled", "subtitles", "origin",
    )


@query
def export_schedule(spark, d):
    drafts = D.assemble_drafts(_titled(spark, d))
    flows = A.table(spark, d, "documents").select(F.concat(F.lit("wf-"), F.col("doc_id")).alias("workflow_id"), (F.col("n_chars") % 2 == 0).alias("auto_export"))
    return D.schedule_exports(drafts, flows)


@query
def scene_edits(spark, d):
    edits = A.table(spark, d, "documents").select(
        F.concat(F.when(F.col("n_chars") % 13 == 0, F.lit("none-")).otherwise(F.lit("draft-")), F.col("doc_id")).alias("draft_id"),
        F.element_at(F.array(F.lit("move"), F.lit("append"), F.lit("replace")), (F.col("doc_id") % 3 + 1).cast("int")).alias("op"),
        (F.col("n_chars") % 9).cast("int").alias("index"), F.when(F.col("n_chars") % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("delta"),
        F.struct(F.lit("new").alias("id"), F.col("source").alias("label"), F.lit(1.0).alias("start_s"), F.lit(4.5).alias("end_s"), F.lit("").alias("evidence")).alias("scene"),
    )
    out = D.apply_scene_edits(A.drafts(spark, d), edits)
    return out.select("draft_id", "op", "reason", F.array_join(F.transform("scenes", lambda s: s["id"]), ",").alias("scene_ids"))


@query
def draft_lineage(spark, d):
    reqs = A.table(spark, d, "events").select(
        F.concat(F.lit("draft-"), F.col("user_id")).alias("draft_id"), F.concat(F.lit("copy-"), F.col("event_id")).alias("new_id"), F.col("event_type").alias("new_title")
    )
    return D.duplicate_drafts(A.drafts(spark, d).drop("scenes"), reqs).select("draft_id", "title", "revision", "parent_draft_id", "parent_revision", "aspect", "reason")


@query
def goal_route(spark, d):
    return O.route_goals(_plans(spark, d).select("plan_id", "mode", "allow_visual", "goals"))


@query
def route_candidates(spark, d):
    """Candidates of the routes that a workflow runs for its open goals, one workflow per customer."""
    k = F.col("c_custkey")
    customers = A.table(spark, d, "customer")
    plans = customers.select(k.alias("workflow_id"), F.when(k % 3 == 0, F.lit("auto")).when(k % 3 == 1, F.lit("visual")).otherwise(F.lit("subtitle")).alias("mode"), (k % 2 == 0).alias("allow_visual"))
    goals = customers.select(k.alias("workflow_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g")).select(
        "workflow_id", A.goal_of(F.col("g")).alias("goal"), ((F.col("workflow_id") + F.col("g")) % 3).cast("int").alias("n_drafts"))
    routes = F.array(F.lit("subtitle"), F.lit("visual"))
    analyses = customers.select(k.alias("workflow_id"), F.explode(routes).alias("route")).select(
        "workflow_id", "route", (~((F.col("workflow_id") % 7 == 0) & (F.col("route") == "visual"))).alias("ok"))
    of = lambda c, route: c.select(F.col("project_id").alias("workflow_id"), F.lit(route).alias("route"), "id", "start_s", "score")
    candidates = of(A.text_candidates(A.cues(spark, d)), "subtitle").unionByName(of(A.visual_candidates(spark, d), "visual"))
    return O.combine_routes(O.open_goals(goals, plans), analyses, candidates)


@query
def timeline_check(spark, d):
    """Stored timelines checked again: spans of four cues, with planted faults of every kind."""
    spark = keyed_session(spark)  # a project is bounded, and all steps keep to it
    cues = materialize_by(A.cues(spark, d), "project_id", "cues")
    k, o = F.col("project_id"), F.col("ord")
    spans = A.text_candidates(cues).select("project_id", F.col("ord").alias("span_id"), "id", "label", "start_s", "end_s")
    faulty = lambda n, bad, good: F.when((k % 13 == n) & (o == 2), bad).otherwise(good)
    candidates = materialize_by(TL.evidence_excerpt(spans, cues), "project_id", "timelines").withColumnRenamed("span_id", "ord").select(
        "project_id", "ord", faulty(1, F.lit("text-9"), F.col("id")).alias("id"), faulty(2, F.lit(" "), F.col("label")).alias("label"),
        faulty(3, F.col("start_s") - 2, F.col("start_s")).alias("start_s"), faulty(4, F.col("end_s") + 0.5, F.col("end_s")).alias("end_s"),
        faulty(5, F.lit("else"), F.col("evidence")).alias("evidence"), faulty(6, F.lit(0.5), F.lit(0.0)).alias("score"),
        faulty(7, F.lit("other"), F.lit("text")).alias("kind"),
    )
    report = candidates.groupBy("project_id").agg((F.count(F.lit(1)) + F.when(k % 13 == 8, 1).otherwise(0)).alias("output")).withColumn(
        "over_tier", F.when(k % 13 == 9, F.lit(3)).otherwise(F.lit(0)))
    profile = A.profiles(spark, d, cues).withColumns({"min_s": F.lit(1.0), "max_s": F.lit(1e4), "hard_max_s": F.when(k % 13 == 10, F.lit(40.0)).otherwise(F.lit(1800.0))})
    return TL.check_timeline(candidates, report, cues, profile)


@query
def export_snapshot(spark, d):
    reqs = A.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("draft-"), F.col("user_id") * 9).alias("draft_id"), (F.col("event_id") % 3 + 1).cast("int").alias("requested_revision")
    )
    ok, conflicts = D.snapshot_exports(A.drafts(spark, d).select("draft_id", "revision", "title", "aspect"), reqs)
    body = F.from_json("body", "title string, aspect string")
    return ok.select("request_id", "draft_id", "revision", body["title"].alias("title"), body["aspect"].alias("aspect")).unionByName(
        conflicts.select("request_id", "draft_id", F.col("requested_revision").alias("revision"), "reason"), allowMissingColumns=True
    )


# --- batch twins of the streaming operators --------------------------------------------------------


@query
def heartbeat_expiry(spark, d):
    log = A.event_log(spark, d)
    tasks = log.groupBy("task_id").agg(F.max("ts").alias("heartbeat"), F.max_by("event_type", F.struct("ts", "seq")).alias("last_type")).select(
        "task_id", "heartbeat", F.when(F.col("last_type") == "purchase", F.lit("completed")).otherwise(F.lit("running")).alias("status"),
        F.lit(False).alias("retryable"), F.lit("").alias("error"),
    )
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return K.expire_heartbeats(tasks, now).drop("heartbeat")


@query
def task_state_stream(spark, d):
    return K.fold_task_log(A.command_log(spark, d)).select("task_id", "status", "stage", "percent", "cancel_requested")


@query
def lease_fence(spark, d):
    log = A.event_log(spark, d)
    updates = log.select("task_id", "seq", F.concat(F.lit("lease-"), F.col("seq") % 3).alias("lease_id"))
    leases = log.groupBy("task_id").agg(
        F.concat(F.lit("lease-"), F.col("task_id") % 3).alias("lease_id"), F.when(F.max("value") > 250, F.lit("failed")).otherwise(F.lit("running")).alias("status")
    )
    return K.fence_leases(updates, leases)


# --- streaming runs over the event table (file source, availableNow) -------------------------------


def _event_stream(spark, d):
    schema = A.table(spark, d, "events").schema
    reader = stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 16)
    return reader.option("pathGlobFilter", "events.parquet").parquet(d)


@query
def snapshot_stream(spark, d):
    v, seq, ts = F.col("value"), F.col("event_id"), F.col("ts").cast("timestamp")
    feed = _event_stream(spark, d).select(
        F.col("user_id").alias("task_id"), ts.alias("ts"), seq.alias("seq"), (ts - F.make_dt_interval(hours=(seq % 40).cast("int"))).alias("updated_at"),
        F.when(v > 350, F.lit("failed")).when(v < 1, F.lit("lost")).otherwise(F.lit("running")).alias("status"),
        F.when(F.col("event_type") != "view", v / 3).alias("percent"),
    )
    return run_available(ST.snapshot_stream(feed), spark, "snapshots").select("task_id", "seq", "status")


@query
def progress_stream(spark, d):
    v = F.col("value")
    line = (
        F.when(F.col("event_type") == "view", F.lit("out_time_us=N/A"))
        .when(F.col("event_type") == "error", F.concat(F.lit("whisper: progress = "), F.floor(v).cast("int"), F.lit("%")))
        .otherwise(F.concat(F.lit("out_time_us="), F.floor(v * 100000).cast("long")))
    )
    lines = _event_stream(spark, d).select(
        F.col("user_id").alias("op_id"), F.col("event_id").alias("seq"), line.alias("line"), F.lit(40.0).alias("duration"), F.lit(98.0).alias("scale")
    )
    return run_available(ST.progress_stream(lines), spark, "progress")


@query
def heartbeat_expiry_stream(spark, d):
    feed = _event_stream(spark, d).select(
        F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") > 350, F.lit("completed")).otherwise(F.lit("running")).alias("status"),
    )
    return run_available(ST.expire_heartbeats(feed, seconds=36000), spark, "heartbeats")


@query
def task_fold_stream(spark, d):
    log = A.command_log(spark, d, _event_stream(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    newest = run_updates(ST.fold_tasks(log), spark, ["task_id"], "applied", "folded")
    return newest.select("task_id", "status", "stage", "percent", "cancel_requested")


@query
def lease_fence_stream(spark, d):
    e = _event_stream(spark, d)
    updates = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.concat(F.lit("lease-"), F.col("event_id") % 3).alias("lease_id"))
    leases = A.table(e.sparkSession, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(
        F.concat(F.lit("lease-"), F.col("task_id") % 3).alias("lease_id"), F.when(F.max("value") > 250, F.lit("failed")).otherwise(F.lit("running")).alias("status")
    )
    return run_available(ST.fence_stream(updates, leases), spark, "fenced")


@query
def lease_version_stream(spark, d):
    """Leases that change while updates arrive: the feed of views grants them, the other events use them."""
    e = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    holder = F.concat(F.lit("lease-"), F.floor(F.col("event_id") / 3) % 2)
    updates = e.where("event_type <> 'view'").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", holder.alias("lease_id"))
    leases = _event_stream(e.sparkSession, d).where("event_type = 'view'").select(
        F.col("user_id").alias("task_id"), holder.alias("lease_id"), F.col("ts").cast("timestamp").alias("granted_at"),
        F.when(F.col("value") > 120, F.lit("failed")).otherwise(F.lit("running")).alias("status"),
    )
    return run_available(ST.fence_versions(updates, leases, "1 hour", "2 days"), spark, "lease-versions").select("task_id", "seq", "lease_id")


@query
def expiry_refresh_stream(spark, d):
    """Tasks that expire in the event stream, on into the workflows and projects that they belong to."""
    feed = _event_stream(spark, d).select(
        F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") > 350, F.lit("completed")).otherwise(F.lit("running")).alias("status"),
    )
    k = F.col("task_id")
    tasks = materialize(A.table(spark, d, "events").select(F.col("user_id").alias("task_id")).distinct().select(
        "task_id", F.floor(k / 8).alias("project_id"), F.floor(k / 4).alias("workflow_id"),
        F.when(k % 4 == 0, F.lit("analyze")).otherwise(F.lit("export")).alias("kind"), A.goal_of(k % 4).alias("goal"), k.alias("seq"),
        F.when(k % 5 == 0, F.lit("completed")).when(k % 5 == 1, F.lit("failed")).otherwise(F.lit("running")).alias("status"),
        F.when(k % 5 == 1, F.lit("E")).otherwise(F.lit("")).alias("error"),
    ), "refresh-tasks")
    goals = tasks.select("workflow_id").distinct().select(
        "workflow_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g")
    ).select("workflow_id", A.goal_of(F.col("g")).alias("goal"), F.lit("analyzing").alias("status"), F.lit("").alias("error"), (F.col("g") % 2).cast("int").alias("n_drafts"))
    flows, projects = refresh_expired(ST.expire_heartbeats(feed, seconds=36000), spark, tasks, goals)
    return flows.select(F.lit("workflow").alias("what"), F.col("workflow_id").alias("id"), "goal", F.col("goal_status").alias("status"), F.col("goal_error").alias("error"), "workflow_status").unionByName(
        projects.select(F.lit("project").alias("what"), F.col("project_id").alias("id"), "status", "error"), allowMissingColumns=True
    )
