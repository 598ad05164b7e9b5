"""Media metadata sources: probe output, engine event logs, manifests, tracks and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import interval_join
from ..functions.media_time import finite
from ..functions.text import first_reason

MAX_SECONDS = 7200.0
MAX_BYTES = 4 << 30
# Accepted containers, and subtitle languages in order of preference.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".mov", ".webm", ".avi", ".m4v", ".flv", ".ts")
LANGUAGES = ("ai-zh", "zh-Hans", "zh-CN", "zh", "en")
TRACK_SOURCES = ("uploaded", "platform", "existing", "asr")
DEFAULT_LABEL = "片段"

PROBE_SCHEMA = (
    "streams array<struct<codec_type string, width int, height int, duration string,"
    " tags struct<rotate string>, side_data_list array<struct<rotation double>>,"
    " disposition struct<attached_pic int>>>, format struct<duration string>"
)


def parse_probe(raw: DataFrame, id_col: str = "project_id", json_col: str = "probe") -> DataFrame:
    """Probe JSON -> ``id, duration, width, height, has_audio, reason``."""
    zero = F.lit(0.0)

    def rotation(s: Column) -> Column:
        sides = s["side_data_list"]
        tag = F.coalesce(s["tags"]["rotate"].try_cast("double"), zero)
        return F.when(
            F.coalesce(F.size(sides), F.lit(0)) > 0,
            F.coalesce(F.try_element_at(sides, F.lit(-1))["rotation"], zero),
        ).otherwise(tag)

    def shape(s: Column) -> Column:
        w, h = F.coalesce(s["width"], F.lit(0)), F.coalesce(s["height"], F.lit(0))
        turned = F.abs(rotation(s) % 180) == 90
        return F.struct(
            F.when(turned, h).otherwise(w).alias("w"),
            F.when(turned, w).otherwise(h).alias("h"),
            F.coalesce(s["duration"].try_cast("double"), zero).alias("d"),
            F.coalesce(s["disposition"]["attached_pic"], F.lit(0)).alias("pic"),
        )

    p = raw.select(id_col, F.from_json(json_col, PROBE_SCHEMA).alias("p"))
    empty = F.array().cast("array<struct<w int, h int, d double, pic int>>")
    videos = F.coalesce(
        F.transform(F.filter("p.streams", lambda s: s["codec_type"] == "video"), shape), empty
    )
    p = p.withColumn("videos", videos)
    chosen = F.try_element_at(F.filter("videos", lambda v: (v["w"] != 0) | (v["pic"] != 0)), F.lit(1))
    container = F.coalesce(F.col("p.format.duration").try_cast("double"), zero)
    p = p.withColumn("v", chosen).withColumn(
        "duration", F.when(finite(container) & (container > 0), container).otherwise(F.col("v.d"))
    )
    bounded = F.col("v.w").between(2, 16384) & F.col("v.h").between(2, 16384)
    reason = first_reason(
        (F.col("v.pic") != 0, "attached_picture"),
        (~F.coalesce(bounded & finite(F.col("duration")) & (F.col("duration") > 0), F.lit(False)), "no_video"),
        (F.col("duration") > MAX_SECONDS, "too_long"),
    )
    ok = reason.isNull()
    return p.select(
        id_col,
        F.when(ok, F.col("duration")).alias("duration"),
        F.when(ok, F.col("v.w")).alias("width"),
        F.when(ok, F.col("v.h")).alias("height"),
        F.when(
            ok, F.coalesce(F.exists("p.streams", lambda s: s["codec_type"] == "audio"), F.lit(False))
        ).alias("has_audio"),
        reason.alias("reason"),
    )


ENGINE_SCHEMA = "type string, stage string, percent double, message string"


def fold_engine_events(
    lines: DataFrame, job_col: str = "job_id", order_col: str = "seq", line_col: str = "line"
) -> DataFrame:
    """NDJSON engine log -> one verdict per job.  Plain aggregates, so partial results combine map-side."""
    e = lines.select(job_col, order_col, F.from_json(line_col, ENGINE_SCHEMA).alias("e"))
    kind, stage = F.col("e.type"), F.coalesce(F.col("e.stage"), F.lit(""))
    pct = F.coalesce(F.col("e.percent"), F.lit(0.0))
    progress = kind == "progress"
    bad = first_reason(
        (kind.isNull(), "invalid_json"),
        (progress & ((stage == "") | (pct < 0) | (pct > 100)), "invalid_progress"),
        ((kind == "error") & (F.coalesce(F.col("e.message"), F.lit("")) == ""), "error_without_message"),
        (kind == "error", "engine_error"),
        (~kind.isin("progress", "result"), "unknown_event"),
    )
    e = e.withColumn("bad", bad)
    good = progress & F.col("bad").isNull()
    folded = e.groupBy(job_col).agg(
        F.count_if(kind == "result").alias("n_results"),
        F.max_by(stage, F.when(good, F.col(order_col))).alias("last_stage"),
        F.max_by(pct, F.when(good, F.col(order_col))).alias("last_percent"),
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col(order_col))).alias("first_bad"),
    )
    reason = F.coalesce(
        F.col("first_bad"),
        first_reason((F.col("n_results") > 1, "more_than_one_result"), (F.col("n_results") == 0, "no_result")),
    )
    return folded.select(
        job_col, reason.isNull().alias("ok"), "n_results", "last_stage", "last_percent", reason.alias("reason")
    )


def engine_candidate_rows(results: DataFrame, projects: DataFrame, *payload: str) -> DataFrame:
    """Engine results with project duration, mapped to candidate columns, plus ``payload`` and ``bad`` per row."""
    joined = results.join(projects.select("project_id", "duration"), "project_id", "left")  # unknown project: bad
    label = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.lit(DEFAULT_LABEL)).otherwise(F.col("title"))
    bad = (
        (F.coalesce(F.col("id"), F.lit("")) == "")
        | (F.col("start_s") < 0)
        | (F.col("end_s") <= F.col("start_s"))
        | (F.col("end_s") > F.col("duration") + 0.001)
    )
    return joined.select(
        "project_id", "seq", "id", label.alias("label"), "start_s", "end_s",
        F.col("reason").alias("evidence"), (F.col("score") / 100).alias("score"), F.lit("other").alias("kind"),
        F.coalesce(bad, F.lit(True)).alias("bad"), *payload,
    )


def engine_candidates(results: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(candidates, rejected projects)``: one bad row rejects the project."""
    rows = engine_candidate_rows(results, projects)
    rejected = rows.where("bad").select("project_id").distinct().withColumn("reason", F.lit("invalid_boundary"))
    return rows.drop("bad").join(rejected, "project_id", "left_anti"), rejected


def clean_path(path: Column, base: str) -> Column:
    """``path`` without ``.``, ``..`` and repeated slashes; a relative one is taken from ``base``."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
        F.concat(acc, F.array(x))
    )
    kept = F.aggregate(parts, F.array().cast("array<string>"), up)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def engine_drafts(results: DataFrame, projects: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """``(drafts, rejects)``: a draft of one scene for every engine candidate, with what its framing needs.

    ``results``: as for ``engine_candidates`` with hook and crop_path; ``projects``: project_id, duration, aspect.  One bad
    boundary, or a crop path outside of ``workspace``, rejects the project, and so does a project without candidates.
    """
    rows = engine_candidate_rows(results, projects, "hook", "crop_path")
    path = clean_path(F.coalesce("crop_path", F.lit("")), workspace)
    root = "/" + workspace.strip("/")
    reason = first_reason(
        (F.col("bad"), "invalid_boundary"), (~F.startswith(path, F.lit(root + "/")), "unsafe_crop_path")
    )
    checked = rows.withColumns({"crop_path": path, "reason": reason})
    # A boundary is checked before the path, candidate by candidate.
    first = checked.where(F.col("reason").isNotNull()).groupBy("project_id").agg(F.min_by("reason", "seq").alias("reason"))
    empty = projects.join(results.select("project_id").distinct(), "project_id", "left_anti").select(
        "project_id", F.lit("no_candidates").alias("reason")
    )
    good = checked.drop("reason", "bad").join(first.select("project_id"), "project_id", "left_anti")
    drafts = good.join(projects.select("project_id", "aspect"), "project_id").select(
        "project_id", "seq", F.substring(F.sha2(F.concat_ws(":", "project_id", F.lit("engine"), "id"), 256), 1, 32).alias("draft_id"),
        F.col("label").alias("title"), F.coalesce("hook", F.lit("")).alias("hook"),
        F.array(F.struct("id", "label", "start_s", "end_s", "evidence")).alias("scenes"), "start_s", "end_s", "aspect",
        F.lit(True).alias("subtitles"), F.lit("python-engine").alias("origin"), F.lit("content").alias("goal"), "crop_path",
        F.when(F.col("aspect") == "portrait", F.lit("9:16")).otherwise(F.lit("16:9")).alias("ratio"),
    )
    return drafts, first.unionByName(empty)


def draft_words(drafts: DataFrame, words: DataFrame) -> DataFrame:
    """Words that an engine draft captions: ``draft_id, seq, text, start_s, end_s, speaker``, clipped to nothing.

    ``words``: project_id, seq, text, start_s, end_s, speaker.  Those outside of the draft's span are left with the project,
    since its captions can never show them.
    """
    spans = drafts.select("project_id", "draft_id", F.col("start_s").alias("d0"), F.col("end_s").alias("d1"))
    met = interval_join(spans, words, ["project_id"], ("d0", "d1"), ("start_s", "end_s"))
    return met.where((F.col("start_s") < F.col("d1")) & (F.col("end_s") > F.col("d0"))).select(
        "draft_id", "seq", "text", "start_s", "end_s", "speaker"
    )


def media_manifest(files: DataFrame) -> DataFrame:
    """``path, size, duration`` -> ``path, ok, reason``."""
    ext = F.lower(F.regexp_extract("path", "(\\.[^./]*)\\z", 1))
    reason = first_reason(
        (~ext.isin(*VIDEO_EXTENSIONS), "extension"),
        (F.coalesce(F.col("size") <= 0, F.lit(True)), "empty"),
        (F.col("size") > MAX_BYTES, "too_large"),
        (~finite(F.col("duration")) | (F.col("duration") <= 0) | (F.col("duration") > MAX_SECONDS), "duration"),
    )
    return files.select("path", reason.isNull().alias("ok"), reason.alias("reason"))


def pick_track(tracks: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Preferred subtitle file per project, else the first by name; none if it has no cues."""
    prefs = F.array(*[F.lit(x) for x in languages])
    at = F.array_position(prefs, F.col("lang"))
    rank = F.when(at > 0, at).otherwise(F.lit(len(languages) + 1).cast("long"))
    best = tracks.groupBy("project_id").agg(
        F.min_by(F.struct("file", "lang", "n_cues"), F.struct(rank.alias("r"), F.col("file"))).alias("t")
    )
    usable = F.col("t.n_cues") > 0
    return best.select(
        "project_id",
        F.when(usable, F.col("t.file")).alias("track"),
        F.when(usable, F.col("t.lang")).alias("lang"),
    )


def resolve_transcripts(tracks: DataFrame, cues: DataFrame, projects: DataFrame) -> DataFrame:
    """Transcript used per project: uploaded, platform, existing, then recognised speech.

    ``tracks``: project_id, source; ``cues``: project_id, source, start_s, end_s; ``projects``:
    project_id, duration.  Every step is a keyed aggregate with partial results.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in TRACK_SOURCES]), F.col("source"))
    chosen = (
        tracks.where(order > 0)
        .groupBy("project_id")
        .agg(F.min_by("source", order).alias("source"))
    )
    stats = cues.groupBy("project_id", "source").agg(
        F.count(F.lit(1)).alias("n_cues"),
        F.max("end_s").alias("last_end"),
        F.bool_or((F.col("start_s") < 0) | (F.col("end_s") <= F.col("start_s"))).alias("bad"),
    )
    joined = (
        projects.select("project_id", "duration")
        .join(chosen, "project_id", "left")
        .join(stats, ["project_id", "source"], "left")
    )
    n = F.coalesce(F.col("n_cues"), F.lit(0))
    status = (
        F.when(F.col("source").isNull(), F.lit("missing"))
        .when(n == 0, F.lit("empty"))
        .when(F.col("bad") | (F.col("last_end") > F.col("duration") + 0.5), F.lit("invalid"))
        .otherwise(F.lit("available"))
    )
    return joined.select("project_id", "source", status.alias("status"), n.alias("n_cues"))
