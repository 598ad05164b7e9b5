"""Drafts: validation, assembly, scene edits, revisions, snapshots and edit-list mapping.

A draft that passes validation holds at most 30 scenes; everything about its scenes happens inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media_time import finite, micros
from ..functions.text import first_reason, not_blank, valid_id
from .options import ASPECTS

MAX_SCENES = 30
# Title styles, layouts and supported title template versions.
STYLES = ("plain", "impact", "card", "comic", "neon", "arena", "editorial", "pixel", "frosted")
LAYOUTS = ("fit", "crop", "blur")
TEMPLATES = (1, 6)


def scenes_length(scenes: Column) -> Column:
    """Total length in seconds, added up in whole microseconds."""
    us = F.aggregate(scenes, F.lit(0).cast("long"), lambda a, s: a + micros(s["end_s"]) - micros(s["start_s"]))
    return us / 1e6


def draft_reason(duration: Column | None) -> Column:
    """First rule a draft row breaks, or null."""
    c = F.col
    bad_scene = lambda s: (
        ~valid_id(s["id"]) | (F.char_length(s["label"]) > 120) | (F.char_length(s["evidence"]) > 1000)
        | ~finite(s["start_s"]) | ~finite(s["end_s"]) | (s["start_s"] < 0) | (s["end_s"] - s["start_s"] < 0.1)
        | (F.lit(False) if duration is None else s["end_s"] > duration + 0.001)
    )
    ids = F.transform("scenes", lambda s: s["id"])
    outside = lambda x, lo, hi: ~finite(c(x)) | (c(x) < lo) | (c(x) > hi)
    return first_reason(
        (
            ~valid_id(c("draft_id")) | ~not_blank(c("title")) | (F.char_length("title") > 200)
            | (F.char_length("hook") > 120),
            "identity",
        ),
        (F.coalesce(F.size("scenes"), F.lit(0)).between(1, MAX_SCENES) == F.lit(False), "scene_count"),
        (F.exists("scenes", bad_scene) | (F.size(F.array_distinct(ids)) < F.size(ids)), "scene"),
        (scenes_length(c("scenes")) > 1800, "too_long"),
        (~c("aspect").isin(*ASPECTS) | ~c("layout").isin(*LAYOUTS) | ~c("title_style").isin(*STYLES), "options"),
        (outside("crop_x", 0.0, 1.0) | outside("title_scale", 0.75, 1.2) | outside("title_y", 0.06, 0.70), "placement"),
        (F.coalesce(~c("title_accent").rlike("^#[0-9a-fA-F]{6}\\z"), F.lit(False)), "accent"),
        (c("revision") < 1, "revision"),
        (~c("title_template_version").isin(*TEMPLATES), "template"),
    )


def validate_drafts(drafts: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds ``reason`` against the duration of each draft's project; a draft of no known project is refused."""
    known = projects.select("project_id", F.col("duration").alias("__d"), F.lit(True).alias("__known"))
    timed = drafts.join(known, "project_id", "left")
    unknown = F.when(F.col("__known").isNull(), F.lit("unknown_project"))
    return timed.withColumn("reason", F.coalesce(unknown, draft_reason(F.col("__d")))).drop("__d", "__known")


def draft_durations(drafts: DataFrame) -> DataFrame:
    return drafts.select(
        "draft_id", F.size("scenes").alias("n_scenes"), scenes_length(F.col("scenes")).alias("seconds")
    )


def draft_ids(drafts: DataFrame, scheme: str = "goal") -> DataFrame:
    """Replaces ``draft_id`` by 32 hex digits of a hash of workflow, goal or scene, old id and position."""
    parts = {
        "goal": ("workflow_id", "goal", "draft_id", "i"),
        "fused": ("workflow_id", "scene_id", "i"),
    }[scheme]
    key = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return drafts.withColumn("draft_id", F.substring(F.sha2(key, 256), 1, 32))


#: Fixed value: origin of drafts that the engine made.
ENGINE = "python-engine"


def assemble_drafts(candidates: DataFrame) -> DataFrame:
    """One draft per titled candidate.

    ``candidates``: project_id, workflow_id, i, id, label, start_s, end_s, evidence, title, hook, goal, route,
    aspect, burn_subtitles, and ``origin`` if some come from the engine.  Content drafts carry no hook and no title; drafts of
    the engine keep their origin and always have subtitles.
    """
    content = F.col("goal") == "content"
    engine = F.col("origin") == ENGINE if "origin" in candidates.columns else F.lit(False)
    engine = F.coalesce(engine, F.lit(False))
    key = F.concat_ws(":", "workflow_id", "goal", "id", F.col("i").cast("string"))
    return candidates.select(
        "project_id", "workflow_id", "goal",
        F.substring(F.sha2(key, 256), 1, 32).alias("draft_id"),
        "title",
        F.when(content, F.lit("")).otherwise(F.col("hook")).alias("hook"),
        F.array(F.struct("id", "label", "start_s", "end_s", "evidence")).alias("scenes"),
        "aspect",
        F.when(F.col("aspect") == "portrait", F.lit("crop")).otherwise(F.lit("fit")).alias("layout"),
        F.lit(0.5).alias("crop_x"), F.lit("plain").alias("title_style"), F.lit(1).alias("title_template_version"),
        F.lit(True).alias("title_motion"),
        F.when(content, F.lit(False)).alias("title_enabled"),
        F.lit(1.0).alias("title_scale"), F.lit(0.12).alias("title_y"), F.lit(None).cast("string").alias("title_accent"),
        (engine | F.col("burn_subtitles")).alias("subtitles"), F.lit(True).alias("original_audio"), F.lit(1).alias("revision"),
        F.when(engine, F.lit(ENGINE)).otherwise(F.concat_ws("-", "route", "goal")).alias("origin"),
    )


def schedule_exports(drafts: DataFrame, workflows: DataFrame) -> DataFrame:
    """Export tasks for finished drafts: always for content, otherwise where the workflow (if it is known) asks for it."""
    return (
        drafts.join(workflows.select("workflow_id", "auto_export"), "workflow_id", "left")
        .where((F.col("goal") == "content") | F.col("auto_export"))
        .select("workflow_id", "project_id", "goal", "draft_id", "revision", F.lit("export").alias("kind"), F.lit("queued").alias("status"))
    )


def move_scene(scenes: Column, index: Column, delta: Column) -> Column:
    """Two scenes swapped (0-based); positions outside the list leave it unchanged."""
    n, other = F.size(scenes), index + delta
    valid = (index >= 0) & (index < n) & (other >= 0) & (other < n)
    at = lambda i: F.try_element_at(scenes, (i + 1).cast("int"))
    swapped = F.transform(
        scenes, lambda s, i: F.when(i == index, at(other)).when(i == other, at(index)).otherwise(s)
    )
    return F.when(valid, swapped).otherwise(scenes)


def apply_scene_edits(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """One edit per draft: ``op`` move (index, delta), append or replace (index) with ``scene``.

    Adds ``reason``: a draft that is not there, a replaced scene that does not exist, or a result that breaks the draft
    rules; such a draft keeps its scenes.
    """
    joined = edits.join(drafts.withColumn("__known", F.lit(True)), "draft_id", "left")
    index, scene = F.col("index"), F.col("scene")
    missing = (F.col("op") == "replace") & ((index < 0) | (index >= F.size("scenes")))
    edited = (
        F.when(F.col("op") == "move", move_scene(F.col("scenes"), index, F.col("delta")))
        .when(F.col("op") == "append", F.concat("scenes", F.array(scene)))
        .when(missing, F.col("scenes"))
        .otherwise(F.transform("scenes", lambda s, i: F.when(i == index, scene).otherwise(s)))
    )
    tried = joined.withColumns({"__old": F.col("scenes"), "__missing": missing}).withColumn("scenes", edited)
    broken = F.when(F.col("op") != "move", draft_reason(None))
    unknown = F.when(F.col("__known").isNull(), F.lit("unknown_draft")).when(F.col("__missing"), F.lit("no_such_scene"))
    tried = tried.withColumn("reason", unknown.otherwise(broken))
    return tried.withColumn(
        "scenes", F.when(F.col("reason").isNull(), F.col("scenes")).otherwise(F.col("__old"))
    ).select(*drafts.columns, "op", "reason")


def duplicate_drafts(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """Copies with lineage: ``requests`` has draft_id, new_id, new_title.  ``reason`` tells of a draft that is not there."""
    copied = requests.join(drafts.withColumn("__known", F.lit(True)), "draft_id", "left")
    known = F.col("__known").isNotNull()
    return copied.withColumns(
        {
            "reason": F.when(~known, F.lit("unknown_draft")),
            "parent_draft_id": F.col("draft_id"), "parent_revision": F.col("revision"),
            "draft_id": F.col("new_id"), "revision": F.when(known, F.lit(1)), "title": F.col("new_title"),
        }
    ).drop("new_id", "new_title", "__known")


def merge_revisions(base: DataFrame, edits: DataFrame, values: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``(merged, conflicts)``.

    An edit applies when its ``base_revision`` equals the stored revision; of several such edits the first by
    ``edit_no`` applies (the others then see a newer revision).  Everything else is a conflict row.
    """
    stored = base.select("id", F.col("revision").alias("__stored"))
    # reduced per (id, base revision) before the join: many edits of one draft move as a few rows
    per_revision = edits.groupBy("id", "base_revision").agg(
        F.min("edit_no").alias("__edit"), F.min_by(F.struct(*values), "edit_no").alias("__new")
    )
    firsts = per_revision.join(
        stored.withColumnRenamed("__stored", "base_revision"), ["id", "base_revision"]
    ).drop("base_revision")
    merged = base.join(firsts, "id", "left").select(
        *[
            (F.when(F.col("__edit").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c))
            for c in base.columns
            if c != "revision"
        ],
        (F.col("revision") + F.col("__edit").isNotNull().cast("int")).alias("revision"),
    )
    applied = stored.join(firsts.select("id", "__edit"), "id", "left")
    conflicts = (
        edits.join(applied, "id", "left")
        .where(F.col("__edit").isNull() | (F.col("edit_no") != F.col("__edit")))
        .select(
            "id", "edit_no", "base_revision",
            F.when(F.col("__stored").isNull(), F.lit("unknown")).otherwise(F.lit("stale")).alias("reason"),
        )
    )
    return merged, conflicts


def snapshot_exports(drafts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(snapshots, conflicts)``: the draft body frozen at the requested revision.

    ``requests``: request_id, draft_id, requested_revision.
    """
    body = F.to_json(F.struct(*[F.col(c) for c in drafts.columns]))
    joined = requests.join(drafts.select("draft_id", "revision", body.alias("body")), "draft_id", "left")
    ok = F.coalesce(F.col("revision") == F.col("requested_revision"), F.lit(False))
    return (
        joined.where(ok).select("request_id", "draft_id", "revision", "body"),
        joined.where(~ok).select(
            "request_id", "draft_id", "requested_revision",
            F.when(F.col("revision").isNull(), F.lit("unknown")).otherwise(F.lit("conflict")).alias("reason"),
        ),
    )


def edl_position(drafts: DataFrame, positions: DataFrame) -> DataFrame:
    """Output position -> ``scene_no, source_s``; the last scene takes any overflow.

    ``positions``: position_id, draft_id, position_s.  Scene offsets are whole microseconds.  A position whose draft is
    unknown or has no scenes stays, with null results and a ``reason``.
    """
    offsets = F.aggregate(
        "scenes", F.array(F.lit(0).cast("long")),
        lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + micros(s["end_s"]) - micros(s["start_s"]))),
    )
    d = drafts.select("draft_id", "scenes", offsets.alias("offsets"), F.lit(True).alias("__known"))
    p = micros(F.col("position_s"))
    # number of scene ends at or before the position, limited to the last scene
    ends = F.slice("offsets", F.lit(2), F.size("scenes"))
    no = F.when(F.size("scenes") > 0, F.least(F.size(F.filter(ends, lambda e: e <= p)), F.size("scenes") - 1))
    joined = positions.join(d, "draft_id", "left").withColumn("scene_no", no)
    at = F.get("scenes", F.col("scene_no"))
    inside = p - F.get("offsets", F.col("scene_no"))
    length = micros(at["end_s"]) - micros(at["start_s"])
    return joined.select(
        "position_id", "draft_id", "scene_no", ((micros(at["start_s"]) + F.least(length, inside)) / 1e6).alias("source_s"),
        F.when(F.col("__known").isNull(), F.lit("unknown_draft")).when(F.col("scene_no").isNull(), F.lit("no_scenes")).alias("reason"),
    )


def disable_subtitles(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(drafts with subtitles off and a new revision, changed count per project)``."""
    changed = F.coalesce(F.col("subtitles"), F.lit(False))
    updated = drafts.withColumns({"revision": F.col("revision") + changed.cast("int"), "subtitles": F.lit(False)})
    counts = drafts.groupBy("project_id").agg(F.count_if(changed).alias("n_changed"))
    return updated, counts
