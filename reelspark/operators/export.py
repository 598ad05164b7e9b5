"""Subtitle export: timeline intersection, SRT and ASS documents.

A document is one value, so its captions come together in one task; ``max_cues`` bounds it.  Projects that are not
exported (too many captions, a bad one, unknown dimensions) come back as reject rows with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_join
from ..functions.media_time import FPS, ass_clock, scene_frames, srt_clock
from ..functions.text import clean_caption
from ..sources.srt import MAX_CUES, caption_reason
from .cues import MAX_SECONDS


def timeline_cues(drafts: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues of a draft's timeline: ``draft_id, out_idx, start_s, end_s, text``.

    ``drafts``: project_id, draft_id, scenes.  Every scene, in edit order and with repeats, takes its own clipped
    copy of the cues it meets; scene lengths are whole frames, so offsets are frame counts.  Scenes follow each other in
    output time, so a place is the number of captions of the scenes before and the place within the scene: no task
    sees all captions of a draft.
    """
    frames = F.transform("scenes", lambda s: scene_frames(s["start_s"], s["end_s"]))
    offsets = F.aggregate(
        frames, F.array(F.lit(0)), lambda a, f: F.concat(a, F.array(F.element_at(a, -1) + f))
    )
    scenes = drafts.select(
        "project_id", "draft_id", F.posexplode(F.arrays_zip(F.col("scenes"), frames.alias("frames"), offsets.alias("offset"))).alias("scene_no", "z")
    ).where(F.col("z.scenes").isNotNull()).select(
        "project_id", "draft_id", "scene_no", F.col("z.scenes.start_s").alias("s0"),
        F.least(F.col("z.scenes.end_s"), F.col("z.scenes.start_s") + F.col("z.frames") / float(FPS)).alias("s1"),
        (F.col("z.offset") / float(FPS)).alias("offset"),
    )
    # Nothing is said outside of a source, however far a scene reaches.
    scenes = scenes.withColumn("to", F.least("s1", F.lit(MAX_SECONDS))).where(F.col("to") > F.greatest("s0", F.lit(0.0)))
    c = cues.select("project_id", "cue_idx", F.col("start_s").alias("c0"), F.col("end_s").alias("c1"), "text")
    start, end = F.greatest("s0", "c0"), F.least("s1", "c1")
    hits = (
        interval_join(scenes, c, ["project_id"], ("s0", "to"), ("c0", "c1"))
        .where(end > start)
        .select(
            "draft_id", "scene_no", "cue_idx", "text",
            (F.col("offset") + start - F.col("s0")).alias("start_s"),
            (F.col("offset") + end - F.col("s0")).alias("end_s"),
        )
    )
    order = Window.partitionBy("draft_id", "scene_no").orderBy("start_s", "cue_idx")
    placed = hits.withColumn("place", F.row_number().over(order) - 1)
    earlier = Window.partitionBy("draft_id").orderBy("scene_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.groupBy("draft_id", "scene_no").agg(F.count(F.lit(1)).alias("n")).select(
        "draft_id", "scene_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("int").alias("first")
    )
    return placed.join(counts, ["draft_id", "scene_no"]).select(
        "draft_id", (F.col("first") + F.col("place")).alias("out_idx"), "start_s", "end_s", "text"
    )


def _admission(cues: DataFrame, key: str, max_cues: int) -> DataFrame:
    """``key, reason``: why the captions of a project make no document, or null.  Partial aggregates only."""
    reason = caption_reason(F.col("start_s"), F.col("end_s"), F.col("text"))
    facts = cues.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(reason.isNotNull()).alias("bad"))
    return facts.select(
        key, F.when(F.col("n") > max_cues, F.lit("too_many_cues")).when(F.col("bad"), F.lit("bad_caption")).alias("reason")
    )


def to_srt(
    cues: DataFrame, key: str = "project_id", order: str = "cue_idx", max_cues: int = MAX_CUES
) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejects)``: one SRT document per project with valid captions."""
    admission = _admission(cues, key, max_cues)
    start = F.round(F.col("start_s") * 1000).cast("long")
    end = F.greatest(start + 1, F.round(F.col("end_s") * 1000).cast("long"))
    kept = cues.join(admission.where(F.col("reason").isNull()).drop("reason"), key)
    body = F.concat(srt_clock(start), F.lit(" --> "), srt_clock(end), F.lit("\n"), clean_caption(F.col("text")), F.lit("\n\n"))
    docs = kept.select(key, F.col(order).alias("__o"), body.alias("__b")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__o", "__b"))).alias("xs")
    )
    lines = F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["__b"]))
    return docs.select(key, F.array_join(lines, "").alias("srt")), admission.where(F.col("reason").isNotNull())


def escape_ass(text: Column) -> Column:
    escaped = F.replace(clean_caption(text), F.lit("\\"), F.lit("\\\\"))
    for raw, out in (("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(out))
    return escaped


# Section headers of an ASS file.
STYLE_FORMAT = (
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, "
    "Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, "
    "MarginV, Encoding"
)
EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
FONT = "Noto Sans SC Thin"


def ass_header(w: Column, h: Column) -> Column:
    whole = lambda c: F.floor(c).cast("int")
    size = F.greatest(F.lit(12), whole(F.least(w, h) * F.lit(0.048)))
    side, low, outline = whole(w / 15), F.greatest(F.lit(6), whole(h / 16)), F.greatest(F.lit(1), whole(h / 540))
    return F.concat(
        F.lit("[Script Info]\nScriptType: v4.00+\nPlayResX: "), w, F.lit("\nPlayResY: "), h,
        F.lit("\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\n" + STYLE_FORMAT + f"\nStyle: Default,{FONT},"),
        size, F.lit(",&H00FFFFFF,&H00FFFFFF,&H00101010,&H80000000,-1,0,0,0,100,100,0,0,1,"), outline,
        F.lit(",0,2,"), side, F.lit(","), side, F.lit(","), low,
        F.lit(",1\n\n[Events]\n" + EVENT_FORMAT + "\n"),
    )


def to_ass(
    cues: DataFrame, dims: DataFrame, key: str = "project_id", order: str = "cue_idx", max_cues: int = MAX_CUES
) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejects)``: one ASS document per project with valid captions and known dimensions.

    ``dims``: project_id, out_w, out_h.  Times are centiseconds, at least one long.
    """
    sized = _admission(cues, key, max_cues).join(dims.select(key, "out_w", "out_h"), key, "left")
    unsized = F.when(F.col("out_w").isNull() | F.col("out_h").isNull(), F.lit("no_dimensions"))
    admission = sized.withColumn("reason", F.coalesce("reason", unsized))
    start = F.round(F.col("start_s") * 100).cast("long")
    end = F.greatest(start + 1, F.round(F.col("end_s") * 100).cast("long"))
    line = F.concat(
        F.lit("Dialogue: 0,"), ass_clock(start), F.lit(","), ass_clock(end), F.lit(",Default,,0,0,0,,"),
        escape_ass(F.col("text")), F.lit("\n"),
    )
    docs = (
        cues.join(admission.where(F.col("reason").isNull()).select(key), key)
        .select(key, F.col(order).alias("__o"), line.alias("__b"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("__o", "__b"))).alias("xs"))
    )
    written = docs.join(admission.where(F.col("reason").isNull()), key).select(
        key, F.concat(ass_header(F.col("out_w"), F.col("out_h")), F.array_join(F.col("xs.__b"), "")).alias("ass")
    )
    return written, admission.where(F.col("reason").isNotNull()).select(key, "reason")


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export sink: one row per document in Parquet (one file per project would not scale)."""
    docs.write.mode(mode).parquet(path)
