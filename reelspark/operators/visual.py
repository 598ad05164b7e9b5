"""Visual events: reply validation, frame citations, review windows and padding.

A reply holds at most twelve events and sixty frames, so validation runs inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_join, near_join
from ..functions.let import let
from ..functions.media_time import finite
from ..functions.scores import rescale_score
from ..functions.text import first_reason, not_blank, text_ok, valid_id
from .sampling import even_downsample
from .selection import NON_PLAY

TIME_TOLERANCE = 1e-3
FRAME_TOLERANCE = 5e-2
MAX_EVENTS = 12
MAX_PLAYABLE = 6
MAX_FRAMES = 600
DEFAULT_LABEL = "片段"
# Event kinds a reply may use.
KINDS = ("gameplay", "menu", "reward_screen", "loading", "other", "unknown")


def trim_bounds(start: Column, end: Column, times: Column, lo: Column, hi: Column, longest: Column) -> Column:
    """Overlong span cut to ``longest`` around its cited times (around the first one if they spread too far)."""
    first = F.coalesce(F.least(end, F.array_min(times)), end)
    last = F.coalesce(F.greatest(start, F.array_max(times)), start)
    no_use = first > last
    a = F.when(no_use, start).otherwise(first)
    b = F.when(no_use, start).otherwise(last)
    center = F.when(b - a > longest, a).otherwise((a + b) / 2)
    new_start = F.greatest(lo, start, F.least(center - longest / 2, end - longest))
    new_end = F.least(hi, end, new_start + longest)
    overlong = end - start > longest + TIME_TOLERANCE
    return F.struct(
        F.when(overlong, F.greatest(lo, new_start)).otherwise(start).alias("start_s"),
        F.when(overlong, F.least(hi, new_end)).otherwise(end).alias("end_s"),
    )


def trim_events(events: DataFrame) -> DataFrame:
    """Trims ``start_s, end_s`` by ``frame_times`` within ``win_start, win_end, max_s``."""
    t = trim_bounds(*[F.col(c) for c in ("start_s", "end_s", "frame_times", "win_start", "win_end", "max_s")])
    return events.withColumn("__t", t).withColumns({"start_s": F.col("__t.start_s"), "end_s": F.col("__t.end_s")}).drop("__t")


def snap_to_frames(citations: DataFrame, frames: DataFrame, tolerance: float = FRAME_TOLERANCE) -> DataFrame:
    """Adds ``frame_time`` (nearest supplied frame within ``tolerance``, earliest on ties) and ``found``.

    ``citations``: project_id, citation_id, t; ``frames``: project_id, time_s.
    """
    # equal frame times count once, so a citation meets only as many frames as the clock can tell apart
    distinct = frames.select("project_id", "time_s").distinct()
    pairs = near_join(citations.select("project_id", "citation_id", "t"), distinct, ["project_id"], "t", "time_s", tolerance)
    best = pairs.groupBy("project_id", "citation_id").agg(
        F.min_by("time_s", F.struct(F.abs(F.col("time_s") - F.col("t")), F.col("time_s"))).alias("frame_time")
    )
    return citations.join(best, ["project_id", "citation_id"], "left").withColumn("found", F.col("frame_time").isNotNull())


def _check_event(e: Column, n: Column, ids: Column, frames: Column, lo: Column, hi: Column, longest: Column) -> Column:
    """One event of a reply -> canonical event plus its first failing rule."""
    start, end = F.greatest(lo, e["start_s"]), F.least(hi, e["end_s"])
    kind = F.when(not_blank(e["kind"]), e["kind"]).otherwise(F.lit("unknown"))
    base = F.struct(
        F.when(e["score"].isNull(), F.lit(0.0)).otherwise(rescale_score(e["score"])).alias("score"),
        kind.alias("kind"),
        F.when(not_blank(e["label"]), e["label"]).otherwise(F.lit(DEFAULT_LABEL)).alias("label"),
        trim_bounds(start, end, e["frame_times"], lo, hi, longest).alias("t"),
    )
    near = lambda c, t: (c >= t["start_s"] - FRAME_TOLERANCE) & (c <= t["end_s"] + FRAME_TOLERANCE)

    def nearest(t: Column) -> Column:
        inside = F.filter(e["frame_times"], lambda c: finite(c) & near(c, t))
        gaps = lambda c: F.transform(
            F.filter(frames, lambda f: F.abs(f - c) <= FRAME_TOLERANCE), lambda f: F.struct(F.abs(f - c).alias("d"), f.alias("f"))
        )
        return F.transform(inside, lambda c: F.array_min(gaps(c))["f"])

    def with_frames(b: Column) -> Column:
        found = F.struct(b.alias("b"), nearest(b["t"]).alias("near"))
        return let(found, lambda x: judged(x["b"], x["near"], F.array_distinct(F.filter(x["near"], lambda f: near(f, x["b"]["t"])))))

    def judged(b: Column, hits: Column, cited: Column) -> Column:
        text = lambda c, limit: text_ok(F.coalesce(c, F.lit("")), limit, False)
        n_cited = F.coalesce(F.size(e["frame_times"]), F.lit(0))
        reason = first_reason(
            (~valid_id(e["id"]) | (F.array_position(ids, e["id"]) <= n), "id"),
            (~text(e["label"], 120), "label"),
            (~text(e["evidence"], 1000), "evidence"),
            (~text(e["selection_reason"], 500), "selection_reason"),
            (b["score"].isNull(), "score"),
            (~b["kind"].isin(*KINDS), "kind"),
            (~finite(e["start_s"]) | ~finite(e["end_s"]), "time"),
            ((e["start_s"] < lo - TIME_TOLERANCE) | (e["end_s"] > hi + TIME_TOLERANCE), "window"),
            (e["end_s"] - e["start_s"] < 0.1 - TIME_TOLERANCE, "too_short"),
            ((n_cited == 0) | (n_cited > F.size(frames)), "citation_count"),
            (end - start < 0.1 - TIME_TOLERANCE, "too_short_clamped"),
            (F.exists(hits, lambda f: f.isNull()), "unknown_frame"),
            (F.coalesce(F.size(cited), F.lit(0)) == 0, "no_supporting_frame"),
        )
        return F.struct(
            e["id"].alias("id"), b["label"].alias("label"), b["t"]["start_s"].alias("start_s"), b["t"]["end_s"].alias("end_s"),
            F.coalesce(e["evidence"], F.lit("")).alias("evidence"), b["kind"].alias("kind"), b["score"].alias("score"),
            F.coalesce(e["selection_reason"], F.lit("")).alias("selection_reason"), cited.alias("frame_times"),
            reason.alias("reason"),
        )

    return let(base, with_frames)


def validate_visual(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)``; one bad event rejects its reply.

    ``replies``: reply_id, events (array), frames (ascending array<double>), win_start, win_end, max_s.
    """
    checked = _checked_replies(replies)
    accepted = F.when(F.col("reason").isNull(), F.col("es"))
    # outer explode and a filter on its output, so that replies are not validated again for the filter
    events = (
        checked.select("reply_id", F.posexplode_outer(accepted).alias("ord", "e"))
        .where(F.col("ord").isNotNull())
        .select("reply_id", "ord", "e.*")
        .drop("reason")
    )
    return events, checked.where(F.col("reason").isNotNull()).select("reply_id", "reason")


def _checked_replies(replies: DataFrame) -> DataFrame:
    first = replies.withColumn("__es", F.slice("events", 1, MAX_EVENTS))
    ids = F.transform("__es", lambda e: e["id"])
    es = F.transform(
        "__es",
        lambda e, n: _check_event(e, n, ids, F.col("frames"), F.col("win_start"), F.col("win_end"), F.col("max_s")),
    )
    checked = first.withColumn("es", es)
    bad = F.try_element_at(F.filter("es", lambda e: e["reason"].isNotNull()), F.lit(1))["reason"]
    reason = (
        F.when(F.col("events").isNull(), F.lit("no_events_array"))
        .when(F.size("events") == 0, F.lit("no_highlights"))
        .otherwise(bad)
    )
    return checked.select("reply_id", "es", reason.alias("reason"))


def prepare_frames(
    frames: DataFrame, projects: DataFrame, max_frames: int = MAX_FRAMES
) -> tuple[DataFrame, DataFrame]:
    """``(frame sets, rejects)``: distinct frame times in order, with a digest each, for projects whose frames are sound.

    ``frames``: project_id, time_s, content; ``projects``: project_id, duration.  Of equal times the smallest digest
    stays.  A project is refused when it is unknown, has a time that is not finite or outside [0, duration], or more than
    ``max_frames`` distinct times; projects without frames are refused as well.  Admission is a partial aggregate, so
    only admitted projects (bounded) are numbered by a window.
    """
    t, d = F.col("time_s"), F.col("duration")
    known = projects.select("project_id", "duration", F.lit(True).alias("__known"))
    per_time = frames.groupBy("project_id", "time_s").agg(F.min(F.sha2(F.col("content"), 256)).alias("digest"))
    placed = per_time.join(known, "project_id", "full")
    bad = F.col("digest").isNotNull() & F.coalesce(~finite(t) | (t < 0) | (t > d), F.lit(True))
    facts = placed.groupBy("project_id").agg(
        F.count("digest").alias("n"), F.bool_or(bad).alias("bad"), F.bool_or(F.col("__known")).alias("known")
    )
    reason = first_reason(
        (F.col("known").isNull(), "unknown_project"), (F.col("n") == 0, "no_frames"), (F.col("bad"), "time_out_of_range"),
        (F.col("n") > max_frames, "too_many_frames"),
    )
    judged = facts.select("project_id", reason.alias("reason"))
    admitted = judged.where(F.col("reason").isNull()).select("project_id")
    order = Window.partitionBy("project_id").orderBy("time_s")
    sets = per_time.join(admitted, "project_id", "left_semi").withColumn("frame_no", F.row_number().over(order) - 1)
    return sets.select("project_id", "frame_no", "time_s", "digest"), judged.where(F.col("reason").isNotNull())


def playable(events: DataFrame, keep: int = MAX_PLAYABLE, key: str = "project_id") -> DataFrame:
    """First 12 events by ``ord``, without menus and loading screens, best ``keep`` by score.

    Both ranks are bounded by constants, so map tasks are cut before each shuffle.
    """
    by_ord = Window.partitionBy(key).orderBy("ord")
    by_score = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("ord").asc())
    return (
        events.withColumn("__n", F.row_number().over(by_ord))
        .where(F.col("__n") <= MAX_EVENTS)
        .drop("__n")
        .where(~F.col("kind").isin(*NON_PLAY))
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= keep)
    )


def review_frames(best: DataFrame, frames: DataFrame, pad: float = 2.0, limit: int = 25) -> DataFrame:
    """Frames within ``pad`` seconds of the best event of each project, evenly cut to ``limit``."""
    windows = best.select(
        "project_id", F.greatest(F.lit(0.0), F.col("start_s") - pad).alias("w0"),
        F.least(F.col("duration"), F.col("end_s") + pad).alias("w1"),
    )
    points = frames.select("project_id", "time_s")
    local = interval_join(windows, points, ["project_id"], ("w0", "w1"), ("time_s", "time_s")).select("project_id", "time_s")
    return even_downsample(local, limit)


def apply_refinement(scan: DataFrame, refine: DataFrame) -> DataFrame:
    """Scan candidates with the outcome of the single refinement.

    ``scan``: project_id, ord, rank (1 = reviewed, null = not playable), id, start_s, end_s, score, kind.
    ``refine``: project_id, ok, id, start_s, end_s, score, kind.  Both may carry further columns (label, evidence,
    reasons, frames); an accepted event (``ok``, same id) replaces the reviewed row in every column they share.
    Rejected: the reviewed row is skipped only when another playable one is left, otherwise the project fails.
    ``no_highlights``: nothing was playable, or what was accepted is not and nothing else is left.  ``selected`` marks
    rows that become drafts.
    """
    shared = [c for c in refine.columns if c in scan.columns and c not in ("project_id", "ord", "rank", "id")]
    facts = scan.groupBy("project_id").agg(
        F.count_if(F.col("rank") > 1).alias("n_other"), F.count_if(F.col("rank") == 1).alias("n_top")
    )
    top = scan.where(F.col("rank") == 1).select("project_id", F.col("id").alias("top_id"))
    r = refine.select("project_id", "ok", F.col("id").alias("r_id"), F.struct(*shared).alias("r"))
    unplayable = F.col("r.kind").isin(*NON_PLAY) & (F.col("n_other") == 0)
    decision = (
        facts.join(top, "project_id", "left")
        .join(r, "project_id", "left")
        .withColumn("accepted", F.coalesce(F.col("ok") & (F.col("r_id") == F.col("top_id")), F.lit(False)))
        .withColumn(
            "status",
            F.when((F.col("n_top") == 0) | (F.col("accepted") & unplayable), F.lit("no_highlights"))
            .when(F.col("accepted"), F.lit("accepted"))
            .when(F.col("n_other") > 0, F.lit("skipped"))
            .otherwise(F.lit("failed")),
        )
        .select("project_id", "top_id", "r", "status")
    )
    joined = scan.join(decision, "project_id")
    is_top = F.coalesce(F.col("id") == F.col("top_id"), F.lit(False))
    use = is_top & (F.col("status") == "accepted")
    pick = lambda c: F.when(use, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    selected = F.when(
        is_top, (F.col("status") == "accepted") & ~F.col("r.kind").isin(*NON_PLAY)
    ).otherwise(F.col("rank").isNotNull() & ~F.col("status").isin("failed", "no_highlights"))
    return joined.select(
        "project_id", "ord", "id", *[pick(c) for c in shared],
        F.when(use, F.lit("refined")).otherwise(F.lit("scan")).alias("disposition"),
        F.coalesce(selected, F.lit(False)).alias("selected"), "status",
    )


def add_context(candidates: DataFrame) -> DataFrame:
    """Lead of at most 1.5 s (half the slack) and tail of at most 2 s, within ``target`` and ``duration``."""
    s, e, target, d = (F.col(c) for c in ("start_s", "end_s", "target", "duration"))
    lead = F.greatest(F.lit(0.0), F.least(F.lit(1.5), (target - (e - s)) / 2))
    new_s = F.greatest(F.lit(0.0), s - lead)
    new_e = F.least(d, e + 2, new_s + target)
    better = finite(d) & (d > 0) & (new_e > new_s) & (new_e - new_s >= e - s)
    return candidates.withColumn("__c", F.struct(
        F.when(better, new_s).otherwise(s).alias("s"), F.when(better, new_e).otherwise(e).alias("e")
    )).withColumns({"start_s": F.col("__c.s"), "end_s": F.col("__c.e")}).drop("__c")
