"""End-to-end plans over tables of many projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.drafts import assemble_drafts, schedule_exports
from ..operators.fusion import fuse_evidence, match_ranked, rebuild_drafts
from ..operators.selection import align_scores, align_titles, select_candidates
from ..operators.timeline import merge_outlines, place_topics, refine_timeline
from ..operators.visual import add_context, apply_refinement, playable, validate_visual
from ..session import materialize


def text_highlights(
    cues: DataFrame, chunks: DataFrame, profile: DataFrame, outline: DataFrame, timeline: DataFrame,
    scores: DataFrame, titles: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Outline, placement, refinement, scores, selection, titles -> ``(titled candidates, report)``.

    ``cues`` are normalised; ``chunks`` is ``project_id, chunk, chunk_start, chunk_end``; the reply tables come
    from ``sources.replies`` (they are external data, so stages are materialised around the model hook).
    """
    topics, _ = merge_outlines(outline)
    placed, _ = place_topics(topics, timeline, chunks)
    items = placed.select(
        "project_id", (F.col("chunk") * 256 + F.col("row_no")).cast("int").alias("ord"), F.col("title").alias("label"),
        "start_s", "end_s",
    )
    candidates, report = refine_timeline(items, cues, profile)
    scored = align_scores(candidates.drop("score"), scores)
    chosen = select_candidates(scored, profile)
    return align_titles(chosen, titles), report


def visual_scan(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visual replies (one per project as ``reply_id``) -> ``(events with rank, rejects)``.

    ``rank`` is 1 for the event to be reviewed, null for what is not playable or not among the best.
    """
    events, rejects = validate_visual(replies)
    named = events.withColumnRenamed("reply_id", "project_id")
    ranks = playable(named.select("project_id", "ord", "kind", "score")).select("project_id", "ord", "rank")
    return named.join(ranks, ["project_id", "ord"], "left"), rejects


def visual_highlights(scan: DataFrame, refine: DataFrame, projects: DataFrame) -> DataFrame:
    """Scan, the reply of the one review, and ``project_id, target, duration`` -> drafts with padded bounds and ids.

    Projects that end without a highlight keep one row with their status and no draft.
    """
    applied = apply_refinement(scan, refine)
    chosen = applied.where("selected").join(projects, "project_id", "left")
    key = F.concat_ws(":", F.col("project_id").cast("string"), F.lit("visual"), "id", F.col("ord").cast("string"))
    drafts = add_context(chosen).select(
        "project_id", "ord", "id", "start_s", "end_s", "score", "kind", "disposition", "status",
        F.substring(F.sha2(key, 256), 1, 32).alias("draft_id"),
    )
    ended = applied.where(F.col("status").isin("failed", "no_highlights")).select("project_id", "status").distinct()
    return drafts.unionByName(ended, allowMissingColumns=True)


def fused_production(
    text: DataFrame, visual: DataFrame, originals: DataFrame, branches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(drafts, rejects)``: drafts of the fused candidates of every project whose branches gave any.

    ``branches``: project_id, workflow_id, burn_subtitles, text_ok, failed_batch (null: none failed).  ``visual`` has its
    ``batch``.  A failed text branch has no candidates and no drafts; of the visual branch the batches before the failed one
    stay.  One failed branch is tolerated, both reject the project, and so does a project without any candidate.
    """
    state = branches.select("project_id", "text_ok", "failed_batch")
    both = branches.withColumn("both", ~F.col("text_ok") & F.col("failed_batch").isNotNull())
    running = both.where(~F.col("both")).drop("both", "text_ok", "failed_batch")
    in_time = F.col("failed_batch").isNull() | (F.col("batch") < F.col("failed_batch"))
    kept_text = text.join(state.where("text_ok").select("project_id"), "project_id").join(running.select("project_id"), "project_id", "left_semi")
    kept_visual = visual.join(state, "project_id").where(in_time).drop("batch", "text_ok", "failed_batch").join(running.select("project_id"), "project_id", "left_semi")
    fused = materialize(fuse_evidence(kept_text, kept_visual), "fused")
    mine = originals.join(state, "project_id").where(F.when(F.col("side") == "text", F.col("text_ok")).otherwise(in_time))
    drafts = rebuild_drafts(fused, mine, running)
    reason = F.when(F.col("both"), F.lit("both_branches_failed")).when(F.col("n").isNull(), F.lit("no_candidates"))
    found = fused.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    rejects = both.join(found, "project_id", "left").select("project_id", reason.alias("reason")).where(F.col("reason").isNotNull())
    return drafts, rejects


def fused_highlights(text: DataFrame, visual: DataFrame, drafts: DataFrame) -> DataFrame:
    """Ranked fused candidates with the best-overlapping draft of each and its deterministic id."""
    fused = match_ranked(materialize(fuse_evidence(text, visual), "fused"), drafts)
    key = F.concat_ws(":", F.col("project_id").cast("string"), "id", (F.col("rank") - 1).cast("string"))
    return fused.withColumn("new_draft_id", F.substring(F.sha2(key, 256), 1, 32))


def produce(candidates: DataFrame, workflows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titled candidates to drafts and their export tasks."""
    drafts = assemble_drafts(candidates)
    return drafts, schedule_exports(drafts, workflows)
