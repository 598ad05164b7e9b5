"""Scores, titles, duration profiles, selection and promo plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media_time import finite
from ..functions.scores import FALLBACK_SCORE, rescale_score
from ..functions.text import SPACE, first_reason, not_blank, text_ok, trim_space, valid_id

# Fixed value: reason of a score that no reply gave.
FALLBACK_REASON = "Not scored by the model; neutral fallback applied."
# Kinds that are never played back as highlights.
NON_PLAY = ("menu", "reward_screen", "loading")
# Fixed value: the largest number of candidates a duration profile keeps.
LARGEST_KEEP = 32


def duration_profile(projects: DataFrame) -> DataFrame:
    """Adds the tier columns to ``project_id, duration, target`` (0 = automatic)."""
    d, target = F.col("duration"), F.col("target")
    long, medium = d >= 1800, d >= 480

    def tier(short_value, medium_value, long_value) -> Column:
        wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(long, wrap(long_value)).when(medium, wrap(medium_value)).otherwise(wrap(short_value))

    hours = F.greatest(F.lit(1.0), d / 3600)
    asked = target > 0
    base_min, base_target, base_max = tier(20.0, 45.0, 90.0), tier(60.0, 120.0, 240.0), tier(150.0, 300.0, 480.0)
    max_s = F.least(d, base_max)
    min_s = F.least(F.when(asked, F.least(base_min, target / 2)).otherwise(base_min), max_s / 2)
    target_s = F.least(d, F.when(asked, target.cast("double")).otherwise(base_target))
    low = tier(3, 4, F.greatest(F.lit(6.0), hours * 6).cast("int"))
    high = tier(6, 10, F.greatest(F.lit(12.0), hours * 14).cast("int"))
    return projects.select(
        *projects.columns,
        min_s.alias("min_s"), target_s.alias("target_s"), max_s.alias("max_s"),
        F.least(d, F.lit(1800.0)).alias("hard_max_s"),
        tier(2, 3, 3).alias("min_keep"), tier(6, 10, LARGEST_KEEP).alias("max_keep"),
        tier("short", "medium", "long").alias("tier"), low.alias("topics_low"), high.alias("topics_high"),
    )


def _single_replies(replies: DataFrame, *values: str) -> DataFrame:
    """Reply rows whose id occurs exactly once in the project; every copy of a repeated id is dropped."""
    return (
        replies.groupBy("project_id", "id")
        .agg(F.count(F.lit(1)).alias("__n"), *[F.first(v).alias(f"__{v}") for v in values])
        .where(F.col("__n") == 1)
        .drop("__n")
    )


def align_scores(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """One score per candidate; unknown or repeated ids are ignored, gaps get the neutral fallback."""
    known = _single_replies(replies, "score", "reason")
    joined = candidates.join(known, ["project_id", "id"], "left")
    return joined.select(
        *candidates.columns,
        F.coalesce(rescale_score(F.col("__score")), F.lit(FALLBACK_SCORE)).alias("score"),
        F.when(text_ok(F.col("__reason"), 500, True), F.col("__reason"))
        .otherwise(F.lit(FALLBACK_REASON))
        .alias("reason"),
    )


def align_titles(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """One title and hook per candidate: reply title, else label, else ``Highlight <id>``."""
    known = _single_replies(replies, "title", "hook")
    joined = candidates.join(known, ["project_id", "id"], "left")
    title = (
        F.when(text_ok(F.col("__title"), 200, True), F.col("__title"))
        .when(text_ok(F.col("label"), 200, True), F.col("label"))
        .otherwise(F.concat(F.lit("Highlight "), F.col("id")))
    )
    hook = F.when(text_ok(F.col("__hook"), 120, False), F.col("__hook")).otherwise(F.lit(""))
    return joined.select(*candidates.columns, title.alias("title"), hook.alias("hook"))


def select_candidates(candidates: DataFrame, profile: DataFrame, largest_keep: int = LARGEST_KEEP) -> DataFrame:
    """Best by score up to ``max_keep``: score >= 0.7, or among the first ``min_keep``.

    ``largest_keep`` is the largest ``max_keep`` in ``profile`` (those of ``duration_profile`` end there; pass your own
    bound with other profiles).  As a constant it lets Spark cut every map task to that many rows per project before
    the shuffle, so a project with very many candidates costs no more than any other.  A profile that asks for more ends the
    job with an error instead of a shorter list; a project without a profile keeps no candidate.
    """
    order = Window.partitionBy("project_id").orderBy(F.col("score").desc(), F.col("ord").asc())
    best = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= largest_keep)
    asked = F.when(F.col("max_keep") <= largest_keep, F.col("max_keep")).otherwise(
        F.raise_error(F.lit(f"max_keep is over largest_keep = {largest_keep}")).cast("int")
    )
    return (
        best.join(profile.select("project_id", "min_keep", asked.alias("max_keep")), "project_id")
        .where(
            (F.col("rank") <= F.col("max_keep")) & ((F.col("score") >= 0.7) | (F.col("rank") <= F.col("min_keep")))
        )
        .drop("min_keep", "max_keep")
    )


def promo_inputs(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(playable candidates of valid projects, rejects)``: 1-6 unique bounded candidates per project."""
    start, end, score = F.col("start_s"), F.col("end_s"), F.col("score")
    ok = (
        valid_id(F.col("id")) & finite(start) & finite(end) & (start >= 0) & (end - start >= 0.1)
        & (end - start <= 1800) & (end <= 7200) & finite(score) & (score >= 0) & (score <= 1)
        & text_ok(F.col("label"), 120, False) & text_ok(F.col("evidence"), 1000, False)
    )
    # ids are counted per (project, id) first, so no task sees all candidates of a large project
    per_id = candidates.groupBy("project_id", "id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"),
        F.count_if(~F.col("kind").isin(*NON_PLAY)).alias("playable"),
    )
    facts = per_id.groupBy("project_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("copies"), F.bool_and("ok").alias("ok"),
        F.sum("playable").alias("playable"),
    )
    reason = first_reason(
        (F.col("n") > 6, "too_many_candidates"),
        (~F.col("ok") | (F.col("copies") > 1), "invalid_candidate"),
        (F.col("playable") == 0, "no_highlights"),
    )
    verdict = facts.select("project_id", reason.alias("reason"))
    kept = candidates.where(~F.col("kind").isin(*NON_PLAY)).join(
        verdict.where(F.col("reason").isNull()).select("project_id"), "project_id"
    )
    return kept, verdict.where(F.col("reason").isNotNull())


def promo_plans(replies: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(plans, rejects)``.  ``replies``: project_id, ord, candidate_id, title, hook.

    One to three plans, every one on a supplied candidate, with distinct openings (hook, else title,
    lower-cased with white space collapsed); otherwise the whole reply is rejected.
    """
    scenes = candidates.select(
        "project_id", F.col("id").alias("candidate_id"), F.struct("id", "label", "start_s", "end_s", "evidence").alias("scene")
    )
    opening = F.when(not_blank(F.col("hook")), F.col("hook")).otherwise(F.col("title"))
    opening = F.lower(F.regexp_replace(trim_space(opening), f"{SPACE}+", " "))
    rows = replies.join(scenes, ["project_id", "candidate_id"], "left").withColumn("opening", opening).withColumn(
        "ok",
        F.col("scene").isNotNull() & text_ok(F.col("title"), 200, True) & text_ok(F.coalesce("hook", F.lit("")), 120, False),
    )
    per_opening = rows.groupBy("project_id", "opening").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok")
    )
    facts = per_opening.groupBy("project_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("copies"), F.bool_and("ok").alias("ok")
    )
    reason = first_reason(
        (F.col("n") > 3, "too_many_plans"),
        (~F.col("ok"), "unknown_or_unbounded"),
        (F.col("copies") > 1, "repeated_opening"),
    )
    verdict = facts.select("project_id", reason.alias("reason"))
    plans = rows.join(verdict.where(F.col("reason").isNull()).select("project_id"), "project_id").select(
        "project_id", "ord", "candidate_id", "title", F.coalesce("hook", F.lit("")).alias("hook"), "scene"
    )
    return plans, verdict.where(F.col("reason").isNotNull())
