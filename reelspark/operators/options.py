"""Options, projects and provider logs: row-local rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_reason, text_ok, trim_space

# Accepted option members.
ASPECTS = ("original", "portrait", "landscape")
GOALS = ("content", "highlight", "promo")
MODES = ("subtitle", "auto", "visual", "fused")
CATEGORIES = ("knowledge", "speech", "business", "entertainment", "opinion", "experience", "content_review")


def validate_options(plans: DataFrame, strict: bool = False) -> DataFrame:
    """Fills defaults and adds ``reason`` to rows with mode, duration, aspect, category, instruction, goals.

    ``strict`` is the request form: no defaults, duration 0 or 10..120, and visual analysis cannot serve
    content alone.
    """
    aspect = F.coalesce(F.col("aspect"), F.lit(""))
    goals = F.coalesce(F.col("goals"), F.array().cast("array<string>"))
    if not strict:
        aspect = F.when(aspect == "", F.lit("original")).otherwise(aspect)
        goals = F.when(F.size(goals) == 0, F.array(F.lit("content"))).otherwise(goals)
    mode, category = F.coalesce(F.col("mode"), F.lit("")), F.coalesce(F.col("category"), F.lit(""))
    d, instruction = F.col("duration"), F.coalesce(F.col("instruction"), F.lit(""))
    wrong_goal = F.exists(goals, lambda g: ~g.isin(*GOALS)) | (F.size(F.array_distinct(goals)) < F.size(goals))
    bad_category = (category != "") & ~category.isin(*CATEGORIES)
    if strict:
        rules = [
            (~mode.isin(*MODES), "mode"),
            ((d != 0) & ((d < 10) | (d > 120)), "duration"),
            (~aspect.isin(*ASPECTS) | (F.octet_length(instruction) > 4000) | bad_category, "options"),
            ((F.size(goals) < 1) | (F.size(goals) > 3), "goal_count"),
            (wrong_goal, "goals"),
            ((mode == "visual") & (F.size(goals) == 1) & (F.element_at(goals, 1) == "content"), "visual_content"),
        ]
    else:
        rules = [
            (
                (d < 0) | (d > 1800) | ~aspect.isin(*ASPECTS) | ~text_ok(instruction, 4000, False) | bad_category
                | ~mode.isin("", *MODES) | (F.size(goals) > 3),
                "options",
            ),
            (wrong_goal, "goals"),
        ]
    return plans.withColumns({"reason": first_reason(*rules), "aspect": aspect, "goals": goals})


def route_goals(plans: DataFrame) -> DataFrame:
    """One row per goal with the analysis ``route`` it uses."""
    mode = F.col("mode")
    visual = F.col("allow_visual") & (F.col("goal") != "content")
    route = (
        F.when(F.col("goal") == "content", F.lit("subtitle"))
        .when((mode == "auto") & visual, F.lit("visual"))
        .when(mode == "auto", F.lit("subtitle"))
        .otherwise(mode)
    )
    others = [c for c in plans.columns if c != "goals"]
    return plans.select(*others, F.explode("goals").alias("goal")).withColumn("route", route)


def open_goals(goals: DataFrame, plans: DataFrame) -> DataFrame:
    """``workflow_id, goal, route`` of the goals that are to be produced: a retry skips goals that have drafts.

    ``goals``: workflow_id, goal, n_drafts; ``plans``: workflow_id, mode, allow_visual.
    """
    missing = goals.where(F.col("n_drafts") == 0).select("workflow_id", F.array("goal").alias("goals"))
    routed = route_goals(missing.join(plans.select("workflow_id", "mode", "allow_visual"), "workflow_id"))
    return routed.select("workflow_id", "goal", "route")


def combine_routes(goals: DataFrame, analyses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of all routes that a workflow ran, with ids made unique across routes by prefix.

    ``goals``: from ``open_goals``; ``analyses``: workflow_id, route, ok; ``candidates``: project or workflow rows with workflow_id,
    route, id.  A route runs once however many goals share it, and gives nothing if its analysis failed.
    """
    ran = goals.select("workflow_id", "route").distinct().join(analyses.where("ok").select("workflow_id", "route"), ["workflow_id", "route"])
    return candidates.join(ran, ["workflow_id", "route"]).withColumn("id", F.concat_ws("-", F.col("route"), F.col("id")))


def output_dimensions(info: DataFrame) -> DataFrame:
    """Adds ``out_w, out_h`` to rows with width, height, aspect; (0, 0) when invalid."""
    w, h, aspect = F.col("width"), F.col("height"), F.col("aspect")
    sane = w.between(2, 16384) & h.between(2, 16384)
    scale = F.least(F.lit(1.0), F.lit(1920.0) / F.greatest(w, h))
    even = lambda side: F.greatest(F.lit(2), (F.floor(F.floor(side * scale) / 2) * 2).cast("int"))

    def pick(portrait: int, landscape: int, side: Column) -> Column:
        return (
            F.when(aspect == "portrait", F.lit(portrait))
            .when(aspect == "landscape", F.lit(landscape))
            .when((aspect == "original") & sane, even(side))
            .otherwise(F.lit(0))
        )

    return info.withColumns({"out_w": pick(1080, 1920, w), "out_h": pick(1920, 1080, h)})


REASON_FUSED = "将结合字幕和抽样画面寻找高光片段；没有字幕时会尝试本地转写，仍可使用画面证据。"
REASON_SUBTITLES = "检测到可用字幕；默认同时使用字幕和抽样画面寻找高光，这是本地检查，尚未调用模型。"
REASON_SILENT = "素材无音轨且没有可用字幕；默认使用抽样画面寻找高光。"


def recommend_plan(projects: DataFrame) -> DataFrame:
    """Local recommendation from subtitle status and audio presence."""
    reason = (
        F.when(F.col("subtitle_status") == "available", F.lit(REASON_SUBTITLES))
        .when(~F.col("has_audio"), F.lit(REASON_SILENT))
        .otherwise(F.lit(REASON_FUSED))
    )
    return projects.withColumns(
        {
            "plan_status": F.lit("awaiting_confirmation"), "mode": F.lit("fused"), "aspect": F.lit("original"),
            "goals": F.array(F.lit("highlight")), "plan_reason": reason,
        }
    )


def search_projects(projects: DataFrame, query: str, ordered: bool = True) -> DataFrame:
    """Case-insensitive substring on ``name``; newest update first."""
    hits = projects.where(F.contains(F.lower("name"), trim_space(F.lower(F.lit(query)))))
    return hits.orderBy(F.col("updated_at").desc()) if ordered else hits


# Provider error labels by class.
MODEL_LABELS = ("model_not_found", "invalid_model", "model_not_supported", "unsupported_model", "model_not_available")
AUTH_LABELS = ("invalid_api_key", "authentication_error", "invalid_authentication")
RATE_LABELS = ("rate_limit_exceeded", "insufficient_quota")
MAX_ATTEMPTS = 3


def classify_errors(log: DataFrame, body_col: str = "body") -> DataFrame:
    """Failed responses -> ``code, retryable, will_retry``.

    ``log``: request_id, attempt (1-based), status (null = no response), network (transient network failure),
    timed_out, body.
    """
    e = F.from_json(body_col, "error struct<code string, type string, param string>")["error"]
    code, kind, param = (F.coalesce(e[c], F.lit("")) for c in ("code", "type", "param"))
    has = lambda labels: code.isin(*labels) | kind.isin(*labels)
    status = F.coalesce(F.col("status"), F.lit(0))
    label = (
        F.when(F.col("status").isNull() & F.col("timed_out"), F.lit("timeout"))
        .when(F.col("status").isNull(), F.lit("endpoint"))
        .when(status.isin(401, 403) | has(AUTH_LABELS), F.lit("auth"))
        .when((status == 429) | has(RATE_LABELS), F.lit("rate_limit"))
        .when(status.isin(408, 504), F.lit("timeout"))
        .when((param == "model") | has(MODEL_LABELS), F.lit("model"))
        .otherwise(F.lit("endpoint"))
    )
    out = log.withColumn("code", label)
    retryable = (F.col("code") == "endpoint") & (status >= 500)
    transient = F.coalesce(F.col("network"), F.lit(False)) | (status == 429) | status.between(500, 599)
    will_retry = ~F.col("code").isin("auth", "model") & transient & (F.col("attempt") < MAX_ATTEMPTS)
    return out.withColumns({"retryable": retryable, "will_retry": will_retry})


def silence_gate(samples: DataFrame, threshold: int = 32) -> DataFrame:
    """``file_id, sample`` -> ``has_signal`` per file (partial aggregation)."""
    return samples.groupBy("file_id").agg(
        (F.max(F.abs(F.col("sample").cast("int"))) > threshold).alias("has_signal")
    )
