"""Fusion of text and visual evidence, draft matching and near-duplicate suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_join
from ..functions.scan import Scan, has_large, hot_key_parts, over_salts, salt_hot_keys, scan
from ..functions.scores import two_decimals
from ..functions.text import not_blank
from ..session import materialize

MAX_FUSED = 6
MATCH_GAP = 2.0
# Evidence prefixes and reason texts.
TEXT_MARK, VISUAL_MARK = "字幕：", "画面："
REASON_TEXT = "仅有字幕证据，未发现对应画面证据"
REASON_VISUAL = "仅有画面证据，未发现可用字幕证据"
REASON_JOINT = ("字幕 ", " + 画面 ", "，时间段重叠并合并")


def earliest_within(probes: DataFrame, spans: DataFrame, gap: float) -> DataFrame:
    """``project_id, v_ord, home``: for every probe the lowest ordinal among the spans within ``gap`` seconds, if any.

    Both sides: project_id, ord, start_s, end_s; empty spans take no part.  Time is cut into cells of twice the gap, so a
    probe, widened by the gap, always reaches into a second cell.  Then one bound decides in each cell.  In a probe's first
    cell it is the end: any span that touches the cell and ends at or after the probe's start is within reach.  Other
    spans within reach start in a later cell: in those between any start will do, in the last one a start at or before the
    probe's end.  A probe reads the running minimum of the ordinals at its own bound.

    The work is the number of cells that spans and probes touch.  A cell with very many entries is cut into slices that
    carry their minimum.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    width = F.lit(2.0 * gap)
    real = F.col("end_s") > F.col("start_s")
    cell = lambda c: F.floor(c / width).cast("long")
    lo, hi = F.col("start_s") - gap, F.col("end_s") + gap

    # Entries at or above a probe's bound are within its reach: ends as they are, starts with their sign turned.
    touched = F.transform(
        F.sequence(cell(F.col("start_s")), cell(F.col("end_s"))),
        lambda c: F.struct(c.alias("cell"), F.lit(0).alias("side"), F.least("end_s", (c + 1) * width).alias("bound")),
    )
    begun = F.struct(cell(F.col("start_s")).alias("cell"), F.lit(1).alias("side"), (-F.col("start_s")).alias("bound"))
    entries = spans.where(real).select(
        "project_id", F.col("ord").alias("home"), F.inline(F.concat(touched, F.array(begun)))
    )
    first, last = cell(lo), cell(hi)
    asked = (
        probes.where(real)
        .select("project_id", F.col("ord").alias("v_ord"), lo.alias("lo"), hi.alias("hi"), first.alias("first"), last.alias("last"))
        .select("*", F.explode(F.sequence("first", "last")).alias("cell"))
        .select(
            "project_id", "cell",
            (F.col("cell") > F.col("first")).cast("int").alias("side"),
            F.when(F.col("cell") == F.col("first"), F.col("lo")).when(F.col("cell") == F.col("last"), -F.col("hi"))
            .otherwise(-(F.col("cell") + 1) * width).alias("bound"),
            "v_ord",
        )
    )
    both = entries.withColumn("v_ord", F.lit(None).cast(asked.schema["v_ord"].dataType)).unionByName(
        asked.withColumn("home", F.lit(None).cast(entries.schema["home"].dataType))
    )
    # Among equal bounds, entries come first (descending: a missing probe sorts above any).
    placed = both.withColumn("entry", F.col("v_ord").isNull()).withColumn("tie", F.coalesce("v_ord", "home"))
    keys, order = ["project_id", "cell", "side"], ["bound", "entry", "tie"]
    rows = probes.select("project_id").unionAll(spans.select("project_id"))
    large = has_large(rows, ["project_id"])  # a cell has no more entries than its project has rows
    seen = scan(
        materialize(placed, "cells") if large else placed, keys, order, [Scan("least", "max", -F.col("home"))], large, True
    )
    return (
        seen.where(F.col("v_ord").isNotNull() & F.col("least").isNotNull())
        .groupBy("project_id", "v_ord")
        .agg((-F.max("least")).alias("home"))
    )


def fuse_evidence(
    text: DataFrame, visual: DataFrame, gap: float = MATCH_GAP, keep: int = MAX_FUSED
) -> DataFrame:
    """Ranked fused candidates, at most ``keep`` per project.

    Inputs: project_id, ord (unique per project), label, start_s, end_s, evidence, score, kind.  Every
    visual goes to the lowest-ordinal text within ``gap`` seconds; of several visuals on one text the
    highest ordinal stays; unmatched visuals follow.  Ids number the groups before ranking.

    The match probes a cell index (``earliest_within``); no pairs are listed.  Ranking is cut to ``keep`` rows per project in every map task; only the survivors get a
    group number, as a salted count of the groups at or before them.
    """
    homes = materialize(earliest_within(visual, text, gap), "homes")  # narrow, read by several later steps

    payload = F.struct("label", "start_s", "end_s", "evidence", "score", "kind")
    t = text.select("project_id", F.col("ord").alias("ord"), payload.alias("t"))
    v = visual.select("project_id", F.col("ord").alias("v_ord"), payload.alias("v"))
    placed = v.join(homes, ["project_id", "v_ord"], "left")
    winners = (
        placed.where(F.col("home").isNotNull())
        .groupBy("project_id", F.col("home").alias("ord"))
        .agg(F.max_by("v", "v_ord").alias("v"))
    )
    no_text = F.lit(None).cast(t.schema["t"].dataType)
    lone = placed.where(F.col("home").isNull()).select(
        "project_id", F.lit(1).alias("part"), F.col("v_ord").alias("ord"), no_text.alias("t"), "v"
    )
    groups = (
        t.join(winners, ["project_id", "ord"], "left")
        .select("project_id", F.lit(0).alias("part"), "ord", "t", "v")
        .unionByName(lone)
    )
    joint = F.col("t").isNotNull() & F.col("v").isNotNull()
    score = (
        F.when(joint, F.least(F.lit(1.0), (F.col("t.score") + F.col("v.score")) / 2 + 0.1))
        .otherwise(F.coalesce("t.score", "v.score"))
    )
    best_first = Window.partitionBy("project_id").orderBy(F.col("score").desc(), F.col("part"), F.col("ord"))
    top = groups.withColumn("score", score).withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= keep
    )
    marks = top.groupBy("project_id").agg(F.collect_list(F.struct("rank", "part", "ord")).alias("marks"))
    every = text.select("project_id", F.lit(0).alias("part"), "ord").unionByName(lone.select("project_id", "part", "ord"))
    parts = hot_key_parts(every, ["project_id"])
    keys = salt_hot_keys(every, ["project_id"], ["part", "ord"], parts)
    reached = lambda i: F.count_if(
        F.struct("part", "ord") <= F.struct(F.try_element_at("marks", F.lit(i + 1))["part"].alias("part"),
                                            F.try_element_at("marks", F.lit(i + 1))["ord"].alias("ord"))
    ).alias(f"c{i}")
    counted = (
        keys.join(over_salts(marks, ["project_id"], parts), ["project_id", "__salt"])
        .groupBy("project_id", "__salt").agg(F.first("marks").alias("marks"), *[reached(i) for i in range(keep)])
        .groupBy("project_id").agg(F.first("marks").alias("marks"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(keep)])
    )
    counts = F.array(*[F.col(f"c{i}") for i in range(keep)])
    numbers = counted.select(
        "project_id", F.inline(F.transform("marks", lambda m, i: F.struct(m["rank"].alias("rank"), F.get(counts, i).alias("group_no"))))
    )
    ranked = top.join(numbers, ["project_id", "rank"])

    mark = lambda side, prefix: F.when(
        not_blank(F.col(f"{side}.evidence")), F.concat(F.lit(prefix), F.col(f"{side}.evidence"))
    )
    base = lambda c: F.coalesce(F.col(f"v.{c}"), F.col(f"t.{c}"))
    kind = F.when(joint, F.lit("joint")).when(F.col("v").isNull(), F.lit("subtitle-only")).otherwise(F.lit("visual-only"))
    reason = (
        F.when(
            joint,
            F.concat(
                F.lit(REASON_JOINT[0]), two_decimals(F.col("t.score")), F.lit(REASON_JOINT[1]),
                two_decimals(F.col("v.score")), F.lit(REASON_JOINT[2]),
            ),
        )
        .when(F.col("v").isNull(), F.lit(REASON_TEXT))
        .otherwise(F.lit(REASON_VISUAL))
    )
    return ranked.select(
        "project_id", "rank",
        F.concat(F.lit("fused-"), F.when(F.col("group_no") < 1000, F.lpad(F.col("group_no").cast("string"), 3, "0"))
                 .otherwise(F.col("group_no").cast("string"))).alias("id"),
        base("label").alias("label"),
        F.when(joint, F.least("t.start_s", "v.start_s")).otherwise(base("start_s")).alias("start_s"),
        F.when(joint, F.greatest("t.end_s", "v.end_s")).otherwise(base("end_s")).alias("end_s"),
        F.concat_ws(" ", mark("t", TEXT_MARK), mark("v", VISUAL_MARK)).alias("evidence"),
        "score", kind.alias("kind"), reason.alias("selection_reason"),
    )


def match_drafts(candidates: DataFrame, drafts: DataFrame) -> DataFrame:
    """Adds ``draft_id, overlap``: the draft whose first scene overlaps most (lowest ``ord`` on ties), if any.

    ``candidates``: project_id, id, start_s, end_s; ``drafts``: project_id, ord, draft_id, start_s, end_s.
    """
    c = candidates.select("project_id", "id", F.col("start_s").alias("c0"), F.col("end_s").alias("c1"))
    d = drafts.select("project_id", "ord", F.col("start_s").alias("d0"), F.col("end_s").alias("d1"))
    pairs = (
        interval_join(c, d, ["project_id"], ("c0", "c1"), ("d0", "d1"))
        .withColumn("overlap", F.least("c1", "d1") - F.greatest("c0", "d0"))
        .where(F.col("overlap") > 0)
    )
    return _with_best(candidates, pairs.select("project_id", "id", "ord", "overlap"), drafts)


def match_ranked(fused: DataFrame, drafts: DataFrame) -> DataFrame:
    """``match_drafts`` for the few ranked candidates of a project (at most ``MAX_FUSED``): work linear in the drafts.

    Every draft meets the one short list of its project and names the candidates that it overlaps; the best draft
    per candidate is cut in the map tasks.  A project with very many drafts meets copies of its list in parts.
    """
    lists = fused.groupBy("project_id").agg(F.collect_list(F.struct("id", "start_s", "end_s")).alias("cs"))
    parts = hot_key_parts(drafts, ["project_id"])
    placed = salt_hot_keys(drafts.select("project_id", "ord", "start_s", "end_s"), ["project_id"], ["ord"], parts)
    met = placed.join(over_salts(lists, ["project_id"], parts), ["project_id", "__salt"])
    overlaps = F.transform(
        "cs",
        lambda c: F.struct(
            c["id"].alias("id"),
            (F.least(c["end_s"], F.col("end_s")) - F.greatest(c["start_s"], F.col("start_s"))).alias("overlap"),
        ),
    )
    pairs = met.select("project_id", "ord", F.inline(F.filter(overlaps, lambda c: c["overlap"] > 0)))
    return _with_best(fused, pairs, drafts)


def _with_best(candidates: DataFrame, pairs: DataFrame, drafts: DataFrame) -> DataFrame:
    """``candidates`` with the id and the overlap of the best of their drafts."""
    order = Window.partitionBy("project_id", "id").orderBy(F.col("overlap").desc(), "ord")
    best = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).drop("n")
    named = best.join(drafts.select("project_id", "ord", "draft_id"), ["project_id", "ord"]).drop("ord")
    return candidates.join(named, ["project_id", "id"], "left")


#: What a new draft starts with.
NEW_DRAFT = {
    "hook": "", "aspect": "original", "layout": "fit", "crop_x": 0.5, "title_style": "plain",
    "title_template_version": 1, "title_motion": True, "title_scale": 1.0, "title_y": 0.12, "original_audio": True, "revision": 1,
}


def rebuild_drafts(fused: DataFrame, originals: DataFrame, workflows: DataFrame) -> DataFrame:
    """A draft for every fused candidate: a copy of the original that it overlaps most, or else a new one.

    ``originals``: project_id, ord, draft_id, scenes and the columns of ``NEW_DRAFT`` (only the first scene counts; without
    scenes a draft is no match); ``workflows``: project_id, workflow_id, burn_subtitles.  Whatever it was copied from,
    a draft has the candidate's label and span as its title and only scene.  ``source_draft_id`` names the original.
    """
    first = F.try_element_at("scenes", F.lit(1))
    scened = originals.select(
        "project_id", "ord", "draft_id", first["start_s"].alias("start_s"), first["end_s"].alias("end_s")
    ).where(F.col("start_s").isNotNull())
    matched = match_ranked(fused, scened).withColumnRenamed("draft_id", "source_draft_id")
    style = originals.select("project_id", F.col("draft_id").alias("source_draft_id"), F.struct(*NEW_DRAFT).alias("o"))
    copied = F.col("source_draft_id").isNotNull()
    key = F.concat_ws(":", "workflow_id", "id", (F.col("rank") - 1).cast("string"))
    return (
        matched.join(style, ["project_id", "source_draft_id"], "left")
        .join(workflows, "project_id")
        .select(
            "project_id", "rank", F.substring(F.sha2(key, 256), 1, 32).alias("draft_id"), "source_draft_id", "overlap",
            F.col("label").alias("title"),
            F.array(F.struct("id", "label", "start_s", "end_s", "evidence")).alias("scenes"),
            *[F.when(copied, F.col("o")[c]).otherwise(F.lit(v)).alias(c) for c, v in NEW_DRAFT.items()],
            F.col("burn_subtitles").alias("subtitles"), F.lit("highlight").alias("goal"), F.lit("fused-highlight").alias("origin"),
        )
    )


#: Best rows of a project that one round of the suppression looks at.
TOP_LIST = 64

_KEPT = "array<struct<rank:int,ord:bigint,start_s:double,end_s:double>>"


def _clear(x: Column, kept: Column, ratio: float) -> Column:
    """Whether a span overlaps none of the kept ones by more than ``ratio`` of the shorter of both."""

    def clash(k: Column) -> Column:
        overlap = F.least(x["end_s"], k["end_s"]) - F.greatest(x["start_s"], k["start_s"])
        shorter = F.least(x["end_s"] - x["start_s"], k["end_s"] - k["start_s"])
        return (x["ord"] == k["ord"]) | ((overlap > 0) & (overlap / shorter > ratio))

    return ~F.exists(kept, clash)


def suppress_near_duplicates(
    drafts: DataFrame, ratio: float = 0.8, keep: int = 6, top: int = TOP_LIST
) -> DataFrame:
    """Score-descending greedy: drop a draft overlapping a kept one by more than ``ratio`` of the shorter.

    ``drafts``: project_id, draft_id, ord (unique per project), start_s, end_s, score.  A round takes the best ``top`` rows of
    each project, cut to that number in every map task, and folds them.  The kept ones of a project are then ``keep``, or its
    rows are used up, or it goes on with what is clear of them.  The best of those is kept in any case, so ``keep`` rounds
    are enough; nearly always the first one is, and the next reads the unfinished projects only.  Rounds move ordinals,
    scores and bounds; ids are joined to the winners.
    """
    rows = drafts.select(
        "project_id", F.col("ord").cast("long").alias("ord"), "start_s", "end_s", F.coalesce("score", F.lit(0.0)).alias("score")
    )
    best = Window.partitionBy("project_id").orderBy(F.col("score").desc(), "ord")

    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) < keep) & _clear(x, kept, ratio), F.concat(kept, F.array(x))).otherwise(kept)

    def fold(left: DataFrame) -> DataFrame:
        listed = (
            left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .groupBy("project_id")
            .agg(
                F.array_sort(F.collect_list(F.struct("rank", "ord", "start_s", "end_s"))).alias("xs"),
                F.first("kept").alias("kept"),
            )
        )
        return listed.select(
            "project_id",
            F.aggregate("xs", F.col("kept"), step).alias("kept"),
            (F.size("xs") == top).alias("more"),
        )

    none = F.expr(f"CAST(array() AS {_KEPT})")
    unfinished = (F.size("kept") < keep) & F.col("more")
    settled = materialize(fold(rows.withColumn("kept", none)), "kept")
    done = [settled.where(~unfinished)]
    while not (rest := settled.where(unfinished)).isEmpty():
        left = rows.join(rest.select("project_id", "kept"), "project_id").where(
            _clear(F.struct("ord", "start_s", "end_s"), F.col("kept"), ratio)
        )
        # A project without a clear row is finished too.
        settled = materialize(
            rest.select("project_id", F.col("kept").alias("before")).join(fold(left), "project_id", "left").select(
                "project_id", F.coalesce("kept", "before").alias("kept"), F.coalesce("more", F.lit(False)).alias("more")
            ),
            "kept",
        )
        done.append(settled.where(~unfinished))
    winners = reduce(DataFrame.unionByName, done).select("project_id", F.posexplode("kept").alias("i", "x"))
    names = drafts.select(
        "project_id", F.col("ord").cast("long").alias("ord"), "draft_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )
    return (
        winners.select("project_id", (F.col("i") + 1).alias("rank"), "x.ord", "x.start_s", "x.end_s")
        .join(names, ["project_id", "ord"])
        .select("project_id", "rank", "draft_id", "start_s", "end_s", "score")
    )
