"""Timeline of one project: evidence, coverage, topic placement and the four-phase span refinement.

A project has at most 256 candidate spans (checked first), so the order-dependent phases fold one small
array per project inside the JVM.  Everything that touches cues is a bucketed join on row-wise cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import interval_join
from ..functions.let import let
from ..functions.media_time import finite, micros
from ..functions.text import first_reason, text_ok, trim_space
from ..session import materialize
from .cues import cue_grounded, snap_to_cues, speech_edges

EXCERPT_CHARS = 1000
MAX_SPANS = 256
MAX_TOPICS = 256
MAX_CHUNKS = 256
MAX_CHUNK_TOPICS = 64
MAX_GAP = 5.0
MIN_COVERAGE = 0.5
HARD_MAX = 1800.0


def _meeting_cues(spans: DataFrame, cues: DataFrame, *payload: str) -> DataFrame:
    """Span keys with every cue that strictly overlaps the span."""
    left = spans.select("project_id", "span_id", "start_s", "end_s")
    right = cues.select(
        "project_id", "cue_idx", F.col("start_s").alias("c_start"), F.col("end_s").alias("c_end"), *payload
    )
    return interval_join(left, right, ["project_id"], ("start_s", "end_s"), ("c_start", "c_end")).where(
        (F.col("c_start") < F.col("end_s")) & (F.col("c_end") > F.col("start_s"))
    )


def evidence_excerpt(spans: DataFrame, cues: DataFrame) -> DataFrame:
    """Adds ``evidence``: overlapping cue texts, trimmed, in cue order, joined, first 1000 code points.

    Pairs of spans and cues carry text lengths.  Only cues that begin within the limit fetch their texts; a cue has a
    character and a blank at least, which bounds the cues of a span before any sum.
    """
    own = cues.withColumn("n", F.char_length(trim_space(F.col("text"))))
    order = Window.partitionBy("project_id", "span_id").orderBy("cue_idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    near = (
        _meeting_cues(spans, own, "n")
        .select("project_id", "span_id", "cue_idx", "n")
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= EXCERPT_CHARS // 2 + 1)
        .withColumn("at", F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0)))
        .where(F.col("at") <= EXCERPT_CHARS)  # at the limit itself, the blank in front still counts
    )
    texts = (
        near.join(cues.select("project_id", "cue_idx", "text"), ["project_id", "cue_idx"])
        .select("project_id", "span_id", "cue_idx", F.substring(trim_space(F.col("text")), 1, EXCERPT_CHARS).alias("x"))
        .groupBy("project_id", "span_id")
        .agg(F.array_sort(F.collect_list(F.struct("cue_idx", "x"))).alias("xs"))
        .select(
            "project_id", "span_id",
            F.substring(F.array_join(F.col("xs.x"), " "), 1, EXCERPT_CHARS).alias("evidence"),
        )
    )
    return spans.join(texts, ["project_id", "span_id"], "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(""))
    )


def covered_micros(spans: DataFrame, cues: DataFrame) -> DataFrame:
    """Adds ``covered_us``: length of the union of cue parts inside each span, in whole microseconds."""
    lo, hi = F.greatest("start_s", "c_start"), F.least("end_s", "c_end")
    parts = _meeting_cues(spans, cues).select(
        "project_id", "span_id", "cue_idx", micros(lo).alias("a"), micros(hi).alias("b")
    )
    earlier = (
        Window.partitionBy("project_id", "span_id").orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, -1)
    )
    gain = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(earlier), F.col("a"))))
    sums = (
        parts.withColumn("gain", gain)
        .groupBy("project_id", "span_id")
        .agg(F.sum("gain").alias("covered_us"))
    )
    return spans.join(sums, ["project_id", "span_id"], "left").withColumn(
        "covered_us", F.coalesce("covered_us", F.lit(0).cast("long"))
    )


def speech_coverage(spans: DataFrame, cues: DataFrame) -> DataFrame:
    """Adds ``coverage``: covered share of the span (cues sorted by start)."""
    length = micros(F.col("end_s")) - micros(F.col("start_s"))
    return (
        covered_micros(spans, cues)
        .withColumn("coverage", F.try_divide(F.col("covered_us"), length))
        .drop("covered_us")
    )


def merge_outlines(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk outlines -> ``(topics, report)``.

    ``replies``: project_id, chunk, items ``array<struct<title, subtopics>>`` (one row per chunk).  The
    first of equal titles stays; an empty chunk is skipped and counted; one malformed chunk, more than
    256 topics or none at all reject the project.  Dedupe happens inside the row.
    """
    bad_sub = lambda s: ~text_ok(s, 500, True)
    bad_item = lambda i: (
        ~text_ok(i["title"], 120, True)
        | (F.size(i["subtopics"]) > 20)
        | F.coalesce(F.exists(i["subtopics"], bad_sub), F.lit(False))
    )
    sized = F.coalesce(F.size("items") <= MAX_CHUNK_TOPICS, F.lit(False))
    first_of_title = let(
        F.transform("items", lambda i: i["title"]),
        lambda ts: F.filter("items", lambda i, n: F.array_position(ts, i["title"]) == n + 1),
    )
    chunks = replies.select(
        "project_id", "chunk", (~sized | F.coalesce(F.exists("items", bad_item), F.lit(True))).alias("bad"),
        F.when(sized, first_of_title).otherwise(F.slice("items", 1, 0)).alias("topics"),
    )
    facts = chunks.groupBy("project_id").agg(
        F.bool_or("bad").alias("bad"),
        F.sum(F.size("topics")).alias("n_topics"),
        F.count_if((F.size("topics") == 0) & ~F.col("bad")).alias("skipped"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    reason = first_reason(
        (F.col("n_chunks") > MAX_CHUNKS, "too_many_chunks"),
        (F.col("bad"), "malformed_chunk"),
        (F.col("n_topics") > MAX_TOPICS, "too_many_topics"),
        (F.col("n_topics") == 0, "no_topics"),
    )
    report = facts.select("project_id", "n_topics", "skipped", reason.alias("reason"))
    admitted = report.where(F.col("reason").isNull()).select("project_id")
    # an admitted project has at most 256 chunks: the running offset is a small window
    earlier = Window.partitionBy("project_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    topics = (
        chunks.join(admitted, "project_id")
        .withColumn("offset", F.coalesce(F.sum(F.size("topics")).over(earlier), F.lit(0)))
        .select("project_id", "chunk", "offset", F.posexplode_outer("topics").alias("n", "topic"))
        .where(F.col("n").isNotNull())
        .select(
            "project_id", "chunk",
            (F.col("offset") + F.col("n") + 1).alias("ord"),
            F.concat(F.lit("topic-"), F.col("offset") + F.col("n") + 1).alias("topic_id"),
            F.col("topic.title").alias("title"),
            F.col("topic.subtopics").alias("subtopics"),
        )
    )
    return topics, report


def place_topics(topics: DataFrame, replies: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Timeline reply rows placed on topics -> ``(placed, rejected chunks)``.

    ``replies``: project_id, chunk, row_no, topic_id, start_s, end_s; ``chunks``: project_id, chunk,
    chunk_start, chunk_end.  Bounds are clamped to the chunk; the first valid row of a topic wins.
    """
    known = topics.select("project_id", "chunk", "topic_id", "title")
    n_topics = known.groupBy("project_id", "chunk").agg(F.count(F.lit(1)).alias("n_topics"))
    n_rows = replies.groupBy("project_id", "chunk").agg(F.count(F.lit(1)).alias("n_rows"))
    verdict = n_topics.join(n_rows, ["project_id", "chunk"], "left").withColumn(
        "reason",
        first_reason(
            (F.coalesce(F.col("n_rows"), F.lit(0)) == 0, "empty_reply"),
            (F.col("n_rows") > F.col("n_topics"), "oversized_reply"),
        ),
    )
    admitted = verdict.where(F.col("reason").isNull()).select("project_id", "chunk")
    start, end = F.greatest("start_s", "chunk_start"), F.least("end_s", "chunk_end")
    placed = (
        replies.where(finite(F.col("start_s")) & finite(F.col("end_s")))
        .join(admitted, ["project_id", "chunk"])
        .join(chunks, ["project_id", "chunk"])
        .select("project_id", "chunk", "row_no", "topic_id", start.alias("start_s"), end.alias("end_s"))
        .where(F.col("end_s") > F.col("start_s"))
        .join(known, ["project_id", "chunk", "topic_id"])
        .groupBy("project_id", "chunk", "topic_id", "title")
        .agg(F.min_by(F.struct("row_no", "start_s", "end_s"), "row_no").alias("r"))
        .select("project_id", "chunk", "topic_id", "title", "r.row_no", "r.start_s", "r.end_s")
    )
    return placed, verdict.where(F.col("reason").isNotNull()).select("project_id", "chunk", "reason")


# ---------------------------------------------------------------------------------------------
# Span refinement.  ``items``: project_id, ord, label, start_s, end_s (placement order ``ord``);
# ``cues``: normalised cues; ``profile``: project_id, min_s, max_s, hard_max_s.
#
# After the first phase every bound is a cue edge, and brings what later phases ask of it: the speech before it and the
# next cue start (``speech_edges``).  So overlaps and speech are settled on the items alone; only spans that are too short
# look at cues again, to grow.

_ITEM = "struct<start_s:double,end_s:double,ord:int,label:string,su:bigint,eu:bigint,next_cue:double,next_u:bigint>"


def snap_items(items: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phase 1: check and snap bounds -> ``(snapped items, per-project facts with reason)``; ``edges`` from ``speech_edges``."""
    source = edges.groupBy("project_id").agg(F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))
    known = items.join(source, "project_id", "left")
    outside = (
        ~finite(F.col("start_s")) | ~finite(F.col("end_s")) | (F.col("end_s") <= F.col("start_s"))
        | (F.col("end_s") <= F.col("first_s")) | (F.col("start_s") >= F.col("last_s"))
    )
    checked = known.withColumn("outside", outside)
    gate = checked.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_input"), F.bool_or("outside").alias("outside"),
        F.count("first_s").alias("n_known"),
    )
    gate_reason = first_reason(
        (F.col("n_input") > MAX_SPANS, "too_many_spans"), (F.col("n_known") == 0, "no_cues"),
        (F.col("outside"), "reversed_or_outside"),
    )
    gate = gate.select("project_id", "n_input", gate_reason.alias("gate_reason"))
    admitted = checked.drop("outside").join(
        gate.where(F.col("gate_reason").isNull()).select("project_id"), "project_id"
    )
    bounds = F.array(
        F.struct(F.lit("start").alias("side"), F.greatest("start_s", "first_s").alias("t")),
        F.struct(F.lit("end").alias("side"), F.least("end_s", "last_s").alias("t")),
    )
    points = admitted.select("project_id", "ord", "label", "last_s", "start_s", "end_s", F.inline(bounds))
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    snapped = (
        snap_to_cues(points, edges, few_points=True, edges=True)
        .groupBy("project_id", "ord", "label", "last_s", F.col("start_s").alias("old_start"), F.col("end_s").alias("old_end"))
        .agg(
            at("start", "snapped").alias("start_s"), at("end", "snapped").alias("end_s"), at("start", "edge.u").alias("su"),
            at("end", "edge.u").alias("eu"), at("end", "edge.next").alias("next_cue"), at("end", "edge.next_u").alias("next_u"),
        )
        .withColumn("moved", (F.col("start_s") != F.col("old_start")) | (F.col("end_s") != F.col("old_end")))
        .drop("old_start", "old_end")
    )
    return snapped, gate


def resolve_overlaps(snapped: DataFrame) -> DataFrame:
    """Phase 2 -> one row per project: ``items`` (non-overlapping), ``merged``, ``shifted``, ``snapped``, ``bad``, ``last_s``."""
    per = snapped.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("start_s", "end_s", "ord", "label", "su", "eu", "next_cue", "next_u"))).alias("xs"),
        F.count_if("moved").alias("snapped"),
        F.bool_or(F.col("end_s") <= F.col("start_s")).alias("bad"),
        F.max("last_s").alias("last_s"),
    )
    zero = F.struct(
        F.array().cast(f"array<{_ITEM}>").alias("items"), F.lit(0).alias("merged"), F.lit(0).alias("shifted")
    )

    def step(acc: Column, x: Column) -> Column:
        items = acc["items"]
        prev = F.try_element_at(items, F.lit(-1))
        head = F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))
        overlap = F.least(prev["end_s"], x["end_s"]) - x["start_s"]
        shorter = F.least(prev["end_s"] - prev["start_s"], x["end_s"] - x["start_s"])
        meets = prev.isNotNull() & (overlap > 0)
        free_start = F.when(prev["next_cue"] < x["end_s"], prev["next_cue"])
        absorb = meets & ((overlap >= shorter * 0.5) | free_start.isNull())
        shift = meets & ~absorb
        later = x["end_s"] > prev["end_s"]
        of_end = lambda c: F.when(later, x[c]).otherwise(prev[c]).alias(c)
        grown = F.struct(
            prev["start_s"].alias("start_s"), of_end("end_s"), prev["ord"].alias("ord"), prev["label"].alias("label"),
            prev["su"].alias("su"), of_end("eu"), of_end("next_cue"), of_end("next_u"),
        )
        placed = F.struct(
            F.when(shift, free_start).otherwise(x["start_s"]).alias("start_s"),
            x["end_s"].alias("end_s"), x["ord"].alias("ord"), x["label"].alias("label"),
            F.when(shift, prev["next_u"]).otherwise(x["su"]).alias("su"), x["eu"].alias("eu"),
            x["next_cue"].alias("next_cue"), x["next_u"].alias("next_u"),
        )
        return F.struct(
            F.when(absorb, F.concat(head, F.array(grown))).otherwise(F.concat(items, F.array(placed))).alias("items"),
            (acc["merged"] + absorb.cast("int")).alias("merged"),
            (acc["shifted"] + shift.cast("int")).alias("shifted"),
        )

    folded = per.select("project_id", "snapped", "bad", "last_s", F.aggregate("xs", zero, step).alias("f"))
    return folded.select(
        "project_id", "snapped", "bad", "last_s", "f.items", F.col("f.merged").alias("merged"), F.col("f.shifted").alias("shifted")
    )


_COUNTERS = ("snapped", "bad", "merged", "shifted")


def extend_short(resolved: DataFrame, edges: DataFrame, profile: DataFrame) -> DataFrame:
    """Phase 3 -> row-wise spans ``project_id, n, ord, label, start_s, end_s, su, eu, extended`` plus profile columns and counters.

    Only spans under the minimum look at cues, and only at cues ending before the tier maximum.
    """
    following = F.transform(
        "items", lambda x, i: F.try_element_at(F.col("items"), (i + 2).cast("int"))["start_s"]
    )
    own = lambda c: F.col(f"z.items.{c}").alias(c)
    spans = (
        resolved.join(profile.select("project_id", "min_s", "max_s", "hard_max_s"), "project_id")
        .select(
            "project_id", "min_s", "max_s", "hard_max_s", "last_s", *_COUNTERS,
            F.posexplode(F.arrays_zip(F.col("items"), following.alias("following"))).alias("n", "z"),
        )
        .select(
            "project_id", "n", *map(own, ("ord", "label", "start_s", "end_s", "su", "eu")),
            F.coalesce(F.col("z.following"), F.col("last_s")).alias("limit_s"),
            "min_s", "max_s", "hard_max_s", *_COUNTERS,
        )
    )
    reach = F.least("limit_s", F.col("start_s") + F.col("max_s"))
    short = spans.where((F.col("end_s") - F.col("start_s") < F.col("min_s")) & (reach > F.col("end_s"))).select(
        "project_id", "n", F.col("start_s").alias("s"), F.col("end_s").alias("e"), "eu", reach.alias("reach"),
        "limit_s", "min_s", "max_s",
    )
    ahead = interval_join(
        short,
        edges.select("project_id", "cue_idx", F.col("start_s").alias("cs"), F.col("end_s").alias("ce"), F.col("end_u").alias("cu")),
        ["project_id"], ("e", "reach"), ("ce", "ce"),
    ).where(F.col("ce") > F.col("e"))
    per = ahead.groupBy("project_id", "n", "s", "e", "eu", "limit_s", "min_s", "max_s").agg(
        F.array_sort(F.collect_list(F.struct("cue_idx", "cs", "ce", "cu"))).alias("xs")
    )
    s, limit = F.col("s"), F.col("limit_s")

    def step(at: Column, c: Column) -> Column:
        e = at["e"]
        take = (
            (e - s < F.col("min_s")) & (c["ce"] > e) & (c["cs"] - e <= MAX_GAP) & (c["ce"] <= limit)
            & (c["ce"] - s <= F.col("max_s"))
        )
        return F.when(take, F.struct(c["ce"].alias("e"), c["cu"].alias("eu"))).otherwise(at)

    grown = per.select("project_id", "n", F.aggregate("xs", F.struct("e", "eu"), step).alias("grown"))
    end = F.coalesce("grown.e", "end_s")
    return (
        spans.join(grown, ["project_id", "n"], "left")
        .withColumn("extended", end > F.col("end_s"))
        .withColumns({"end_s": end, "eu": F.coalesce("grown.eu", "eu")})
        .drop("grown", "limit_s")
    )


_SPAN = "struct<start_s:double,end_s:double,ord:int,label:string,su:bigint,eu:bigint>"


def merge_short(spans: DataFrame) -> DataFrame:
    """Phase 4 -> one row per project: ``items``, ``merged``, ``dropped``, ``extended``, ``over_hard_max`` and the counters before.

    Speech inside a span is what its last edge has before it less what its first edge has.
    """
    per = spans.groupBy("project_id", "min_s", "max_s", *_COUNTERS).agg(
        F.array_sort(F.collect_list(F.struct("n", "start_s", "end_s", "ord", "label", "su", "eu"))).alias("xs"),
        F.count_if("extended").alias("extended"),
        F.bool_or(F.col("end_s") - F.col("start_s") > F.least(F.lit(HARD_MAX), F.col("hard_max_s"))).alias("over_hard_max"),
    )
    none = F.lit(None).cast(_SPAN)
    zero = F.struct(
        F.array().cast(f"array<{_SPAN}>").alias("done"), none.alias("cur"),
        F.lit(0).alias("merged"), F.lit(0).alias("dropped"),
    )
    min_s, max_s = F.col("min_s"), F.col("max_s")

    def until(first: Column, last: Column, end: Column, eu: Column) -> Column:
        return F.struct(
            first["start_s"].alias("start_s"), end.alias("end_s"), first["ord"].alias("ord"), first["label"].alias("label"),
            first["su"].alias("su"), eu.alias("eu"),
        )

    def close(acc: Column) -> Column:
        """Settle the open span: keep, join to the previous one, or drop."""
        cur, done = acc["cur"], acc["done"]
        prev = F.try_element_at(done, F.lit(-1))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        is_open = cur.isNotNull()
        is_short = is_open & (cur["end_s"] - cur["start_s"] < min_s)
        joins = is_short & F.coalesce(
            (cur["start_s"] - prev["end_s"] <= MAX_GAP) & (cur["end_s"] - prev["start_s"] <= max_s), F.lit(False)
        )
        silent = cur["eu"] - cur["su"] < (micros(cur["end_s"]) - micros(cur["start_s"])) * MIN_COVERAGE
        drop = is_open & ~joins & (is_short | silent)
        keep = is_open & ~is_short & ~drop
        later = cur["end_s"] > prev["end_s"]
        widened = until(
            prev, cur, F.greatest(prev["end_s"], cur["end_s"]), F.when(later, cur["eu"]).otherwise(prev["eu"])
        )
        return F.struct(
            F.when(joins, F.concat(head, F.array(widened)))
            .when(keep, F.concat(done, F.array(cur)))
            .otherwise(done)
            .alias("done"),
            none.alias("cur"),
            (acc["merged"] + joins.cast("int")).alias("merged"),
            (acc["dropped"] + drop.cast("int")).alias("dropped"),
        )

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        absorb = F.coalesce(
            (cur["end_s"] - cur["start_s"] < min_s)
            & (x["start_s"] - cur["end_s"] <= MAX_GAP)
            & (x["end_s"] - cur["start_s"] <= max_s),
            F.lit(False),
        )
        settled = close(acc)
        return F.when(
            absorb,
            F.struct(
                acc["done"].alias("done"), until(cur, x, x["end_s"], x["eu"]).alias("cur"),
                (acc["merged"] + 1).alias("merged"), acc["dropped"].alias("dropped"),
            ),
        ).otherwise(
            F.struct(
                settled["done"].alias("done"), until(x, x, x["end_s"], x["eu"]).alias("cur"),
                settled["merged"].alias("merged"), settled["dropped"].alias("dropped"),
            )
        )

    kept = ("project_id", "max_s", "extended", "over_hard_max", "snapped", "bad", "shifted")
    return per.select(*kept, "min_s", "merged", F.aggregate("xs", zero, step, close).alias("f")).select(
        *kept, F.col("merged").alias("merged_before"), F.col("f.done").alias("items"), F.col("f.merged").alias("merged"),
        F.col("f.dropped").alias("dropped"),
    )


def refine_timeline(items: DataFrame, cues: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All phases -> ``(candidates, report)``; a project with a ``reason`` in the report has no candidates.

    One plan leads from items and cues to a row per project, which is stored, since both results are read from it.
    ``cues`` and ``items`` should be stored tables too.
    """
    edges = speech_edges(cues)
    snapped, gate = snap_items(items, edges)
    resolved = resolve_overlaps(snapped)
    refined = merge_short(extend_short(resolved, edges, profile))
    # Every project with items has one row here, with the reason why it has no spans, if any.
    over = F.size(F.filter("items", lambda x: x["end_s"] - x["start_s"] > F.col("max_s") + 1e-6))
    final = materialize(
        gate.join(profile.select("project_id", F.lit(True).alias("tier")), "project_id", "left").join(
            refined.withColumn("over_tier", over), "project_id", "left"
        ),
        "refined",
    )
    zero = F.lit(0)
    none = F.lit(0).cast("long")
    bad = F.coalesce("bad", F.lit(False))  # such a project ends with the second phase
    late = lambda c, empty=zero: F.when(~bad & F.col(c).isNotNull(), F.col(c)).otherwise(empty)
    output = F.when(~bad & F.col("items").isNotNull(), F.size("items")).otherwise(zero)
    reason = first_reason(
        (F.col("gate_reason").isNotNull(), F.col("gate_reason")),
        (F.col("tier").isNull(), "no_profile"),
        (F.col("bad"), "not_grounded"),
        (F.col("over_hard_max"), "over_hard_max"),
        (output == 0, "nothing_survived"),
    )
    report = final.select(
        "project_id", F.col("n_input").alias("input"), output.alias("output"), F.coalesce("snapped", none).alias("snapped"),
        (F.coalesce("merged_before", zero) + late("merged")).alias("merged"), F.coalesce("shifted", zero).alias("shifted"),
        late("extended", none).alias("extended"), F.lit(0).alias("trimmed"), late("dropped").alias("dropped"),
        late("over_tier").alias("over_tier"), reason.alias("reason"),
    )
    rows = (
        final.where(~F.col("over_hard_max") & ~F.col("bad"))
        .select("project_id", F.posexplode("items").alias("i", "x"))
        .select(
            "project_id", (F.col("i") + 1).alias("span_id"), F.concat(F.lit("text-"), F.col("i") + 1).alias("id"),
            F.col("x.label").alias("label"), F.col("x.start_s").alias("start_s"), F.col("x.end_s").alias("end_s"),
        )
    )
    candidates = evidence_excerpt(rows, cues).select(
        "project_id", F.col("span_id").alias("ord"), "id", "label", "start_s", "end_s", "evidence",
        F.lit(0.0).alias("score"), F.lit("text").alias("kind"),
    )
    return candidates, report


def quality_report(items: DataFrame, cues: DataFrame, profile: DataFrame) -> DataFrame:
    """Counters of the refinement with ``consistent``: whether the surviving rows bear them out.

    A project's rows must be as many as reported, in order without overlap, bounded by cue edges, and hold as many spans
    over the tier maximum as reported; a project with a reason must have none.
    """
    candidates, report = refine_timeline(items, cues, profile)
    spans = cue_grounded(candidates.select("project_id", F.col("ord").alias("span_id"), "start_s", "end_s"), cues)
    before = Window.partitionBy("project_id").orderBy("span_id")  # at most 256 spans in a project
    found = (
        spans.withColumn("after", F.coalesce(F.lag("end_s").over(before) <= F.col("start_s"), F.lit(True)))
        .join(profile.select("project_id", "max_s"), "project_id", "left")
        .groupBy("project_id")
        .agg(
            F.count("*").alias("n"),
            F.bool_and(F.col("grounded") & F.col("after") & (F.col("end_s") > F.col("start_s"))).alias("sound"),
            F.count_if(F.col("end_s") - F.col("start_s") > F.col("max_s") + 1e-6).alias("n_over"),
        )
    )
    none = F.col("n").isNull()
    agrees = F.col("sound") & (F.col("n") == F.col("output")) & (F.col("n_over") == F.col("over_tier"))
    return (
        report.join(found, "project_id", "left")
        .withColumn("consistent", F.when(F.col("reason").isNotNull(), none).otherwise(F.coalesce(agrees, F.lit(False))))
        .drop("n", "sound", "n_over")
    )


def check_timeline(candidates: DataFrame, report: DataFrame, cues: DataFrame, profile: DataFrame) -> DataFrame:
    """``project_id, reason``: whether a stored timeline still holds when it is used again (null: it does).

    ``candidates``: project_id, ord, id, label, start_s, end_s, evidence, score, kind; ``report``: project_id, output, over_tier;
    ``profile``: project_id, min_s, max_s, hard_max_s.  Of all rules that some row breaks the first is named: the number of rows,
    their ids in order, labels, bounds, order without overlap, length between minimum and hard maximum, edges of cues,
    evidence as the cues give it, speech over half of the span, kind and score, and the number of rows over the tier.
    """
    sound = F.coalesce(finite(F.col("start_s")) & finite(F.col("end_s")), F.lit(False))
    keys = candidates.withColumnRenamed("ord", "span_id").withColumns(
        {"sound": sound, **{c: F.when(sound, F.col(c)).otherwise(0.0) for c in ("start_s", "end_s")}}  # lookups need numbers
    )
    grounded = cue_grounded(keys.select("project_id", "span_id", "start_s", "end_s"), cues).select("project_id", "span_id", "grounded")
    covered = covered_micros(keys.select("project_id", "span_id", "start_s", "end_s"), cues).select("project_id", "span_id", "covered_us")
    told = evidence_excerpt(keys.select("project_id", "span_id", "start_s", "end_s"), cues).select(
        "project_id", "span_id", F.col("evidence").alias("said")
    )
    on = ["project_id", "span_id"]
    # Only projects of at most 256 rows come to the window; more are an error by themselves.
    before = Window.partitionBy("project_id").orderBy("span_id")
    sized = report.select("project_id", "output", "over_tier")
    counts = keys.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    few = counts.where(F.col("n") <= MAX_SPANS).select("project_id")
    rows = (
        keys.join(few, "project_id")
        .join(grounded, on).join(covered, on).join(told, on)
        .join(profile.select("project_id", "min_s", "max_s", "hard_max_s"), "project_id")
        .withColumns({"place": F.row_number().over(before), "prior": F.lag("end_s", 1, 0.0).over(before)})
    )
    length = F.col("end_s") - F.col("start_s")
    hard = F.when(F.col("hard_max_s") > 0, F.least(F.lit(HARD_MAX), F.col("hard_max_s"))).otherwise(F.lit(HARD_MAX))
    silent = F.col("covered_us") < (micros(F.col("end_s")) - micros(F.col("start_s"))) * MIN_COVERAGE
    rules = {
        "id": F.col("id") != F.concat(F.lit("text-"), F.col("place")), "label": ~text_ok(F.col("label"), 120, True),
        "bounds": ~F.col("sound"), "overlap": F.col("start_s") < F.col("prior"),
        "too_short": length < F.col("min_s") - 1e-6, "too_long": length > hard + 1e-6, "not_grounded": ~F.col("grounded"),
        "evidence": ~F.col("evidence").eqNullSafe(F.col("said")), "silence": silent,
        "kind": (F.col("kind") != "text") | (F.col("score") != 0),
    }
    facts = rows.groupBy("project_id").agg(
        *[F.bool_or(F.coalesce(rule, F.lit(True))).alias(f"x_{name}") for name, rule in rules.items()],
        F.count_if(length > F.col("max_s") + 1e-6).alias("n_over"),
    )
    reason = first_reason(
        (F.coalesce(F.col("n"), F.lit(0)) == 0, "empty"), (F.col("n") != F.col("output"), "count"),
        (F.col("n") > MAX_SPANS, "too_many_spans"), (F.col("n_over").isNull(), "no_profile"),
        *[(F.col(f"x_{name}"), name) for name in rules], (F.col("n_over") != F.col("over_tier"), "over_tier"),
    )
    return sized.join(counts, "project_id", "left").join(facts, "project_id", "left").select("project_id", reason.alias("reason"))
