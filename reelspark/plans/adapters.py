"""Domain tables derived from the given tables, for the registered queries.

Formulas are integer milliseconds first and ``/ 1000`` last, so every engine gets the same doubles.
All adapters read whole tables; ``%`` only varies attributes of a row, it never drops rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.media_time import srt_clock
from ..functions.text import not_blank
from ..operators.cues import normalize_cues
from ..operators.selection import duration_profile
from ..session import materialize, spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), not_blank)


def long_cues(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle lines of each document as raw cues."""
    lines = (
        table(spark, d, "documents")
        .select(F.col("doc_id").alias("project_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
        .where(not_blank(F.col("text")))
    )
    dur = 400 + 80 * F.char_length("text")
    gap = (F.col("seq") * 700) % 3100
    before = Window.partitionBy("project_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum((dur + gap).cast("long")).over(before), F.lit(0).cast("long"))
    return (
        lines.withColumn("s", start)
        .select(
            "project_id", "seq", (F.col("s") / 1000).alias("start_s"), ((F.col("s") + dur) / 1000).alias("end_s"), "text"
        )
    )


def short_cues(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as raw cues (row-local times, so they may overlap)."""
    n = F.char_length("text")
    start = F.col("turn") * 15000 + (n * 37) % 4000
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("project_id"), F.col("turn").cast("int").alias("seq"),
        (start / 1000).alias("start_s"), ((start + 500 + 40 * n) / 1000).alias("end_s"), "text",
    )


def cues(spark: SparkSession, d: str) -> DataFrame:
    return normalize_cues(long_cues(spark, d))[0]


def stored_cues(spark: SparkSession, d: str) -> DataFrame:
    """Normalised cues as a stored table, for plans that read them several times."""
    return materialize(cues(spark, d), "cues")


def profiles(spark: SparkSession, d: str, normal: DataFrame) -> DataFrame:
    projects = normal.groupBy("project_id").agg(F.max("end_s").alias("duration")).withColumn(
        "target", ((F.col("project_id") % 4) * 20).cast("int")
    )
    return duration_profile(projects)


def srt_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each document as an SRT file; some have a broken timing line, a CRLF layout or no index lines."""
    lines = _lines(F.col("text"))
    k = F.col("doc_id") % 7

    def block(line: Column, i: Column) -> Column:
        start = i.cast("long") * 4000 + 123
        end = start + 500 + F.char_length(line) * 10
        arrow = F.when((k == 3) & (i == 1), F.lit(" -> ")).otherwise(F.lit(" --> "))
        index = F.when(k == 4, F.lit("")).otherwise(F.concat((i + 1).cast("string"), F.lit("\n")))
        return F.concat(index, srt_clock(start), arrow, srt_clock(end), F.lit("\n"), line, F.lit("  \n"))

    doc = F.array_join(F.transform(lines, block), "\n")
    doc = F.when(k == 5, F.regexp_replace(doc, "\n", "\r\n")).when(k == 6, F.concat(F.lit("﻿\n\n"), doc)).otherwise(doc)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", doc.alias("content"))


def visual_candidates(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"click": "gameplay", "view": "other", "signup": "unknown", "purchase": "reward_screen", "error": "menu"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    start = F.floor(_event_ms() / 360)
    return table(spark, d, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("ord"),
        F.concat(F.lit("event-"), F.col("event_id")).alias("id"), F.col("event_type").alias("label"),
        (start / 1000).alias("start_s"),
        ((start + 100 + F.floor(F.col("value") * 100)) / 1000).alias("end_s"),
        F.col("props").alias("evidence"), (F.col("value") / 500).alias("score"), kind.alias("kind"),
    )


def _event_ms() -> Column:
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", base, F.col("ts").cast("timestamp_ntz"))


def stored_text(spark: SparkSession, d: str) -> DataFrame:
    """Text candidates as the stored table that a later stage starts from."""
    return materialize(text_candidates(cues(spark, d)), "text")


def text_candidates(normal: DataFrame) -> DataFrame:
    """Four consecutive cues as one text candidate."""
    part = F.floor(F.col("cue_idx") / 4).cast("long") + 1
    groups = normal.groupBy("project_id", part.alias("ord")).agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("text", "cue_idx").alias("evidence")
    )
    return groups.select(
        "project_id", "ord", F.concat(F.lit("text-"), F.col("ord")).alias("id"),
        F.concat(F.lit("part "), F.col("ord")).alias("label"), "start_s", "end_s", "evidence",
        (((F.col("project_id") * 31 + F.col("ord") * 17) % 101) / 100).alias("score"), F.lit("text").alias("kind"),
    )


def timeline_items(normal: DataFrame) -> DataFrame:
    """Five consecutive cues as one proposed span with loose, partly overlapping bounds."""
    g = F.floor(F.col("cue_idx") / 5).cast("int")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    groups = normal.groupBy("project_id", g.alias("ord")).agg(
        F.min(ms("start_s")).alias("a"), F.max(ms("end_s")).alias("b")
    )
    start = F.greatest(F.lit(0), F.col("a") + (F.col("ord") * 311) % 1500 - 300)
    end = F.col("b") + (F.col("ord") * 17170 + F.col("project_id") * 3) % 40000 - 4000
    return groups.select(
        "project_id", "ord", F.concat(F.lit("topic "), F.col("ord")).alias("label"),
        (start / 1000).alias("start_s"), (end / 1000).alias("end_s"),
    )


def drafts(spark: SparkSession, d: str) -> DataFrame:
    def scene(line: Column, i: Column) -> Column:
        start = i.cast("long") * 6500
        return F.struct(
            F.concat(F.lit("s"), F.when(F.char_length(line) % 50 == 0, F.lit("0")).otherwise(i.cast("string"))).alias("id"),
            F.concat(F.col("lang"), F.lit("-"), i.cast("string")).alias("label"),
            (start / 1000).alias("start_s"),
            ((start + F.char_length(line) * 40) / 1000).alias("end_s"),
            line.alias("evidence"),
        )

    k = F.col("doc_id") % 4
    return spread(table(spark, d, "documents")).select(
        F.col("doc_id").alias("project_id"),
        F.concat(F.lit("draft-"), F.col("doc_id")).alias("draft_id"),
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("hook"),
        F.transform(_lines(F.col("text")), scene).alias("scenes"),
        F.when(k == 0, F.lit("original")).when(k == 1, F.lit("portrait")).when(k == 2, F.lit("landscape"))
        .otherwise(F.when(F.col("doc_id") % 3 == 0, F.lit("square")).otherwise(F.lit("original"))).alias("aspect"),
        F.when(k == 1, F.lit("crop")).otherwise(F.lit("fit")).alias("layout"),
        ((F.col("n_chars") % 12) / 10).alias("crop_x"), F.lit("plain").alias("title_style"),
        F.lit(1).alias("title_template_version"), F.lit(1.0).alias("title_scale"), F.lit(0.12).alias("title_y"),
        F.when(F.col("doc_id") % 9 == 0, F.lit("red")).otherwise(F.lit("#a0B1c2")).alias("title_accent"),
        (F.col("doc_id") % 3 == 0).alias("subtitles"),
        (1 + F.col("doc_id") % 3).cast("int").alias("revision"),
    )


def draft_projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("project_id"), (F.col("n_chars") / 8).alias("duration")
    )


def task_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def task_seq() -> Column:
    return (F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")


def goal_of(c: Column) -> Column:
    return F.element_at(F.array(F.lit("content"), F.lit("highlight"), F.lit("promo")), (c % 3 + 1).cast("int"))


def lineitem_tasks(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    status = (
        F.when(q <= 1, F.lit("queued")).when(q <= 2, F.lit("running")).when(q <= 40, F.lit("completed"))
        .when(q <= 44, F.lit("failed")).when(q <= 47, F.lit("interrupted")).otherwise(F.lit("cancelled"))
    )
    n = F.col("l_linenumber")
    kind = F.when(n == 1, F.lit("analyze")).when(n == 2, F.lit("preview")).otherwise(F.lit("export"))
    return table(spark, d, "lineitem").select(
        task_key().alias("task_id"), F.col("l_orderkey").alias("workflow_id"), task_seq().alias("seq"),
        kind.alias("kind"), goal_of(n).alias("goal"), status.alias("status"),
        F.concat("l_returnflag", "l_linestatus").alias("error"),
        F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("created_at"),
    )


def project_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Line items as tasks of the customer that ordered them."""
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("workflow_id"), F.col("o_custkey").alias("project_id"))
    kind = F.when(F.col("part_id") % 5 == 0, F.lit("import")).when(F.col("part_id") % 5 == 1, F.lit("inspect")).otherwise(F.col("kind"))
    return lineitem_tasks(spark, d).withColumn("kind", kind).join(owners, "workflow_id")


def workflow_goals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("workflow_id"), "o_orderstatus", "o_orderpriority", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g")
    )
    status = F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "P", F.lit("analyzing")).otherwise(F.lit("failed"))
    return o.select(
        "workflow_id", F.col("g").alias("ord"), goal_of(F.col("g")).alias("goal"), status.alias("status"),
        F.when(status == "failed", F.col("o_orderpriority")).otherwise(F.lit("")).alias("error"),
        ((F.col("workflow_id") + F.col("g")) % 3).cast("int").alias("n_drafts"),
    )


def event_log(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events (the table, or a stream of it) as a task log ordered by time and id."""
    return (table(spark, d, "events") if events is None else events).select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), "event_type", "value"
    )


def command_log(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events as commands: mostly progress, some heartbeats, rare cancels and finishes."""
    v = F.col("value")
    op = (
        F.when(v > 250, F.lit("finish")).when((v > 200) & (F.col("event_type") == "error"), F.lit("cancel"))
        .when(F.col("event_type") == "view", F.lit("heartbeat")).otherwise(F.lit("progress"))
    )
    return event_log(spark, d, events).select(
        "task_id", "ts", "seq", op.alias("op"), F.col("event_type").alias("stage"),
        F.least(F.lit(100.0), v / 4).alias("percent"),
        F.when(F.col("event_type") == "purchase", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
    )
