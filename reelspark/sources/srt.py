"""SRT files as a table source.

A file is at most 8 MiB, so it is parsed inside its own row with higher-order functions: no shuffle,
and the all-or-nothing verdict for a file is known before its cues are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.text import BLANK, clean_caption, not_blank, trim_space, unify_newlines

MAX_FILE_BYTES = 8 << 20
MAX_CUES = 100_000
MAX_CAPTION_BYTES = 16_384
MAX_SECONDS = 3_600_000
CLOCK = "^(\\d{1,3}):([0-5]\\d):([0-5]\\d)[,.](\\d{3})\\z"
INDEX = "^[+-]?[0-9]{1,18}\\z"


def read_srt_files(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """``(path, content)`` with raw bytes, so that invalid UTF-8 is seen and not replaced."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )


def _clock_ms(text: Column) -> Column:
    def ms(t: Column) -> Column:
        # the last ten characters have fixed places, so one match suffices
        tail = lambda at, size: F.substring(t, at, size).cast("long")
        hours = F.substring_index(t, ":", 1).cast("long")
        return F.when(t.rlike(CLOCK), hours * 3600000 + tail(-9, 2) * 60000 + tail(-6, 2) * 1000 + tail(-3, 3))

    return let(trim_space(text), ms)


def clean_caption_reason(start: Column, end: Column, text: Column) -> Column:
    """Media rules for one cue whose text is already cleaned."""
    bad_time = start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end)
    return (
        F.when(bad_time | (start < 0) | (end <= start) | (end >= MAX_SECONDS), F.lit("bad_bounds"))
        .when(~F.is_valid_utf8(text) | (F.instr(text, "\u0000") > 0), F.lit("bad_text"))
        .when(F.octet_length(text) > MAX_CAPTION_BYTES, F.lit("text_too_long"))
        .when(text == "", F.lit("empty_text"))
    )


def caption_reason(start: Column, end: Column, text: Column) -> Column:
    """Media rules for one cue; blank text is found without cleaning the whole caption."""
    return F.coalesce(
        clean_caption_reason(start, end, text), F.when(~not_blank(text), F.lit("empty_text"))
    )


def _parse_block(block: Column) -> Column:
    def from_lines(lines: Column) -> Column:
        first = F.element_at(lines, 1)
        numbered = trim_space(first).rlike(INDEX)
        head = F.when(
            numbered, F.struct(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("timing"), F.lit(3).alias("skip"))
        ).otherwise(F.struct(first.alias("timing"), F.lit(2).alias("skip")))
        return let(head, lambda h: from_head(lines, h))

    def from_head(lines: Column, h: Column) -> Column:
        def timed(halves: Column) -> Column:
            two = F.size(halves) == 2
            return F.struct(
                (F.when(two, _clock_ms(F.element_at(halves, 1))) / 1000).alias("start_s"),
                (F.when(two, _clock_ms(F.try_element_at(halves, F.lit(2)))) / 1000).alias("end_s"),
                clean_caption(F.array_join(F.slice(lines, h["skip"], F.size(lines)), "\n")).alias("text"),
            )

        return let(let(F.split(h["timing"], "-->"), timed), judged)

    def judged(c: Column) -> Column:
        untimed = c["start_s"].isNull() | c["end_s"].isNull()
        reason = F.when(untimed, F.lit("bad_timing")).otherwise(clean_caption_reason(c["start_s"], c["end_s"], c["text"]))
        return F.struct(
            c["start_s"].alias("start_s"), c["end_s"].alias("end_s"), c["text"].alias("text"), reason.alias("reason")
        )

    return let(F.split(block, "\n"), from_lines)


def _parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.col(text_col)
    size = F.octet_length(raw)
    text = F.col("__text")
    line_free = f"(?:{BLANK}*+\\n)++"
    body = F.regexp_replace(unify_newlines(F.regexp_replace(text, "^\\uFEFF", "")), f"\\A{line_free}", "")
    body = F.regexp_replace(body, f"(?:\\n{BLANK}*+)+\\z", "")
    blocks = F.when(trim_space(body) == "", F.array().cast("array<string>")).otherwise(
        F.split(body, f"\\n{line_free}")
    )
    readable = F.is_valid_utf8(raw.cast("string")) & (size <= MAX_FILE_BYTES)
    base = docs.select(
        F.col(id_col), F.when(readable, raw.cast("string")).alias("__text"), (size > MAX_FILE_BYTES).alias("__big")
    )
    rows = base.select(
        id_col, "__text", "__big", F.transform(blocks, _parse_block).alias("__cues")
    )
    bad = F.filter("__cues", lambda c: c["reason"].isNotNull())
    reason = (
        F.when(F.col("__big"), F.lit("file_too_large"))
        .when(text.isNull(), F.lit("invalid_utf8"))
        .when(F.size("__cues") > MAX_CUES, F.lit("too_many_cues"))
        .when(F.size(bad) > 0, F.element_at(bad, 1)["reason"])
    )
    return rows.select(id_col, "__cues", reason.alias("reason"))


def parse_srt_rows(docs: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """One pass: a row per cue of an accepted file, and one row with ``reason`` per rejected file."""
    # outer explode and a filter on its output: a filter on the array would parse every file twice
    parsed = _parsed(docs, id_col, text_col)
    kept = F.when(F.col("reason").isNull(), F.col("__cues"))
    return (
        parsed.select(id_col, "reason", F.posexplode_outer(kept).alias("cue_idx", "__c"))
        .where(F.col("cue_idx").isNotNull() | F.col("reason").isNotNull())
        .select(
            id_col,
            "cue_idx",
            F.col("__c.start_s").alias("start_s"),
            F.col("__c.end_s").alias("end_s"),
            F.col("__c.text").alias("text"),
            "reason",
        )
    )


def parse_srt(docs: DataFrame, id_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """``(cues, rejects)``.  A malformed cue rejects its whole file."""
    rows = parse_srt_rows(docs, id_col, text_col)
    return (
        rows.where(F.col("cue_idx").isNotNull()).drop("reason"),
        rows.where(F.col("reason").isNotNull()).select(id_col, "reason"),
    )
