"""Media-axis time: parsing, formatting and frame quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 30
# Accepted clock form and JSON number form.
CLOCK_PATTERN = "^(?:[0-9]{2,}:)?[0-5][0-9]:[0-5][0-9](?:[,.][0-9]{1,3})?\\z"
NUMBER_PATTERN = "^-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\\z"


def micros(seconds: Column) -> Column:
    """Whole microseconds, so that sums of spans do not depend on the order of addition."""
    return F.round(seconds * F.lit(1e6)).cast("long")


def finite(c: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False))


def round_to(c: Column, scale: int) -> Column:
    """Half-away rounding at ``scale`` steps per unit, on the product rather than on the decimal text."""
    return F.round(c * F.lit(float(scale))) / F.lit(float(scale))


def parse_timestamp(token: Column) -> Column:
    """Raw JSON token -> ``struct<seconds, reason>``: a number, or a quoted (HH:)MM:SS(.mmm) string."""
    quoted = token.startswith('"')
    clock = F.regexp_extract(token, '^"(.*)"\\z', 1)
    clock_ok = quoted & clock.rlike(CLOCK_PATTERN)
    parts = F.split(F.translate(clock, ",", "."), ":")
    n = F.size(parts)
    secs = F.try_element_at(parts, F.lit(-1)).try_cast("double")
    mins = F.try_element_at(parts, F.lit(-2)).try_cast("double")
    hours = F.when(n == 3, F.try_element_at(parts, F.lit(1)).try_cast("double")).otherwise(F.lit(0.0))
    number = F.when(token.rlike(NUMBER_PATTERN), token.try_cast("double"))
    value = F.when(clock_ok, (hours * 60 + mins) * 60 + secs).when(~quoted & finite(number), number)
    reason = (
        F.when(value.isNotNull(), F.lit(None).cast("string"))
        .when(quoted, F.lit("malformed_clock"))
        .when(number.isNotNull(), F.lit("not_finite"))
        .otherwise(F.lit("not_a_time"))
    )
    return F.struct(value.alias("seconds"), reason.alias("reason"))


def scene_frames(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.round((end - start) * F.lit(float(FPS))).cast("int"))


def srt_clock(ms: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000),
        F.floor(ms / 60000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def ass_clock(cs: Column) -> Column:
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100
    )


def duration_label(seconds: Column) -> Column:
    positive = F.coalesce(seconds > 0, F.lit(False)) & ~F.isnan(seconds)
    whole = F.floor(seconds)
    return F.when(
        positive, F.format_string("%d:%02d", F.floor(seconds / 60), whole % 60)
    ).otherwise(F.lit("0:00"))
