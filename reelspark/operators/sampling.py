"""Sample-time generators: row-local sequences, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media_time import finite, round_to
from ..functions.scan import Scan, prefix_scan, slice_hot_keys
from ..functions.text import first_reason

BATCH = 60
MAX_SAMPLES = 60
MAX_SECONDS = 7200.0


def second_samples(projects: DataFrame) -> DataFrame:
    """One row per whole second before the end, with its 60-frame batch number."""
    d = F.col("duration")
    usable = finite(d) & (d > 0)
    last = F.when(usable, F.greatest(F.ceil(d), F.lit(1)) - 1).otherwise(F.lit(0)).cast("int")
    return projects.select("project_id", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "project_id", F.col("i").cast("double").alias("time_s"), (F.floor(F.col("i") / BATCH) + 1).cast("int").alias("batch")
    )


def sparse_sample_times(duration: Column) -> Column:
    """At most 60 points, at least 2 s apart, ending 0.1 s before the end; the first is always 0."""
    step = F.greatest(F.lit(2.0), duration / float(MAX_SAMPLES))
    at = F.transform(F.sequence(F.lit(1), F.lit(MAX_SAMPLES - 1)), lambda i: i * step)
    inside = F.filter(at, lambda t: t < duration - 0.1)
    return F.concat(F.array(F.lit(0.0)), F.transform(inside, lambda t: round_to(t, 1000)))


def sparse_samples(projects: DataFrame) -> DataFrame:
    return projects.select(
        "project_id", F.posexplode(sparse_sample_times(F.col("duration"))).alias("i", "time_s")
    )


def validate_samples(requests: DataFrame) -> DataFrame:
    """``request_id, duration, times`` -> adds ``normalized`` (ms) and ``reason``."""
    times = F.col("times")
    normalized = F.transform(times, lambda t: round_to(t, 1000))
    bad = F.exists(times, lambda t: ~finite(t) | (t < 0) | (t > MAX_SECONDS))
    late = F.exists(times, lambda t: t >= F.col("duration")) | F.exists(normalized, lambda t: t >= F.col("duration"))
    reason = first_reason(
        (F.coalesce(F.size(times), F.lit(0)).between(1, MAX_SAMPLES) == F.lit(False), "count"),
        (bad, "invalid_time"),
        (F.size(F.array_distinct(normalized)) < F.size(normalized), "duplicate_time"),
        (late, "past_end"),
    )
    out = requests.withColumn("reason", reason)
    return out.withColumn("normalized", F.when(F.col("reason").isNull(), normalized))


def even_downsample(frames: DataFrame, n: int, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """At most ``n`` rows per key, evenly by position, keeping first and last.

    Positions come from a sliced scan; whether a position is chosen is arithmetic on that row alone.
    """
    numbered = prefix_scan(
        slice_hot_keys(frames, list(keys), ["time_s"]), list(keys), "__b", ["time_s"],
        [Scan("__pos", "count")],
    )
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("__len"))
    o, length = F.col("__pos") - 1, F.col("__len")
    i = F.floor((o * (n - 1) + length - 2) / (length - 1))
    chosen = (length <= n) | ((i <= n - 1) & (F.floor(i * (length - 1) / (n - 1)) == o))
    return numbered.join(sizes, list(keys)).where(chosen).drop("__b", "__pos", "__len")


def review_times(windows: DataFrame) -> DataFrame:
    """``window_id, start_s, end_s, duration`` -> up to 25 review points per window."""
    step = F.greatest(F.lit(1.0), (F.col("end_s") - F.col("start_s")) / 24)
    at = F.transform(
        F.sequence(F.lit(0), F.lit(24)), lambda i: round_to(F.col("start_s") + i * step, 1000)
    )
    inside = F.filter(at, lambda t: (t <= F.col("end_s") + 1e-3) & (t < F.col("duration")))
    return windows.select("window_id", F.posexplode(inside).alias("i", "time_s"))


def screening_times(duration: Column) -> Column:
    """The four screening points: head, thirds and just before the end."""
    end = F.greatest(F.lit(0.0), duration - 0.1)
    return F.array(F.lit(0.0), end / 3, end * 2 / 3, end)
