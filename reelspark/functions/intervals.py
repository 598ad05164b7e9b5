"""Interval and tolerance joins on a media axis, always with equality keys plus a bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _span(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("long")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float = 60.0,
    pad: float = 0.0,
) -> DataFrame:
    """Pairs whose closed spans meet within ``pad``; each pair appears once.

    Both sides are cut into ``width``-second buckets and joined on ``(on, bucket)``, so a project with
    many rows spreads over its buckets and pairs far apart in time are never compared.  A pair is kept
    only in the first bucket the two spans share.  Spans must already be bounded (they are validated to
    at most two hours upstream).
    """
    lo_l, hi_l = F.col(left_span[0]) - pad, F.col(left_span[1]) + pad
    lo_r, hi_r = F.col(right_span[0]), F.col(right_span[1])
    lb = (
        left.where(hi_l >= lo_l)
        .withColumn("__lb", _span(lo_l, width))
        .withColumn("__bucket", F.explode(F.sequence(F.col("__lb"), _span(hi_l, width))))
    )
    rb = (
        right.where(hi_r >= lo_r)
        .withColumn("__rb", _span(lo_r, width))
        .withColumn("__bucket", F.explode(F.sequence(F.col("__rb"), _span(hi_r, width))))
    )
    joined = lb.join(rb, [*on, "__bucket"])
    return joined.where(
        (F.col("__bucket") == F.greatest("__lb", "__rb")) & (lo_r <= hi_l) & (hi_r >= lo_l)
    ).drop("__lb", "__rb", "__bucket")


def near_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_point: str, right_point: str, tolerance: float
) -> DataFrame:
    """Pairs of points at most ``tolerance`` apart; each right point is placed in one bucket and each
    left point probes the buckets its tolerance reaches."""
    width = tolerance * 2
    lo, hi = F.col(left_point) - tolerance, F.col(left_point) + tolerance
    probe = left.withColumn("__bucket", F.explode(F.sequence(_span(lo, width), _span(hi, width))))
    points = right.withColumn("__bucket", _span(F.col(right_point), width))
    return (
        probe.join(points, [*on, "__bucket"])
        .where(F.abs(F.col(right_point) - F.col(left_point)) <= tolerance)
        .drop("__bucket")
    )
