"""Score scale handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media_time import round_to

FALLBACK_SCORE = 0.5


def rescale_score(x: Column) -> Column:
    """0..1 kept, (1,10] tenths, (10,100] hundredths; anything else is null. Two decimals."""
    unit = (
        F.when(F.isnan(x) | (x < 0) | (x > 100), F.lit(None).cast("double"))
        .when(x <= 1, x)
        .when(x <= 10, x / 10)
        .otherwise(x / 100)
    )
    return round_to(unit, 100)


def two_decimals(x: Column) -> Column:
    """``%.2f`` with ties to even, from whole hundredths."""
    cents = F.rint(x * F.lit(100.0)).cast("long")
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)
