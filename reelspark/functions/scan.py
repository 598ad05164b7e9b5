"""Ordered scans over keys that may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` puts every row of one key into one task.  Here a large key is cut by row rank
into slices that follow the order (``slice_hot_keys``); rows are scanned inside ``(key, slice)`` and the state at
the start of each slice comes from one summary row per slice.  Summaries use partial aggregation.  Keys of
ordinary size are one slice, so for them the summary is a single row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """One scanned column.

    ``kind`` is ``count`` (1-based position), ``sum`` / ``max`` (over earlier rows only),
    ``lag`` (value of the row before) or ``last`` (latest non-null value before this row).
    """

    name: str
    kind: str
    value: Column | None = None


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    scans: Sequence[Scan],
    descending: bool = False,
) -> DataFrame:
    """Add scanned columns.  ``bucket`` must be monotone in ``order``; order must be total per key."""
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    local = Window.partitionBy(*keys, bucket).orderBy(*[direction(c) for c in order])
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    across = (
        Window.partitionBy(*keys).orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    )
    position = F.struct(*[F.col(c) for c in order])
    latest = F.min_by if descending else F.max_by

    prepared = df
    for s in scans:
        if s.value is not None:
            prepared = prepared.withColumn(f"__v_{s.name}", s.value)

    summaries: list[Column] = []
    offsets: list[Column] = []
    local_cols: list[Column] = []
    final: dict[str, Column] = {}
    for s in scans:
        v = F.col(f"__v_{s.name}")
        summary, offset, here = f"__s_{s.name}", f"__o_{s.name}", f"__l_{s.name}"
        if s.kind == "count":
            summaries.append(F.count(F.lit(1)).alias(summary))
            offsets.append(F.coalesce(F.sum(summary).over(across), F.lit(0)).alias(offset))
            local_cols.append(F.row_number().over(local).cast("long").alias(here))
            final[s.name] = F.col(here) + F.col(offset)
        elif s.kind == "sum":
            summaries.append(F.sum(v).alias(summary))
            offsets.append(F.sum(summary).over(across).alias(offset))
            local_cols.append(F.sum(v).over(before).alias(here))
            zero = F.lit(0)
            final[s.name] = F.coalesce(F.col(here), zero) + F.coalesce(F.col(offset), zero)
        elif s.kind == "max":
            summaries.append(F.max(v).alias(summary))
            offsets.append(F.max(summary).over(across).alias(offset))
            local_cols.append(F.max(v).over(before).alias(here))
            final[s.name] = F.greatest(F.col(here), F.col(offset))
        elif s.kind == "last":
            summaries.append(latest(v, F.when(v.isNotNull(), position)).alias(summary))
            offsets.append(F.last(summary, ignorenulls=True).over(across).alias(offset))
            local_cols.append(F.last(v, ignorenulls=True).over(before).alias(here))
            final[s.name] = F.coalesce(F.col(here), F.col(offset))
        elif s.kind == "lag":
            # wrap the value so that a null value and a missing row stay distinct
            boxed = F.struct(v.alias("v"))
            summaries.append(latest(boxed, position).alias(summary))
            offsets.append(F.last(summary).over(across).alias(offset))
            local_cols.append(F.lag(boxed).over(local).alias(here))
            final[s.name] = F.coalesce(F.col(here), F.col(offset))["v"]
        else:
            raise ValueError(s.kind)

    per_bucket = prepared.groupBy(*keys, bucket).agg(*summaries)
    carried = per_bucket.select(*keys, bucket, *offsets)
    scanned = prepared.select("*", *local_cols).join(carried, [*keys, bucket], "left")
    return scanned.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in final.items()])


ROWS_PER_SLICE = 1_000_000


#: Sampled positions per slice, from which the edges of slices are taken.
SAMPLES_PER_SLICE = 40


def _hot(df: DataFrame, keys: Sequence[str], rows: int, *facts: Column) -> DataFrame:
    """Keys with more than ``rows`` rows: at most one per ``rows`` input rows, so the result is small by
    construction and joins without moving the large side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *facts).where(F.col("__n") > rows)


def _edges_before(edges: Column, position: Column) -> Column:
    """Number of sorted ``edges`` at or before ``position``, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(edges, at + step - 1) <= position, at + step).otherwise(at),
    )


def slice_hot_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__b", rows: int | None = None
) -> DataFrame:
    """Adds a bucket that follows ``order`` (the columns of the scan's total order).

    A key with at most ``rows`` rows is one bucket.  A larger one is cut at quantiles of its own positions, taken
    from a sample chosen by a hash of the position, so slices hold about ``rows`` rows each however the positions are
    spread; only rows at one and the same position stay together.
    """
    rows = rows or ROWS_PER_SLICE
    hot = _hot(df, keys, rows).select(*keys, F.col("__n"), F.ceil(F.col("__n") / rows).cast("int").alias("__slices"))
    position = F.struct(*order)
    chosen = F.pmod(F.xxhash64(*order), "__n") < F.col("__slices") * SAMPLES_PER_SLICE
    sample = (
        df.select(*keys, *[c for c in order if c not in keys])
        .join(hot, list(keys))
        .where(chosen)
        .groupBy(*keys, "__slices")
        .agg(F.array_sort(F.collect_list(position)).alias("__at"))
    )
    size, slices = F.size("__at"), F.col("__slices")
    picks = F.transform(
        F.sequence(F.lit(1), slices - 1), lambda i: F.get(F.col("__at"), F.floor(i * size / slices).cast("int"))
    )
    edges = sample.select(
        *keys, F.array_distinct(F.when(slices > 1, picks).otherwise(F.slice("__at", 1, 0))).alias("__edges")
    )
    bucket = F.coalesce(_edges_before(F.col("__edges"), position), F.lit(0)).cast("long")
    return df.join(edges, list(keys), "left").select(*df.columns, bucket.alias(name))


def has_large(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> bool:
    """Whether some key has more rows than a slice.  Runs one count per key; tells how to build a scan, not what it returns."""
    return not _hot(df, keys, rows or ROWS_PER_SLICE).isEmpty()


def plain_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Sequence[Scan], descending: bool = False
) -> DataFrame:
    """``prefix_scan`` with one slice per key: windows only, for keys that were found, or are known, to be small."""
    at = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    made = {
        "count": lambda v: F.row_number().over(at).cast("long"),
        "sum": lambda v: F.coalesce(F.sum(v).over(before), zero),
        "max": lambda v: F.max(v).over(before),
        "lag": lambda v: F.lag(v).over(at),
        "last": lambda v: F.last(v, ignorenulls=True).over(before),
    }
    return df.withColumns({s.name: made[s.kind](s.value) for s in scans})


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    large: bool,
    descending: bool = False,
    slice_by: Sequence[str] | None = None,
) -> DataFrame:
    """``plain_scan``, or with ``large`` keys ``prefix_scan`` over slices that follow ``slice_by`` (first columns of the order)."""
    if not large:
        return plain_scan(df, keys, order, scans, descending)
    sliced = slice_hot_keys(df, keys, slice_by or order)
    return prefix_scan(sliced, keys, "__b", order, scans, descending).drop("__b")


def hot_key_parts(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """``keys, __salts`` of the large keys only: how many parts each is cut into."""
    rows = rows or ROWS_PER_SLICE
    return _hot(df, keys, rows).select(*keys, F.ceil(F.col("__n") / rows).cast("int").alias("__salts"))


def salt_hot_keys(df: DataFrame, keys: Sequence[str], by: Sequence[str], parts: DataFrame | None = None) -> DataFrame:
    """Adds ``__salts`` (1, or the number of parts of a large key) and ``__salt`` (the part of this row)."""
    parts = hot_key_parts(df, keys) if parts is None else parts
    n = F.coalesce(F.col("__salts"), F.lit(1))
    return (
        df.join(parts, list(keys), "left")
        .select(*df.columns, n.alias("__salts"))
        .withColumn("__salt", F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int"))
    )


def over_salts(small: DataFrame, keys: Sequence[str], parts: DataFrame) -> DataFrame:
    """One copy of each row of ``small`` per part of its key, to meet ``salt_hot_keys`` on (keys, ``__salt``)."""
    n = F.coalesce(F.col("__salts"), F.lit(1))
    return small.join(parts, list(keys), "left").select(
        *small.columns, F.explode(F.sequence(F.lit(0), n - 1)).alias("__salt")
    )
