"""Cue tables: validation, normalisation, chunking, edge lookup and grounding.

Cues stay row-wise.  A project is admitted (at most 100,000 cues and 8 MiB of text) by one partial
aggregate *before* any per-project window, so windows only ever see bounded projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import near_join
from ..functions.media_time import finite, micros
from ..functions.scan import Scan, has_large, plain_scan, scan
from ..functions.text import first_reason, text_ok
from ..session import materialize
from ..sources.srt import caption_reason

MAX_CUES = 100_000
MAX_TEXT_BYTES = 8 << 20
MAX_SECONDS = 7200.0
MAX_CHARS = 8000
CHUNK_SECONDS = 1800.0
CHUNK_BYTES = 64 << 10
CUE_OVERHEAD = 128
SNAP_SECONDS = 3.0
GROUND_TOLERANCE = 1e-6


def cue_admission(cues: DataFrame) -> DataFrame:
    """``project_id, duration, n_cues, reason`` (null reason = admitted)."""
    start, end, text = F.col("start_s"), F.col("end_s"), F.col("text")
    ok = (
        finite(start) & finite(end) & (start >= 0) & (end > start) & (end <= MAX_SECONDS)
        & text_ok(text, MAX_CHARS, True)
    )
    facts = cues.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_cues"),
        F.sum(F.octet_length("text")).alias("n_bytes"),
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_ok"),
        F.max("end_s").alias("duration"),
    )
    reason = first_reason(
        (F.col("n_cues") > MAX_CUES, "too_many_cues"),
        (~F.col("all_ok"), "bad_cue"),
        (F.col("n_bytes") > MAX_TEXT_BYTES, "too_much_text"),
    )
    return facts.select("project_id", "duration", "n_cues", reason.alias("reason"))


def normalize_cues(cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cues, rejects)``: cues sorted by (start, end), renumbered, with the project ``duration``.

    Input order is column ``seq``.
    """
    admission = cue_admission(cues)
    admitted = admission.where(F.col("reason").isNull()).select("project_id", "duration")
    order = Window.partitionBy("project_id").orderBy("start_s", "end_s", "seq")
    kept = cues.join(admitted, "project_id").select(
        "project_id",
        (F.row_number().over(order) - 1).alias("cue_idx"),
        "start_s", "end_s", "text", "duration",
    )
    rejects = admission.where(F.col("reason").isNotNull()).select("project_id", "reason")
    return kept, rejects


def validate_cues(cues: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Adds ``reason``: media rules per cue, then the source-duration rule (end at most 0.5 s past it)."""
    reason = caption_reason(F.col("start_s"), F.col("end_s"), F.col("text"))
    if projects is None:
        return cues.withColumn("reason", reason)
    timed = cues.join(projects.select("project_id", F.col("duration").alias("__d")), "project_id", "left")
    past = F.when(F.col("end_s") > F.col("__d") + 0.5, F.lit("past_source_end"))
    return timed.withColumn("reason", F.coalesce(reason, past)).drop("__d")


#: Cues of a project that one array holds; a project with more finds its chunks by a table of successors.
CUES_PER_FOLD = 20_000


def chunk_cues(
    cues: DataFrame,
    max_seconds: float = CHUNK_SECONDS,
    max_bytes: int = CHUNK_BYTES,
    overhead: int = CUE_OVERHEAD,
) -> DataFrame:
    """Adds ``chunk`` to normalised cues.

    A chunk ends in front of the first cue that would make it longer than ``max_seconds`` or larger than ``max_bytes``.  For a
    project of at most ``CUES_PER_FOLD`` cues one fold walks ``(start, end, bytes)`` and returns the first ordinal of
    every chunk; larger ones are never put together (``_chunk_starts``).
    """
    narrow = cues.select(
        "project_id", "cue_idx", "start_s", "end_s", (F.octet_length("text") + overhead).cast("long").alias("cost")
    )
    if not has_large(narrow, ["project_id"], CUES_PER_FOLD):
        return _numbered(cues, _folded_starts(narrow, max_seconds, max_bytes))
    sizes = narrow.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > CUES_PER_FOLD).select("project_id")
    rest = _folded_starts(narrow.join(large, "project_id", "left_anti"), max_seconds, max_bytes)
    starts = _chunk_starts(materialize(narrow.join(large, "project_id"), "chunk-cues"), max_seconds, max_bytes)
    begun = cues.join(large, "project_id").join(starts.withColumn("begins", F.lit(1)), ["project_id", "cue_idx"], "left")
    counted = scan(begun, ["project_id"], ["cue_idx"], [Scan("chunk", "sum", F.coalesce("begins", F.lit(0)))], True)
    numbered = counted.withColumn("chunk", (F.col("chunk") + F.coalesce("begins", F.lit(0)) - 1).cast("int"))
    return _numbered(cues.join(large, "project_id", "left_anti"), rest).unionByName(numbered.drop("begins"))


def _numbered(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cues`` with the chunk that the sorted first ordinals of their project give."""
    return (
        cues.join(cuts, "project_id")
        .withColumn("chunk", F.size(F.filter("__firsts", lambda f: f <= F.col("cue_idx"))) - 1)
        .drop("__firsts")
    )


def _folded_starts(narrow: DataFrame, max_seconds: float, max_bytes: int) -> DataFrame:
    """``project_id, __firsts``: first ordinals of the chunks, by a fold over each project."""
    per_project = narrow.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("cue_idx", "start_s", "end_s", "cost"))).alias("cs")
    )
    zero = F.struct(
        F.array().cast("array<int>").alias("firsts"), F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("size")
    )

    def step(acc: Column, x: Column) -> Column:
        full = (x["end_s"] - acc["t"] > max_seconds) | (acc["size"] + x["cost"] > max_bytes)
        cut = (F.size(acc["firsts"]) == 0) | full
        return F.struct(
            F.when(cut, F.concat(acc["firsts"], F.array(x["cue_idx"]))).otherwise(acc["firsts"]).alias("firsts"),
            F.when(cut, x["start_s"]).otherwise(acc["t"]).alias("t"),
            F.when(cut, x["cost"]).otherwise(acc["size"] + x["cost"]).alias("size"),
        )

    return per_project.select("project_id", F.aggregate("cs", zero, step, lambda a: a["firsts"]).alias("__firsts"))


def _counted_below(entries: DataFrame, asked: DataFrame, strict: bool) -> DataFrame:
    """``project_id, cue_idx, n``: how many ``entries`` (project_id, at) lie below each asked place, or at it."""
    e = entries.select("project_id", "at", F.lit(None).cast("int").alias("cue_idx"), F.lit(1).alias("one"))
    q = asked.select("project_id", "at", "cue_idx", F.lit(0).alias("one"))
    # At equal places the asked ones come first if entries must lie strictly below.
    tie = F.col("one") if strict else 1 - F.col("one")
    both = materialize(e.unionByName(q).withColumns({"tie": tie, "last": F.coalesce("cue_idx", F.lit(-1))}), "chunk-merge")
    found = scan(both, ["project_id"], ["at", "tie", "last"], [Scan("n", "sum", F.col("one"))], True, slice_by=["at"])
    return found.where(F.col("cue_idx").isNotNull()).select("project_id", "cue_idx", "n")


def _chunk_starts(narrow: DataFrame, max_seconds: float, max_bytes: int) -> DataFrame:
    """``project_id, cue_idx`` of the first cue of every chunk, for projects of any size.

    Every cue gets its successor: the first cue of the next chunk, were it the first of one.  Cue ``i`` is too late for all
    chunks that begin before place ``r``, the number of cues that start before its end less ``max_seconds``; so the
    successor by time is the first cue whose running maximum of ``r`` is past the place.  The successor by size is a search
    on prefix sums.  Both are counts in a merge of two orders.  The starts are those that successors reach from the first
    cue, found by doubling: a round adds what all known starts reach by a jump, and the jump then counts twice.
    """
    at = lambda c: c.cast("double").alias("at")
    before = materialize(
        scan(narrow, ["project_id"], ["cue_idx"], [Scan("before", "sum", F.col("cost"))], True), "chunk-sums"
    )
    too_late = _counted_below(
        before.select("project_id", at(F.col("start_s"))),
        before.select("project_id", "cue_idx", at(F.col("end_s") - max_seconds)), True,
    )
    bounded = materialize(too_late.withColumn("r", F.least("n", F.col("cue_idx").cast("long"))), "chunk-late")
    reach = scan(bounded, ["project_id"], ["cue_idx"], [Scan("m", "max", F.col("r"))], True)
    by_time = _counted_below(
        reach.select("project_id", at(F.greatest("r", F.coalesce("m", F.col("r"))))),
        before.select("project_id", "cue_idx", at(F.col("cue_idx"))), False,
    ).withColumnRenamed("n", "by_time")
    by_size = _counted_below(
        before.select("project_id", at(F.col("before") + F.col("cost"))),
        before.select("project_id", "cue_idx", at(F.col("before") + max_bytes)), False,
    ).withColumnRenamed("n", "by_size")
    following = F.least("by_time", F.greatest("by_size", F.col("cue_idx") + 1)).cast("int")
    jumps = materialize(
        by_time.join(by_size, ["project_id", "cue_idx"]).select("project_id", "cue_idx", following.alias("to")), "chunk-jumps"
    )
    known = materialize(narrow.where("cue_idx = 0").select("project_id", "cue_idx"), "chunk-starts")
    n = known.count()
    while True:
        reached = known.join(jumps, ["project_id", "cue_idx"]).select("project_id", F.col("to").alias("cue_idx"))
        real = reached.join(narrow.select("project_id", "cue_idx"), ["project_id", "cue_idx"], "left_semi")
        known = materialize(known.union(real).distinct(), "chunk-starts")
        if (after := known.count()) == n:
            return known
        n = after
        further = jumps.select("project_id", F.col("cue_idx").alias("to"), F.col("to").alias("next"))
        jumps = materialize(
            jumps.join(further, ["project_id", "to"]).select("project_id", "cue_idx", F.col("next").alias("to")), "chunk-jumps"
        )


def speech_edges(cues: DataFrame) -> DataFrame:
    """``project_id, cue_idx, start_s, end_s`` with what a span needs to know when it begins or ends at an edge.

    ``start_u`` / ``end_u``: microseconds of speech before the edge, as the length of the union of all cues, so speech
    between two edges is a difference.  ``end_next`` / ``end_next_u``: the first cue start at or after the end, and its
    speech.  Cues are admitted (at most 100,000 in a project); all of this is one exchange.
    """
    order = Window.partitionBy("project_id").orderBy("cue_idx")
    a, b = micros(F.col("start_s")), micros(F.col("end_s"))
    prior = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    said = (
        cues.select("project_id", "cue_idx", "start_s", "end_s", a.alias("a"), b.alias("b"))
        .withColumn("prior", F.coalesce(prior, F.col("a")))
        .withColumn("gain", F.greatest(F.lit(0), F.col("b") - F.greatest("a", "prior")))
        .withColumn("total", F.sum("gain").over(order))
        .withColumns(
            {
                "start_u": F.col("total") - F.col("gain") - F.greatest(F.lit(0), F.col("prior") - F.col("a")),
                "known": F.struct("total", F.greatest("prior", "b").alias("most")),
            }
        )
    )
    # Starts and ends of all cues in time order; at equal times starts come first, upwards and downwards.
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("start_s").alias("t")), F.struct(F.lit(1).alias("side"), F.col("end_s").alias("t"))
    )
    events = said.select("project_id", "cue_idx", "start_s", "end_s", "b", "start_u", "known", F.inline(ends))
    started = lambda c: F.when(F.col("side") == 0, c)
    until = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("project_id").orderBy("t", "side", "cue_idx").rowsBetween(*until)
    down = Window.partitionBy("project_id").orderBy(F.col("t").desc(), "side", F.col("cue_idx").desc()).rowsBetween(*until)
    seen = events.withColumns(
        {
            "held": F.last(started(F.col("known")), ignorenulls=True).over(up),
            "next": F.last(started(F.struct("start_s", "start_u")), ignorenulls=True).over(down),
        }
    ).where("side = 1")
    return seen.select(
        "project_id", "cue_idx", "start_s", "end_s", "start_u",
        (F.col("held.total") - F.greatest(F.lit(0), F.col("held.most") - F.col("b"))).alias("end_u"),
        F.col("next.start_s").alias("end_next"), F.col("next.start_u").alias("end_next_u"),
    )


#: Columns of ``speech_edges`` that go with an edge of either side.
_PAYLOAD = {"u": "bigint", "next": "double", "next_u": "bigint"}


def edge_neighbours(points: DataFrame, cues: DataFrame, few_points: bool = False) -> DataFrame:
    """For every point: nearest cue edge at or below and at or above, first cue reaching it, last cue.

    ``points``: project_id, side (``start`` / ``end``: which cue edge counts), t, ...  Adds ``below``, ``above``, ``reaching`` (the
    edge of the first cue in order whose end is at or past the point) and ``last`` (that of the last cue), each a struct of
    value, cue_idx and, where ``cues`` come from ``speech_edges``, u, next and next_u.

    Edges and points of a project are merged in time order and scanned upwards and downwards.  Cues per project are admitted
    (at most 100,000); where a project has very many points (``few_points``: that is ruled out), the merge is cut into time
    slices, which carry the last edge across.  Cues of projects without points are never read into the merge.
    """
    large = not few_points and has_large(points, ["project_id"])
    asked_for = points.select("project_id").distinct()
    facts = [c for c in cues.columns if c not in ("project_id", "cue_idx", "text", "duration")]
    own = cues.select("project_id", "cue_idx", *facts).join(asked_for, "project_id", "left_semi")
    # A cue that ends no later than an earlier one is never the first to reach a point.
    c = plain_scan(own, ["project_id"], ["cue_idx"], [Scan("prior", "max", F.col("end_s"))]).withColumn(
        "record", F.col("prior").isNull() | (F.col("end_s") > F.col("prior"))
    )
    point_cols = [x for x in points.columns if x not in ("project_id", "side", "t")]

    def edge(side: str) -> Column:
        more = [
            (F.col(f"{side}_{n}") if f"{side}_{n}" in facts else F.lit(None)).cast(t).alias(n) for n, t in _PAYLOAD.items()
        ]
        return F.struct(F.col(f"{side}_s").alias("value"), "cue_idx", *more)

    kind = "struct<value:double,cue_idx:int," + ",".join(f"{n}:{t}" for n, t in _PAYLOAD.items()) + ">"
    none = F.lit(None).cast(kind)

    def event(side: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(f"{side}_s").alias("t"), edge(side).cast(kind).alias("e"), none.alias("r"))

    def record(side: str) -> Column:
        return F.when(
            F.col("record"),
            F.struct(F.lit(side).alias("side"), F.col("end_s").alias("t"), none.alias("e"), edge(side).cast(kind).alias("r")),
        )

    edges = c.select(
        "project_id", "cue_idx", F.explode(F.array(*[f(side) for side in ("start", "end") for f in (event, record)])).alias("x")
    ).where(F.col("x").isNotNull()).select("project_id", "x.*", "cue_idx")
    asked = points.select(
        "project_id", "side", "t", none.alias("e"), none.alias("r"), F.lit(None).cast("int").alias("cue_idx"),
        F.struct(*point_cols).alias("p"),
    )
    merged = edges.withColumn("p", F.lit(None).cast(asked.schema["p"].dataType)).unionByName(asked)
    # Of equal edges the first in cue order is the one seen last, and points see edges at their own time, in both directions.
    keys, is_point = ["project_id", "side"], F.col("p").isNotNull()
    ordered = merged.withColumns(
        {"up_tie": is_point.cast("int"), "down_tie": (~is_point).cast("int"), "back": -F.col("cue_idx")}
    )
    if large:
        ordered = materialize(ordered, "edges")
    up = scan(ordered, keys, ["t", "up_tie", "back"], [Scan("below", "last", F.col("e"))], large, slice_by=["t"])
    if large:
        up = materialize(up, "edges")
    down = [Scan("above", "last", F.col("e")), Scan("reaching", "last", F.col("r"))]
    both = scan(up, keys, ["t", "down_tie", "cue_idx"], down, large, True, ["t"])
    latest = own.groupBy("project_id").agg(F.max("cue_idx").alias("cue_idx"))
    lasts = own.join(latest, ["project_id", "cue_idx"]).select(
        "project_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), edge(s).cast(kind).alias("last")) for s in ("start", "end")])).alias("x")
    ).select("project_id", "x.side", "x.last")
    return (
        both.where(is_point)
        .join(lasts, ["project_id", "side"], "left")
        .select("project_id", "side", "t", "p.*", "below", "above", "reaching", "last")
    )


def snap_to_cues(points: DataFrame, cues: DataFrame, few_points: bool = False, edges: bool = False) -> DataFrame:
    """Adds ``snapped`` to ``project_id, side, t, ...``, and with ``edges`` the edge it was taken from.

    Nearest edge of that side within 3 s (first in cue order on ties); else the edge of the first cue that
    contains or follows the point; else the edge of the last cue.  Without cues the point is unchanged.
    """
    near = edge_neighbours(points, cues, few_points)
    t = F.col("t")
    gap = lambda s: F.abs(F.col(s)["value"] - t)
    lower_wins = F.col("above").isNull() | (
        F.col("below").isNotNull()
        & (
            (gap("below") < gap("above"))
            | ((gap("below") == gap("above")) & (F.col("below.cue_idx") < F.col("above.cue_idx")))
        )
    )
    nearest = F.when(lower_wins, F.col("below")).otherwise(F.col("above"))
    close = F.when(F.abs(nearest["value"] - t) <= SNAP_SECONDS, nearest)
    found = near.withColumn("edge", F.coalesce(close, "reaching", "last")).withColumn("snapped", F.coalesce(F.col("edge.value"), t))
    return found.drop("below", "above", "reaching", "last", *([] if edges else ["edge"]))


def cue_grounded(spans: DataFrame, cues: DataFrame) -> DataFrame:
    """Adds ``grounded``: both bounds coincide (1e-6 s) with some cue start and some cue end."""
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("start_s").alias("v")),
                    F.struct(F.lit("e").alias("side"), F.col("end_s").alias("v")))
    points = spans.select("project_id", "span_id", F.inline(sides).alias("side", "t"))
    edges = cues.select("project_id", F.inline(sides).alias("side", "edge")).distinct()
    hits = (
        near_join(points, edges, ["project_id", "side"], "t", "edge", GROUND_TOLERANCE)
        .where(F.abs(F.col("edge") - F.col("t")) < GROUND_TOLERANCE)
        .groupBy("project_id", "span_id")
        .agg(
            F.bool_or(F.col("side") == "s").alias("__s"),
            F.bool_or(F.col("side") == "e").alias("__e"),
        )
    )
    both = F.coalesce(F.col("__s") & F.col("__e"), F.lit(False))
    return spans.join(hits, ["project_id", "span_id"], "left").withColumn("grounded", both).drop("__s", "__e")
