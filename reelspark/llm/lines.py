"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is a repeat if it equals an earlier line of the corpus or is within ``max_edits`` edits of one; earlier means a
smaller doc_id, or the same document and a smaller line number.  Repeats are judged on the input, not on what is left.

* Equal lines meet through two 64-bit hashes and a fixed-width minimum.
* Near lines: a line is split into ``max_edits + 1`` segments of even length.  If two lines are within ``max_edits``, the
  longer has a substring equal to a segment of the shorter, and it starts close to the segment's place (the multi-match
  bounds of Li et al., Pass-Join, 2011).  Segments are indexed by line length, number and hash; substrings of a line probe
  the index of its own length and of lengths up to ``max_edits`` less.  Candidates are verified by a bit-parallel automaton
  whose states are the 2 * max_edits + 1 diagonals of the band, one word of bits per number of edits.

Every line with a character that is no blank takes part (blanks at the ends cut).  How many edits a near copy may have
goes by its length: one for every ``EDIT_CHARS`` code points of the shorter line, ``max_edits`` at most; under
``EDIT_CHARS`` an edit makes another line.  Each number of edits has an index of its own, so that segments stay long.
Callers may ask for less: lines under ``min_chars`` are then left alone, and a ``near_chars`` lets near matching start
there, with ``max_edits`` at once.

Defined results: null and empty texts have no lines that take part; of rows with one doc_id the order is that of a hash of
their texts, and equal rows have equal results, as neither is earlier; rows with a null doc_id come last in the order;
an empty table gives an empty result; extra columns are ignored by ``repeated_lines`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.let import let
from reelspark.llm.rows import bits_apart, stored

#: Characters cut from the ends of a line before comparison.
BLANKS = " \t\r\v\f"

#: Columns that say where a line is, in the order of the corpus.
PLACE = ("doc", "tie", "n")

#: Code points of a line for each edit that a near copy may have.
EDIT_CHARS = 10

#: Stands for a null doc_id: the last place in the order.
LAST = (1 << 63) - 1


def segments(length: Column, number: int, count: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``number`` of ``count``: even lengths, the longer ones last."""
    short = F.floor(length / count).cast("int")
    longer = length % count  # so many segments are one longer
    first_long = count - longer
    start = short * number + F.greatest(F.lit(number) - first_long, F.lit(0))
    return start.cast("int"), (short + (F.lit(number) >= first_long).cast("int")).cast("int")


def segment_keys(line: Column, length: Column, max_edits: int) -> Column:
    """Hashes of the segments of a line: the index side, which also meets lines of equal length at equal places."""
    keys = []
    for i in range(max_edits + 1):
        start, size = segments(length, i, max_edits + 1)
        keys.append(F.xxhash64(F.lit(i), length, F.substring(line, start + 1, size)))
    return F.array(*keys)


def probe_keys(line: Column, length: Column, max_edits: int) -> Column:
    """Hashes of the substrings of a line that may equal a segment of a line as long or up to ``max_edits`` shorter.

    Null where a substring would reach over an end of the line.
    """
    keys = []
    count = max_edits + 1
    for less in range(max_edits + 1):
        other = length - less
        for i in range(count):
            start, size = segments(other, i, count)
            left = max(-i, less - (max_edits - i))
            right = min(i, less + (max_edits - i))
            for shift in range(left, right + 1):
                if less == 0 and shift == 0:
                    continue  # the same key as the line's own segment
                at = start + shift
                inside = (at >= 0) & (at + size <= length)
                keys.append(F.when(inside, F.xxhash64(F.lit(i), other, F.substring(line, at + 1, size))))
    return F.array(*keys)


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two strings are within ``max_edits`` (at most 6) edits: a banded bit-parallel automaton.

    Bit d of word e is set when the text read so far matches a pattern prefix that is d - max_edits characters longer, with
    at most e edits.  Reading a character keeps a diagonal on a match or substitution, moves down one on an insertion and
    up one on a deletion.  The words share one integer.
    """
    width = 2 * max_edits + 1
    mask = (1 << width) - 1

    def words(state: Column) -> list[Column]:
        return [F.shiftright(state, e * width).bitwiseAND(F.lit(mask)) for e in range(max_edits + 1)]

    def step(state: Column, equal: Column) -> Column:
        old = words(state)
        return let(old[0].bitwiseAND(equal), lambda new: _levels(old, equal, new, new, 1, max_edits, width, mask))

    start = 0
    for e in range(max_edits + 1):
        start |= ((1 << (e + 1)) - 1) << max_edits << e * width

    def matches(pattern: Column, text: Column) -> Column:
        def run(state: Column, j: Column) -> Column:
            equal = F.lit(0).cast("long")
            c = F.get(text, j)
            for d in range(width):
                equal = equal.bitwiseOR(
                    F.when(F.get(pattern, j + F.lit(d - max_edits)) == c, F.lit(1 << d)).otherwise(F.lit(0)).cast("long")
                )
            return F.when(state == 0, state).otherwise(let(equal, lambda m: step(state, m)))

        last = F.aggregate(F.sequence(F.lit(0), F.size(text) - 1), F.lit(start).cast("long"), run)
        place = F.size(pattern) - F.size(text) + F.lit(max_edits * width + max_edits)
        bit = F.expr("1L")
        return last.bitwiseAND(F.call_function("shiftleft", bit, place)) != 0

    both = F.array(F.split(a, ""), F.split(b, ""))
    close = F.abs(F.length(a) - F.length(b)) <= max_edits
    long = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(~close, F.lit(False)).when(
        long, let(both, lambda s: matches(F.element_at(s, 1), F.element_at(s, 2)))
    ).otherwise(F.greatest(F.length(a), F.length(b)) <= max_edits)


def _levels(old, equal, packed, below, e, max_edits, width, mask) -> Column:
    """Words ``e`` and up of the next state, packed over the words before; ``below`` is the new word e - 1."""
    if e > max_edits:
        return packed
    word = (
        old[e]
        .bitwiseAND(equal)
        .bitwiseOR(old[e - 1])
        .bitwiseOR(F.shiftright(old[e - 1], 1))
        .bitwiseOR(F.shiftleft(below, 1).bitwiseAND(F.lit(mask)))
    )
    return let(
        word,
        lambda new: _levels(
            old, equal, packed.bitwiseOR(F.shiftleft(new, e * width)), new, e + 1, max_edits, width, mask
        ),
    )


def _lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc, tie, n, line, chars, h1, h2 of every line that takes part."""
    return (
        documents.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
            F.xxhash64("text").alias("tie"),
            F.posexplode_outer(F.split("text", "\n", -1)).alias("n", "line"),
        )
        .withColumn("line", F.trim("line", F.lit(BLANKS)))
        .withColumn("chars", F.length("line"))
        .where(F.col("chars") >= min_chars)
        .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    )


def _one_copy_of_frequent(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``lines`` without the later copies of very frequent lines.

    A line is very frequent with more than max(1,000, a ten-thousandth of all lines) copies, so there are at most
    10,000 of them, and their list is broadcast.  Copies of other lines are few and meet their equals later.
    """
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    frequent = firsts.where(F.col("copies") > max(1000, total // 10_000)).select(
        "h1", "h2", *(F.col(c).alias(f"first_{c}") for c in PLACE)
    )
    found = lines.join(F.broadcast(frequent), ["h1", "h2"], "left")
    return found.where(F.col("first_doc").isNull() | _at_first()).select(*lines.columns)


def _at_first() -> Column:
    same = F.lit(True)
    for c in PLACE:
        same &= F.col(c) == F.col(f"first_{c}")
    return same


def _shared_entries(lines: DataFrame, max_edits: int) -> DataFrame:
    """key, id, indexed of the index entries and probes whose key belongs to more than one line.

    Most keys belong to one line only: they go in one pass over sorted entries, before any join.
    """
    line, chars = F.col("line"), F.col("chars")
    own, probes = segment_keys(line, chars, max_edits), probe_keys(line, chars, max_edits)
    # The outer form: a plain explode would first test the size of the array, and so compute all keys twice.
    entries = (
        lines.select(F.col("h1").alias("id"), F.concat(own, probes).alias("keys"))
        .select("id", F.posexplode_outer("keys").alias("place", "key"))
        .where(F.col("key").isNotNull())
        .select("id", "key", (F.col("place") <= max_edits).alias("indexed"))
    )
    per_key = Window.partitionBy("key")
    return (
        entries.withColumns({"least": F.min("id").over(per_key), "most": F.max("id").over(per_key)})
        .where("least < most")
        .select("key", "id", "indexed")
        .distinct()
    )


def parity(line: Column) -> Column:
    """64 bits: which characters (by code point modulo 64) occur an odd number of times.  An edit changes two at most."""
    one = F.lit(1).cast("long")
    flip = lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", one, F.ascii(c) % 64))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), flip)


def _near_repeats(lines: DataFrame, firsts: DataFrame, max_edits: int) -> DataFrame:
    """doc, tie, n of the first places of lines that an earlier, different line is within ``max_edits`` of."""
    entries = stored(_shared_entries(_one_copy_of_frequent(lines, firsts), max_edits), "line-entries")
    places = firsts.join(entries.select(F.col("id").alias("h1")).distinct(), "h1").select("h1", *PLACE)
    named = stored(
        places.join(lines.select(*PLACE, "line", "chars"), list(PLACE))
        .dropDuplicates(list(PLACE))
        .withColumn("parity", parity(F.col("line"))),
        "line-texts",
    )
    marked = entries.join(named.select(F.col("h1").alias("id"), "parity", "chars"), "id")
    x, y = marked.where("indexed").alias("x"), marked.alias("y")
    met = (
        (F.col("x.key") == F.col("y.key"))
        & F.when(F.col("y.indexed"), F.col("x.id") < F.col("y.id")).otherwise(F.col("x.id") != F.col("y.id"))
        & (F.abs(F.col("x.chars") - F.col("y.chars")) <= max_edits)
        & (bits_apart(F.col("x.parity"), F.col("y.parity")) <= 2 * max_edits)
    )
    pairs = (
        x.join(y, met)
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )
    a, b = (
        named.select(F.col("h1").alias(s), F.struct(*PLACE).alias(f"{s}_at"), F.col("line").alias(f"{s}_line"))
        for s in ("a", "b")
    )
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(within_edits(F.col("a_line"), F.col("b_line"), max_edits))
        .select(F.greatest("a_at", "b_at").alias("later"))
        .select("later.*")
        .distinct()
    )


def repeated_lines(
    documents: DataFrame, max_edits: int = 2, min_chars: int = 1, near_chars: int | None = None
) -> DataFrame:
    """doc, tie, n and near of every line that repeats an earlier one; ``near``: no earlier line equals it."""
    lines = _lines(documents, min_chars)
    # Places and hashes without the texts: a narrow table that both kinds of repeats start from.
    narrow = stored(lines.select(*PLACE, "h1", "h2"), "line-places")
    firsts = stored(
        narrow.groupBy("h1", "h2")
        .agg(F.min(F.struct(*PLACE)).alias("at"), F.count("*").alias("copies"))
        .select("h1", "h2", "at.*", "copies"),
        "line-firsts",
    )
    heads = firsts.where("copies > 1").select("h1", "h2", *(F.col(c).alias(f"first_{c}") for c in PLACE))
    exact = (
        narrow.join(heads, ["h1", "h2"])
        .where(~_at_first())
        .select("doc", "tie", "n", F.lit(False).alias("near"))
        .distinct()
    )
    chars = F.col("chars")
    if near_chars is not None:
        near = _near_repeats(lines.where(chars >= near_chars), firsts, max_edits)
    else:
        near = _near_repeats(lines.where(chars >= max_edits * EDIT_CHARS), firsts, max_edits)
        for edits in range(1, max_edits):  # the shorter line has the length for so many, the longer so many more at most
            fewer = chars.between(edits * EDIT_CHARS, (edits + 1) * EDIT_CHARS - 1 + edits)
            near = near.union(_near_repeats(lines.where(fewer), firsts, edits))
        near = near.distinct()
    return exact.union(near.withColumn("near", F.lit(True)))


def _by_document(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("doc", "tie").agg(
        F.sort_array(F.collect_list("n")).alias("removed_lines"), F.count_if("near").alias("n_near")
    )


def _keyed(documents: DataFrame, doc: str = "_doc", tie: str = "_tie") -> DataFrame:
    return documents.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), tie: F.xxhash64("text")})


def line_report(documents: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_lines, n_repeats, n_near and removed_lines (numbers from 0) of each document."""
    repeats = _by_document(repeated_lines(documents, **limits))
    narrow = _keyed(documents.select("doc_id", "text")).select(
        "doc_id", "_doc", "_tie", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines")
    )
    return narrow.join(
        repeats, (narrow["_doc"] == repeats["doc"]) & (narrow["_tie"] == repeats["tie"]), "left"
    ).select(
        "doc_id",
        F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_repeats"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def without_repeats(documents: DataFrame, **limits: int) -> DataFrame:
    """The documents with repeated lines removed from their texts; columns, and texts without repeats, stay."""
    taken = {c.lower() for c in documents.columns}
    doc, tie, removed = (next(n for n in (f"{name}{'_' * k}" for k in count()) if n not in taken) for name in ("doc", "tie", "removed"))
    repeats = _by_document(repeated_lines(documents, **limits)).select(
        F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("removed_lines").alias(removed)
    )
    lines = F.split("text", "\n", -1)
    kept = let(
        lines,
        lambda found: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col(removed)), lambda i: F.get(found, i)),
            "\n",
        ),
    )
    return (
        _keyed(documents, doc, tie)
        .join(repeats, [doc, tie], "left")
        .withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
        .select(*documents.columns)
    )
