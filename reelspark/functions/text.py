"""Text predicates shared by every validator (native column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space (Unicode White_Space).
SPACES = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = "".join(f"\\u{ord(c):04X}" for c in SPACES)
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
# White space that does not end a line, for line-wise regular expressions.
BLANK = "[" + "".join(f"\\u{ord(c):04X}" for c in SPACES if c not in "\n\r") + "]"


def trim_space(c: Column) -> Column:
    """Strip Unicode white space at both ends (plain ``trim`` only strips U+0020)."""
    return F.btrim(c, F.lit(SPACES))


def not_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(NOT_SPACE), F.lit(False))


def text_ok(c: Column, limit: int, required: bool) -> Column:
    """Valid UTF-8, at most ``limit`` code points and, when required, not blank."""
    ok = c.isNotNull() & F.is_valid_utf8(c) & (F.char_length(c) <= limit)
    return F.coalesce(ok & not_blank(c) if required else ok, F.lit(False))


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-zA-Z0-9_-]{1,100}\\z"), F.lit(False))


def unify_newlines(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\\r\\n?", "\n")).otherwise(c)


def clean_caption(c: Column) -> Column:
    """Caption text as exported: LF newlines, no blank lines, no trailing blanks.

    One-line text, the usual case, only needs the trim.
    """
    no_tail = F.regexp_replace(unify_newlines(c), "[ \\t]+(?=\\n|\\z)", "")
    no_blank_lines = F.regexp_replace(no_tail, f"\\n(?:{BLANK}*+\\n)++", "\n")
    many = F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    return trim_space(F.when(many, no_blank_lines).otherwise(c))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule (in order) whose condition holds, else null."""
    out = None
    for condition, name in rules:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out
