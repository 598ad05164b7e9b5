"""Source-URL canonicalisation over a URL table, by site rules given as data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_reason, trim_space

MAX_URL_BYTES = 4096
_PARTS = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?\\z"
_PLAIN_PATH = "^[A-Za-z0-9_.~$&+,/:;=@-]*\\z"


@dataclass(frozen=True)
class SiteRule:
    """One accepted page shape.  ``path`` captures the video id, unless ``query_id`` names it."""

    site: str
    hosts: tuple[str, ...]
    path: str
    prefix: str
    query_id: str | None = None
    id_pattern: str | None = None
    page_param: str | None = None
    share_link: bool = False


# The accepted sites and page shapes.
_YT = ("youtube.com", "www.youtube.com", "m.youtube.com")
_ID11 = "^[A-Za-z0-9_-]{11}\\z"
DEFAULT_RULES = (
    SiteRule("youtube", _YT, "^/watch\\z", "https://www.youtube.com/watch?v=", query_id="v", id_pattern=_ID11),
    SiteRule("youtube", _YT, "^/shorts/(.*)\\z", "https://www.youtube.com/watch?v=", id_pattern=_ID11),
    SiteRule("youtube", ("youtu.be",), "^/?(.*)\\z", "https://www.youtube.com/watch?v=", id_pattern=_ID11),
    SiteRule(
        "bilibili", ("bilibili.com", "www.bilibili.com", "m.bilibili.com"),
        "(?i)^(/video/(?:BV[A-Za-z0-9]{10}|av[1-9][0-9]*))/?\\z", "https://www.bilibili.com", page_param="p",
    ),
    SiteRule("b23", ("b23.tv",), "^(/[A-Za-z0-9]{4,24})/?\\z", "https://b23.tv", share_link=True),
)


def _values(pairs: Column, name: str) -> Column:
    """Decoded values of one query parameter."""
    named = F.filter(pairs, lambda p: F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)) == name)
    return F.transform(named, lambda p: F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)\\z", 1)))


def canonicalize_urls(df: DataFrame, url_col: str = "url", rules: Sequence[SiteRule] = DEFAULT_RULES) -> DataFrame:
    """Adds ``canonical, site, video_id, needs_resolution, reason``.  Native expressions only."""
    raw = F.col(url_col)
    part = lambda i: F.regexp_extract(raw, _PARTS, i)
    split = df.withColumn(
        "__u",
        F.struct(
            F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), part(3).alias("path"),
            part(4).alias("query"), part(5).alias("fragment"),
        ),
    ).withColumn("__q", F.filter(F.split("__u.query", "&"), lambda p: p != ""))
    u, pairs = F.col("__u"), F.col("__q")
    clean = (
        (F.octet_length(raw) <= MAX_URL_BYTES)
        & (trim_space(raw) == raw)
        & ~raw.rlike("[\\\\\\x00\\r\\n\\t]")
        & raw.rlike(_PARTS)
    )
    bad_query = F.exists(pairs, lambda p: p.contains(";")) | u["query"].rlike("%(?![0-9A-Fa-f]{2})")
    all_hosts = sorted({h for r in rules for h in r.hosts})

    hit = None
    for r in rules:
        values = _values(pairs, r.query_id) if r.query_id else None
        vid = (
            F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1)))
            if values is not None
            else F.regexp_extract(u["path"], r.path, 1)
        )
        fits = u["host"].isin(*r.hosts) & u["path"].rlike(r.path)
        if r.id_pattern:
            fits = fits & F.coalesce(vid.rlike(r.id_pattern), F.lit(False))
        suffix = F.lit("")
        if r.page_param:
            pages = _values(pairs, r.page_param)
            one = F.try_element_at(pages, F.lit(1))
            fits = fits & ((F.size(pages) == 0) | ((F.size(pages) == 1) & one.rlike("^[1-9][0-9]{0,3}\\z")))
            suffix = F.when(F.size(pages) == 1, F.concat(F.lit(f"?{r.page_param}="), one)).otherwise(suffix)
        if r.share_link:
            fits = fits & (u["query"] == "") & (u["fragment"] == "")
        value = F.struct(
            F.concat(F.lit(r.prefix), vid, suffix).alias("canonical"),
            F.lit(r.site).alias("site"),
            F.regexp_replace(vid, "^.*/", "").alias("video_id"),
            F.lit(r.share_link).alias("needs_resolution"),
        )
        hit = F.when(fits, value) if hit is None else hit.when(fits, value)

    reason = first_reason(
        (~F.coalesce(clean, F.lit(False)), "malformed"),
        (u["scheme"] != "https", "scheme"),
        (~u["host"].isin(*all_hosts), "host"),
        (~u["path"].rlike(_PLAIN_PATH), "path"),
        (bad_query, "query"),
        (hit.isNull(), "not_a_video_page"),
    )
    done = split.withColumn("reason", reason).withColumn("__hit", F.when(F.col("reason").isNull(), hit))
    return done.select(
        *df.columns,
        F.col("__hit.canonical").alias("canonical"),
        F.col("__hit.site").alias("site"),
        F.col("__hit.video_id").alias("video_id"),
        F.coalesce(F.col("__hit.needs_resolution"), F.lit(False)).alias("needs_resolution"),
        "reason",
    )


def distinct_sources(canonical: DataFrame) -> DataFrame:
    """One row per canonical URL (partial aggregation, first id wins by minimum)."""
    keys = [c for c in canonical.columns if c not in ("canonical", "site", "video_id", "needs_resolution", "reason")]
    return (
        canonical.where(F.col("reason").isNull())
        .groupBy("canonical", "site", "video_id", "needs_resolution")
        .agg(F.min(F.struct(*keys)).alias("first"), F.count(F.lit(1)).alias("n_urls"))
        .select("canonical", "site", "video_id", "needs_resolution", "n_urls", "first.*")
    )
