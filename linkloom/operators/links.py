"""Links of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An anchor-like tag, its first href, and the value up to its closing quote (or white space or >).
HREF = r"(?i)<a[^>]*?href=(\"[^\"]*|'[^']*|[^\s>]*)"
NOT_CRAWLABLE = r"^(javascript:|mailto:|tel:|#)"
MAX_LINKS = 256
MAX_URL_CHARS = 4095


def raw_hrefs(html: Column) -> Column:
    """All href values of a page in order, opening quotes removed, cut at the longest URL that is kept."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(found, lambda h: F.substring(F.regexp_replace(h, "^[\"']", ""), 1, MAX_URL_CHARS))


def is_crawlable(link: Column) -> Column:
    """Not empty, no fragment, and none of the schemes that lead nowhere (case-sensitive)."""
    return (F.length(link) > 0) & ~link.rlike(NOT_CRAWLABLE)


def crawlable_links(html: Column, limit: int | None = MAX_LINKS) -> Column:
    kept = F.filter(raw_hrefs(html), is_crawlable)
    return F.slice(kept, 1, limit) if limit else kept


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", limit: int | None = MAX_LINKS) -> DataFrame:
    """url, pos, link: one row per kept link of each page, pos from 0."""
    return pages.select(F.col(url).alias("url"), F.posexplode(crawlable_links(F.coalesce(F.col(html), F.lit("")), limit)).alias("pos", "link"))


def resolve(base: Column, link: Column) -> Column:
    """A link made absolute: protocol-relative, root-relative and relative ones against the page's URL."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(plain == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(plain, link))
        .otherwise(F.concat(folder, link))
    )
