"""URL classes and normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that are no pages.
FILES = sorted(("doc", "docx", "css", "gif", "jpeg", "jpg", "js", "mp3", "png", "wav", "wma", "zip"))
_PARTS = r"^(?i:(https?)://)([^/?#;]*)([^?#;]*)(?:;[^?#]*)?(\?[^#]*)?(?:#.*)?$"


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def is_pdf(u: Column) -> Column:
    return F.endswith(F.lower(path(u)), F.lit(".pdf"))


def is_page(u: Column) -> Column:
    p = F.lower(path(u))
    plain = (p == "") | F.endswith(p, F.lit("/")) | ~p.rlike(r"\.(?:" + "|".join(FILES) + r")$")
    return ~is_pdf(u) & plain


def is_allowed(u: Column, domains: tuple[str, ...]) -> Column:
    h = host(u)
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def is_junk(u: Column) -> Column:
    low = F.lower(u)
    return F.contains(low, F.lit("/webresource.axd")) | F.contains(low, F.lit("/scriptresource.axd"))


def normalize_absolute(u: Column) -> Column:
    """Absolute http(s) URLs without parameters and fragment, an empty path as "/"; null for others."""
    u = F.trim(u)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    p = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(u.rlike(_PARTS) & ~is_junk(u), F.concat(F.lower(part(1)), F.lit("://"), part(2), p, part(4)))


def citation_key(u: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(u), "/+$", ""))


def resolve(href: str | None, page: str, domains: tuple[str, ...]) -> str | None:
    """One link of a page, joined and normalised; for use inside Arrow-batched parsers."""
    from urllib.parse import urljoin, urlsplit, urlunsplit

    href = (href or "").strip()
    if not href or href.split(":", 1)[0].lower() in ("data", "javascript", "mailto", "tel"):
        return None
    try:
        u = urlsplit(urljoin(page, href))
    except ValueError:
        return None
    if u.scheme not in ("http", "https"):
        return None
    h = u.netloc.lower().removeprefix("www.")
    if domains and not any(h == d or h.endswith("." + d) for d in domains):
        return None
    p = u.path or "/"
    last = p.rsplit("/", 1)
    out = urlunsplit((u.scheme, u.netloc, "/".join([*last[:-1], last[-1].split(";")[0]]) or "/", u.query, ""))
    low = out.lower()
    return None if "/webresource.axd" in low or "/scriptresource.axd" in low else out
