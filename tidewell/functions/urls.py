"""URL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCKED_PARTS = ("youtube.com", "youtu.be", "microsoft.com", "geeksforgeeks.org", "wikipedia.org")
PRIORITY_PARTS = ("arxiv.org", "doi.org", "semanticscholar.org", "habr.com", "peerj.com", "crossref")
ACADEMIC_HOSTS = ("arxiv.org", "export.arxiv.org", "semanticscholar.org", "aclanthology.org", "doi.org", "openreview.net")
ACADEMIC_TIERS = ("consensus", "arxiv", "semantic_scholar", "searxng_science", "openalex", "academic")
PRACTICAL_BLOCKED_HOSTS = ("arxiv.org", "doi.org", "semanticscholar.org", "export.arxiv.org", "dictionary.com", "merriam-webster.com", "cambridge.org", "wikipedia.org", "books.google.com")
API_PATHS = ("/docs/", "/reference/", "/api/", "v1_operations", "v2_operations", "/sdk/", "/swagger/", "/openapi/", "/apidocs/")
PLACEHOLDER_HOSTS = ("example.com", "example.org", "example.net", "example.edu", "localhost", "127.0.0.1", "0.0.0.0")
PLACEHOLDER_ENDS = (".example", ".invalid", ".test")
ARXIV_DOI = r"(?i)10\.48550/arxiv\.(\d{4}\.\d{4,5}|[a-z][a-z\-]*/\d{4,7})(v\d+)?"
BIORXIV_DOI = r"(?i)10\.1101/(\d{4}\.\d{2}\.\d{2}\.\d{6,9})(v\d+)?"
ZENODO_DOI = r"(?i)10\.5281/zenodo\.(\d+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def host(url: Column | str) -> Column:
    """Lower-case host without ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(_c(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(_c(url)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"\?([^#]*)", 1)


def strip_slash(url: Column | str) -> Column:
    """Key of a URL: trimmed, lower case, without slashes at the end."""
    return F.regexp_replace(F.lower(F.trim(_c(url))), r"/+$", "")


def document_id(url: Column | str) -> Column:
    """Short stable id of a URL; ``local`` for a blank one."""
    key = strip_slash(url)
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("local")).otherwise(F.substring(F.sha2(key, 256), 1, 24))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def is_blocked(url: Column | str) -> Column:
    return contains_any(F.lower(_c(url)), BLOCKED_PARTS)


def priority(url: Column | str) -> Column:
    """Place of the first priority part in the URL, or one past the list."""
    low, out = F.lower(_c(url)), F.lit(len(PRIORITY_PARTS) + 1)
    for i in reversed(range(len(PRIORITY_PARTS))):
        out = F.when(F.contains(low, F.lit(PRIORITY_PARTS[i])), F.lit(i)).otherwise(out)
    return out


def under(host_: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a host is one of the suffixes or below one."""
    return any_of([(host_ == s) | host_.endswith(f".{s}") for s in suffixes])


def is_collectible(url: Column | str) -> Column:
    """An article's address: http, not blocked, a dotted host, more than the bare home page."""
    u = F.trim(_c(url))
    site = F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]+)", 1)
    bare = (F.regexp_replace(path(u), r"^/+|/+$", "") == "") & (F.trim(query_of(u)) == "")
    return u.startswith("http") & ~is_blocked(u) & F.contains(site, F.lit(".")) & ~bare


def is_academic(url: Column | str) -> Column:
    return under(host(url), ACADEMIC_HOSTS)


def bucket(url: Column | str, tier: Column | str) -> Column:
    """Academic or practical, by tier, then host, then parts of the URL."""
    t, u = F.lower(F.trim(F.coalesce(_c(tier), F.lit("")))), F.lower(F.trim(_c(url)))
    scholarly = t.isin(*ACADEMIC_TIERS) | t.startswith("consensus") | is_academic(u) | contains_any(u, ("arxiv.org", "biorxiv.org", "medrxiv.org"))
    return F.when(scholarly, F.lit("academic")).otherwise(F.lit("practical"))


def practical_reject(url: Column | str, official: Sequence[str] = ()) -> Column:
    """Why a practical source is refused; null if it isn't.

    Reference pages are refused by their path, but not on ``official`` hosts of
    documentation, which is where they belong.
    """
    u = F.trim(_c(url))
    low, h = F.lower(u), host(u)
    out = F.when(~u.startswith("http"), F.lit("not_http"))
    exempt = F.coalesce(F.regexp_replace(h, r"^www\.", "").isin([o.lower() for o in official]), F.lit(False)) if official else F.lit(False)
    for m in API_PATHS:
        out = out.when(~exempt & F.contains(low, F.lit(m)), F.lit(f"practical_api_doc_path:{m}"))
    for s in PRACTICAL_BLOCKED_HOSTS:
        out = out.when((h == s) | h.endswith(f".{s}"), F.lit(f"practical_blocked_host:{s}"))
    return out


def is_placeholder(url: Column | str) -> Column:
    """An address that is no source: too short, not http, without a host, or one reserved for examples."""
    u = F.trim(F.coalesce(_c(url), F.lit("")))
    site = F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return (F.length(u) < 8) | (site == "") | site.isin(*PLACEHOLDER_HOSTS) | any_of([site.endswith(e) for e in PLACEHOLDER_ENDS])


def arxiv_id(url: Column | str) -> Column:
    """Identifier in an abstract's or a paper's address; null elsewhere."""
    tail = F.regexp_replace(F.trim(F.regexp_extract(F.trim(_c(url)), r"(?i)arxiv\.org/abs/(.+)$", 1)), r"/+$", "")
    pdf = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(F.trim(_c(url)), r"(?i)arxiv\.org/pdf/(.+)$", 1)), r"/+$", ""), r"(?i)\.pdf$", "")
    return F.when(tail != "", tail).when(pdf != "", pdf)


def doi_tail(url: Column | str) -> Column:
    """Path of any URL, as a DOI's tail; the host isn't looked at."""
    p = F.regexp_replace(F.coalesce(F.try_url_decode(path(url)), path(url)), r"^/+|/+$", "")
    return F.trim(F.when(F.lower(p).startswith("doi/"), F.regexp_replace(p, r"(?i)^doi/", "")).otherwise(p))


def source_key(url: Column | str) -> Column:
    """One key for a paper's abstract, file and DOI; the path for other URLs."""
    u = F.trim(_c(url))
    aid = F.regexp_replace(F.regexp_replace(F.lower(arxiv_id(u)), r"/+$", ""), r"\.pdf$", "")
    tail = doi_tail(u)
    by_doi = F.regexp_extract(tail, ARXIV_DOI, 1)
    return (
        F.when(aid.isNotNull(), F.concat(F.lit("arxiv:"), aid))
        .when((tail != "") & (by_doi != ""), F.concat(F.lit("arxiv:"), F.lower(by_doi), F.lower(F.regexp_extract(tail, ARXIV_DOI, 2))))
        .when(tail != "", F.concat(F.lit("doi:"), F.lower(tail)))
        .otherwise(strip_slash(u))
    )


def canonical(url: Column | str) -> Column:
    """Canonical address of a DOI or preprint; null where no rule applies."""
    tail = doi_tail(url)
    arxiv, bio, zenodo = F.regexp_extract(tail, ARXIV_DOI, 0), F.regexp_extract(tail, BIORXIV_DOI, 0), F.regexp_extract(tail, ZENODO_DOI, 1)
    return (
        F.when((tail == "") & arxiv_id(url).isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(url), F.lit(".pdf")))
        .when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_extract(tail, ARXIV_DOI, 1), F.regexp_extract(tail, ARXIV_DOI, 2), F.lit(".pdf")))
        .when(bio != "", F.concat(F.lit("https://www.biorxiv.org/content/10.1101/"), F.regexp_extract(tail, BIORXIV_DOI, 1), F.regexp_extract(tail, BIORXIV_DOI, 2)))
        .when(zenodo != "", F.concat(F.lit("https://zenodo.org/record/"), zenodo))
    )


def pdf_address(url: Column | str) -> Column:
    """Preprint pages as the paper's file; other URLs unchanged."""
    u = F.trim(_c(url))
    return F.when(arxiv_id(u).isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(u), F.lit(".pdf"))).otherwise(u)
