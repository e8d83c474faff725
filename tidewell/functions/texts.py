"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHALLENGE_MARKERS = ("just a moment", "cloudflare", "cf-browser-verification", "checking your browser", "verifying your browser", "enable javascript", "access denied", "captcha", "bot detection", "please turn javascript on", "robot check")
BLOCKED_STATUS = (401, 403, 429, 503)
SCOPES = ("CONCEPT", "MECHANIC", "PRACTICE", "EDGE_CASE", "ANTI_PATTERN")
SCOPE_ALIASES = {
    "PRINCIPLE": "CONCEPT", "PRINCIPLES": "CONCEPT", "BASIS": "CONCEPT", "FUNDAMENTAL": "CONCEPT",
    "INSTANCE": "PRACTICE", "INSTANCES": "PRACTICE", "EVIDENCE": "PRACTICE", "EXAMPLE": "PRACTICE", "CASE": "PRACTICE", "METRIC": "PRACTICE",
    "ALGORITHM": "MECHANIC", "MECHANISM": "MECHANIC", "MECHANICS": "MECHANIC",
    "ERROR": "ANTI_PATTERN", "BAD_PRACTICE": "ANTI_PATTERN", "ANTIPATTERN": "ANTI_PATTERN",
    "LIMIT": "EDGE_CASE", "CORNER_CASE": "EDGE_CASE", "EDGECASE": "EDGE_CASE",
}
SCOPE_TAG = r"(?is)^\[SCOPE:\s*(CONCEPT|MECHANIC|PRACTICE|EDGE_CASE|ANTI_PATTERN|PRINCIPLE|INSTANCE)\s*\]"
PERMISSION_NOTICE = r"(?i)permission\s+to\s+make\s+digital\s+or\s+hard\s+copies"
PAGE_NUMBER = r"^\d{1,3}$"
RUNNING_HEAD = r"(?i)(?:ASPLOS|IEEE|ACM|Proceedings)\s*[’']?\s*\d{2,4}|March\s+\d{1,2}[-–][\p{L}\p{N}_]+\s+\d{4}.*Rotterdam|Derrick\s+Quinn\s+et\s+al\.|Accelerating\s+Retrieval-Augmented\s+Generation\s+ASPLOS"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\s+[A-ZА-Я][\p{L}\p{N}_\s\-–—]{2,80}$"
AXIS_LABEL = r"(?i)^(?:\d+\s*|(?:queries/sec|qps|latency|throughput|log\s+scale|linear\s+scale)(?:\s*\([^)]{0,40}\))?|\d+(?:\.\d+)?\s*%|[0-9]+(?:\.[0-9]+)?)$"
LINE_END_HYPHEN = r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)"
INNER_HYPHEN = r"([\p{L}\p{N}_]{4,})-\s+(\p{Ll}[\p{L}\p{N}_]+)"
#: Space separators of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BROKEN_WORD = r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: Column | str) -> Column:
    """The text without space characters of any width at its ends; tabs and line ends stay."""
    return F.trim(_c(text), F.lit(SPACES))


def blocks_of(text: Column | str, separator: str, least: int) -> Column:
    """Trimmed parts of at least so many characters."""
    return F.filter(F.transform(F.split(_c(text), separator), lambda x: trimmed(x)), lambda x: F.length(x) >= least)


def heading_blocks(markdown: Column | str, least: int) -> Column:
    """Blocks between second-level headings of more than so many characters."""
    return blocks_of(F.concat(F.lit("\n"), _c(markdown)), r"\n## ", least + 1)


def clean(text: Column | str) -> Column:
    """Unix line ends, hyphen breaks joined, line ends trimmed, blank runs collapsed."""
    t = F.regexp_replace(_c(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, BROKEN_WORD, "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def is_challenge(html: Column | str, status: Column | None = None, method: Column | None = None) -> Column:
    """Whether a fetch met an access wall rather than a page."""
    low = F.lower(F.substring(F.coalesce(_c(html), F.lit("")), 1, 8000))
    out = low.rlike("|".join(CHALLENGE_MARKERS))
    if status is not None:
        out = out | F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False))
    if method is not None:
        out = out | (F.lower(F.trim(F.coalesce(method, F.lit("")))) == "failed")
    return out


def is_noise(text: Column | str) -> Column:
    """Paragraphs without content: very short, permission notices, page numbers, running heads, axis labels."""
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    running = t.rlike(RUNNING_HEAD) & ~t.rlike(NUMBERED_HEADING)
    return (
        (F.length(t) < 2)
        | t.rlike(PERMISSION_NOTICE)
        | t.rlike(PAGE_NUMBER)
        | ((F.length(t) <= 120) & running & (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) <= 2))
        | ((F.length(t) <= 48) & t.rlike(AXIS_LABEL))
    )


def merge_hyphens(text: Column | str) -> Column:
    """Words cut by a hyphen and a line end, or by a hyphen and a space before a lower-case rest."""
    return F.regexp_replace(F.regexp_replace(_c(text), LINE_END_HYPHEN, "$1$2"), INNER_HYPHEN, "$1$2")


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_tags(html: Column | str, most: int | None = None) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(_c(html), r"<[^>]+>", " "), r"\s+", " "))
    return F.substring(t, 1, most) if most else t


def image_sources(html: Column | str) -> Column:
    """Sources of the images of a page in order, each once."""
    tags = F.regexp_extract_all(_c(html), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.regexp_extract(x, r'(?i)\bsrc="([^"]*)"', 1)), lambda x: x != ""))


def code_blocks(html: Column | str) -> Column:
    """Whole ``pre`` blocks, then ``code`` outside them."""
    pre = F.regexp_extract_all(_c(html), F.lit(r"(?is)<pre\b[^>]*>(.*?)</pre>"), F.lit(1))
    rest = F.regexp_replace(_c(html), r"(?is)<pre\b[^>]*>.*?</pre>", " ")
    return F.concat(pre, F.regexp_extract_all(rest, F.lit(r"(?is)<code\b[^>]*>(.*?)</code>"), F.lit(1)))


def headings(html: Column | str) -> Column:
    """``level, title`` of the headings of a page in order."""
    tags = F.regexp_extract_all(_c(html), F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    return F.transform(tags, lambda x: F.struct(F.regexp_extract(x, "(?i)<h([1-6])", 1).cast("int").alias("level"), strip_tags(x).alias("title")))


def estimated_tokens(text: Column | str) -> Column:
    """Tokens by script, without a tokenizer."""
    t = F.coalesce(_c(text), F.lit(""))
    cyrillic = F.length(F.regexp_replace(t, "[^Ѐ-ӿ]", ""))
    return F.floor(cyrillic / F.lit(1.75) + (F.length(t) - cyrillic) / F.lit(3.7)).cast("long")


def is_mostly_latin(text: Column | str) -> Column:
    """Fewer Cyrillic than Latin letters; false without letters."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.length(F.regexp_replace(t, "[^А-Яа-яЁё]", "")) < F.length(F.regexp_replace(t, "[^A-Za-z]", ""))


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(F.trim(_c(text)), r"(?<=[.!?…])\s+"), lambda x: x != "")


def extract(text: Column | str, mode: Column | str) -> Column:
    """All of a paragraph, its first sentence, or its first two."""
    s = sentences(text)
    return F.when(_c(mode) == "first", F.array_join(F.slice(s, 1, 1), " ")).when(_c(mode) == "first_two", F.array_join(F.slice(s, 1, 2), " ")).otherwise(F.trim(_c(text)))


def scope_of(value: Column | str) -> Column:
    """Scope of a tag, with or without brackets.

    A name or alias counts as it is; else the first alias that holds the tag or lies in
    it; a tag that fits none is a concept.
    """
    raw = F.trim(F.coalesce(_c(value), F.lit("")))
    inner = F.regexp_extract(raw, SCOPE_TAG, 1)
    upper = F.translate(F.upper(F.when(inner != "", inner).otherwise(raw)), "- ", "__")
    out = F.when(raw == "", F.lit("CONCEPT")).when(upper.isin(*SCOPES), upper)
    for alias, scope in SCOPE_ALIASES.items():
        out = out.when(upper == alias, F.lit(scope))
    for alias, scope in SCOPE_ALIASES.items():
        out = out.when(F.contains(upper, F.lit(alias)) | F.contains(F.lit(alias), upper), F.lit(scope))
    return out.otherwise(F.lit("CONCEPT"))


def slug(label: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(label))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def tokens(text: Column | str, least: int = 1) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= least))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, overlap(a, b) / both).otherwise(F.lit(0.0))


def urls_in(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0)))
