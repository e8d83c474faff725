"""Score expressions and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls

# Fixed values.
SEMANTIC_WEIGHT = {"SPEC_EXACT": 1.0, "CONCEPTUAL_MODEL": 0.6, "METAPHOR_ONLY": 0.2}
CORRECTNESS_WEIGHT = {"VERIFIED": 1.0, "SIMPLIFIED": 0.7, "CONTRADICTION": 0.0}
DENSITY_WEIGHT = {"HIGH": 1.0, "NEUTRAL": 0.5, "WATER_OR_OPINION": 0.1}
PEDAGOGY_WEIGHT = {
    "intro": {"CONCEPT": 1.3, "MECHANIC": 1.0, "PRACTICE": 0.7, "EDGE_CASE": 0.4, "ANTI_PATTERN": 0.5},
    "deep_dive": {"MECHANIC": 1.35, "CONCEPT": 0.85, "PRACTICE": 1.1, "EDGE_CASE": 0.7, "ANTI_PATTERN": 0.8},
    "practice": {"PRACTICE": 1.4, "MECHANIC": 1.2, "CONCEPT": 0.7, "EDGE_CASE": 1.0, "ANTI_PATTERN": 1.1},
    "advanced": {"PRACTICE": 1.5, "MECHANIC": 1.3, "EDGE_CASE": 1.4, "ANTI_PATTERN": 1.3, "CONCEPT": 0.5},
    "expert": {"EDGE_CASE": 1.7, "ANTI_PATTERN": 1.6, "PRACTICE": 1.4, "MECHANIC": 1.1, "CONCEPT": 0.3},
}
LOW_DEPTH_BOOST = {"PRACTICE": 1.25, "CONCEPT": 1.15}
HIGH_DEPTH_BOOST = {"MECHANIC": 1.25, "EDGE_CASE": 1.35, "ANTI_PATTERN": 1.30}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trust_of(trust: Column | str) -> Column:
    """Trust in 0..1; unknown trust is full."""
    return clamp(F.coalesce(_c(trust), F.lit(1.0)))


def search_trust(trust: Column | str) -> Column:
    """Trust as chunk search counts it, in its cutoff and in its rank: a trust of exactly 0 acts as unknown."""
    t = trust_of(trust)
    return F.when(t == 0, 1.0).otherwise(t)


def passes_trust(similarity: Column | str, trust: Column | str, least: float = 0.2, or_similar: float = 0.85) -> Column:
    return (trust_of(trust) >= least) | (_c(similarity) >= or_similar)


def relax(rows: DataFrame, keys: list[str], gates: list[Column], least: int) -> DataFrame:
    """Rows of each group at the strictest gate that at least so many rows pass; the last level takes all. Adds ``chosen``."""
    level = F.lit(len(gates))
    for i in reversed(range(len(gates))):
        level = F.when(gates[i], i).otherwise(level)
    marked = rows.withColumn("_level", level)
    chosen = F.lit(len(gates))
    for i in reversed(range(len(gates))):
        chosen = F.when(F.count_if(F.col("_level") <= i) >= least, i).otherwise(chosen)
    groups = marked.groupBy(*keys).agg(chosen.cast("long").alias("chosen"))
    return marked.join(groups, keys).where(F.col("_level") <= F.col("chosen")).drop("_level")


def match_whitelist(rows: DataFrame, patterns: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Category of the first pattern that equals, begins or contains the host or its path; patterns are a small fixed list."""
    site, tail = urls.host(url), F.regexp_replace(urls.path(url), r"^/+|/+$", "")
    u = rows.select(key, site.alias("host"), F.when(tail == "", site).otherwise(F.concat_ws("/", site, tail)).alias("host_path"))
    base = F.split_part("pattern", F.lit("/"), F.lit(1))
    hit = (F.col("host") == F.col("pattern")) | F.startswith("host_path", "pattern") | F.startswith("pattern", "host_path") | (F.col("host") == base) | F.endswith("host", F.concat(F.lit("."), base))
    return u.join(F.broadcast(patterns), hit & (F.col("host") != "")).groupBy(key).agg(F.min_by("category", "i").alias("category"))


def discards_source(raw: Column | str, filtered: Column | str) -> Column:
    """Whether filtering a long text left a stub."""
    raw, filtered = _c(raw), _c(filtered)
    return (raw >= 800) & (filtered < raw) & ((filtered < 400) | (filtered < 0.35 * raw))


def citation_share(count: Column | str, saturation: float = 40.0) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), F.coalesce(_c(count), F.lit(0))).cast("double")) / math.log1p(max(1.0, saturation)))


def recency(year: Column | str, now: int, half_life: float = 5.0) -> Column:
    """Halves with every half-life; unknown or impossible years are neutral."""
    y = _c(year)
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - y)
    return F.when(y.isNull() | (y < 1990) | (y > now + 1), F.lit(0.5)).otherwise(F.exp(F.lit(-math.log(2.0) / max(0.5, half_life)) * age))


def hybrid(relevance: Column | str, trust: Column | str, citations: Column | str, year: Column | str, now: int, weights: tuple[float, float, float, float] = (0.45, 0.25, 0.20, 0.10), half_life: float = 5.0) -> Column:
    total = sum(weights)
    a, b, c, d = (w / total for w in weights)
    return F.round(a * clamp(_c(relevance)) + b * trust_of(trust) + c * citation_share(citations) + d * recency(year, now, half_life), 6)


def venue_trust(citations: Column | str, published: Column, open_access: Column) -> Column:
    """Trust of a paper by venue and citations."""
    source = F.when(published, 0.85).when(open_access, 0.6).otherwise(0.5)
    return F.round(clamp(source * (F.lit(0.3) + F.lit(0.7) * citation_share(citations))), 3)


def _weight(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    got = F.element_at(F.create_map(*pairs), key)
    return got if default is None else F.coalesce(got, F.lit(default))


def paragraph_score(semantic: Column, correctness: Column, density: Column) -> Column:
    return F.round(_weight(correctness, CORRECTNESS_WEIGHT) * (0.6 * _weight(semantic, SEMANTIC_WEIGHT) + 0.4 * _weight(density, DENSITY_WEIGHT)), 3)


def pedagogy_weight(scope: Column, depth: Column) -> Column:
    """Weight of a scope at a depth; 1 where the table has none."""
    flat = {f"{d}:{s}": w for d, row in PEDAGOGY_WEIGHT.items() for s, w in row.items()}
    return _weight(F.concat_ws(":", depth, scope), flat, 1.0)


def novelty_weight(seen: Column, new_article: Column) -> Column:
    return F.when(seen, 0.4).otherwise(1.0) * F.when(new_article, 1.25).otherwise(1.0)


def depth_signal(why: Column, how: Column, mechanic: Column) -> Column:
    """``low`` while the first layer isn't passed, ``high`` when only the last isn't, else null."""
    return F.when(~why, "low").when(why & how & ~mechanic, "high")


def shift_weight(scope: Column, signal: Column) -> Column:
    """Weight of the scopes that fit the learner's present angle."""
    return F.when(signal == "low", _weight(scope, LOW_DEPTH_BOOST, 1.0)).when(signal == "high", _weight(scope, HIGH_DEPTH_BOOST, 1.0)).otherwise(1.0)


def affinity_weight(repelled: Column, attracted: Column) -> Column:
    """Weight by the greatest similarity to claims to avoid and to seek; unknown ones are neutral."""
    return F.when(repelled >= 0.82, 0.45).otherwise(1.0) * F.when(attracted >= 0.75, 1.35).otherwise(1.0)


def coverage(keywords: list[str], text: Column | str) -> Column:
    """Mean credit over keywords: whole, or the share of its words found."""
    words = [k.strip().lower() for k in keywords if k.strip()]
    if not words:
        return F.lit(1.0)
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    credit = []
    for k in words:
        parts = k.split()
        credit.append(F.when(F.contains(low, F.lit(k)), 1.0).otherwise(sum((F.contains(low, F.lit(p)).cast("double") for p in parts), F.lit(0.0)) / len(parts)))
    return sum(credit[1:], credit[0]) / len(words)
