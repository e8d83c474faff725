"""Selections whose steps depend on earlier picks.

Each group is one query's bounded pool, which Spark has cut by rank before, or one
document's lines; groups run apart, so the cost grows with the number of groups and
not with the table.  Keys must name such pools.  ``accept_stream`` takes groups of any
size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.dedup import cut, similar_pairs
from tidewell.operators.tables import latest


def _per_group(rows: DataFrame, keys: Sequence[str], pick: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """Rows that ``pick`` chooses of each group, with ``place`` from 1."""
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        chosen = pick(group)
        return group.iloc[chosen].assign(place=range(1, len(chosen) + 1))

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def mmr(rows: DataFrame, keys: Sequence[str], key: str, vector: str, score: str, k: int, weight: float = 0.62, weigh_first: bool = True) -> DataFrame:
    """Maximal marginal relevance: ``weight * score - (1 - weight) * nearest pick``; equal values go by score, then key.

    Weights from 0.999 give the head by score.
    """

    def pick(g: pd.DataFrame) -> list[int]:
        g = g.sort_values([score, key], ascending=[False, True], kind="stable")
        order, v, s = g.index.to_numpy(), _units(g[vector]), g[score].to_numpy(float)
        if weight >= 0.999:
            return order[np.argsort(-s, kind="stable")[:k]].tolist()
        near, open_, out = np.zeros(len(g)), np.ones(len(g), bool), []
        while open_.any() and len(out) < k:
            value = weight * s - (1 - weight) * near if out or weigh_first else s
            i = int(np.argmax(np.where(open_, value, -np.inf)))
            open_[i] = False
            sim = v @ v[i]
            near = sim if not out else np.maximum(near, sim)
            out.append(int(order[i]))
        return out

    return _per_group(rows, keys, pick)


def adapted_gamma(scores: np.ndarray, gamma: float = 0.55) -> float:
    """Redundancy weight by the spread of the pool's scores."""
    return gamma if len(scores) <= 1 else float(np.clip(gamma + (0.10 - np.std(scores)) * 1.5, 0.35, 0.75))


def mmr_per_source(rows: DataFrame, keys: Sequence[str], key: str, vector: str, score: str, source: str, k: int, per_source: int, gamma: float = 0.55) -> DataFrame:
    """``score - gamma * nearest pick`` with a cap for each source; gamma adapts to the pool."""

    def pick(g: pd.DataFrame) -> list[int]:
        g = g.sort_values([score, key], ascending=[False, True], kind="stable")
        order, v, s, src = g.index.to_numpy(), _units(g[vector]), g[score].to_numpy(float), g[source].to_numpy()
        weight, near, open_, out, used = adapted_gamma(s, gamma), np.zeros(len(g)), np.ones(len(g), bool), [], {}
        while open_.any() and len(out) < k:
            free = open_ & np.array([used.get(x, 0) < per_source for x in src])
            if not free.any():
                break
            i = int(np.argmax(np.where(free, s - weight * near, -np.inf)))
            open_[i] = False
            used[src[i]] = used.get(src[i], 0) + 1
            sim = v @ v[i]
            near = sim if not out else np.maximum(near, sim)
            out.append(int(order[i]))
        return out

    return _per_group(rows, keys, pick)


def distinct_vectors(rows: DataFrame, keys: Sequence[str], key: str, vector: str, score: str, threshold: float = 0.85) -> DataFrame:
    """Best first, each kept unless a kept one is nearer than the threshold."""

    def pick(g: pd.DataFrame) -> list[int]:
        g = g.sort_values([score, key], ascending=[False, True], kind="stable")
        v, out, kept = _units(g[vector]), [], []
        for i in range(len(g)):
            if not kept or (v[kept] @ v[i]).max() <= threshold:
                kept.append(i)
                out.append(int(g.index[i]))
        return out

    return _per_group(rows, keys, pick)


def distinct_texts(rows: DataFrame, keys: Sequence[str], key: str, text: str, score: str, threshold: float = 0.90) -> DataFrame:
    """Best first, each kept unless its matching-block ratio with a kept one reaches the threshold."""

    def alike(a: str, b: str) -> bool:
        m = SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold

    def pick(g: pd.DataFrame) -> list[int]:
        g = g.sort_values([score, key], ascending=[False, True], kind="stable")
        out, kept = [], []
        for i, t in zip(g.index, g[text].fillna("").str.lower()):
            if not any(alike(t, k) for k in kept):
                kept.append(t)
                out.append(int(i))
        return out

    return _per_group(rows, keys, pick)


def distinct_lines(rows: DataFrame, keys: Sequence[str], position: str, text: str, longer_than: int = 20) -> DataFrame:
    """Lines in order, each kept unless it equals a kept one or, if long, one holds the other."""

    def pick(g: pd.DataFrame) -> list[int]:
        g = g.sort_values(position, kind="stable")
        out, kept = [], []
        for i, t in zip(g.index, g[text].fillna("").str.strip().str.lower()):
            if t and not any(t == k or (len(t) > longer_than and (t in k or k in t)) for k in kept):
                kept.append(t)
                out.append(int(i))
        return out

    return _per_group(rows, keys, pick)


def interleave(rows: DataFrame, keys: Sequence[str], provider: str, position: str, url_key: str, cap: int) -> DataFrame:
    """Providers in turn, each giving its next row that isn't taken yet."""

    def pick(g: pd.DataFrame) -> list[int]:
        queues = [q.sort_values(position, kind="stable") for _, q in g.groupby(provider, sort=True)]
        rest = [list(zip(q.index, q[url_key])) for q in queues]
        seen, out = set(), []
        while any(rest) and len(out) < cap:
            for q in rest:
                while q and q[0][1] in seen:
                    q.pop(0)
                if q and len(out) < cap:
                    i, u = q.pop(0)
                    seen.add(u)
                    out.append(int(i))
        return out

    return _per_group(rows, keys, pick)


def within_budget(rows: DataFrame, keys: Sequence[str], position: str, cost: str, budget: float, most: int) -> DataFrame:
    """Rows in order while they fit; one too large is passed over, the first always stays."""

    def pick(g: pd.DataFrame) -> list[int]:
        g, out, used = g.sort_values(position, kind="stable"), [], 0.0
        for i, c in zip(g.index, g[cost]):
            if len(out) < most and (not out or used + c <= budget):
                out.append(int(i))
                used += c
        return out

    return _per_group(rows, keys, pick)


def rejected_in_rounds(edges: DataFrame) -> DataFrame | None:
    """``b``: what one pass in order refuses, for ``edges`` of an earlier ``a`` that rules out a later ``b``; None if there are none.

    What has no undecided earlier neighbour is accepted, which refuses its later
    neighbours; what they would have refused is open again.
    """
    edges, gone = cut(edges.select("a", "b")), None
    while edges.limit(1).count():
        heads = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        lost = cut(edges.join(heads, "a", "left_semi").select("b").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        edges = cut(edges.join(lost, "b", "left_anti").join(lost.select(F.col("b").alias("a")), "a", "left_anti"))
    return gone


def accept_stream(rows: DataFrame, keys: Sequence[str], position: str, vector: str, threshold: float = 0.88) -> DataFrame:
    """Rows in order of arrival, each accepted unless an accepted one of its group is nearer than the threshold.

    ``position`` is a whole number that no two rows share.  Groups may be of any size:
    near pairs are found by blocks, and rows are decided in rounds.  A row without an
    undecided earlier neighbour is accepted, which rejects its later neighbours; what
    they would have rejected is open again.  The result is that of one pass in order.
    Of equal vectors only the first can be accepted, so the others leave at once.
    """
    if threshold >= 1:
        return rows
    zero = F.forall(vector, lambda x: x == 0)
    keyed = rows.withColumn("_own", F.when(F.coalesce(zero, F.lit(True)), F.col(position).cast("string")))
    first = latest(keyed, [*keys, vector, "_own"], F.asc(position)).drop("_own")
    first = cut(first)
    gone = rejected_in_rounds(similar_pairs(first, position, vector, threshold, within=list(keys), inclusive=False))
    return first if gone is None else first.join(gone.select(F.col("b").alias(position)), position, "left_anti")


def sample_by_score(rows: DataFrame, keys: Sequence[str], key: str, score: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement in proportion to exp(score / mean), by Gumbel keys; listed by score."""

    def pick(g: pd.DataFrame) -> list[int]:
        g = g.sort_values([score, key], ascending=[False, True], kind="stable")
        s = np.maximum(g[score].to_numpy(float), 1e-6)
        noise = np.random.default_rng([seed, *g[key].astype(int).abs()[:4]]).gumbel(size=len(g))
        chosen = np.sort(np.argsort(-(s / max(s.mean(), 1e-6) + noise), kind="stable")[:k])
        return g.index[chosen].tolist()

    return _per_group(rows, keys, pick)
