"""Approximate nearest neighbours by learned partitions.

On a sample of at most ``SAMPLE`` distinct vectors the exact neighbour graph is made
(in tasks, block by block) and cut into parts of nearly equal size with few edges
between them.  A small network learns which parts hold a vector's neighbours.  It then
places every row of the table in its most probable part, and routes each query to as
many parts as held-out vectors of the sample needed to find ``TARGET`` of their own
neighbours.  The rows of those parts are reranked by exact distance.

What is fitted is bounded by the sample; every row is indexed and every query answered.
A part is dealt over blocks of at most about ``BLOCK`` rows and its queries over blocks
of ``QUERIES``, so a task compares two bounded blocks however large the part, even if
one vector fills a third of the table.

Defined results: vectors that are null, empty, all zero, or hold a null, NaN or
infinite component take no part, nor do rows without id or of another length than most
vectors have (of equally common lengths the smaller); a row that repeats an id or a
vector is a row of its own, and a query leaves out only itself; ties go to the smaller
id; a query looks into further parts until it has met ``k`` others, so it gets ``k``
rows, or all candidates if there are fewer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import forget, release_memory, scratch_path

#: Most vectors of the sample that the graph and the network are made from.
SAMPLE = 16_384
#: Parts at most, and vectors of the sample for each part at least.
PARTS, PER_PART = 64, 128
#: Share of their neighbours in the sample that held-out vectors must find.
TARGET = 0.97
#: Rows and queries of a comparison.
BLOCK, QUERIES = 4096, 1024


@dataclass(frozen=True)
class Router:
    """The network, and how many parts a query is sent to."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    probes: int

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        x = np.clip(np.nan_to_num((vectors - self.mean) / self.scale), -100, 100)
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def usable(rows: DataFrame) -> DataFrame:
    """Rows of ``id, vector`` that take part, vectors as doubles."""
    v = F.col("vector").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.select("*", v.alias("_v")).where(F.col("id").isNotNull() & F.col("_v").isNotNull() & ~odd & F.exists("_v", lambda x: x != 0))
    sound = sound.drop("vector").withColumnRenamed("_v", "vector")
    common = sound.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return sound.where(F.size("vector") == (common.n if common else 0))


def take_sample(rows: DataFrame, total: int, size: int) -> np.ndarray:
    """Distinct vectors chosen by their hash, at most ``size``; copies are merged in the tasks."""
    hashed = F.xxhash64("vector")
    near = rows.where(F.pmod(F.shiftrightunsigned(hashed, 8), F.lit(max(1, total // size))) == 0)
    chosen = near.groupBy(hashed.alias("h")).agg(F.min("vector").alias("vector")).orderBy("h").limit(size)
    return np.array([r.vector for r in chosen.collect()], float)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long lists without nulls as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def neighbour_graph(spark: SparkSession, sample: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector of the sample, found in tasks; the sample has a fixed bound."""
    shared, n, step = spark.sparkContext.broadcast(sample), len(sample), 512
    square = (sample * sample).sum(axis=1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        all_ = shared.value
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = all_[start : start + step]
                apart = square[None, :] - 2 * part @ all_.T
                apart[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
                near = np.argpartition(apart, k - 1, axis=1)[:, :k].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"start": [start], "near": [near.tobytes()]}, pa.schema([("start", pa.int64()), ("near", pa.binary())]))
        release_memory()

    blocks = spark.range(0, n, step, numPartitions=max(1, min(64, n // step)))
    found = sorted(blocks.mapInArrow(find, "start long, near binary").collect())
    return np.concatenate([np.frombuffer(bytes(r.near), np.int32).reshape(-1, k) for r in found])


def fill(score: np.ndarray, room: int) -> np.ndarray:
    """Give each row the column of its highest score that has room; of those who ask for one, the best are taken first."""
    score, out = score.copy(), np.full(len(score), -1)
    free = np.full(score.shape[1], room)
    while (open_ := np.flatnonzero(out < 0)).size:
        wish = score[open_].argmax(axis=1)
        for p in np.unique(wish):
            asking = open_[wish == p]
            taken = asking[np.argsort(-score[asking, p], kind="stable")[: free[p]]]
            out[taken] = p
            free[p] -= len(taken)
            if not free[p]:
                score[:, p] = -np.inf
    return out


def balanced_parts(sample: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A part for each node: all of nearly one size, few edges between them.

    Parts grow around seeds as far as there is room; then nodes move to the part of
    most of their neighbours while it has room, those that gain most first.
    """
    n, k = near.shape
    room = -(-n * 21 // (20 * parts))
    seeds = sample[rng.choice(n, parts, replace=False)]
    part = fill(2 * sample @ seeds.T - (seeds * seeds).sum(axis=1), room)
    x, y = np.repeat(np.arange(n), k), near.reshape(-1)
    ends = np.concatenate([x * parts, y * parts])
    for _ in range(rounds):
        held = np.bincount(ends + np.concatenate([part[y], part[x]]), minlength=n * parts).reshape(n, parts)
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - held[np.arange(n), part]
        moving = np.flatnonzero((gain > 0) & (rng.random(n) < 0.5))
        moving = moving[np.argsort(-gain[moving], kind="stable")]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in moving:
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved * 1000 < n:
            break
    return part


def train(sample: np.ndarray, wanted: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 20, batch: int = 512) -> tuple[np.ndarray, np.ndarray, tuple]:
    """A network of one hidden layer that gives the shares of a vector's neighbours in the parts; Adam on the cross-entropy."""
    mean, scale = sample.mean(axis=0), sample.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    x, wanted, (n, d), parts = ((sample - mean) / scale).astype(np.float32), wanted.astype(np.float32), sample.shape, wanted.shape[1]
    w = [rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(n), max(1, n // batch)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - wanted[at]) / np.float32(len(at))
            dh = (dz @ w[2].T) * (h > 0)
            slopes = [x[at].T @ dh + np.float32(1e-4) * w[0], dh.sum(axis=0), h.T @ dz + np.float32(1e-4) * w[2], dz.sum(axis=0)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = np.float32(0.9) * first[i] + np.float32(0.1) * g
                second[i] = np.float32(0.999) * second[i] + np.float32(0.001) * g * g
                w[i] = w[i] - np.float32(rate) * (first[i] / np.float32(1 - 0.9**step)) / (np.sqrt(second[i] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return mean, scale, tuple(a.astype(float) for a in w)


def fit(spark: SparkSession, sample: np.ndarray, k: int, seed: int = 7, parts: int = PARTS, per_part: int = PER_PART, target: float = TARGET) -> Router:
    """The router that a sample gives; with too few vectors for two parts, all lie in one."""
    rng, (n, d) = np.random.default_rng(seed), sample.shape
    parts, k = min(parts, n // per_part), min(k, n - 1)
    if parts < 2 or k < 1:
        return Router(np.zeros(d), np.ones(d), (np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    near = neighbour_graph(spark, sample, k)
    part = balanced_parts(sample, near, parts, rng)
    wanted = np.bincount(np.repeat(np.arange(n), k) * parts + part[near].reshape(-1), minlength=n * parts).reshape(n, parts).astype(float)
    wanted[np.arange(n), part] += 1
    wanted /= wanted.sum(axis=1, keepdims=True)
    held = np.zeros(n, bool)
    held[rng.choice(n, max(1, n // 10), replace=False)] = True
    router = Router(*train(sample[~held], wanted[~held], rng), 1)
    logits = router.logits(sample)
    place = np.argsort(np.argsort(-logits[held], axis=1, kind="stable"), axis=1, kind="stable")  # rank of each part for each held-out vector
    needed = np.take_along_axis(place, logits.argmax(axis=1)[near[held]], axis=1)
    found = np.cumsum(np.bincount(needed.reshape(-1), minlength=parts)) / needed.size
    return Router(router.mean, router.scale, router.weights, int(np.argmax(found >= target)) + 1)


def nearest_exact(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest others among the rows: ``(query, row, distance)``, distances from the differences themselves.

    A matrix product chooses the candidates, with all that rounding might have put
    beyond the k-th, and one more for the query itself.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        squares, own = (vectors * vectors).sum(axis=1), (queries * queries).sum(axis=1)
        apart = own[:, None] - 2 * queries @ vectors.T + squares[None, :]
        k1 = min(k + 1, len(vectors))
        edge = np.partition(apart, k1 - 1, axis=1)[:, k1 - 1] + 1e-9 * (own + squares.max())
        out: list[tuple[int, int, float]] = []
        for q in range(len(queries)):
            at = np.flatnonzero(~(apart[q] > edge[q]) & (rows != query_rows[q]))
            distance = np.sqrt(((vectors[at] - queries[q]) ** 2).sum(axis=1))
            best = np.lexsort((rows[at], ids[at], distance))[:k]
            out += zip([q] * len(best), at[best].tolist(), distance[best].tolist())
    q, at, distance = zip(*out) if out else ((), (), ())
    return np.array(q, int), np.array(at, int), np.array(distance, float)


def index_rows(rows: DataFrame, router: Router) -> DataFrame:
    """Every row with the part that the network gives it."""
    schema = pa.schema([("_row", pa.int64()), ("id", pa.int64()), ("asks", pa.bool_()), ("vector", pa.list_(pa.float64())), ("part", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            part = router.logits(matrix(batch.column("vector"))).argmax(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("_row", "id", "asks", "vector")] + [pa.array(part, pa.int32())], schema=schema)

    return rows.mapInArrow(place, "_row long, id long, asks boolean, vector array<double>, part int")


def route(queries: DataFrame, router: Router, sizes: np.ndarray, k: int) -> DataFrame:
    """Each query once for every part it is sent to: the most probable ones, and more until they hold ``k`` others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.logits(matrix(batch.column("vector"))), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]  # rows met before a part is opened
            q, at = np.nonzero((np.arange(router.parts) < router.probes) | (before <= k))
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(q)), batch.column("id").take(pa.array(q)), batch.column("vector").take(pa.array(q)), pa.array(order[q, at], pa.int32())], names=["_row", "id", "vector", "part"])

    return queries.mapInArrow(send, "_row long, id long, vector array<double>, part int")


def search(rows: DataFrame, asks: Column, k: int = 10, sample: int = SAMPLE, seed: int = 7, target: float = TARGET, parts: int = PARTS, per_part: int = PER_PART) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest found for each row of ``id, vector`` that ``asks`` chooses."""
    spark = rows.sparkSession
    sound = usable(rows.select(F.col("id").cast("long").alias("id"), "vector", F.coalesce(asks, F.lit(False)).alias("asks")))
    total = sound.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    router = fit(spark, take_sample(sound, total, sample), k, seed, parts, per_part, target)
    path = scratch_path(spark, "partitions")
    index_rows(sound.withColumn("_row", F.monotonically_increasing_id()), router).write.parquet(path)  # the index
    index = spark.read.parquet(path)
    counted = index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most PARTS rows
    sizes = np.zeros(router.parts, np.int64)
    for r in counted:
        sizes[r.part] = r.n
    routed = route(index.where("asks"), router, sizes, k)
    dealt = F.xxhash64("_row")
    asked = dict(routed.groupBy("part").count().collect())  # at most PARTS rows
    layout = spark.createDataFrame([(r.part, -(-r.n // BLOCK), -(-asked[r.part] // QUERIES)) for r in counted if r.part in asked], "part int, blocks int, turns int")
    left = index.join(F.broadcast(layout), "part").withColumn("block", F.pmod(dealt, F.col("blocks")).cast("int"))
    left = left.select("part", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "_row", "id", "vector", F.lit(False).alias("query"))
    right = routed.join(F.broadcast(layout), "part").withColumn("turn", F.pmod(dealt, F.col("turns")).cast("int"))
    right = right.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "turn", "_row", "id", "vector", F.lit(True).alias("query"))

    def compare(group: pa.Table) -> pa.Table:
        is_query, ids, keys = group.column("query").to_numpy(), group.column("id").to_numpy(), group.column("_row").to_numpy()
        vectors = matrix(group.column("vector"))
        if is_query.all() or not is_query.any():
            q, at, distance = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            q, at, distance = nearest_exact(ids[~is_query], keys[~is_query], vectors[~is_query], keys[is_query], vectors[is_query], k)
        return pa.table({"_query": keys[is_query][q], "query_id": ids[is_query][q], "_row": keys[~is_query][at], "id": ids[~is_query][at], "distance": distance})

    met = left.unionByName(right).groupBy("part", "block", "turn").applyInArrow(compare, "_query long, query_id long, _row long, id long, distance double")
    best = Window.partitionBy("_query").orderBy("distance", "id", "_row")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
