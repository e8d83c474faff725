"""A stored inverted-file index with product quantisation, for approximate cosine search with filters.

Lists and codebooks are fitted on a sample of bounded size; every row lies in the list of
its nearest centre, with a code of a few bytes for what the centre leaves over.  A
search filters rows first, opens for each query as many lists as held-out vectors of
the sample needed, and more until they hold enough rows that pass, compares codes by
table look-up, and reranks the ``ef`` best by their exact cosine.  Lists are dealt over
blocks of bounded size, so a task meets a bounded number of rows and queries.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.vectors import dot, unit
from tidewell.operators.dedup import cut

#: Vectors of the sample at most.
SAMPLE = 20_000
#: Vectors of the sample for each list at least, and lists at most.
PER_LIST, LISTS = 40, 256
#: Dimensions that one byte of a code stands for.
STEP = 4
#: Rows and queries of one comparison.
BLOCK, QUERIES = 8192, 512
#: Share of their nearest neighbours that held-out vectors of the sample must meet in the lists that are opened.
TARGET = 0.97


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from k of the rows; an empty centre is moved to the row that lies farthest from its own."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        apart = (centres * centres).sum(axis=1) - 2 * x @ centres.T
        near = apart.argmin(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        far = np.argsort(-(apart[np.arange(len(x)), near] + (x * x).sum(axis=1)), kind="stable")
        empty = np.flatnonzero(size == 0)
        centres = total / np.maximum(size, 1)[:, None]
        centres[empty] = x[far[: len(empty)]]
    return centres


@dataclass(frozen=True)
class Quantizer:
    """Centres of the lists, codebooks of the parts of what they leave over, and how many lists a query opens."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    def residues(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        parts, width = len(self.books), self.books.shape[2]
        return np.pad(rest, ((0, 0), (0, parts * width - rest.shape[1]))).reshape(len(x), parts, width)

    def nearest_lists(self, x: np.ndarray) -> np.ndarray:
        return np.argsort((self.centres * self.centres).sum(axis=1) - 2 * x @ self.centres.T, axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each vector."""
        lists = ((self.centres * self.centres).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)
        rest = self.residues(x, lists)
        code = np.stack([((b * b).sum(axis=1) - 2 * rest[:, m] @ b.T).argmin(axis=1) for m, b in enumerate(self.books)], axis=1)
        return lists, code.astype(np.uint8)

    def apart(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query from the coded rows of a list, by one table look-up a byte."""
        rest = self.residues(query[None], np.array([at]))[0]
        table = ((self.books - rest[:, None, :]) ** 2).sum(axis=2)
        return table[np.arange(len(self.books)), codes].sum(axis=1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books, probes=self.probes)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Quantizer:
        got = np.load(io.BytesIO(raw))
        return Quantizer(got["centres"], got["books"], int(got["probes"]))


def fit(sample: np.ndarray, seed: int = 5, k: int = 10, target: float = TARGET) -> Quantizer:
    """A quantizer from unit vectors; a tenth of them, set aside, say how many lists hold their nearest neighbours."""
    rng, (n, d) = np.random.default_rng(seed), sample.shape
    held = rng.choice(n, max(1, n // 10), replace=False)
    kept = np.delete(np.arange(n), held) if n > 1 else np.arange(n)
    centres = kmeans(sample[kept], max(1, min(LISTS, len(kept) // PER_LIST)), rng)
    draft = Quantizer(centres, np.zeros((-(-d // STEP), 1, STEP)), 1)
    lists = draft.encode(sample)[0]
    rest = draft.residues(sample[kept], lists[kept])
    size = min(256, len(kept))
    books = np.stack([kmeans(rest[:, m], size, rng, 8) for m in range(rest.shape[1])])
    probes = len(centres)
    if n > k + 1:
        some = held[:1000]
        score = sample[some] @ sample.T
        score[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-score, k, axis=1)[:, :k]
        place = np.argsort(draft.nearest_lists(sample[some]), axis=1, kind="stable")
        needed = np.take_along_axis(place, lists[near], axis=1)
        probes = int(np.argmax(np.cumsum(np.bincount(needed.reshape(-1), minlength=len(centres))) >= target * needed.size)) + 1
    return Quantizer(centres, books, probes)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class VectorIndex:
    """Build, extend and search an index by path; ``id`` is a long, other columns are kept for filters."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, key: str, vector: str, sample: int = SAMPLE, seed: int = 5) -> Quantizer:
        """Fit on at most ``sample`` rows chosen by hash, then index every row with a vector that isn't zero."""
        sound = self._sound(rows, key, vector)
        total = sound.count()
        chosen = sound.select("_v").where(F.pmod(F.xxhash64("_v"), F.lit(max(1, total // sample))) == 0).orderBy(F.xxhash64("_v")).limit(sample)
        made = fit(np.array([r._v for r in chosen.collect()], float), seed)
        self.spark.createDataFrame([(bytearray(made.dump()),)], "model binary").coalesce(1).write.parquet(f"{self.path}/model")
        self._write(sound, made)
        return made

    def add(self, rows: DataFrame, key: str, vector: str) -> None:
        """Index further rows by the lists and books that are there."""
        self._write(self._sound(rows, key, vector), self.model())

    def model(self) -> Quantizer:
        return Quantizer.load(bytes(self.spark.read.parquet(f"{self.path}/model").first().model))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, ef: int = 100, where: Column | None = None, probes: int | None = None, apart: bool = False) -> DataFrame:
        """``query, id, score, rank``: the k best by cosine of each query among the rows that pass.

        Of the opened lists the ``ef`` rows with the nearest codes are reranked.  ``apart``
        leaves out the row of the query's own key.
        """
        model = self.model()
        passing = self.rows() if where is None else self.rows().where(where)
        count = dict(passing.groupBy("_list").count().collect())  # at most LISTS rows
        sizes = np.array([count.get(i, 0) for i in range(len(model.centres))])
        want, opened, blocks = ef + apart, probes or model.probes, np.maximum(1, -(-sizes // BLOCK))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    order = model.nearest_lists(_matrix(batch.column("_v")))
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    q, at = np.nonzero(((np.arange(order.shape[1]) < opened) | (before < want)) & (sizes[order] > 0))
                    yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(q)), batch.column("_v").take(pa.array(q)), pa.array(order[q, at], pa.int32())], ["query", "_v", "_list"])

        asked = cut(queries.select(F.col(key).cast("long").alias("query"), unit(vector).alias("_v")).where(F.exists("_v", lambda x: x != 0)))
        routed = asked.mapInArrow(route, "query long, _v array<double>, _list int")
        turns = {i: -(-n // QUERIES) for i, n in routed.groupBy("_list").count().collect()}
        layout = F.broadcast(self.spark.createDataFrame([(i, int(blocks[i]), n) for i, n in turns.items()], "_list int, blocks int, turns int"))  # at most LISTS rows
        dealt = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.col("blocks" if c == "id" else "turns")).cast("int")
        empty = F.lit(None)
        coded = passing.select("id", "_code", "_list").join(layout, "_list").select("_list", dealt("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("t"), "id", "_code", empty.cast("array<double>").alias("_v"))
        turned = routed.join(layout, "_list").select("_list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), dealt("query").alias("t"), F.col("query").alias("id"), empty.cast("binary").alias("_code"), "_v")

        def compare(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            is_row = group.column("_v").is_null().to_numpy()
            ids = group.column("id").to_numpy()
            rows, asks = ids[is_row], ids[~is_row]
            out_q, out_i, out_d = [], [], []
            if len(rows) and len(asks):
                at = group.column("_list")[0].as_py()
                codes = np.frombuffer(b"".join(group.column("_code").filter(pa.array(is_row)).to_pylist()), np.uint8).reshape(len(rows), -1)
                vectors = _matrix(group.column("_v").filter(pa.array(~is_row)).combine_chunks())
                for q, v in zip(asks, vectors):
                    far = model.apart(v, at, codes)
                    best = np.lexsort((rows, far))[:want]
                    out_q.append(np.full(len(best), q))
                    out_i.append(rows[best])
                    out_d.append(far[best])
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            return pa.table({"query": join(out_q, pa.int64()), "id": join(out_i, pa.int64()), "far": join(out_d, pa.float64())})

        met = coded.unionByName(turned).groupBy("_list", "b", "t").applyInArrow(compare, "query long, id long, far double")
        first = F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))
        short = met.withColumn("_rn", first).where(F.col("_rn") <= want).select("query", "id")
        exact = short.join(passing.select("id", F.col("_v").alias("_row")), "id").join(asked, "query")
        scored = exact.where(F.col("query") != F.col("id")) if apart else exact
        scored = scored.select("query", "id", dot("_row", "_v").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def _sound(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        others = [c for c in rows.columns if c not in (key, vector)]
        scaled = rows.select(F.col(key).cast("long").alias("id"), unit(vector).alias("_v"), *others)
        return scaled.where(F.col("id").isNotNull() & F.col("_v").isNotNull() & F.exists("_v", lambda x: x != 0))

    def _write(self, sound: DataFrame, model: Quantizer) -> None:
        kept = sound.schema.names

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    lists, codes = model.encode(_matrix(batch.column("_v")))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*kept, "_list", "_code"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sound.schema.fields)
        sound.mapInArrow(encode, f"{schema}, _list int, _code binary").write.mode("append").partitionBy("_list").parquet(f"{self.path}/rows")
