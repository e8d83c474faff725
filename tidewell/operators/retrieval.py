"""Vector and lexical search."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.vectors import as_double, cosine
from tidewell.operators import blocks
from tidewell.operators.blocks import cut
from tidewell.streaming.run import scratch

#: Bytes of query vectors that one cell holds; more go block by block.
BROADCAST_BYTES = 8 << 20
#: Most words of queries that are broadcast.
BROADCAST_WORDS = 200_000


def fallback_score(a: Column | str, b: Column | str) -> Column:
    """Cosine moved to 0..1, for want of a cross-encoder."""
    return (cosine(a, b) + 1) / 2


#: Codes of pairs that have no number as score, beside scores times ten to the digits: null, not a number.
NULL, NAN = -(1 << 39), 1 << 39
#: Most pairs that a task scores at once, and rows of a cell.
TILE, CELL = 1 << 20, 1 << 15
#: Cells of small tables, so that all cores have work.
CELLS = 48
#: Pairs whose vectors a task holds side by side.
BESIDE = 1 << 14


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and their matrix scaled to length 1 as ``unit`` does it; null ones are in none."""
    size, found = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False), {}
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        flat = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64())
        m = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(len(at), n)
        with np.errstate(all="ignore"):
            length = np.sqrt(np.add.accumulate(m * m, axis=1)[:, -1:]) if n else np.zeros((len(at), 1))
            holes = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1, keepdims=True)
            found[int(n)] = at, np.where((length <= 0) | holes, 0.0, m / length)
    return found


def _places(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of places in a matrix."""
    row = at // width
    return row, at - row * width


def _round(sums: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray | None, digits: int) -> np.ndarray:
    """Sums rounded half up, times ten to the digits; near a half the sum in order decides, as ``dot`` makes it.

    ``at`` are the pairs' places in the product of ``a`` and ``b``, by default all.
    """
    with np.errstate(all="ignore"):
        part = sums * 10**digits
        part += 0.5
        whole = np.floor(part)
        part -= whole
        part -= 0.5
        near = np.flatnonzero(np.abs(part) > 0.5 - 1e-7)
        whole[np.isnan(part)] = NAN
        code = whole.astype(np.int64)
    for lo in range(0, len(near), BESIDE):
        some = near[lo : lo + BESIDE]
        x, y = _places(some if at is None else at[some], len(b))
        exact, back = np.unique(np.add.accumulate(a[x] * b[y], axis=1)[:, -1], return_inverse=True)
        exact = [int(Decimal(repr(float(v))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP)) for v in exact]
        code[some] = np.array(exact, np.int64)[back]
    return code


def _rounded(a: np.ndarray, b: np.ndarray, digits: int) -> np.ndarray:
    """Products of all rows, rounded."""
    return _round((a @ b.T).ravel(), a, b, None, digits).reshape(len(a), len(b))


def _rounded_at(a: np.ndarray, b: np.ndarray, at: np.ndarray, digits: int) -> np.ndarray:
    """Products of the rows at some places, rounded."""
    sums = np.empty(len(at))
    for lo in range(0, len(at), BESIDE):
        x, y = _places(at[lo : lo + BESIDE], len(b))
        sums[lo : lo + BESIDE] = np.einsum("ij,ij->i", a[x], b[y])
    return _round(sums, a, b, at, digits)


def _short(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Products in single precision, and how far they may be from those in double precision; the vectors are of length 1 or 0."""
    return a @ b.T, (a.shape[1] + 8) * 2.0**-23


def _may_be_best(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, keep: int, digits: int, loose: float = 0.0) -> np.ndarray:
    """Places of pairs that hold each row of ``x``'s ``keep`` best rows of ``y`` within each stretch, and what is below them by ``loose`` at most, whatever rounding makes of them.

    The stretch is cut into more groups than are kept.  So many groups' best are so many
    rows, and what is below the least of them by more than both errors isn't among the best.
    """
    near, error = _short(x, y)
    near[np.isnan(near)] = np.inf  # no number comes first
    slack, may = np.float32(2 * error + 1.01 * 10.0**-digits + 1.01 * loose), np.empty(near.shape, bool)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = near[:, lo:hi]
        wide = min(hi - lo, max(8 * keep, 64))
        if wide <= keep:
            may[:, lo:hi] = True
            continue
        deep = (hi - lo) // wide
        top = part[:, : deep * wide].reshape(len(x), deep, wide).max(axis=1)
        rest = hi - lo - deep * wide
        np.maximum(top[:, :rest], part[:, deep * wide :], out=top[:, :rest])
        least = np.partition(top, wide - keep, axis=1)[:, wide - keep]
        np.greater_equal(part, (least - slack)[:, None], out=may[:, lo:hi])
    return np.flatnonzero(may)


def _first(group: np.ndarray, keep: int) -> np.ndarray:
    """Whether a place is one of the first ``keep`` of its group; groups lie together."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    start = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group)))) < keep


def _few_copies(y: np.ndarray, stretch: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows but for those that have ``most`` equal ones before them in their stretch."""
    kind = np.unique(y.view(f"V{y.itemsize * y.shape[1]}").ravel(), return_inverse=True)[1] if y.shape[1] else np.zeros(len(y), np.int64)
    order = np.lexsort((kind, stretch))
    return np.sort(order[_first(stretch[order] * (kind.max(initial=0) + 1) + kind[order], most)])


def score_pairs(
    queries: DataFrame, rows: DataFrame, query_key: str, key: str, vector: str = "embedding", carry: Sequence[Column] = (), digits: int = 6,
    keep: int | None = None, within: Sequence[str] = (), apart: bool = False, floor: float | None = None, score: bool = True, levels: tuple[Sequence[float], Sequence[str]] | None = None, loose: float = 0.0,
) -> DataFrame:
    """Cosine of every query with every row, rounded: ``score`` and ``query`` beside the rows' columns.

    Blocks of rows meet blocks of
    queries in cells, whose number grows with the tables and not their size; a task
    scales one cell's vectors to length 1 and multiplies their matrices.  ``carry`` are columns of the query that its pairs
    have too.  With ``keep`` a cell gives only each query's best so many of its rows
    (of each value of ``within``), of equal scores the smaller keys, so all of a query's
    best are among what is left; products in single precision tell which pairs may be among
    them, and only these are scored.  ``loose`` gives as well what is below a query's k-th best of a cell by no more,
    of each score the k smallest keys: enough for an order by a function of the score that makes scores equal only so near.  ``apart`` leaves out a row's match with itself,
    ``floor`` the pairs with a lower score, but not those without one.  Without ``score``
    there is no such column, and with a floor only pairs near it are scored.  ``levels`` are
    bounds, ascending, and columns of the rows, of which a pair has one as ``value`` in
    place of its score: that whose number is how many bounds its rounded score reaches; two
    more are for pairs without score and for scores that are no number.
    """
    bounds_, picked = levels or ((), ())
    score = score and not levels
    plain = all(isinstance(t := d.schema[vector].dataType, T.ArrayType) and isinstance(t.elementType, T.FloatType) for d in (queries, rows))
    numbers_ = F.col(vector) if plain else as_double(vector)
    q = queries.select(F.col(query_key).alias("query"), numbers_.alias("_v"), *carry)
    size = q.agg(F.sum(F.size("_v") * 8 + 64)).first()[0] or 0
    n = rows.count()
    across = max(1, math.ceil(size / BROADCAST_BYTES))
    down = max(1, math.ceil(n / CELL), min(math.ceil(n / 1024), math.ceil(CELLS / across)))
    r = rows.withColumn("_v", numbers_).drop(vector)
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = q.withColumn("_asked", F.lit(True)).withColumn("_q", F.pmod(F.xxhash64("query"), F.lit(across)).cast("int")).withColumn("_r", numbers(down))
    right = r.withColumn("_asked", F.lit(False)).withColumn("_r", F.pmod(F.xxhash64(key), F.lit(down)).cast("int")).withColumn("_q", numbers(across))
    own, asked = [c for c in r.columns if c != "_v" and c not in picked], [c for c in q.columns if c != "_v"]
    fields = [*[r.schema[c] for c in own], *[q.schema[c] for c in asked], *([T.StructField("score", T.DoubleType())] if score else [])]
    fields += [T.StructField("value", r.schema[picked[0]].dataType)] if levels else []
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    least = None if floor is None else round(floor * 10**digits)
    lower = math.ceil(loose * 10**digits)

    steps = np.array([round(v * 10**digits) for v in bounds_], np.int64)

    def level(code: np.ndarray) -> np.ndarray:
        """The number of the column that a pair has by its code."""
        found = np.searchsorted(steps, code, "right")
        found[code == NULL], found[code == NAN] = len(steps) + 1, len(steps) + 2
        return found

    def passing(x: np.ndarray, y: np.ndarray, x_short: np.ndarray, y_short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that reach the floor, and their codes, or with ``levels`` their columns' numbers."""
        every = lambda: (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
        if levels:
            sums, error = _short(x_short, y_short)
            code, near = np.zeros(sums.shape, np.int8), np.isnan(sums)
            for edge in (steps - 0.5) / 10.0**digits:
                code += sums >= np.float32(edge)
                near |= np.abs(sums - np.float32(edge)) <= np.float32(error)
            code, at = code.ravel(), np.flatnonzero(near)
            code[at] = level(_rounded_at(x, y, at, digits))
            return *every(), code
        if least is None:
            return *every(), _round((x @ y.T).ravel(), x, y, None, digits)
        edge = (least - 0.5) / 10.0**digits
        sums, error = (x @ y.T, 1e-9) if score else _short(x_short, y_short)
        low, high = sums.dtype.type(edge - error), sums.dtype.type(edge + error)
        at = np.flatnonzero(~(sums < low))
        sums = sums.ravel()[at]
        if score:
            code = _round(sums, x, y, at, digits)
        else:
            code, near = np.full(len(at), least), np.flatnonzero(~(sums > high))
            code[near] = _rounded_at(x, y, at[near], digits)
        real = code >= least
        if not real.all():
            at, code = at[real], code[real]
        return *_places(at, len(y)), code

    def best(x: np.ndarray, y: np.ndarray, x_short: np.ndarray, y_short: np.ndarray, bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that hold the best ``most`` of each stretch, and their codes."""
        odd = np.isnan(x_short).any(axis=1)
        at = _may_be_best(x_short, y_short, bounds, most, digits, loose) if not odd.any() else None
        if at is None or len(at) > len(x) * (len(y) // 8 + most * (len(bounds) - 1)):  # too many near ones to be taken one by one
            at, code = np.arange(len(x) * len(y)), _round((x @ y.T).ravel(), x, y, None, digits)
        else:
            code = _rounded_at(x, y, at, digits)
        return *_places(at, len(y)), code

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        queries_, rows_ = both.filter(both["_asked"]), both.filter(pc.invert(both["_asked"]))
        if apart:
            queries_, rows_ = queries_.filter(pc.is_valid(queries_["query"])), rows_.filter(pc.is_valid(rows_[key]))
        if not len(queries_) or not len(rows_):
            return
        rows_ = rows_.take(pc.sort_indices(rows_, sort_keys=[(c, "ascending") for c in [*within, key]], null_placement="at_start"))
        a, b = _by_length(queries_["_v"].combine_chunks()), _by_length(rows_["_v"].combine_chunks())
        names = pa.chunked_array([*queries_["query"].cast(rows_[key].type).chunks, *rows_[key].chunks]).combine_chunks().dictionary_encode().indices
        names = pc.fill_null(names, -1).to_numpy(zero_copy_only=False)
        asking, named = names[: len(queries_)], names[len(queries_) :]
        most = keep and keep + (np.bincount(named).max() if apart else 0)  # so many are left without a query's own
        stretch = np.zeros(len(rows_), np.int64)
        for c in within:
            m = pc.fill_null(rows_[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            stretch[1:] += m[1:] != m[:-1]
        stretch = np.cumsum(stretch > 0)
        values = pa.chunked_array([c for name in picked for c in rows_[name].chunks]).combine_chunks() if levels else None
        queries_, rows_ = queries_.select(asked), rows_.select(own)

        def found(i: np.ndarray, j: np.ndarray, code: np.ndarray) -> list[pa.RecordBatch]:
            if apart:
                other = asking[i] != named[j]
                i, j, code = i[other], j[other], code[other]
            if keep is not None:
                group = i * (stretch[-1] + 1) + stretch[j]
                order = np.lexsort((j, -code, group))
                first = _first(group[order], keep)
                if lower:
                    g, c = group[order], code[order]
                    new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    each = np.diff(np.append(new, len(g)))
                    least = c[new + np.minimum(each, keep) - 1]  # the k-th best code of each group, or the last
                    same = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
                    first |= (c >= np.repeat(least, each) - lower) & _first(same, keep) if len(g) else first
                order = order[first]
                i, j, code = i[order], j[order], code[order]
            columns = [*rows_.take(pa.array(j)).columns, *queries_.take(pa.array(i)).columns]
            if score:
                value = code / 10.0**digits
                value[code == NAN] = np.nan
                columns.append(pa.array(value, mask=code == NULL))
            elif levels:
                columns.append(values.take(pa.array(code * len(rows_) + j)))
            return pa.table(columns, names=schema.names).to_batches()

        for length in [*a, None]:
            i = a[length][0] if length is not None else np.setdiff1d(np.arange(len(queries_)), np.concatenate([i for i, _ in a.values()] or [[]]))
            j, y = b.get(length, (np.arange(0), None))
            # rows that can have no score with these queries; of a stretch that has enough others none is among the best
            without = np.setdiff1d(np.arange(len(rows_)), j)
            if keep is not None:
                without = without[np.bincount(stretch[j], minlength=stretch[-1] + 1)[stretch[without]] < most]
                without = without[_first(stretch[without], most)]
                if len(j):
                    few = _few_copies(y, stretch[j], most)
                    j, y = j[few], y[few]
            step = max(1, TILE // (len(j) + len(without) or 1))
            x, bounds = a[length][1] if len(j) else None, np.append(np.flatnonzero(np.diff(stretch[j], prepend=-1)), len(j))
            x_short, y_short = (x.astype(np.float32), y.astype(np.float32)) if len(j) else (None, None)
            for lo in range(0, len(i), step):
                some = i[lo : lo + step]
                places, theirs = [np.repeat(some, len(without))], [np.tile(without, len(some))]
                codes = [np.full(len(places[0]), len(steps) + 1 if levels else NULL)]
                if len(j):
                    block = x[lo : lo + step], y, x_short[lo : lo + step], y_short
                    at, to, code = passing(*block) if keep is None else best(*block, bounds, most)
                    at, to = some[at], j[to]
                    if keep is not None and least is not None:
                        at, to, code = at[code >= least], to[code >= least], code[code >= least]
                    places, theirs, codes = [*places, at], [*theirs, to], [*codes, code]
                yield from found(np.concatenate(places), np.concatenate(theirs), np.concatenate(codes))

    # the cell's function names its argument's type, by which Spark hands it batches
    return left.unionByName(right, allowMissingColumns=True).groupBy("_q", "_r").applyInArrow(meet, schema)


#: Queries and rows of a cell of word counts, words of the rows at most, and queries counted at once.
ASKED, COUNTED, COUNTED_WORDS, ABREAST = 8192, 1 << 17, 1 << 23, 128
#: Rows with most words, which tell how many a query's best rows share at least.
HEAD = 1 << 14
#: Most of the best rows that are broadcast to the rows' table.
BROADCAST_BEST = 200_000


def _codes(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each list the list's number and the word's place in ``known``; unknown words are left out."""
    place = pc.index_in(pc.list_flatten(words), value_set=known)
    real = pc.is_valid(place).to_numpy(zero_copy_only=False)
    return pc.list_parent_indices(words).to_numpy()[real], pc.drop_null(place).to_numpy()


def _most_shared(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """``query, _at, shared``: of each query's rows that reach its bar the k best, ties to the smaller ``_at``.

    Queries go by falling bar, rows by falling number of words, so that a few queries at
    once are counted on those rows only that have as many words as the least bar among them.
    """
    asked = asked.sort_by([("bar", "descending")])
    rows = rows.sort_by("_at")
    mine, theirs = asked["_w"].combine_chunks(), rows["_w"].combine_chunks()
    known = pc.unique(pc.list_flatten(mine))
    (q, word), (r, said) = _codes(mine, known), _codes(theirs, known)
    bars = asked["bar"].to_numpy()
    per = np.bincount(r, minlength=len(rows))
    rank = np.argsort(-per, kind="stable")  # rows with most words first, so the n-th words are those of a head
    falling = per[rank]
    starts = np.concatenate([[0], np.cumsum(per)])
    nth = [said[starts[rank[: np.count_nonzero(per > n)]] + n] for n in range(per.max(initial=0))]
    small = np.uint8 if per.max(initial=0) < 256 else np.uint32
    found = [[np.zeros(0, np.int64)] * 3]
    for at in range(0, len(asked), ABREAST):
        lo, hi = np.searchsorted(q, [at, at + ABREAST])
        bar = np.maximum(bars[at : at + ABREAST], 1)
        deep = int(np.searchsorted(-falling, -bar.min(), "right"))
        if not deep:
            continue
        held = np.zeros((len(known), len(bar)), small)
        held[word[lo:hi], q[lo:hi] - at] = 1
        counts = np.zeros((deep, len(bar)), small)
        for w in nth:
            counts[: len(w)] += held[w[:deep]]
        columns = np.ascontiguousarray(counts.T)
        for n, c in enumerate(columns):
            top = np.flatnonzero(c >= bar[n])
            if len(top) > k:
                least = np.partition(c[top], len(top) - k)[len(top) - k]
                more, ties = top[c[top] > least], rank[top[c[top] == least]]
                place = np.argsort(ties, kind="stable")[: k - len(more)]
                top = np.concatenate([more, top[c[top] == least][place]])
            found.append([np.full(len(top), at + n), rank[top], c[top].astype(np.int64)])
    i, j, shared = (np.concatenate(x) for x in zip(*found))
    return pa.table({"query": asked["query"].combine_chunks().take(pa.array(i)), "_at": rows["_at"].combine_chunks().take(pa.array(j)), "shared": pa.array(shared)})


def _word_blocks(rows: DataFrame) -> DataFrame:
    """``payload, known``: ``_at`` and the words' places in the block's own list of words, of runs of rows as they lie."""
    most, heavy = COUNTED, COUNTED_WORDS

    def pack(table: pa.Table) -> pa.RecordBatch:
        words = table["_w"].combine_chunks()
        coded = pc.list_flatten(words).dictionary_encode()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())]), pa.int32()), coded.indices)
        payload = blocks.to_bytes(pa.table({"_at": table["_at"].combine_chunks(), "_w": lists}))
        return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary()), pa.array([blocks.to_bytes(pa.table({"known": coded.dictionary}))], pa.binary())], ["payload", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, n, size = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                while part.num_rows:
                    some = part.slice(0, most - n)
                    open_.append(some)
                    n, size = n + some.num_rows, size + (pc.sum(pc.list_value_length(some.column("_w"))).as_py() or 0)
                    part = part.slice(some.num_rows)
                    if n >= most or size >= heavy:
                        yield pack(pa.Table.from_batches(open_))
                        open_, n, size = [], 0, 0
        if n:
            yield pack(pa.Table.from_batches(open_))

    return cut(rows.select("_at", "_w").mapInArrow(run, "payload binary, known binary"))


def shared_words(queries: DataFrame, rows: DataFrame, query_key: str, key: str, words: str, k: int, said: Column | None = None) -> DataFrame:
    """``query_key``, the rows' columns and ``shared``, how many words both have: each query's best k rows, ties to the smaller key.

    ``words`` are lists without repeats, for rows those of ``said`` where it is given, so that they needn't move.  Rows are
    written in order of key and numbered.
    Blocks of their words meet blocks of queries where they lie, a cell counts what may be
    among the best and gives each query's best k of its rows; rows without a common word
    are left out.  The rows with most words are counted first: what the k-th best of them
    shares is a bar, and rows of fewer words aren't counted for that query.  Neither pairs
    nor copies of blocks are ever written.
    """
    spark = rows.sparkSession
    path = scratch(spark, "rows")
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumnRenamed(words, "_w") if said is None else ordered.withColumn("_w", said)
    ordered.write.option("compression", "zstd").parquet(path)
    held = spark.read.parquet(path)
    kind = queries.schema[query_key].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in blocks.pairs_in(batches):
            theirs, known = blocks.from_bytes(pair["payload"]), blocks.from_bytes(pair["known"])["known"].combine_chunks()
            lists = theirs["_w"].combine_chunks()
            named = pa.ListArray.from_arrays(lists.offsets, pa.DictionaryArray.from_arrays(lists.values, known).dictionary_decode())
            found = _most_shared(blocks.from_bytes(pair["asked"]), pa.table({"_at": theirs["_at"], "_w": named}), k)
            yield from found.to_batches()

    def best(asked: DataFrame, their: DataFrame) -> DataFrame:
        across = max(1, math.ceil(asked.count() / ASKED))
        numbered = asked.withColumn("_q", F.pmod(F.xxhash64("query"), F.lit(across)).cast("int"))
        mine = blocks.packed(numbered, ["_q"], across).select(F.col("payload").alias("asked"))
        found = blocks.each_pair(_word_blocks(their), mine).mapInArrow(meet, f"query {kind}, _at long, shared long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "_at"))
        return cut(found.withColumn("_rn", place).where(F.col("_rn") <= k))

    asked = queries.select(F.col(query_key).alias("query"), F.col(words).alias("_w"))
    sizes = sorted(((r["_n"], r["count"]) for r in held.groupBy(F.size("_w").alias("_n")).count().collect()), reverse=True)  # a row for each number of words
    long_, n = None, 0
    for size, count in sizes:
        n += count
        if n > HEAD:
            break
        long_ = size
    if long_ is not None and sum(c for _, c in sizes) > HEAD:
        head = held.where(F.size("_w") >= long_).repartition(4)  # some thousand rows
        bars = best(asked.withColumn("bar", F.lit(0).cast("long")), head).where(F.col("_rn") == k).select("query", F.col("shared").alias("bar"))
        asked = asked.join(bars, "query", "left").select("query", "_w", F.coalesce("bar", F.lit(0).cast("long")).alias("bar"))
    else:
        asked = asked.withColumn("bar", F.lit(0).cast("long"))
    top = best(asked, held).select(F.col("query").alias(query_key), "_at", "shared")
    top = F.broadcast(top) if top.count() <= BROADCAST_BEST else top
    return held.drop("_w").join(top, "_at").select(query_key, *[c for c in rows.columns if c != words], "shared")


def nearest(queries: DataFrame, rows: DataFrame, query_key: str, key: str, k: int, vector: str = "embedding", digits: int = 6, apart: bool = False) -> DataFrame:
    """The k nearest rows of each query; equal scores go by key; ``apart`` leaves out a row's match with itself.

    A cell gives k rows a query, and the filter on the rank lets Spark keep each task's
    own k best before the exchange (``WindowGroupLimit``), so the shuffle never holds all
    pairs.
    """
    scored = score_pairs(queries, rows.select(key, vector), query_key, key, vector, digits=digits, keep=k, apart=apart)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key)))
    return scored.withColumn("_rn", rank).where(F.col("_rn") <= k).select("query", key, "score", F.col("_rn").cast("long").alias("rank"))


def _noisy(noise: float, seed: int):
    def shift(vector: pd.Series, query: pd.Series) -> pd.Series:
        out = []
        for v, q in zip(vector, query):
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1.0) + noise * np.random.default_rng([seed, abs(int(q))]).normal(size=len(v))
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return pd.Series(out)

    return shift


def search_atoms(
    queries: DataFrame, rows: DataFrame, query_key: str, key: str, k: int = 8, vector: str = "embedding", chunks: str | None = None, exclude_ids: Sequence = (), exclude_chunks: Sequence[str] = (), min_score: float = 0.0, weight: float = 1.0, noise: float = 0.0, sample: bool = False, pool_mult: int = 3, seed: int = 0,
) -> DataFrame:
    """``query, key, score, place``: diverse rows for each query.

    The query vector may be shifted by seeded noise.  Excluded ids go before the search;
    more rows than wanted are fetched, then rows that hold an excluded chunk, or whose id
    is one, and rows below the floor go.  The best five, or without sampling three, times
    k are weighed against each other; with ``sample`` twice k of them are drawn from by
    score.  Excluded ids and chunks are a session's short lists.
    """
    from tidewell.operators import greedy

    many = bool(exclude_ids or exclude_chunks or weight < 0.999 or sample)
    fetch = max(k * max(pool_mult, 4 if many else 1), k + len(exclude_ids) + 8)
    q = queries.select(query_key, vector)
    q = q.withColumn(vector, F.pandas_udf(_noisy(noise, seed), "array<double>")(vector, query_key)) if noise > 0 else q
    open_ = rows.where(~F.col(key).isin(list(exclude_ids))) if exclude_ids else rows
    found = nearest(q, open_, query_key, key, fetch, vector).drop("rank")
    kept = found.where(F.col("score") >= max(0.0, min_score)).join(rows.select(key, vector, *([chunks] if chunks else [])), key)
    if exclude_chunks:
        gone = F.array(*[F.lit(c) for c in exclude_chunks])
        kept = kept.where(~F.array_contains(gone, F.col(key).cast("string")))
        kept = kept.where(~F.coalesce(F.arrays_overlap(chunks, gone), F.lit(False))) if chunks else kept
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key)))
    pool = kept.withColumn("_rn", rank).where(F.col("_rn") <= k * (5 if sample else 3)).drop("_rn")
    picked = greedy.mmr(pool, ["query"], key, vector, "score", 2 * k if sample else k, weight, weigh_first=False)
    if sample:
        picked = greedy.sample_by_score(picked.drop("place"), ["query"], key, "score", k, seed)
    return picked.select("query", key, "score", "place")


#: Documents and queries of a cell of BM25.
LEXICAL_ROWS, LEXICAL_ASKED = 1 << 15, 2048


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Numbers times ten to the digits, rounded as ``round`` of a column does it."""
    part = values * 10**digits + 0.5
    whole = np.floor(part)
    for i in np.flatnonzero(np.abs(part - whole - 0.5) > 0.5 - 1e-4):
        whole[i] = int(Decimal(repr(float(values[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return whole


def best_sums(rows: np.ndarray, weights: np.ndarray, bounds: np.ndarray, asked: Sequence[np.ndarray], n: int, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of terms the k rows of the highest rounded sums of weights, of equal ones the first: list, row, rounded sum times ten to the digits, or the sum itself without digits.

    Term ``t`` has the rows and weights from ``bounds[t]`` to ``bounds[t + 1]``; rows without any aren't given.
    """
    found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
    for q, terms in enumerate(asked):
        if not len(terms):
            continue
        at = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in terms])
        sums = np.bincount(rows[at], weights[at], minlength=n)
        some = np.flatnonzero(sums > 0)
        if len(some) > k:
            least = np.partition(sums[some], len(some) - k)[len(some) - k]
            some = some[sums[some] >= least - (0 if digits is None else 1.01 * 10.0**-digits)]
        code = sums[some] if digits is None else half_up(sums[some], digits)
        order = np.lexsort((some, -code))[:k]
        found.append([np.full(len(order), q), some[order], code[order]])
    return tuple(np.concatenate(x) for x in zip(*found))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: Column, query_key: str, terms: Column, k1: float = 1.2, b: float = 0.75, keep: int | None = None, digits: int = 4) -> DataFrame:
    """BM25 of documents that share a term with a query: ``query, key, score``.

    Only words of queries leave a document; their vocabulary is broadcast while it is
    small, so a task counts them before anything is exchanged.  With ``keep`` scores are
    rounded, and blocks of documents meet blocks of queries where they lie, which give at
    least each query's best so many, ties to the smaller key; else all pairs are made.
    """
    words = docs.select(key, F.filter(text, lambda w: w != "").alias("w"))
    size = words.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("w")).alias("_mean"))
    asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(terms)).alias("term"))
    vocabulary = asked.select("term").distinct()
    if keep is not None:
        return _best_bm25(words, size, asked, vocabulary, key, k1, b, keep, digits)
    vocabulary = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_WORDS else vocabulary
    tf = words.select(key, F.size("w").alias("_len"), F.explode("w").alias("term")).join(vocabulary, "term", "left_semi").groupBy(key, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return weighted.select(key, "term", weight.alias("_w")).join(asked, "term").groupBy("query", key).agg(F.sum("_w").alias("score"))


def _best_bm25(words: DataFrame, size: DataFrame, asked: DataFrame, vocabulary: DataFrame, key: str, k1: float, b: float, keep: int, digits: int) -> DataFrame:
    """``query, key, score``: at least each query's best ``keep``, rounded."""
    known = cut(vocabulary.where("term IS NOT NULL").withColumn("_t", F.monotonically_increasing_id()))
    named = F.broadcast(known) if known.count() <= BROADCAST_WORDS else known
    held = words.select(key, F.size("w").alias("_len"), F.explode("w").alias("term")).join(named, "term")
    held = cut(held.groupBy(key, "_len").agg(F.collect_list("_t").alias("_t")))  # a document's words of queries
    df = held.select(F.explode(F.array_distinct("_t")).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weighed = df.crossJoin(F.broadcast(size)).select("_t", idf.alias("_idf"))  # one row
    mine = cut(asked.join(known, "term").join(weighed, "_t").groupBy("query").agg(F.collect_list(F.struct("_t", "_idf")).alias("_asked")))
    mean, n = size.first()["_mean"], held.count()
    across = max(1, math.ceil(mine.count() / LEXICAL_ASKED))
    down = max(1, math.ceil(n / LEXICAL_ROWS), min(math.ceil(n / 1024), math.ceil(CELLS / across)))
    left = blocks.packed(held.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(down)).cast("int")), ["_block"], down).select("payload")
    right = blocks.packed(mine.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(across)).cast("int")), ["_block"], across).select(F.col("payload").alias("asked"))
    schema = T.StructType([T.StructField("query", mine.schema["query"].dataType), T.StructField(key, words.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in blocks.pairs_in(batches):
            docs, queries = blocks.from_bytes(pair["payload"]), blocks.from_bytes(pair["asked"])
            docs = docs.take(pc.sort_indices(docs, sort_keys=[(key, "ascending")], null_placement="at_start"))
            names, lists = docs[key].combine_chunks(), queries["_asked"].combine_chunks()
            which, of = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
            terms, first, local = np.unique(of.field("_t").to_numpy(), return_index=True, return_inverse=True)
            idf = of.field("_idf").to_numpy()[first]
            row, said = _codes(docs["_t"].combine_chunks(), pa.array(terms))
            pairs, tf = np.unique(said.astype(np.int64) * len(docs) + row, return_counts=True)  # by term, then by row
            term, row = _places(pairs, len(docs))
            length = docs["_len"].to_numpy()[row]
            weights = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            one = np.append(True, pc.fill_null(pc.not_equal(names[1:], names[:-1]), True).to_numpy(zero_copy_only=False)) if len(names) else np.zeros(0, bool)
            one[1:] &= ~(pc.is_null(names[1:]).to_numpy(zero_copy_only=False) & pc.is_null(names[:-1]).to_numpy(zero_copy_only=False))
            of_key = np.cumsum(one) - 1  # rows of one key count as one
            bounds = np.searchsorted(term, np.arange(len(terms) + 1))
            ends = np.searchsorted(which, np.arange(len(queries) + 1))
            q, i, code = best_sums(of_key[row], weights, bounds, [local[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])], len(docs), keep, digits)
            yield from pa.table([queries["query"].take(pa.array(q)), names.take(pa.array(np.flatnonzero(one)[i])), pa.array(code / 10.0**digits)], names=schema.names).to_batches()

    return blocks.each_pair(left, right).mapInArrow(meet, schema)


def fuse_ranks(ranked: Sequence[DataFrame], keys: Sequence[str], constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists with ``rank``."""
    rows = ranked[0].select(*keys, "rank")
    for r in ranked[1:]:
        rows = rows.unionByName(r.select(*keys, "rank"))
    return rows.groupBy(*keys).agg(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))).alias("fused"))


def anchor_first(scored: DataFrame, by: Sequence[str], doc: str, key: str, score: str, supplements: int = 2, rows: DataFrame | None = None) -> DataFrame:
    """For each query (``by``) all rows of the best row's document in order of key, then the best others; ``place`` from 1.

    ``rows`` are the documents' rows where ``scored`` holds only the best of each query and
    document, at least ``supplements`` of them; they have no score.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    first = scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(*by, F.col(doc).alias("_doc"))
    marked = scored.join(first, list(by))
    own = marked.where(F.col(doc) == F.col("_doc")) if rows is None else first.join(rows.withColumn("_doc", F.col(doc)), "_doc").withColumn(score, F.lit(None).cast("double")).select(*marked.columns)
    whole = own.withColumn("_part", F.lit(0)).withColumn("_at", F.col(key).cast("double"))
    rest = marked.where(F.col(doc) != F.col("_doc")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= supplements).drop("_rn").withColumn("_part", F.lit(1)).withColumn("_at", -F.col(score))
    order = Window.partitionBy(*by).orderBy("_part", "_at", key)  # one document and its supplements
    return whole.unionByName(rest).withColumn("place", F.row_number().over(order).cast("long")).drop("_part", "_at", "_doc")
