"""Source divergence audit: how far the word distributions of a language's sources lie apart.

First a count-min sketch of document frequencies by language and term is filled in
every task and merged; counters saturate and a merged counter is never below the true
frequency, so a term whose least counter is below the bound cannot reach it and is
dropped inside the scan.  What is left is counted exactly: occurrences and documents
by (language, source, term), summed in the task before the exchange.  The terms that
truly reach the bound are kept.

Probabilities are whole numbers of a billionth.  A pair of sources is compared over
all kept terms without making the rows of terms that a source lacks: with ``z`` the
probability of an absent term, the sum over all terms of ``f(p, q)`` is ``V * f(z, z')``,
plus what the terms of one source alone add, which follows from its histogram of
counts, plus a correction for the terms that both hold, which is the only join by term.

Defined results: null text, language and source count as empty; a group without terms
is compared like any other; a language without kept terms has value 0 for every pair;
ids play no part, every row is a document; texts of any length are read whole; columns
beyond text, lang and source play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, drop_path, forget, mix64, release_memory, scratch_path, text_batches

#: Counters of a row of the sketch, and its rows.  One byte a counter: it saturates far above any bound.
WIDTH, DEPTH = 1 << 22, 3
#: What a counter saturates at; bounds on document frequency must lie below.
FULL = 255
#: Sums by source and term that a task holds before it puts them out, terms that it knows, and their bytes.
HELD_SUMS, HELD_TERMS, HELD_BYTES = 1_000_000, 200_000, 8 << 20
#: Counters of a slice of the sketch, which is what moves when sketches are merged.
SLICE = 1 << 19
#: Bytes of text that are hashed at once; a multiple of the 64 places that have weights.
PIECE = 1 << 20
_WEIGHTS = mix64(np.arange(64, dtype=np.uint64)) | np.uint64(1)
#: One in probabilities.
UNIT = 1_000_000_000

#: Lower-cases A-Z and makes a space of every other ASCII character that isn't a letter.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The runs of letters and characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between spaces begin, and a sum over each word's bytes, weighed by their place."""
    word = buf != 32
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = (np.arange(int(sizes.sum())) - np.repeat(first, sizes)) & 63
    return starts, np.add.reduceat(buf[word].astype(np.uint64) * _WEIGHTS[place], first) + sizes.astype(np.uint64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw`` begin and a 64-bit hash of each, without an object a word; piece by piece, words uncut."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.rfind(b" ", at, at + PIECE)
        if end < at:  # a word longer than a piece: its blocks' sums add up, since weights repeat with the block
            end = raw.find(b" ", at + PIECE)
            end = len(raw) if end < 0 else end
            total = sum(int(_hashes(np.frombuffer(raw, np.uint8, min(PIECE, end - k), k))[1][0]) for k in range(at, end, PIECE))
            out.append((np.array([at]), np.array([total & (2**64 - 1)], np.uint64)))
        elif end > at:
            starts, sums = _hashes(np.frombuffer(raw, np.uint8, end - at, at))
            out.append((starts + at, sums))
        at = max(end, at + 1)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in out]), mix64(np.concatenate([h for _, h in out]))


def spread(hashes: np.ndarray, lang: str, width: int) -> np.ndarray:
    """A counter in each row of the sketch for every hash of a language's terms: an array of rows by hashes."""
    own = mix64(hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))))
    step = (own >> np.uint64(32)) | np.uint64(1)
    return np.stack([(mix64(own + np.uint64(k) * step) % np.uint64(width)).astype(np.int64) for k in range(DEPTH)])


def places(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """The counters of terms."""
    return spread(word_hashes(b" ".join(terms))[1], lang, width)


def holders(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' terms, and how many of the texts hold each."""
    raws = [t.encode("utf-8", "surrogatepass").translate(_LETTERS) for t in texts]
    starts, hashes = word_hashes(b" ".join(raws))
    order = np.argsort(hashes, kind="stable")  # a hash's texts come in their order
    hashes, text = hashes[order], np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")[order]
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    first = np.flatnonzero(new)
    new[1:] |= text[1:] != text[:-1]
    return hashes[first], np.add.reduceat(new.astype(np.int64), first)


def document_frequencies(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The merged sketch over ``lang, text``; its size is fixed by the width, whatever the table."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sketch = np.zeros((DEPTH, width), np.uint16)
        for batch in batches:
            for part, texts in text_batches(batch, "text"):
                langs = part.column("lang").to_pylist()
                for lang in set(langs):
                    hashes, n = holders([t for x, t in zip(langs, texts) if x == lang])
                    for row, at in zip(sketch, spread(hashes, lang, width)):
                        np.add.at(row, at, n.astype(np.uint16))  # at most a batch's rows above what it saturates at
                        row[at] = np.minimum(row[at], FULL)
        flat = sketch.reshape(-1)
        out = [(k, zlib.compress(flat[k * SLICE : (k + 1) * SLICE].astype(np.uint8).tobytes(), 1)) for k in range(-(-len(flat) // SLICE)) if flat[k * SLICE : (k + 1) * SLICE].any()]
        release_memory()
        yield pa.RecordBatch.from_pydict({"slice": [k for k, _ in out], "payload": [p for _, p in out]}, pa.schema([("slice", pa.int32()), ("payload", pa.binary())]))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for payload in table.column("payload"):
            got = np.frombuffer(zlib.decompress(payload.as_py()), np.uint8)
            total = got.copy() if total is None else np.minimum(FULL, total.astype(np.uint16) + got).astype(np.uint8)
        return pa.table({"slice": [key[0].as_py()], "payload": [zlib.compress(total.tobytes(), 1)]}, schema=pa.schema([("slice", pa.int32()), ("payload", pa.binary())]))

    schema = "slice int, payload binary"
    slices = docs.select("lang", "text").mapInArrow(fill, schema).withColumn("part", F.floor(F.spark_partition_id() / 256))  # no group holds a payload of every task
    merged = slices.groupBy("slice", "part").applyInArrow(merge, schema).groupBy("slice").applyInArrow(merge, schema)
    out = np.zeros(DEPTH * width, np.uint8)
    for row in merged.collect():  # as many slices as the width has
        got = np.frombuffer(zlib.decompress(bytes(row.payload)), np.uint8)
        out[row.slice * SLICE : row.slice * SLICE + len(got)] = got
    return out.reshape(DEPTH, width)


class Terms:
    """Numbers of a language's terms in one task; -1 for those that the sketch rules out."""

    def __init__(self, lang: str, bits: np.ndarray, width: int) -> None:
        self.lang, self.bits, self.width = lang, bits, width
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.passed: list[bytes] = []
        self.weight = 0

    def learn(self, docs: list[list[bytes]]) -> None:
        new = list(set().union(*docs).difference(self.numbers))
        if not new:
            return
        at = places(self.lang, new, self.width)
        ok = np.logical_and.reduce([(row[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 for row, a in zip(self.bits, at)])
        numbers = np.where(ok, len(self.passed) + np.cumsum(ok) - 1, -1)
        self.numbers.update(zip(new, numbers.tolist()))
        self.passed += [t for t, x in zip(new, ok) if x]
        self.weight += sum(map(len, new))


def summed(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sums by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n, np.add.reduceat(docs[order], first) if len(first) else docs


def count_terms(docs: DataFrame, sketch: np.ndarray, least_docs: int) -> DataFrame:
    """``lang, term, docs, n, found`` of each task: exact documents and occurrences, these also by source, of the terms that the sketch doesn't rule out."""
    width = sketch.shape[1]
    passed = np.packbits(sketch >= least_docs, axis=1)  # all that the scan asks of the sketch: one bit a counter
    shared = docs.sparkSession.sparkContext.broadcast(passed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[str, Terms] = {}
        sources: dict[str, int] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def put() -> Iterator[pa.RecordBatch]:
            names = pa.array(sources, pa.string())
            for lang, chunks in held.items():
                key, n, of = summed(*map(np.concatenate, zip(*chunks)))
                number = key >> 32
                first = np.flatnonzero(np.diff(number, prepend=-1))
                terms = pa.array([known[lang].passed[k].decode("utf-8", "surrogatepass") for k in number[first].tolist()], pa.string())
                by_source = pa.StructArray.from_arrays([names.take(pa.array(key & 0xFFFFFFFF)), pa.array(n)], ["source", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), by_source)
                sums = [pa.array(np.add.reduceat(x, first) if len(first) else x) for x in (of, n)]
                whole = pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), terms, *sums, lists], ["lang", "term", "docs", "n", "found"])
                yield from (whole.slice(k, 5_000) for k in range(0, len(first), 5_000))
            held.clear()
            sources.clear()
            for terms_ in known.values():
                terms_.clear()

        for batch in batches:
            for part, texts in text_batches(batch, "text"):
                langs, of = part.column("lang").to_pylist(), [sources.setdefault(s, len(sources)) for s in part.column("source").to_pylist()]
                for lang in set(langs):
                    mine = known.setdefault(lang, Terms(lang, shared.value, width))
                    found = [terms_of(t) for x, t in zip(langs, texts) if x == lang]
                    mine.learn(found)
                    get, sizes = mine.numbers.__getitem__, np.fromiter(map(len, found), np.int64, len(found))
                    flat = np.fromiter((k for terms in found for k in map(get, terms)), np.int64, int(sizes.sum()))
                    row = np.repeat(np.arange(len(found)), sizes)
                    pairs, n = np.unique((row[flat >= 0] << 32) | flat[flat >= 0], return_counts=True)  # a document's term
                    source = np.array([s for x, s in zip(langs, of) if x == lang], np.int64)[pairs >> 32]
                    chunks = held.setdefault(lang, [])
                    chunks.append(summed(((pairs & 0xFFFFFFFF) << 32) | source, n, np.ones(len(n), np.int64)))
                    if len(chunks) > 16:
                        held[lang] = [summed(*map(np.concatenate, zip(*chunks)))]
                if sum(len(c[0]) for chunks in held.values() for c in chunks) > HELD_SUMS or sum(len(t.numbers) for t in known.values()) > HELD_TERMS or sum(t.weight for t in known.values()) > HELD_BYTES:
                    yield from put()
        yield from put()
        release_memory()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, docs long, n long, found array<struct<source: string, n: long>>")


def probability(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """One plus the smoothed share in whole billionths; the product may pass 64 bits, so it is made in decimals."""
    return F.expr(f"1 + ((cast({UNIT} AS decimal(11, 0)) * cast({n} + 2 AS decimal(20, 0))) div cast({total} + 2 * {terms} AS decimal(20, 0)))")


def divergence(p: str, q: str) -> Column:
    """``floor((p - q)^2 / (p + q))`` of whole billionths; a billion squared fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, width: int = WIDTH) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of a language's sources, and the terms that mark a source.

    ``pair`` rows hold the summed divergence of a source from each other one of its
    language; ``term`` rows the terms more likely in the source than in the language, to
    rank ``top_terms``.
    """
    if not 0 < least_docs <= FULL:
        raise ValueError(f"the bound on document frequency must lie from 1 to {FULL}")
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = cut(plain.select("lang", "source").distinct())
    path = scratch_path(docs.sparkSession, "terms")
    count_terms(plain, document_frequencies(plain, width), least_docs).write.parquet(path)  # compact: each term once a task
    counted = docs.sparkSession.read.parquet(path)
    of_lang = cut(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs).drop("docs"))
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("lang_total"))
    here = counted.select("lang", "term", "found").repartition("lang", "term").join(of_lang.hint("shuffle_hash"), ["lang", "term"])
    each = here.select("lang", "term", "n_lang", F.explode("found").alias("x")).select("lang", F.col("x.source").alias("source"), "term", "n_lang", F.col("x.n").alias("n"))
    kept = cut(each.groupBy("lang", "term", "n_lang", "source").agg(F.sum("n").alias("n")))  # lies together by term already
    drop_path(docs.sparkSession, path)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # one row a source: its total, its language's number of terms, the probability of a term that it lacks
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    sized = cut(sized.withColumn("z", F.when(F.col("v") > 0, probability("0", "total", "v"))))
    weighed = kept.join(sized, ["lang", "source"]).withColumn("p", probability("n", "total", "v")).withColumn("q", probability("n_lang", "lang_total", "v"))
    weighed = cut(weighed.select("lang", "source", "term", "p", "q", "z"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term"))
    marking = weighed.where("p > q").withColumn("value", divergence("p", "q")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    marking = marking.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    left = sized.select("lang", "source", "v", "z")
    pairs = left.join(left.select("lang", F.col("source").alias("item"), F.col("z").alias("z2")), "lang").where(F.col("source") < F.col("item"))  # the result's own rows, halved
    base = pairs.withColumn("value", F.coalesce(F.col("v") * divergence("z", "z2"), F.lit(0).cast("long")))
    histogram = weighed.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("m"))
    other = sized.select("lang", F.col("source").alias("item"), F.col("z").alias("z2"))
    alone = histogram.join(other, "lang").where(F.col("source") != F.col("item"))
    alone = alone.withColumn("value", F.col("m") * (divergence("p", "z2") - divergence("z", "z2"))).groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).agg(F.sum("value").alias("alone"))
    second = weighed.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("z").alias("z2"))
    both = weighed.drop("q").join(second, ["lang", "term"]).where(F.col("source") < F.col("item"))
    both = both.withColumn("value", divergence("p", "p2") - divergence("p", "z2") - divergence("z", "p2") + divergence("z", "z2")).groupBy("lang", "source", "item").agg(F.sum("value").alias("both"))

    half = base.join(alone.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "alone"), ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    half = cut(half.select("lang", "source", "item", (F.col("value") + F.coalesce("alone", F.lit(0)) + F.coalesce("both", F.lit(0))).alias("value")))
    whole = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    apart = whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return apart.unionByName(marking)
