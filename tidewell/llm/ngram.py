"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes the maximum-likelihood estimates of trigram, bigram and unigram and
the uniform one, each order with the order below: P_k = w f_k + (1 - w) P_(k-1).
A weight depends on the order and on how often the context occurred, in buckets of
powers of two.  Weights are learned by expectation-maximisation on counts of a
deleted part of the training documents against estimates from the rest.  Scores then
use the counts of all training documents with those weights.

Counts are exact and never broadcast.  Documents are gathered into blocks of a
bounded number of tokens; a block hands on each distinct n-gram once, as sorted
64-bit keys with counts, cut by key range.  A range sums the counts of the blocks and
answers each block with the totals in the block's own order.  Blocks meet their
answers and score their documents.  A frequent n-gram reaches its range once a
block, so no key is hot.

Sums form a tree: up to ``FANOUT`` blocks are summed together, then up to ``FANOUT``
of such groups by finer ranges, and so on; totals come down the same way.  So a block
is cut into at most ``FANOUT`` ranges of each order and what moves grows with the
corpus (times the levels, 2 up to some 200 TB), and a range holds some block's worth
of keys at every level.

Blocks are made anew in each pass rather than kept, to save disk.  A block's digest
goes with its counts, so rows that come in another order in a later pass are an
error, not a wrong score; a source of unsure order must be checkpointed first.

Two n-grams of an order share a key with probability 2**-64; below some 10**9
distinct ones none is expected to.

Defined results: null and empty texts are one end token; texts and words of any
length count whole, a text longer than a block being a block of its own; a row
without id counts as training; rows that repeat an id are documents of their own; an
empty table gives an empty result; columns beyond id and text play no part, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import chain64, cut, forget, mix64, text_batches

#: Tokens of a block at most, but for a longer document.
BLOCK_TOKENS = 2_000_000
#: Bytes of text of a block, for the number of ranges.
BLOCK_BYTES = 12 << 20
#: Blocks, or groups of them, that are summed together.
FANOUT = 4096
#: Context-frequency buckets: 0 for unseen, then powers of two.
BUCKETS = 42
#: Rounds of expectation-maximisation at most, and the change of weights that ends it.
ROUNDS, SETTLED = 12, 0.002
#: Tokens of all buckets that each bucket's weight is mixed with.
PRIOR = 10.0
#: Where the order stands in a range's number.
ORDER_AT = 48

END = np.uint64(xxhash.xxh64_intdigest(b"\0end"))
START = np.uint64(xxhash.xxh64_intdigest(b"\0start"))

Block = dict[str, np.ndarray]


def fold_of(doc_id: int | None) -> int:
    """Remainder that decides: 0 is held out, 1 is the deleted part of training; a null id trains."""
    return 2 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes by significance, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


class Gatherer:
    """Documents of one kind until they make a block."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.tokens = 0

    def add(self, doc: int | None, text: str) -> None:
        words = text.encode().lower().split()
        self.ids.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc)
        self.tokens += len(words) + 1

    def block(self) -> Block:
        """Hashes of the local words, the words of all documents by local number, and their lengths."""
        vocabulary = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        return {"vocabulary": vocabulary, "ids": np.concatenate(self.ids), "lengths": np.array([len(i) for i in self.ids], np.uint32), "held": np.array([fold_of(d) == 0 for d in self.docs])}


def blocks(batches: Iterator[pa.RecordBatch], only_deleted: bool = False) -> Iterator[tuple[int, bool, list[int | None], Block]]:
    """Blocks of a task in an order that the same task repeats: number, whether of the deleted part, ids, content."""
    from pyspark import TaskContext

    forget()
    first = TaskContext.get().partitionId() << 24
    open_ = {True: Gatherer(), False: Gatherer()}
    number = {True: 0, False: 0}

    def close(deleted: bool) -> tuple[int, bool, list[int | None], Block]:
        g, open_[deleted] = open_[deleted], Gatherer()
        number[deleted] += 1
        return first + 2 * number[deleted] + deleted, deleted, g.docs, g.block()

    for whole in batches:
        for batch, texts in text_batches(whole, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                deleted = fold_of(doc) == 1
                if deleted or not only_deleted:
                    open_[deleted].add(doc, text)
                    if open_[deleted].tokens >= BLOCK_TOKENS:
                        yield close(deleted)
    for deleted in (True, False):
        if open_[deleted].docs:
            yield close(deleted)


class Grams:
    """The distinct n-grams of a block's tokens, by order from 1: sorted keys, training counts, each token's place.

    A document's tokens are its words and the end; before it stands the start.
    """

    def __init__(self, b: Block, order: int) -> None:
        lengths = b["lengths"].astype(np.int64)
        n = lengths + 1
        self.ends = np.cumsum(n) - 1
        self.starts = self.ends - lengths
        hashed = mix64(np.append(b["vocabulary"], END))
        by_key = np.argsort(hashed)
        place = np.empty(len(hashed), np.int32)
        place[by_key] = np.arange(len(hashed), dtype=np.int32)
        at = np.full(int(n.sum()), place[-1], np.int32)
        is_word = np.ones(len(at), bool)
        is_word[self.ends] = False
        at[is_word] = place[b["ids"]]
        self.trains = ~np.repeat(b["held"], n)
        self.keys, self.at = [hashed[by_key]], [at]
        token = key = self.keys[0][at]
        for _ in range(order - 1):
            before = np.empty_like(key)
            before[1:] = key[:-1]
            before[self.starts] = START
            key = chain64(before, token)
            keys, at = np.unique(key, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))
        self.counts = [np.bincount(a, weights=self.trains, minlength=len(k)).astype("<u8") for k, a in zip(self.keys, self.at)]

    def estimates(self, totals: list[np.ndarray], n_tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each token's estimate of every order, and the buckets of its contexts from order 2 on."""
        found = [totals[0][self.at[0]] / max(1, n_tokens)]
        buckets = []
        documents = totals[0][self.at[0][self.ends[0]]]  # the start occurs as often as the end
        for k in range(1, len(self.keys)):
            context = np.empty(len(self.at[0]))
            context[1:] = totals[k - 1][self.at[k - 1][:-1]]
            context[self.starts] = documents
            found.append(totals[k][self.at[k]] / np.maximum(context, 1))
            buckets.append(np.where(context > 0, 1 + np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 2), 0))
        return found, buckets


def digest_of(b: Block) -> int:
    h = xxhash.xxh64()
    for name in ("vocabulary", "ids", "lengths", "held"):
        h.update(np.ascontiguousarray(b[name]))
    return h.intdigest() - (1 << 63)


def packed(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys and counts beside them, deflated."""
    raw = _planes(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw + b"".join(_planes(c.astype("<u8")) for c in counts))


def unpacked(payload: bytes, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    columns = [_from_planes(raw[8 * n * k : 8 * n * (k + 1)], "<u8") for k in range(len(raw) // max(1, 8 * n))]
    return np.cumsum(columns[0], dtype=np.uint64), columns[1:]


ASKED = "block long, rng long, deleted boolean, digest long, n int, payload binary"


def cut_by_range(block: int, deleted: bool, digest: int, order: int, bits: int, keys: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """Rows of ``ASKED`` for the ranges of an order, which are told by the keys' first bits."""
    own = keys >> np.uint64(64 - bits)
    first = np.flatnonzero(np.diff(own, prepend=own[:1] ^ np.uint64(1))) if len(own) else np.array([], np.int64)
    cuts = [*first.tolist(), len(keys)]
    rng = [(order << ORDER_AT) + int(own[i]) for i in cuts[:-1]]
    parts = [packed(keys[i:j], *(c[i:j] for c in counts)) for i, j in zip(cuts, cuts[1:])]
    n = len(rng)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * n, pa.int64()), pa.array(rng, pa.int64()), pa.array([deleted] * n, pa.bool_()), pa.array([digest] * n, pa.int64()), pa.array(np.diff(cuts).astype(np.int32)), pa.array(parts, pa.binary())],
        ["block", "rng", "deleted", "digest", "n", "payload"],
    )


def requests(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Each block's keys and counts, cut by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, deleted, _, b in blocks(batches):
            grams, digest = Grams(b, order), digest_of(b)
            for k in range(order):
                yield cut_by_range(number, deleted, digest, k + 1, bits, grams.keys[k], grams.counts[k])

    return docs.mapInArrow(run, ASKED)


class Sums:
    """Summed counts of a range's rows: totals, and those without the deleted part, by distinct key."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        keys, all_, rest = [], [], []
        for deleted, n, payload in zip(table.column("deleted").to_pylist(), table.column("n").to_pylist(), table.column("payload")):
            k, counts = unpacked(payload.as_py(), n)
            keys.append(k)
            all_.append(counts[0])
            rest.append(counts[1] if len(counts) > 1 else np.zeros(n, "<u8") if deleted else counts[0])
        self.sizes = [len(k) for k in keys]
        self.distinct, self.at = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda c: np.bincount(self.at, weights=np.concatenate(c), minlength=len(self.distinct)).astype("<u8")
        self.total, self.rest = total(all_), total(rest)

    def answers(self, rng: int, total: np.ndarray, rest: np.ndarray) -> pa.Table:
        """What each row gets back, in its own order of keys; only the deleted part and groups need ``rest``."""
        start, parts = 0, []
        for block, deleted, n in zip(self.table.column("block").to_pylist(), self.table.column("deleted").to_pylist(), self.sizes):
            mine = self.at[start : start + n]
            start += n
            parts.append(packed(np.array([], np.uint64), total[mine], *([rest[mine]] if deleted else [])))
        same = pa.array([rng] * len(parts), pa.int64())
        return pa.table({"block": self.table.column("block"), "rng": same, "digest": self.table.column("digest"), "n": pa.array(self.sizes, pa.int32()), "payload": pa.array(parts, pa.binary())})


ANSWERED = "block long, rng long, digest long, n int, payload binary"


def summed(asked: DataFrame, groups: list[int], bits: int) -> DataFrame:
    """``ANSWERED``: the totals of each row's keys; block -1 has tokens and distinct ones of a range of words."""
    if len(groups) == 1:

        def answer(key: tuple, table: pa.Table) -> pa.Table:
            rng = key[0].as_py()
            sums = Sums(table)
            out = sums.answers(rng, sums.total, sums.rest)
            if rng >> ORDER_AT > 1:
                return out
            stats = np.array([f(x) for x in (sums.total, sums.rest) for f in (np.sum, np.count_nonzero)], np.int64).tobytes()
            return pa.concat_tables([out, pa.table({"block": pa.array([-1], pa.int64()), "rng": pa.array([rng], pa.int64()), "digest": pa.array([0], pa.int64()), "n": pa.array([4], pa.int32()), "payload": pa.array([stats], pa.binary())})])

        return asked.groupBy("rng").applyInArrow(answer, ANSWERED)

    finer = bits + max(1, (min(FANOUT, groups[0]) - 1).bit_length())

    def sum_up(key: tuple, table: pa.Table) -> pa.Table:
        sums = Sums(table)
        return pa.Table.from_batches([cut_by_range(key[0].as_py(), True, 0, key[1].as_py() >> ORDER_AT, finer, sums.distinct, sums.total, sums.rest)])

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = Sums(left)
        got = right.sort_by("rng")
        parts = [_counts(p.as_py(), n) for p, n in zip(got.column("payload"), got.column("n").to_pylist())]
        total, rest = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return sums.answers(left.column("rng")[0].as_py(), total, rest)

    mine = cut(asked.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups[0]))))
    above = summed(cut(mine.groupBy("grp", "rng").applyInArrow(sum_up, ASKED)), groups[1:], finer)
    above = cut(above)
    order, own = F.shiftright("rng", ORDER_AT), F.expr(f"rng & {(1 << ORDER_AT) - 1}L")
    parent = F.shiftleft(order, ORDER_AT) + F.shiftright(own, finer - bits)
    replies = above.where("block <> -1").withColumn("parent", parent)
    dealt = mine.groupBy("grp", "rng").cogroup(replies.groupBy("block", "parent")).applyInArrow(deal, ANSWERED)
    return dealt.union(above.where("block = -1"))


def _counts(payload: bytes, n: int) -> list[np.ndarray]:
    """The columns of an answer."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    return [_from_planes(raw[8 * n * k : 8 * n * (k + 1)], "<u8") for k in range(len(raw) // max(1, 8 * n))]


def _contents(docs: DataFrame, only_deleted: bool) -> DataFrame:
    """``block, doc_ids, payload``: the blocks again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for number, _, ids, b in blocks(batches, only_deleted):
            head = np.array([len(b["vocabulary"]), len(b["ids"]), len(b["lengths"])], np.int64).tobytes()
            raw = head + b["vocabulary"].tobytes() + _planes(b["ids"]) + b["lengths"].tobytes() + b["held"].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack.compress(raw)], pa.binary())], ["block", "doc_ids", "payload"])

    return docs.mapInArrow(run, "block long, doc_ids array<long>, payload binary")


def _opened(left: pa.Table, right: pa.Table, order: int) -> tuple[Block, list[list[np.ndarray]]]:
    """A block and the totals of its keys: one list a column, by order."""
    raw = zstandard.ZstdDecompressor().decompress(left.column("payload")[0].as_py())
    v, n, d = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    b = {"vocabulary": np.frombuffer(raw, np.uint64, v, at)}
    at += 8 * v
    b["ids"] = _from_planes(raw[at : at + 4 * n], "<u4")
    at += 4 * n
    b["lengths"] = np.frombuffer(raw, np.uint32, d, at)
    b["held"] = np.frombuffer(raw, bool, d, at + 4 * d)
    if left.num_rows > 1 or set(right.column("digest").to_pylist()) != {digest_of(b)}:
        raise RuntimeError("rows came in another order than before: checkpoint the documents first")
    got = right.sort_by("rng")
    parts: list[list[list[np.ndarray]]] = [[] for _ in range(order)]
    for rng, m, payload in zip(got.column("rng").to_pylist(), got.column("n").to_pylist(), got.column("payload")):
        parts[(rng >> ORDER_AT) - 1].append(_counts(payload.as_py(), m))
    columns = 1 + (left.column("block")[0].as_py() & 1)
    return b, [[np.concatenate([p[c] for p in parts[k]]) for k in range(order)] for c in range(columns)]


def mixed(found: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Probabilities by order from the unigram on; ``weights[k][bucket]`` of order k + 1."""
    out = [weights[0, 1] * found[0] + (1 - weights[0, 1]) / (n_words + 1)]
    for k, b in enumerate(buckets, 1):
        w = weights[k][b]
        out.append(w * found[k] + (1 - w) * out[-1])
    return out


def learn_weights(evidence: DataFrame, n_words: int, order: int) -> np.ndarray:
    """Expectation-maximisation over the deleted part: ``weights[k][bucket]``, the share of order k + 1 against those below.

    ``evidence`` has rows of ``n, payload``: estimates as 32-bit floats, then buckets.
    A context that wasn't seen gives its order no weight.
    """
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0.0
    for _ in range(ROUNDS):
        now = weights

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, order, BUCKETS))
            for batch in batches:
                for n, payload in zip(batch.column("n").to_pylist(), batch.column("payload")):
                    raw = zstandard.ZstdDecompressor().decompress(payload.as_py())
                    found = [_from_planes(raw[4 * n * k : 4 * n * (k + 1)], "<f4").astype(float) for k in range(order)]
                    buckets = [np.frombuffer(raw, np.uint8, n, 4 * n * order + n * k) for k in range(order - 1)]
                    p = mixed(found, buckets, now, n_words)
                    reach = np.ones(n)
                    for k in reversed(range(order)):
                        b = buckets[k - 1] if k else np.ones(n, np.uint8)
                        chosen = reach * now[k][b] * found[k] / p[k]
                        sums[0, k] += np.bincount(b, weights=chosen, minlength=BUCKETS)
                        sums[1, k] += np.bincount(b, weights=reach, minlength=BUCKETS)
                        reach = reach - chosen
            k, b = np.divmod(np.arange(order * BUCKETS), BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[0].reshape(-1)), pa.array(sums[1].reshape(-1))], ["k", "bucket", "chosen", "reach"])

        chosen, reach = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
        for r in evidence.mapInArrow(expect, "k int, bucket int, chosen double, reach double").groupBy("k", "bucket").agg(F.sum("chosen").alias("chosen"), F.sum("reach").alias("reach")).collect():
            chosen[r.k, r.bucket], reach[r.k, r.bucket] = r.chosen, r.reach
        if not reach.any():  # nothing was deleted
            return weights
        overall = chosen[:, 1:].sum(axis=1) / np.maximum(reach[:, 1:].sum(axis=1), 1e-300)
        weights = np.minimum((chosen + PRIOR * overall[:, None]) / (reach + PRIOR), 1 - 1e-6)
        weights[:, 0] = 0.0
        if np.abs(weights - now).max() < SETTLED:
            break
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_blocks, groups = size // BLOCK_BYTES + 1, []
    bits = max(5, (min(FANOUT, n_blocks) - 1).bit_length())
    while n_blocks > FANOUT:
        n_blocks = -(-n_blocks // FANOUT)
        groups.append(n_blocks)
    replies = cut(summed(requests(source, order, bits), [*groups, 1], bits))
    stats = [np.frombuffer(bytes(r.payload), np.int64) for r in replies.where("block = -1").select("payload").collect()]  # 32 bytes for each range of words
    n_train, v_train, n_kept, v_kept = map(int, np.sum(stats, axis=0)) if stats else (0, 0, 0, 0)
    replies = replies.where("block <> -1")

    def collect_evidence(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, out = [], []
        if left.num_rows:
            b, totals = _opened(left, right, order)
            found, buckets = Grams(b, order).estimates(totals[1], n_kept)
            raw = b"".join([*(_planes(f.astype("<f4")) for f in found), *(x.astype(np.uint8).tobytes() for x in buckets)])
            sizes.append(len(found[0]))
            out.append(zstandard.ZstdCompressor(level=1).compress(raw))
        return pa.table({"n": pa.array(sizes, pa.int64()), "payload": pa.array(out, pa.binary())})

    deleted = replies.where("block % 2 = 1")
    evidence = cut(_contents(source, True).groupBy("block").cogroup(deleted.groupBy("block")).applyInArrow(collect_evidence, "n long, payload binary"))
    weights = learn_weights(evidence, v_kept, order)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        b, totals = _opened(left, right, order)
        grams = Grams(b, order)
        known = totals[0][0][grams.at[0]].astype(np.int64)
        value = np.log10(mixed(*grams.estimates(totals[0], n_train), weights, v_train)[-1])
        base = np.log10((known + 0.1) / (n_train + 0.1 * (v_train + 1)))
        n = b["lengths"].astype(np.int64) + 1
        total = lambda x: np.add.reduceat(x, grams.starts)
        arrays = [left.column("doc_ids").combine_chunks().flatten(), pa.array(b["held"]), pa.array(n), pa.array(total((known > 0).astype(np.int64))), pa.array(np.full(len(n), n_train, np.int64)), pa.array(total(base)), pa.array(total(value))]
        return pa.table(arrays, names)

    return _contents(source, False).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCORED)
