"""Exact token counts without ids: pieces per distinct pre-token, joined to per-document frequencies.

1. Every task counts the pre-tokens of its texts; the counts are summed into one
   table of distinct pre-tokens with corpus frequencies.
2. The library counts the pieces of each distinct pre-token once.
3. Documents count their pre-tokens again.  The most frequent ones, at most
   ``head_entries`` whatever the corpus, are broadcast and summed in place; the
   rest of each document's frequencies meet the table in a shuffled join.

Ids are never kept.  A text with characters that the library may class differently
from Python (see ``tokens``), such as those of most scripts beyond Latin, Greek,
Cyrillic and Han, is cut by the library's own pre-tokenizer; an added token's string
counts as the library counts it, one piece, and splits its text.  What a task and the
broadcast hold is bounded in entries and in bytes.

Defined results: null and empty texts have no bytes and no tokens; texts and words
of any length are counted whole; a row without id is counted; rows that repeat an id
are counted each on its own; an empty table gives an empty result; columns beyond id
and text play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, text_batches, with_row_key
from tidewell.llm.tokens import PieceEncoder, encoder

#: Distinct pre-tokens that a task holds before it hands its counts on, and their UTF-8 bytes.
TASK_ENTRIES, TASK_BYTES = 300_000, 16 << 20
#: UTF-8 bytes of the frequent pre-tokens that are broadcast, beside the bound on their number.
HEAD_BYTES = 8 << 20


def spans(code: PieceEncoder, text: str) -> tuple[list[str], int]:
    """The text's parts between added tokens, and the number of those."""
    parts, special = [text], 0
    for a in code.added:
        cutup = [p.split(a) for p in parts]
        special += sum(len(c) - 1 for c in cutup)
        parts = [x for c in cutup for x in c]
    return parts, special


def odd_pretokens(code: PieceEncoder, text: str) -> list[str]:
    """Pre-tokens of a text with characters that the library may class otherwise: the library's own."""
    return [text[a:b] for _, (a, b) in code.library.pre_tokenizer.pre_tokenize_str(text)]


def frequencies(code: PieceEncoder, text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text and the number of its added tokens."""
    cut_up = code.pretokens if text.isascii() or code.strange.search(text) is None else lambda t: odd_pretokens(code, t)
    if any(a in text for a in code.added):
        parts, special = spans(code, text)
        return [w for p in parts for w in cut_up(p)], special
    return cut_up(text), 0


def distinct_pretokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``pretoken, freq`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, weight = encoder(tokenizer), Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pretoken", "freq"])

        for whole in batches:
            for _, texts in text_batches(whole, "text"):
                for t in texts:
                    held.update(frequencies(code, t)[0])
                    weight += len(t)  # no text adds more than itself
                    if weight > TASK_BYTES // 4:  # characters of at most four bytes
                        weight = sum(map(len, held))
                    if len(held) > TASK_ENTRIES or weight > TASK_BYTES // 4:
                        yield out()
                        held, weight = Counter(), 0
        if held:
            yield out()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pretoken string, freq long")
    return counted.groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def piece_counts(pretokens: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``n_pieces``: what the library makes of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            n = [len(code.model_ids(w)) // 4 for w in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], [*batch.schema.names, "n_pieces"])

    return pretokens.mapInArrow(run, "pretoken string, freq long, n_pieces int")


def frequent(table: DataFrame, entries: int, size: int = HEAD_BYTES) -> tuple[int, dict[str, int]]:
    """The least frequency of which at most ``entries`` pre-tokens of ``size`` bytes have so many, and those pre-tokens' piece counts."""
    steps = table.groupBy(F.floor(F.log2("freq") * 4).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("pretoken")).alias("bytes"), F.min("freq").alias("least"))
    least, total, weight = None, 0, 0
    for row in sorted(steps.collect(), key=lambda r: -r.step):  # at most 4 x 63 rows
        total, weight = total + row.n, weight + row.bytes
        if total > entries or weight > size:
            break
        least = row.least
    if least is None:
        return 1 << 62, {}
    return least, {r.pretoken: r.n_pieces for r in table.where(F.col("freq") >= least).select("pretoken", "n_pieces").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, head_entries: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row."""
    table = cut(piece_counts(distinct_pretokens(docs, tokenizer, text_col), tokenizer))
    least, head = frequent(table, head_entries)
    head = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, get = encoder(tokenizer), head.value.get
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                rows, docs_, toks, freqs = batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), [], []
                at, size, known = [], [], []
                for i, t in enumerate(texts):
                    words, n = frequencies(code, t)
                    rare = []
                    if words:
                        found = list(map(get, words))
                        if None in found:
                            rare = [w for w, x in zip(words, found) if x is None]
                            found = [x for x in found if x is not None]
                        n += sum(found)
                    at.append(i)
                    toks.append(f"\0{rows[i]}")  # the document's own row; no pre-token of a text starts so and is a number after it, as NUL and digits never share one
                    freqs.append(None)
                    size.append(len(t.encode()))
                    known.append(n)
                    for w, f in Counter(rare).items():
                        at.append(i)
                        toks.append(w)
                        freqs.append(f)
                        size.append(None)
                        known.append(None)
                index = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").take(pa.array(index)), batch.column("doc_id").take(pa.array(index)), pa.array(toks, pa.string()), pa.array(freqs, pa.int64()), pa.array(size, pa.int64()), pa.array(known, pa.int64())],
                    ["_row", "doc_id", "pretoken", "n", "n_bytes", "known"],
                )

    source = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    counted = source.mapInArrow(run, "_row long, doc_id long, pretoken string, n long, n_bytes long, known long")
    tail = table.where(F.col("freq") < least).select("pretoken", "n_pieces")
    joined = counted.join(tail, "pretoken", "left")
    summed = joined.groupBy("_row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.coalesce(F.col("known"), F.col("n") * F.col("n_pieces"))).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens")
