"""Quality rules as a short-circuit cascade.

Each rule sees a document's text and says whether to reject it; what it counts is
made when a rule first asks for it.  On a sample of bounded size every rule is run
on every text, its cost is timed, counts included, and its share of rejections
counted; rules then run in descending order of rejections per cost, and a document
leaves at its first rejection.  The verdict is the conjunction of all rules, so the
order changes the time and never the result.

``judge`` owes the base rule's counts of every whole text and makes them all;
``keep_documents`` takes the base rule's halves as rules of the cascade and makes
only what the cascade asks for.

Defined results: a null or empty text has no words and fails the base rule
(fewer than 50 words); texts of any length are judged whole, though those beyond
``SAMPLE_BYTES`` are not among the timed ones; a row without id is judged; rows that repeat an id are judged each on its own; an
empty table gives an empty result; columns beyond id and text play no part.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_BYTES, forget, text_batches

#: Symbols that the contract counts (fixed values).
SYMBOLS = b"#*$%&|<>"

LOWER, UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Texts of the sample on which rules are timed, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 16


def count_of(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


class Text:
    """A text whose counts are made when a rule first asks for them."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        tight = self.raw.translate(None, SPACE_BYTES)
        return len(tight) if tight.isascii() else int((np.frombuffer(tight, np.int8) >= -64).sum())  # bytes that begin a code point

    @cached_property
    def n_symbols(self) -> int:
        return count_of(self.raw, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 3:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    v = len(number)
    if v < 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # the product would not fit
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        key = pair[:-1].astype(np.int64) * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[order]) == 0)
    if not len(same):
        return 0
    hit = np.zeros(n, bool)
    for at in (order[same], order[same + 1]):
        for k in range(3):
            hit[at + k] = True
    return int(hit.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The rules beside the base rule.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("exclamations", lambda t: 10 * t.raw.count(b"!") > 3 * t.n_words),
    Rule("capitals", lambda t: (up := count_of(t.raw, UPPER)) * 10 > 6 * (up + count_of(t.raw, LOWER))),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("few_distinct_words", lambda t: 20 * len(set(t.words)) < t.n_words),
)
#: The base rule's two halves, as rules of the cascade.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost on the sample, with seconds a text and share of rejections.

    A rule is timed with the counts that it asks for, on texts that only have their words.
    """
    sample = [t.encode() for t in texts]
    found = []
    for rule in rules:
        fresh = [Text(t) for t in sample]
        for t in fresh:
            t.n_words  # noqa: B018  every rule asks for the words
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, fresh))
        cost = (time.perf_counter() - began) / max(1, len(sample))
        found.append((rule, max(cost, 1e-9), (rejected + 0.5) / (len(sample) + 1)))  # a rule without rejections still has an order
    return sorted(found, key=lambda x: -x[2] / x[1])


def sampled_texts(docs: DataFrame, text_col: str, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """At most ``rows`` texts of at most ``SAMPLE_BYTES`` each, spread over the table, for timing only."""
    total = docs.count()
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    picked = text.sample(min(1.0, 3.0 * rows / max(1, total)), seed).orderBy(F.rand(seed)).limit(rows)
    return [r.text for r in picked.collect()]


def cascade(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> list[str]:
    """Names of the rules in the order in which they run."""
    return [r.name for r, _, _ in order_rules(sampled_texts(docs, text_col), rules)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base verdict and the cascade's verdict of every row, and the rule that rejected it."""
    names = cascade(docs, text_col, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        by_name = {r.name: r for r in rules}
        ordered = [by_name[n] for n in names]
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                rows = []
                for raw in texts:
                    t = Text(raw.encode())
                    failed = t.base_failed()
                    by = "base" if failed else next((r.name for r in ordered if r.rejects(t)), None)
                    rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def keep_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + RULES) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects; the base rule's halves are rules like the others."""
    names = cascade(docs, text_col, rules)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        by_name = {r.name: r for r in rules}
        ordered = [by_name[n] for n in names]
        for whole in batches:
            for batch, texts in text_batches(whole, whole.schema.names[place]):
                judged = (Text(raw.encode()) for raw in texts)
                yield batch.filter(pa.array([not any(r.rejects(t) for r in ordered) for t in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
