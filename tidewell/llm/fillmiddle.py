"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are brought together by the SHA-256 of their content and compared
(the least and the greatest text of a group must be the same, or the job stops).
The boundaries of a group's tokens are found once and kept as an Elias-Fano list, which
answers "where does token i end" without unpacking the list.  Documents, without
their texts, are joined back to the groups; each has its own seeded cut, read from
the list of its group.  Texts cross the network once.

A text that holds more than ``SHARE`` of the rows, or more than ``COPIES`` of them, is
dealt over groups by a hash of its other columns, so that no task meets all its copies;
at most ``1 / SHARE`` texts can hold that share, so their table is bounded.

Defined results: a null text counts as empty; an empty text and one that holds a
marker stay plain; texts of any length are cut whole; a null id is hashed as an empty
string after the seed; rows that repeat are transformed each on its own (equal rows
alike); an empty table gives an empty result; other columns come back under ``doc``
if asked for by ``carry``, so their names clash with none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: A text with more copies than this, and than this share of all rows, is dealt over several groups.
COPIES, SHARE = 256, 1 / 65536

#: ASCII white space of the token rule ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_ends(text: str) -> np.ndarray:
    """Where each token ends, in code points; the last end is the text's length."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    space = _SPACE[raw]
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    ends = np.flatnonzero(last) + 1
    if len(raw) == len(text):
        return ends
    lead = ((raw & 0xC0) != 0x80).view(np.uint8)
    return np.cumsum(np.add.reduceat(lead, np.concatenate([[0], ends[:-1]]), dtype=np.int64))


class EliasFano:
    """A strictly ascending list of n numbers up to u in about ``n * (2 + log2(u / n))`` bits.

    Each number's low bits are stored side by side; its high part is the place of a set
    bit, so that finding the i-th number means finding the i-th set bit.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.width = max(0, int(values[-1] // self.n).bit_length() - 1) if self.n else 0
        low = (values & ((1 << self.width) - 1)).astype(np.uint64)
        self.low = np.packbits(((low[:, None] >> np.arange(self.width, dtype=np.uint64)) & np.uint64(1)).astype(bool))
        high = np.zeros(int(values[-1] >> self.width) + self.n if self.n else 0, bool)
        high[(values >> self.width) + np.arange(self.n)] = True
        self.high = np.packbits(high)
        self.ranks = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def __getitem__(self, i: int) -> int:
        at = int(np.searchsorted(self.ranks, i + 1))
        before = int(self.ranks[at - 1]) if at else 0
        place = 8 * at + int(np.flatnonzero(np.unpackbits(self.high[at : at + 1]))[i - before])
        first = i * self.width
        bits = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8])[first % 8 :][: self.width]
        return ((place - i) << self.width) | sum(int(b) << k for k, b in enumerate(bits))

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes


def _choose(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Cuts of documents that come group by group; the first row of a group brings its text."""
    ends = EliasFano(np.zeros(0, np.int64))
    for texts, firsts, seconds, cuts in parts:
        n, prefix, middle = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, (text, a, b, cut) in enumerate(zip(texts, firsts, seconds, cuts)):
            if text is not None:
                ends = EliasFano(token_ends(text))
            n[i] = ends.n
            if cut:
                low, high = sorted((int(a) % (ends.n + 1), int(b) % (ends.n + 1)))
                prefix[i] = ends[low - 1] if low else 0
                middle[i] = (ends[high - 1] if high else 0) - prefix[i]
        yield pd.DataFrame({"n": n, "prefix": prefix, "middle": middle})


def _part(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def text_groups(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``_text``, ``_salted``) with ``_key`` and ``_salt``, equal for identical texts but for those dealt over groups."""
    hashed = F.xxhash64("_text")
    total = docs.agg(F.count(F.lit(1)).alias("_total"))
    counts = docs.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_copies")).crossJoin(F.broadcast(total))  # one row
    most = F.greatest(F.lit(COPIES), F.ceil(F.col("_total") * F.lit(SHARE)))
    hot = counts.where(F.col("_copies") > most).select("_hash", F.ceil(F.col("_copies") / most).cast("long").alias("_groups"))
    keyed = docs.withColumn("_hash", hashed).join(F.broadcast(hot), "_hash", "left")  # at most 1 / SHARE rows
    return keyed.select("*", F.unhex(F.sha2("_text", 256)).alias("_key"), F.pmod("_salted", F.coalesce("_groups", F.lit(1).cast("long"))).alias("_salt"))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` and, if asked for, ``doc``.

    ``percent`` of the documents are transformed, ``spm_percent`` of those with the suffix
    first; which, and where they are cut, follows from the seed and the id alone.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    kept = [F.struct(*carry).alias("doc")] if carry else []
    plain_docs = docs.select("doc_id", *kept, F.coalesce("text", F.lit("")).alias("_text"), F.xxhash64(F.lit(seed), *others).alias("_salted"))
    keyed = text_groups(plain_docs)

    same = F.col("_least") == F.col("_most")  # both made beyond the exchange, which a text crosses once
    checked = F.when(same, F.col("_least")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("string"))
    texts = keyed.select("_key", "_salt", "_text").repartition("_key", "_salt").groupBy("_key", "_salt").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most")).select("_key", "_salt", checked.alias("_body"))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = (F.col("_text") == "") | F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = F.when(marked | (_part(digest, 2) % 100 >= percent), "plain").when(_part(digest, 3) % 100 < spm_percent, "spm").otherwise("psm")
    slim = keyed.select("_key", "_salt", "_salted", "doc_id", *["doc" for _ in kept], form.alias("form"), _part(digest, 0).alias("_a"), _part(digest, 1).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("_salted"))
    joined = slim.withColumn("_first", place == 1).join(texts.hint("merge"), ["_key", "_salt"])  # a merge keeps a group's documents together and in order

    chosen = F.pandas_udf(_choose, "n long, prefix long, middle long")(F.when(F.col("_first"), F.col("_body")), "_a", "_b", F.col("form") != "plain")
    cut = joined.withColumn("_cut", chosen)
    text, p, m = F.col("_body"), F.col("_cut.prefix").cast("int"), F.col("_cut.middle").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    moved = F.col("form") != "plain"
    return cut.select("doc_id", *["doc" for _ in kept], F.col("_cut.n").alias("n"), "form", F.when(moved, F.col("_cut.prefix")).alias("prefix_chars"), F.when(moved, F.col("_cut.middle")).alias("middle_chars"), output.alias("output"))


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made from.

    The text holds no marker, and no marker can arise where a part meets one, so the
    first occurrence of each marker is the one that was put in.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    end = F.length(output)
    body = F.substring(output, F.lit(4), end)

    def parted(second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(head) + 4, end)
        mid = F.substring_index(rest, MIDDLE, 1)
        return head, mid, F.substring(rest, F.length(mid) + 4, end)

    prefix, suffix, middle = parted(SUFFIX)
    suffix2, prefix2, middle2 = parted(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
