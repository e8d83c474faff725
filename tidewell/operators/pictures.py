"""Which pictures of a document are kept: big enough, of usual shape, off the page's edges, and unlike those kept before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.greedy import rejected_in_rounds
from tidewell.operators.tables import latest

#: Least width and height, greatest ratio of sides, page zones of headers and footers, and bits within which hashes are alike (fixed values of the rule).
LEAST_WIDTH, LEAST_HEIGHT, MOST_RATIO = 150, 150, 4.0
HEADER, FOOTER = 0.08, 0.92
ALIKE = 4


def passes_shape(width: Column, height: Column) -> Column:
    """Size and ratio of sides; unknown sizes fail."""
    ratio = width / F.when(height > 0, height)
    return F.coalesce((width >= LEAST_WIDTH) & (height >= LEAST_HEIGHT) & (ratio <= MOST_RATIO) & (ratio >= 1 / MOST_RATIO), F.lit(False))


def passes_zone(page_height: Column, top: Column, bottom: Column) -> Column:
    """Neither in the header nor in the footer; pictures without a known place pass."""
    known = page_height.isNotNull() & (page_height > 0) & top.isNotNull()
    low = F.when(F.coalesce(bottom, F.lit(0)) != 0, bottom).otherwise(top)
    return ~F.coalesce(known & ((top / page_height < HEADER) | (low / page_height > FOOTER)), F.lit(False))


def unlike(rows: DataFrame, keys: Sequence[str], position: str, hashed: str, bits: int = 64, most: int = ALIKE) -> DataFrame:
    """Rows in order, each kept unless its hash is within ``most`` bits of one kept before; ``position`` is a number that no two rows share.

    Of equal hashes only the first can be kept, so the others leave before any pair is
    made.  With ``most + 1`` bands two hashes that are alike agree in one band, and rows
    that meet there are compared in full.  The result is that of one pass in order.
    """
    first = latest(rows.where(F.col(hashed).isNotNull()), [*keys, hashed], F.asc(position))
    width = bits // (most + 1)
    ends = [*[i * width for i in range(most + 1)], bits]
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"shiftrightunsigned(shiftleft(`{hashed}`, {64 - high}), {64 - high + low})").alias("v")) for i, (low, high) in enumerate(zip(ends, ends[1:]))])
    banded = first.select(*keys, F.col(position).alias("a"), F.col(hashed).alias("h"), F.explode(bands).alias("band"))
    other = banded.select(*keys, F.col("a").alias("b"), F.col("h").alias("h2"), "band")
    near = banded.join(other, [*keys, "band"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= most))
    gone = rejected_in_rounds(near.select("a", "b").distinct())
    return first if gone is None else first.join(gone.select(F.col("b").alias(position)), position, "left_anti")


def accepted(rows: DataFrame, keys: Sequence[str], position: str, hashed: str) -> DataFrame:
    """The kept pictures of ``width, height, page_height, top, bottom`` and a hash; only kept ones rule out later ones."""
    fit = passes_shape(F.col("width"), F.col("height")) & passes_zone(F.col("page_height"), F.col("top"), F.col("bottom"))
    return unlike(rows.where(fit), keys, position, hashed)
