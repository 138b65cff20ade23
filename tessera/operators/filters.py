"""Filters that go before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and of the filter at most: 128 MB.
BITS_PER_KEY, MOST_BITS = 16, 1 << 30


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """A power of two that gives every key BITS_PER_KEY bits, within ``most``; 0 where there would be less than two for each key."""
    return 0 if 2 * n > most else min(most, max(1 << 16, 1 << (BITS_PER_KEY * n - 1).bit_length()))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, column: str, most: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys[column]``: all that are, and some that aren't.

    One bit for each hash; the bitmaps are built with map-side combining and broadcast. They are sized by the number of keys, which is
    counted when the query is built, and bounded by ``most`` bits; with more keys than such a filter could tell apart nothing is
    filtered. A join must follow; this only spares it most of the rows. Null keys are dropped.
    """
    bits = bits_for(keys.count(), most)
    if not bits:
        return df.filter(key.isNotNull())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = keys.filter(F.col(column).isNotNull()).select(slot(F.col(column)).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__map"))
    slotted = df.withColumn("__slot", F.when(key.isNotNull(), slot(key))).withColumn("__bucket", F.bitmap_bucket_number("__slot")).withColumn("__at", F.bitmap_bit_position("__slot"))
    hit = F.expr("shiftright(cast(conv(hex(substring(__map, cast(__at DIV 8 AS int) + 1, 1)), 16, 10) AS int), cast(__at % 8 AS int)) & 1 = 1")
    return slotted.join(F.broadcast(maps), "__bucket").filter(hit).drop("__slot", "__bucket", "__at", "__map")
