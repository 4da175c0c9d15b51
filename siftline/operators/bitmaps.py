"""A mergeable bitmap over hashed keys: rows whose key is surely not among them stay out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest bitmap (16 MB, which is the most that is ever broadcast), and bits for each key below that.
MOST_BITS, BITS_A_KEY = 1 << 27, 32
#: Bits of one row of the table, fixed by the bitmap functions.
ROW_BITS = 8 * 4096


def bitmap_bits(keys: int) -> int:
    """A power of two, at least one row of the table, with BITS_A_KEY bits for each key up to MOST_BITS."""
    bits = ROW_BITS
    while bits < min(keys * BITS_A_KEY, MOST_BITS):
        bits *= 2
    return bits


def key_bitmap(hashes: DataFrame, bits: int, name: str = "hash") -> DataFrame:
    """``(bucket, bitmap)``: one bit set for each 64-bit hash in ``hashes(name)``; at most ``bits`` / ROW_BITS rows.

    Each task sets bits of its own and bitmaps are merged by OR, so the keys are never shuffled as rows.
    Past MOST_BITS / BITS_A_KEY keys it fills up and lets more rows through, never fewer.
    """
    place = F.pmod(F.col(name), F.lit(bits))
    bit = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return bit.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def maybe_among(df: DataFrame, bitmap: DataFrame, value: Column, bits: int) -> tuple[DataFrame, Column]:
    """``df`` joined with the broadcast ``bitmap``, and whether the hash ``value`` may be among its keys.

    False is certain; true may be wrong for about one row in BITS_A_KEY. The column
    ``_bitmap`` is added and is to be dropped by the caller. A null hash may not be among them.
    """
    place = F.pmod(value, F.lit(bits))
    known = F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
    found = df.join(known, F.bitmap_bucket_number(place) == F.col("_bucket"), "left").drop("_bucket")
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found, F.coalesce(F.expr("1") == F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(False))
