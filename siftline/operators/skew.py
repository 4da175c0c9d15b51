"""Joins that stay balanced when a few keys hold a large part of the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.bitmaps import MOST_BITS, bitmap_bits, key_bitmap, maybe_among
from siftline.session import fits_broadcast

#: Slices a hot key is dealt into.
SALTS = 64
#: Most keys ever looked at as hot; more than this many cannot each hold a large share.
MOST_HOT = 1000


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that alone would fill an average shuffle partition.

    One narrow pass with a fixed-size sketch per task and no shuffle of the keys. The
    sketch only steers the balance: a key it misses is joined the ordinary way.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.expr(f"approx_top_k(`{key}`, {MOST_HOT}, 10000)")
    row = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] * partitions > row["n"]]


def hashable(df: DataFrame) -> list[str]:
    """Columns whose values can be hashed."""
    plain = [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    return [f"`{name}`" for name in plain]


def surely_apart(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose key is surely not in ``keys``, null keys among them, and the rest.

    A bitmap of the hashes of ``keys``, at most 16 MB, is merged from the tasks' own and broadcast, so the first
    part is a filter on the scan of ``df``. Each key has 32 bits up to about four million keys; past that the bitmap
    fills up, and beyond the number at which it is full it is not worth a pass and the first part is empty.
    """
    value = F.xxhash64(F.col(key))
    n = keys.count()
    if n > 2 * MOST_BITS:  # nearly every bit would be set
        return df.where(F.lit(False)), df
    bits = bitmap_bits(n)
    bitmap = key_bitmap(keys.select(value.alias("hash")), bits)
    found, may = maybe_among(df, bitmap, value, bits)
    may = may & F.col(key).isNotNull()
    return found.where(~may).drop("_bitmap"), found.where(may).drop("_bitmap")


def balanced_anti_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in the distinct ``keys``.

    Where ``keys`` is known to be small it is broadcast and ``df`` does not move.
    Otherwise rows whose key is surely not among them stay where they are; see ``surely_apart``. Of the others, rows of hot
    keys are dealt over all partitions, and only the few hot keys are repeated on the other side.
    Size-based splitting at run time would not see them, because equal rows compress to next to nothing.
    """
    if fits_broadcast(keys):
        return df.join(keys, key, "left_anti")
    apart, rest = surely_apart(df, keys, key)
    hot = hot_keys(rest, key)
    is_hot = F.col(key).isin(hot)
    # by content, so that a task that runs again deals every row as before
    dealt = F.pmod(F.xxhash64(*hashable(df)), F.lit(SALTS)).cast("int")
    salt = F.when(is_hot, dealt).otherwise(0)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    left = rest.withColumn("_salt", salt)
    right = keys.select(key, F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))).alias("_salt"))
    unseen = left.join(right, [key, "_salt"], "left_anti").select(*df.columns)
    return apart.select(*df.columns).unionByName(unseen)
