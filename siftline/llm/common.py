"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.session import written

#: A word: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Most bytes of text that one fit reads.
FIT_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows kept out of every fit: crc32 of the id as text divides by 5. A null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int = FIT_BYTES) -> pd.DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold, in an order that no partitioning changes.

    The rows are chosen on the narrow label table by the hash of their id, so the
    text table is joined with a side of at most ``max_rows`` rows and never sorted. Of documents that
    share an id, the text with the smallest hash is taken, combined in the tasks. Texts come to the
    driver in that order, each that still fits into ``max_bytes`` together with those before it.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("at", F.xxhash64("doc_id"))
        .orderBy("at", "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("at", "doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = written(one.withColumn("size", F.octet_length("text")), "fit-sample")
    fitting, total = [], 0
    for row in sample.select("doc_id", "size").orderBy("at", "doc_id").collect():  # at most max_rows narrow rows
        if total + row["size"] <= max_bytes:
            fitting.append(row["doc_id"])
            total += row["size"]
    if not fitting:
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "text": pd.Series(dtype=object), "label": pd.Series(dtype="int32")})
    rows = sample.where(F.col("doc_id").isin(fitting)).select("at", "doc_id", "text", "label").toPandas()
    return rows.sort_values(["at", "doc_id"]).reset_index(drop=True)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows of a narrow table by ``order`` from 0 as ``name``, without sorting them in one task.

    Rows are range-partitioned and written with their partition's number, which
    fixes the ranges; the only global window then runs over one row per partition.
    Equal rows get neighbouring numbers.
    """
    keys = [F.col(c) for c in order]
    dealt = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (
        dealt.withColumn("_row", inside)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_part", "_row", "_start")
    )


def ordinals(df: DataFrame, keys: list[str], n: str, into: str, share: int) -> DataFrame:
    """Each row ``n`` times, numbered from 0 as ``into``; rows, told apart by ``keys``, are dealt over tasks in runs of ``share`` numbers."""
    runs = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(share).cast("long"))))
    upto = F.least(F.col("_from") + share, F.col(n)) - 1
    dealt = runs.repartition("_from", *keys)
    return dealt.withColumn(into, F.explode(F.sequence(F.col("_from"), upto))).drop("_from")
