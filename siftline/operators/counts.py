"""Counts, distributions and weights per class or value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.schemas import LABEL_NAMES
from siftline.session import bounded_local


def class_totals(df: DataFrame, label: str, into: str = "n") -> DataFrame:
    """Rows per class; partial counts make a class of any size cheap."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(into))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage (one decimal) per class, ordered by class.

    The window sees one row per class, never the data.
    """
    everything = Window.partitionBy()
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 1)
    return class_totals(df, label).withColumn("pct", share).orderBy(label)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; ties by value."""
    return class_totals(df, column).orderBy(F.desc("n"), column)


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties by value."""
    return value_counts(df, column).limit(k)


def with_label_name(df: DataFrame, label: str = "label", into: str = "bug_type") -> DataFrame:
    """Add the class name; the four names are literals, so there is no join."""
    name = F.lit(None).cast("string")
    for code, text in LABEL_NAMES.items():
        name = F.when(F.col(label) == code, text).otherwise(name)
    return df.withColumn(into, name)


def balanced_weights(df: DataFrame, label: str = "label", into: str = "weight") -> DataFrame:
    """Add ``rows / (classes * rows of the class)`` to every row."""
    totals, _ = bounded_local(class_totals(df, label, "_n"))
    everything = Window.partitionBy()
    weights = totals.select(
        label,
        (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias(into),
    )
    return df.join(weights, label)


def counters(df: DataFrame, **conditions) -> DataFrame:
    """One row: ``total`` and the rows meeting each named condition, in one pass.

    An ``Observation`` would count while the data is used for something else, but
    once a session has one, ML models of Spark 4.1 no longer transform in it: their
    functions carry the session, which then holds a part that cannot be serialised.
    """
    counts = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts)
