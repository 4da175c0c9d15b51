"""Evaluation of predicted classes and predicted text.

The data is read once into (actual, predicted) cell counts; every figure then comes
from that table of at most classes-squared rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import strip
from siftline.schemas import LABEL_NAMES
from siftline.session import bounded_local


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the share of rows whose prediction is right."""
    right = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    return df.agg(F.avg(right).alias("accuracy"))


def confusion_cells(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for the pairs that occur."""
    pairs = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
    return pairs.agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    classes: list[int] | None = None,
) -> DataFrame:
    """One row per actual class, a ``predicted_<class>`` column each, zeros kept.

    Classes that occur but are not listed are added, so no row of ``df`` goes missing.
    """
    classes = sorted(LABEL_NAMES) if classes is None else classes
    cells, _ = bounded_local(confusion_cells(df, label, prediction))
    return matrix_from_cells(cells, classes)


def matrix_from_cells(cells: DataFrame, classes: list[int]) -> DataFrame:
    """The zero-filled matrix of (actual, predicted, n) over ``classes`` and all that occur."""
    present = cells.select(F.explode(F.array(F.col("actual").cast("int"), F.col("predicted").cast("int"))).alias("c"))
    found = [row["c"] for row in present.where("c IS NOT NULL").distinct().collect()]
    classes = sorted(set(classes) | set(found))
    every = cells.sparkSession.createDataFrame(pa.table({"actual": pa.array(classes, pa.int32())}))
    counts = [
        F.sum(F.when(F.col("predicted") == code, F.col("n")).otherwise(0)).alias(f"predicted_{code}")
        for code in classes
    ]
    rows = cells.withColumn("actual", F.col("actual").cast("int")).groupBy("actual").agg(*counts)
    return every.join(rows, "actual", "left").fillna(0).orderBy("actual")


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def report_from_cells(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages."""
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("called"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("long").alias("hit"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("called"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("called").alias("called")
    )
    scored = sums.withColumn("precision", _ratio(F.col("hit"), F.col("called"))).withColumn(
        "recall", _ratio(F.col("hit"), F.col("support"))
    )
    scored = scored.withColumn("f1", _ratio(2 * F.col("hit"), F.col("called") + F.col("support")))
    figures = ["precision", "recall", "f1"]
    per_class = scored.select(F.col("class").cast("string").alias("row"), *figures, "support")
    total = F.sum("support").alias("support")
    macro = scored.agg(F.lit("macro avg").alias("row"), *[F.avg(f).alias(f) for f in figures], total)
    weighted = scored.agg(
        F.lit("weighted avg").alias("row"),
        *[(F.sum(F.col(f) * F.col("support")) / F.sum("support")).alias(f) for f in figures],
        total,
    )
    right = F.sum("hit") / F.sum("support")
    overall = scored.agg(F.lit("accuracy").alias("row"), *[right.alias(f) for f in figures], total)
    rows = per_class.unionByName(overall).unionByName(macro).unionByName(weighted)
    return rows.select("row", *[F.round(f, 4).alias(f) for f in figures], "support")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    cells, _ = bounded_local(confusion_cells(df, label, prediction))
    return report_from_cells(cells)


def exact_match(
    df: DataFrame,
    prediction: str = "prediction",
    target: str = "target",
    limit: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """One row: percentage of stripped predictions equal to their targets; 0 when empty.

    ``limit`` scores the first rows by ``order`` only, as a quick check during training.
    """
    if limit is not None:
        df = df.orderBy(order).limit(limit)
    hit = F.when(strip(F.col(prediction)) == strip(F.col(target)), 100.0).otherwise(0.0)
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("exact_match_pct"))


def evaluate(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy, report, confusion matrix) from a single pass over the data."""
    cells, _ = bounded_local(confusion_cells(df, label, prediction))
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    overall = cells.agg((right / F.sum("n")).alias("accuracy"))
    return overall, report_from_cells(cells), matrix_from_cells(cells, sorted(LABEL_NAMES))
