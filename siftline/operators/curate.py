"""Label mapping, union, deduplication and set tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import md5_hex
from siftline.operators.skew import balanced_anti_join
from siftline.schemas import CLEAN_TEXT, LABEL_NAMES, TASK_LABELS
from siftline.session import written


def task_label_table(spark: SparkSession, tasks: dict[str, tuple[str, int]] = TASK_LABELS) -> DataFrame:
    """(source_task, label text, label, bug_type): two rows for each known task."""
    rows = []
    for task, (text, code) in tasks.items():
        rows += [(task, CLEAN_TEXT, 0, LABEL_NAMES[0]), (task, text, code, LABEL_NAMES[code])]
    values = ", ".join(
        "('{}', '{}', {}, '{}')".format(*(str(part).replace("'", "''") for part in row)) for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(source_task, label_text, label, bug_type)")


def map_labels(df: DataFrame, tasks: dict[str, tuple[str, int]] = TASK_LABELS) -> DataFrame:
    """Label text to (label, bug_type) by task; unknown and missing labels drop out.

    ``df`` has ``source_task`` and text ``label``. The map is a literal table of
    two rows per task.
    """
    table = task_label_table(df.sparkSession, tasks)
    raw = df.withColumnRenamed("label", "label_text")
    rest = [name for name in df.columns if name not in ("label", "source_task")]
    mapped = raw.join(table, ["source_task", "label_text"])
    return mapped.select(*rest, "label", "bug_type", "source_task")


def skipped_labels(df: DataFrame, tasks: dict[str, tuple[str, int]] = TASK_LABELS) -> DataFrame:
    """Rows ``map_labels`` drops, counted by task."""
    table = task_label_table(df.sparkSession, tasks)
    raw = df.withColumnRenamed("label", "label_text")
    lost = raw.join(table, ["source_task", "label_text"], "left_anti")
    return lost.groupBy("source_task").agg(F.count(F.lit(1)).alias("skipped"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name."""
    return reduce(DataFrame.unionByName, frames)


def dedupe_first(df: DataFrame, key: Column | str, order: list[str] | str) -> DataFrame:
    """One row per key: the first by ``order``, which must be unique within a key.

    ``min_by`` combines on the map side, so a key holding a third of all rows
    leaves each task as a single row, and rows move once. They move with all columns of
    ``df``, so select what is needed before, with the text replaced by its hash where
    the hash will do.
    """
    order = [order] if isinstance(order, str) else order
    key = F.col(key) if isinstance(key, str) else key
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")


def dedupe_clean(df: DataFrame, text: str, label: str, order: list[str] | str) -> DataFrame:
    """Keep the first copy of each clean text; rows of other classes stay as they are.

    Only the clean rows are shuffled.
    """
    clean = df.where(F.col(label) == 0)
    return dedupe_first(clean, md5_hex(F.col(text)), order).unionByName(df.where(F.col(label) != 0))


def _distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def exclude_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``seen``; duplicates in ``df`` stay.

    The seen keys are made distinct (map-side combined) and written as a narrow
    table, whose size then decides between a broadcast and a join that deals hot keys
    of ``df`` over all partitions.
    """
    return balanced_anti_join(df, written(_distinct_keys(seen, key), "seen-keys"), key)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys present on both sides; one shuffle per side serves both steps."""
    return _distinct_keys(left, key).join(_distinct_keys(right, key), key, "left_semi")


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise if any key is on both sides."""
    if not overlap(left, right, key).isEmpty():
        raise AssertionError(f"the two tables share values of {key!r}")
