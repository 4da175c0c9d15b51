"""Labelled functions of several tasks and splits."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators.curate import union_all
from siftline.schemas import RAW_LABELLED

log = logging.getLogger(__name__)


def read_labelled_functions(
    spark: SparkSession, paths: dict[str, dict[str, str]], fmt: str = "parquet", row_key: str | None = None
) -> DataFrame:
    """(function, label text, source_task, split) of every split that can be read.

    ``paths`` is ``{task: {split: path}}``. A split that is not there is passed over
    with a warning; if none is there, that is an error.

    ``row_key`` names a further column that tells all rows apart, equal ones too, as samples and
    splits need it: for Parquet the place of the row in its file, which costs
    nothing; for other formats the digest of the row with its number among equal
    rows, which brings equal rows together.
    """
    frames = []
    kept = ["function", "label", *([row_key] if row_key else [])]
    for task, splits in paths.items():
        for split, path in splits.items():
            try:
                frame = spark.read.format(fmt).schema(RAW_LABELLED).load(path)
                frame.inputFiles()
            except AnalysisException as problem:
                log.warning("passing over %s/%s: %s", task, split, problem.getCondition())
                continue
            if row_key and fmt == "parquet":
                place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
                frame = frame.select("function", "label", place.alias(row_key))
            elif row_key:
                same = F.md5(F.to_json(F.struct("function", "label")))
                nth = F.row_number().over(Window.partitionBy("_same").orderBy(F.lit(0)))
                frame = frame.withColumn("_same", same).withColumn("_nth", nth)
                frame = frame.withColumn(row_key, F.concat_ws(":", F.lit(task), F.lit(split), "_same", "_nth"))
            frames.append(
                frame.select(*kept, F.lit(task).alias("source_task"), F.lit(split).alias("split"))
            )
    if not frames:
        raise FileNotFoundError("none of the given splits can be read")
    return union_all(frames)
