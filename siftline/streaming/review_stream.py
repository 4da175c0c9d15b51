"""Scoring of source files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.learn import CodeModel
from siftline.plans.review import review_corpus


def stream_source_files(
    spark: SparkSession, path: str, files_per_trigger: int = 10_000, pattern: str = "*.py"
) -> DataFrame:
    """(path, code) of every new source file, searched for below ``path`` as in a batch read."""
    reader = spark.readStream.format("text").options(wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    files = reader.option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))


def batch_folders(target: str, review: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each reviewed batch into a folder of its own number below ``target``.

    A batch that is played again after a crash, wherever the crash was, replaces what it wrote before, so every
    file is reviewed once in the result. The number reads back as column ``batch``.
    """

    def write(batch: DataFrame, number: int) -> None:
        review(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return write


def review_stream(
    spark: SparkSession,
    source: str,
    target: str,
    model: CodeModel,
    threshold: float = 0.30,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Review all files not seen before into a Parquet table, then stop.

    Stateless, so a lost executor repeats only its own files; the checkpoint keeps
    each file to one batch, and a repeated batch replaces itself.
    """
    place = checkpoint or f"{target.rstrip('/')}/_checkpoint"
    put = batch_folders(target, lambda files: review_corpus(files, model, threshold))
    writer = stream_source_files(spark, source).writeStream.foreachBatch(put).option("checkpointLocation", place)
    return writer.trigger(availableNow=True).start()
