"""Source files and CSV tables of source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Line breaks, quotes and outer blanks belong to the text, so nothing is trimmed.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_code_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with multi-line text. Empty text reads back as NULL; any other is verbatim."""
    return spark.read.options(multiLine="true", mode="FAILFAST", **_CSV).schema(schema).csv(path)


def write_code_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write text columns so that ``read_code_csv`` gives them back.

    A multi-line CSV file cannot be split when read; Parquet is the better choice
    for anything large.
    """
    df.write.options(**_CSV).mode(mode).csv(path)


def read_source_files(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """(path, code): one row per source file that is not empty, searched for below ``path``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))


#: Tasks for each core that write source files.
WRITERS_A_CORE = 4


def write_source_files(df: DataFrame, key: str, path: str) -> None:
    """One text file for each value of ``key``, in a folder ``key=value`` below ``path``, of the other column's text.

    A file takes far longer than a row, so keys are dealt out to all cores, however few bytes they are; and tasks
    move their files to their place themselves when they commit, where otherwise the driver moves all of them, one by one.
    ``path`` must be new: a job that fails leaves some files, and no marker.
    """
    tasks = WRITERS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    writer = df.repartition(tasks, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(key).text(path)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed: its last act is the marker file. A half-written folder has none."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless ``path`` holds a finished table; whether it was written.

    What a job that died left at ``path`` is replaced. Needs the marker files that Spark writes by default.
    """
    if is_finished(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
