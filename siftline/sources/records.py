"""Commit records in sharded JSON lines, plain or gzipped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType, VariantType

from siftline.functions.text import clean_utf8, last_name_wins, strip
from siftline.schemas import COMMIT_FLAG_FIELDS, COMMIT_OPEN_FIELDS, COMMIT_TEXT_FIELDS

#: Columns that put records back into shard and line order.
RECORD_ORDER = ["shard", "shard_offset", "line_id"]


#: Stands behind a record when it is parsed; it is only read back if the line was one whole value.
_END = "end-of-line-5b1d0c7e"


def _line_schema() -> ArrayType:
    """A line's record and the mark behind it; open fields and the edit script keep their JSON type."""
    fields = [StructField(name, StringType()) for name in COMMIT_TEXT_FIELDS]
    fields += [StructField(name, BooleanType()) for name in COMMIT_FLAG_FIELDS]
    fields += [StructField(name, VariantType()) for name in (*COMMIT_OPEN_FIELDS, "edit_script")]
    return ArrayType(StructType([*fields, StructField("_end", StringType())]))


def parse_records(df: DataFrame, line: str = "value") -> DataFrame:
    """Replace a column of JSON text by the commit fields.

    Blank lines and lines that are not one JSON object drop out; a field that is missing or of
    another type becomes NULL and the record stays. The reader knows the fields beforehand, so each line is
    parsed once, in the JVM, and only these fields are built. It takes NaN and Infinity as values, as Python does, and keeps the
    last of repeated names. The parser stops after a line's first value and would take joined values, so the line is read as the
    first of a list of two, whose second is known.
    """
    kept = [name for name in df.columns if name != line]
    last_name_wins(df.sparkSession)
    listed = F.concat(F.lit("["), strip(clean_utf8(F.col(line))), F.lit(f',{{"_end":"{_END}"}}]'))
    options = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false", "maxStringLen": str(2**31 - 1)}
    parsed = df.select(*kept, F.explode(F.array(F.from_json(listed, _line_schema(), options))).alias("_line"))
    record = F.col("_line")[0]
    held = parsed.where((F.size("_line") == 2) & (F.col("_line")[1]["_end"] == _END) & record.isNotNull())
    names = [*COMMIT_TEXT_FIELDS, *COMMIT_FLAG_FIELDS, *COMMIT_OPEN_FIELDS]
    return held.select(*kept, *[record[name].alias(name) for name in names], F.to_json(record["edit_script"]).alias("edit_script"))


def read_commit_records(
    spark: SparkSession, path: str, partitions: int | None = None
) -> DataFrame:
    """Commit records with their order columns; a path without files is an error.

    A gzip shard is read by one task, since gzip cannot be split. With few and
    large shards give ``partitions`` to spread the lines before they are parsed.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as problem:
        raise FileNotFoundError(f"no record shards under {path}") from problem
    lines = text.select(
        "value",
        F.col("_metadata.file_path").alias("shard"),
        F.col("_metadata.file_block_start").alias("shard_offset"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    if not lines.inputFiles():
        raise FileNotFoundError(f"no record shards under {path}")
    return parse_records(lines.repartition(partitions) if partitions else lines)
