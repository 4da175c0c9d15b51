"""Lint reports in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import last_name_wins, parse_json


def read_lint_reports(df: DataFrame, report: str = "report") -> DataFrame:
    """One row per finding of a JSON array, as ``position`` and VARIANT ``finding``.

    A report that is empty or not JSON keeps one row with NULLs, so no file goes
    missing.
    """
    last_name_wins(df.sparkSession)
    parsed = df.withColumn("_report", parse_json(F.col(report)))
    rows = parsed.lateralJoin(
        df.sparkSession.tvf.variant_explode_outer(F.col("_report").outer()), how="left"
    )
    kept = [name for name in df.columns if name != report]
    return rows.select(*kept, F.col("pos").alias("position"), F.col("value").alias("finding"))
