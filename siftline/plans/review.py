"""From source files to scored functions and repair inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.features import split_functions
from siftline.operators.filters import drop_blank
from siftline.operators.learn import CodeModel, score_binary, score_multiclass
from siftline.operators.repair_text import repair_input


def review_corpus(
    files: DataFrame, model: CodeModel, threshold: float = 0.30, code: str = "code", intent: str | None = None
) -> DataFrame:
    """One row per function with its probability, status and, where buggy, repair input.

    Functions below the threshold stay in the result with status CLEAN and no input.
    There is no shuffle: a file's functions are scored in the task that read the file.
    """
    functions = split_functions(drop_blank(files, code), code)
    scored = score_binary(functions, model, "function_code", threshold)
    asked = repair_input(F.col("function_code"), F.col(intent) if intent else None)
    return scored.withColumn("status", F.when(F.col("is_buggy") == 1, "BUGGY").otherwise("CLEAN")).withColumn(
        "repair_input", F.when(F.col("is_buggy") == 1, asked)
    )


def review_multiclass(files: DataFrame, model: CodeModel, code: str = "code", intent: str | None = None) -> DataFrame:
    """One row per function with its class, confidence, whether it goes on, and then its repair input.

    Every class but the clean one goes on. There is no shuffle here either, and a file is
    parsed once: its functions' syntax features come with their slices.
    """
    ast = "ast" if model.with_ast else None
    functions = split_functions(drop_blank(files, code), code, with_ast=model.with_ast)
    scored = score_multiclass(functions, model, "function_code", ast).drop("ast")
    asked = repair_input(F.col("function_code"), F.col(intent) if intent else None)
    return scored.withColumn("repair_input", F.when(F.col("pass_on"), asked))


def review_summary(reviewed: DataFrame) -> DataFrame:
    """Readable verdict lines, as in ``name: BUGGY (Confidence: 87.50%)``."""
    line = F.format_string("%s: %s (Confidence: %.2f%%)", "function_name", "status", F.col("probability") * 100)
    return reviewed.withColumn("verdict", line)
