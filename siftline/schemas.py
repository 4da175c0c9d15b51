"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_LABELLED = T.StructType(
    [
        T.StructField("function", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

LABELLED_FUNCTION = T.StructType(
    [
        T.StructField("function", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("bug_type", T.StringType()),
        T.StructField("source_task", T.StringType()),
    ]
)

LEGACY_SNIPPET = T.StructType(
    [
        T.StructField("code_snippet", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

FIX_PAIR = T.StructType(
    [
        T.StructField("input_text", T.StringType()),
        T.StructField("target_text", T.StringType()),
        T.StructField("sstub_pattern", T.StringType()),
    ]
)

# The fields of a commit record, by the type they are read as.
COMMIT_TEXT_FIELDS = (
    "project",
    "project_url",
    "commit_sha",
    "parent_sha",
    "file_path",
    "diff",
    "before",
    "after",
)
COMMIT_FLAG_FIELDS = ("comodified", "in_function")
# Kept as VARIANT: the strict filters ask for the JSON type, not only the value.
COMMIT_OPEN_FIELDS = ("sstub_pattern", "likely_bug")

# Class names and the label texts of the three training tasks.
LABEL_NAMES = {
    0: "Clean",
    1: "Wrong Binary Operator",
    2: "Variable Misuse",
    3: "Swapped Operand",
}
CLEAN_TEXT = "Correct"
TASK_LABELS = {
    "wrong_binary_operator_datasets": ("Wrong binary operator", 1),
    "variable_misuse_datasets": ("Variable misuse", 2),
    "swapped_operands_datasets": ("Swapped operands", 3),
}
