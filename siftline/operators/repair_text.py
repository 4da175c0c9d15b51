"""Texts handed to a repair model and to a reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import strip

# The model prefixes and the reviewer's instructions.
PLAIN_PREFIX = "fix: "
INTENT_PREFIX = "fix intent: "
INTENT_CODE = " code: "
REVIEW_PROMPT = """
        You are a Code Reviewer.
        Buggy Code: %s
        Fixed Code: %s
        
        Task:
        1. Analysis: Make a comparison between Buggy Code and Fixed Code. 1 sentence on the bug. Or if no change, say no bug found. Then no need to do reasoning if there's no bug.
        2. Reasoning: 1 or 2 sentences on the fix.
        
        Format:
        Analysis: ...
        Reasoning: ...
        """  # noqa: E501, W293


def repair_input(code: Column, intent: Column | None = None, prefix: str = PLAIN_PREFIX) -> Column:
    """Model input for one function; only an empty intent takes the short form."""
    plain = F.concat(F.lit(prefix), code)
    if intent is None:
        return plain
    stated = F.concat(F.lit(INTENT_PREFIX), strip(intent), F.lit(INTENT_CODE), code)
    return F.when(F.coalesce(intent, F.lit("")) != "", stated).otherwise(plain)


def build_repair_input(df: DataFrame, code: str, intent: str | None = None, into: str = "repair_input"):
    return df.withColumn(into, repair_input(F.col(code), F.col(intent) if intent else None))


def build_review_prompt(df: DataFrame, buggy: str, fixed: str, into: str = "prompt") -> DataFrame:
    """Instructions for a reviewer, with both sides of the change filled in."""
    return df.withColumn(into, F.format_string(REVIEW_PROMPT, buggy, fixed))


def coalesce_feedback(df: DataFrame, sources: list[str], into: str = "feedback") -> DataFrame:
    """Feedback of the first source that has one, stripped, else NULL."""
    return df.withColumn(into, F.coalesce(*[strip(F.col(name)) for name in sources]))
