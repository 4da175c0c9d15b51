"""Row filters and flags for records, code and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import strip

#: Pattern name given to a change that fits no specific pattern.
CATCH_ALL_PATTERN = "SINGLE_STMT"

# JSON texts of the values Python takes for false.
FALSY_JSON = r'^(?:false|null|""|\[\]|\{\}|-?0(?:\.0+)?(?:[eE][+-]?[0-9]+)?)$'

STRICT = "strict"
LOOSE = "loose"


def _check_mode(mode: str) -> None:
    if mode not in (STRICT, LOOSE):
        raise ValueError(f"mode must be {STRICT!r} or {LOOSE!r}, not {mode!r}")


def is_truthy(df: DataFrame, name: str) -> Column:
    """Whether a value counts as true in Python; never NULL.

    Works on typed columns and on VARIANT, where empty text, zero, an empty list
    and an empty object are all false.
    """
    value, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        truth = value
    elif isinstance(kind, T.StringType):
        truth = value != ""
    elif isinstance(kind, T.VariantType):
        truth = ~F.to_json(value).rlike(FALSY_JSON)
    else:
        truth = value != 0
    return F.coalesce(truth, F.lit(False))


def _as_text(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.VariantType):
        return F.try_variant_get(value, "$", "string")
    return value.cast("string")


def specific_pattern(df: DataFrame, mode: str, column: str = "sstub_pattern") -> Column:
    """Whether the record names a specific change pattern; never NULL."""
    _check_mode(mode)
    text = _as_text(df, column)
    if mode == LOOSE:
        return is_truthy(df, column) & F.coalesce(text != CATCH_ALL_PATTERN, F.lit(True))
    named = ~strip(text).isin("", CATCH_ALL_PATTERN)
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        named = F.to_json(column).startswith('"') & named
    elif not isinstance(kind, T.StringType):
        named = F.lit(False)
    return F.coalesce(named, F.lit(False))


def likely_bug(df: DataFrame, mode: str, column: str = "likely_bug") -> Column:
    """Whether the record is marked as a fix; never NULL. Strict wants a JSON true."""
    _check_mode(mode)
    if mode == LOOSE:
        return is_truthy(df, column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        flag = F.to_json(column) == "true"
    elif isinstance(kind, T.BooleanType):
        flag = F.col(column)
    else:
        flag = F.lit(False)
    return F.coalesce(flag, F.lit(False))


def filter_pattern(df: DataFrame, mode: str, column: str = "sstub_pattern") -> DataFrame:
    """Keep records of a specific pattern, with the pattern as text."""
    return df.where(specific_pattern(df, mode, column)).withColumn(column, _as_text(df, column))


def filter_likely_bug(df: DataFrame, mode: str, column: str = "likely_bug") -> DataFrame:
    return df.where(likely_bug(df, mode, column))


def has_both_sides(before: str = "buggy", after: str = "fixed") -> Column:
    return F.coalesce((F.col(before) != "") & (F.col(after) != ""), F.lit(False))


def is_changed(before: str = "buggy", after: str = "fixed") -> Column:
    return F.coalesce(strip(F.col(before)) != strip(F.col(after)), F.lit(False))


def filter_changed(df: DataFrame, before: str = "buggy", after: str = "fixed") -> DataFrame:
    """Keep rows whose two sides are both there and differ."""
    return df.where(has_both_sides(before, after) & is_changed(before, after))


def filter_length(df: DataFrame, column: str, longest: int) -> DataFrame:
    """Keep rows of at most ``longest`` code points."""
    return df.where(F.length(column) <= longest)


def drop_blank(df: DataFrame, column: str = "code") -> DataFrame:
    """Drop rows holding whitespace only, or nothing."""
    return df.where(strip(F.col(column)) != "")


def flag_binary(df: DataFrame, probability: str = "probability", threshold: float = 0.30) -> DataFrame:
    """Add ``is_buggy`` 0/1: the threshold itself counts as buggy."""
    return df.withColumn("is_buggy", F.when(F.col(probability) >= threshold, 1).otherwise(0))


def flag_multiclass(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``pass_on``: every class but the clean one goes on to repair."""
    return df.withColumn("pass_on", F.col(label) != 0)


def gate(df: DataFrame, flag: str = "is_buggy") -> DataFrame:
    """Keep the rows that go on to repair."""
    kept = F.col(flag)
    return df.where(kept if isinstance(df.schema[flag].dataType, T.BooleanType) else kept == 1)
