"""Text functions with Python's ideas of whitespace and line ends.

All are native expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Every character Python counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex class: the separators of Unicode and the blank
# control characters, each on its own, since single characters are looked up in a bitmap.
WHITESPACE_CLASS = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\p{Z}"
# Every line end ``str.splitlines`` knows, other than the plain newline.
OTHER_LINE_END = r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def md5_hex(text: Column) -> Column:
    """md5 of the UTF-8 bytes, as lower-case hex."""
    return F.md5(text)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, as Python defines it.

    A trim over a character set is linear; an anchored ``ws+$`` regex is quadratic
    on long inner runs of blanks.
    """
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    """Remove trailing whitespace, as Python defines it."""
    return F.rtrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line.

    All ends become newlines first: a replacement compiles its pattern once per task,
    and splitting at one plain character needs no pattern, while splitting by pattern
    would compile it again for every row.
    """
    even = F.regexp_replace(text, OTHER_LINE_END, "\n")
    closed = F.regexp_replace(even, "\\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(closed, "\n", -1))


#: Stands behind a text when it is parsed; it is only read back if the text was one whole value.
_TEXT_END = "end-of-text-5b1d0c7e"


def last_name_wins(spark: SparkSession) -> None:
    """Let an object with a repeated name keep the last value, as Python's reader does."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_json(text: Column) -> Column:
    """JSON text to VARIANT; text that is not exactly one JSON value becomes NULL.

    The parser stops after the first value and would take ``{..} junk`` or two joined objects.
    So the text is read as the first element of a list whose second is known.
    """
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_TEXT_END}"]')))
    whole = F.try_variant_get(both, "$[1]", "string") == _TEXT_END
    return F.when(whole, F.try_variant_get(both, "$[0]", "variant"))


def clean_utf8(text: Column) -> Column:
    """Drop bytes that are not valid UTF-8, keep everything else."""
    repaired = F.translate(F.make_valid_utf8(text), "\ufffd", "")
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)
