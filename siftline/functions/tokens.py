"""Code tokenizers and n-grams as native array expressions.

Letters and digits are spelled as Unicode categories, because the shorthand
classes of the regex engine are ASCII-only. The plain ranges in front of them change
nothing but are tried first, which saves looking up the category of most characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import WHITESPACE_CLASS

WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
DIGITS = r"\p{Nd}+"

# String literals each tokenizer masks.
LEGACY_STRING = r"\"[^\n]*?\"|'[^\n]*?'"
BUG_AWARE_STRING = "(?s)\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\\n]*\"|'[^'\\n]*'"

# The separators of the legacy tokenizer.
LEGACY_SEPARATOR = r"=+\-*/%<>&!|:;{}()\[\]"

# The operators and punctuation of the bug-aware tokenizer.
LONG_OPERATORS = (
    r"\*\*", "//", "==", "!=", "<=", ">=", r"\+=", "-=", r"\*=", "/=", "%=", "->", "<<", ">>",
)
SHORT_OPERATORS = r"[+\-*/%<>&|!^~=:;,.()\[\]{}@]"

# A whole word made of digits only, other than the plain 0 and 1. Asking for a digit
# first spares the look-behind at every other character.
LEGACY_NUMBER = rf"(?=\p{{Nd}})(?<!{WORD})(?![01](?!{WORD})){DIGITS}(?!{WORD})"
LEGACY_TOKEN = rf"[{LEGACY_SEPARATOR}]|[^{LEGACY_SEPARATOR}{WHITESPACE_CLASS}]+"
BUG_AWARE_TOKEN = "|".join(
    [rf"[A-Za-z_]{WORD}*", rf"{DIGITS}(?:\.{DIGITS})?", *LONG_OPERATORS, SHORT_OPERATORS]
)


def tokenize_legacy(code: Column) -> Column:
    """Blank-separated tokens with strings and most integers masked."""
    masked = F.regexp_replace(code, LEGACY_STRING, " STR ")
    masked = F.regexp_replace(masked, LEGACY_NUMBER, " NUM ")
    return F.regexp_extract_all(masked, F.lit(LEGACY_TOKEN), F.lit(0))


def tokenize_bug_aware(code: Column) -> Column:
    """Identifiers, numbers and operators, with whole operators kept together."""
    masked = F.regexp_replace(code, BUG_AWARE_STRING, "STR")
    return F.regexp_extract_all(masked, F.lit(BUG_AWARE_TOKEN), F.lit(0))


def ngrams(tokens: Column, shortest: int, longest: int) -> Column:
    """Every run of ``shortest`` to ``longest`` neighbouring tokens, blank-joined.

    ``tokens`` should be a plain column. The shifted slices are made once per
    length and zipped, so the cost is linear in the number of tokens.
    """

    def runs(width: int) -> Column:
        if width == 1:
            return tokens
        count = F.greatest(F.size(tokens) - F.lit(width - 1), F.lit(0))
        shifted = [F.slice(tokens, F.lit(start), count).alias(f"t{start}") for start in range(1, width + 1)]
        return F.transform(
            F.arrays_zip(*shifted),
            lambda run: F.concat_ws(" ", *[run[f"t{start}"] for start in range(1, width + 1)]),
        )

    return F.concat(*[runs(width) for width in range(shortest, longest + 1)])
