"""Before and after sides of unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import rstrip, split_lines, strip

# Line starts that carry no code. A removed line that itself starts
# with two dashes looks like a file header and is passed over with them.
HEADER_STARTS = ("---", "+++", "@@")


def extract_diff(df: DataFrame, diff: str = "diff", context: bool = False) -> DataFrame:
    """Add ``buggy`` and ``fixed``, and with ``context`` also ``input_with_context``.

    Lines and the sides are each made behind a one-element generator. Predicates
    are not pushed below a generator, so filters on the results read the computed
    columns and the diff is split once per row.
    """
    body = F.filter(
        split_lines(F.col(diff)),
        lambda line: ~(
            line.startswith(HEADER_STARTS[0])
            | line.startswith(HEADER_STARTS[1])
            | line.startswith(HEADER_STARTS[2])
        ),
    )
    lines = df.select("*", F.explode(F.array(body)).alias("_body"))
    tail = rstrip if context else (lambda text: text)

    def unmarked(line: Column) -> Column:
        return tail(F.substring(line, 2, 2_147_483_647))

    def side(mark: str) -> Column:
        marked = F.filter("_body", lambda line: line.startswith(mark))
        return strip(F.array_join(F.transform(marked, unmarked), "\n"))

    sides = [side("-").alias("buggy"), side("+").alias("fixed")]
    if context:
        shown = F.transform(
            F.filter("_body", lambda line: ~line.startswith("+")),
            lambda line: F.when(line.startswith("-") | line.startswith(" "), unmarked(line)).otherwise(
                rstrip(line)
            ),
        )
        sides.insert(0, strip(F.array_join(shown, "\n")).alias("input_with_context"))
    return lines.select(*df.columns, F.inline(F.array(F.struct(*sides))))
