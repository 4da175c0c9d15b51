"""From commit records to training pairs of buggy and fixed code."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import md5_hex
from siftline.operators.counts import value_counts
from siftline.operators.curate import assert_disjoint, dedupe_first
from siftline.operators.diffs import extract_diff
from siftline.operators.filters import (
    LOOSE,
    STRICT,
    filter_changed,
    filter_length,
    filter_likely_bug,
    filter_pattern,
    has_both_sides,
    is_changed,
    likely_bug,
    specific_pattern,
)
from siftline.operators.sampling import balanced_holdout, flag_quota_sample, sample_rows, take_split
from siftline.session import written
from siftline.sources.code_files import write_once

log = logging.getLogger(__name__)

# Length caps by mode, and the numbers of the two data sets.
LONGEST = {STRICT: 400, LOOSE: 600}
NAMED_QUOTAS = {"CHANGE_BINARY_OPERATOR": 4000, "CHANGE_IDENTIFIER_USED": 3000}
HOLDOUT_CLASSES, HOLDOUT_PER_CLASS, HOLDOUT_TOTAL = 10, 100, 1000
LOOSE_TRAIN, LOOSE_VAL = 50_000, 5_000


def _shown(mode: str) -> str:
    return "input_with_context" if mode == LOOSE else "buggy"


def mine_fix_pairs(records: DataFrame, mode: str, order: list[str] | str) -> DataFrame:
    """(input_text, target_text, sstub_pattern, pair_hash), one row per buggy text.

    The cheap tests come first, so a diff is only split where they hold. ``order``
    decides which of several equal buggy texts stays.
    """
    order = [order] if isinstance(order, str) else order
    likely = filter_likely_bug(filter_pattern(records, mode), mode).select(*order, "sstub_pattern", "diff")
    sides = extract_diff(likely, "diff", context=mode == LOOSE)
    usable = filter_length(filter_changed(sides), _shown(mode), LONGEST[mode])
    pairs = usable.select(
        *order,
        F.col(_shown(mode)).alias("input_text"),
        F.col("fixed").alias("target_text"),
        "sstub_pattern",
        md5_hex(F.col("buggy")).alias("pair_hash"),
    )
    first = dedupe_first(pairs, "pair_hash", order)
    return first.select("input_text", "target_text", "sstub_pattern", "pair_hash")


def filter_funnel(records: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row: how many records are left after each filter, in a single pass."""
    flagged = records.select(
        specific_pattern(records, mode).alias("_a"), likely_bug(records, mode).alias("_b"), "diff"
    )
    sides = extract_diff(flagged, "diff", context=mode == LOOSE)
    steps: list[Column] = [
        F.col("_a"),
        F.col("_b"),
        has_both_sides(),
        is_changed(),
        F.coalesce(F.length(_shown(mode)) <= LONGEST[mode], F.lit(False)),
    ]
    names = ["specific_pattern", "likely_bug", "both_sides", "changed", "short_enough"]
    counts, so_far = [], F.lit(True)
    for name, step in zip(names, steps, strict=True):
        so_far = so_far & step
        counts.append(F.count_if(so_far).alias(name))
    distinct = F.count_distinct(F.when(so_far, md5_hex(F.col("buggy")))).alias("distinct_pairs")
    return sides.agg(F.count(F.lit(1)).alias("raw"), *counts, distinct)


def strict_sets(
    pairs: DataFrame,
    train_total: int,
    named: dict[str, int] | None = None,
    holdout: tuple[int, int, int] = (HOLDOUT_CLASSES, HOLDOUT_PER_CLASS, HOLDOUT_TOTAL),
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by quotas: fixed numbers of two patterns in the training set,
    a balanced validation set from the rows left, and a check that they share no pair."""
    named = NAMED_QUOTAS if named is None else named
    pairs = written(pairs, "fix-pairs")
    if pairs.count() < train_total:
        log.warning("fewer pairs than the %d asked for", train_total)
    # one pair per hash: what is not in the training set is a filter, not an anti join
    flagged = flag_quota_sample(pairs, "sstub_pattern", train_total, named, "pair_hash", seed, "in_train")
    train = flagged.where("in_train").drop("in_train")
    pool = flagged.where("NOT in_train").drop("in_train")
    val = written(balanced_holdout(pool, "sstub_pattern", *holdout, "pair_hash", seed), "fix-val")
    assert_disjoint(train, val, "pair_hash")
    return train, val


def loose_sets(
    pairs: DataFrame, n_train: int = LOOSE_TRAIN, n_val: int = LOOSE_VAL, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) as consecutive slices of the seeded order."""
    return take_split(written(pairs, "fix-pairs"), n_train, n_val, "pair_hash", seed)


def training_columns(pairs: DataFrame) -> DataFrame:
    """The columns that are written out."""
    return pairs.select("input_text", "target_text", "sstub_pattern")


@dataclass(frozen=True)
class PreparedSets:
    train: DataFrame
    val: DataFrame
    train_distribution: DataFrame
    val_distribution: DataFrame
    examples: DataFrame


def prepare_sets(train: DataFrame, val: DataFrame, folder: str, seed: int = 42) -> PreparedSets:
    """Write both sets below ``folder`` unless they are there already, and report on what is there.

    The tables hold the three training columns. A set that was prepared before is read as it
    is. Distributions are rows per pattern; the examples are three rows of the training set.
    """
    spark = train.sparkSession
    sets = []
    for name, frame in (("train", train), ("val", val)):
        write_once(training_columns(frame), f"{folder.rstrip('/')}/{name}")
        sets.append(spark.read.parquet(f"{folder.rstrip('/')}/{name}"))
    counts = [value_counts(frame, "sstub_pattern") for frame in sets]
    return PreparedSets(*sets, *counts, sample_rows(sets[0], 3, ["input_text", "target_text"], seed))
