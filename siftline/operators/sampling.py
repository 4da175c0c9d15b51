"""Exact, reproducible samples and splits.

Randomness comes from one total order: the md5 of seed and row key, then the key.
It does not depend on partitioning, and any other engine can repeat it.

Taking the first ``quota`` rows of a class in that order never ranks the class. A
narrow pass counts rows per leading hex digits of the hash, which finds the bucket
holding the last row wanted; a second narrow pass ranks only that bucket and yields
one cut-off per class. The wide rows are then kept or dropped by comparison with the
cut-off, in the task that read them: they are neither shuffled nor sorted.

The key need not tell rows apart, and without one (None) all columns are the key. Where a
quota ends inside a run of rows with one key, the rows of that run alone are ordered by all
their columns in the same way, and of rows equal in every column, which nothing can tell
apart, the run gives as many copies as the quota still needs.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.counts import class_totals
from siftline.session import bounded_local

log = logging.getLogger(__name__)

#: Up to this many rows a sorted top-n is cheap: every task sends that many wide rows to
#: one reducer, which for thousands of rows and tasks would be a large part of the table.
SMALL_TAKE = 100

#: Equal rows that one task writes out again when a quota ends among them.
RUN_ROWS = 100_000

_HASH, _KEY, _CLASS = "_hash_order", "_key_order", "_class"
_CUT_HASH, _CUT_KEY = "_cut_hash", "_cut_key"


Key = str | list[str] | None


def hash_order(key: str | list[str], seed: int = 42) -> Column:
    """The seeded place of a row, by its ``key``."""
    keys = [key] if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(name).cast("string") for name in keys]))


def _names(df: DataFrame, key: Key) -> list[str]:
    """The columns of the key; all columns without one."""
    return list(df.columns) if key is None else [key] if isinstance(key, str) else list(key)


def _with_order(df: DataFrame, key: Key, seed: int) -> DataFrame:
    names = _names(df, key)
    return df.withColumn(_HASH, hash_order(names, seed)).withColumn(_KEY, F.struct(*names))


def _bucket_digits(rows: int | None) -> int:
    """Hex digits so that the one ranked bucket stays some millions of narrow rows."""
    if rows is None or rows > 2**32:
        return 4
    return 3 if rows > 2**20 else 2


def hash_cutoffs(
    df: DataFrame, quotas: DataFrame, label: str, key: Key, seed: int, rows: int | None
) -> tuple[DataFrame, list[str], bool]:
    """The place of the last row within each class's quota, the columns to join it on, and whether a quota ends in a run.

    ``quotas`` is (label, quota); a class with quota 0 gets no row, one with fewer rows than its quota all of them.
    A cut-off names the last key within the quota, the rows with that key (``_same``) and how many of them the
    quota takes (``_take``). Keys are counted before they are ranked, so one key of any number of rows is one row there. With a bounded number
    of classes the cut-offs are a local table, joined on the class. Past the bound they
    are repeated for every bucket of the class and joined on both, so that the rows of
    one large class are spread over its buckets and do not meet in one task.
    """
    narrow = _with_order(df, key, seed).select(label, _HASH, _KEY)
    bucket = F.substring(_HASH, 1, _bucket_digits(rows))
    counted = narrow.groupBy(label, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    of_class = Window.partitionBy(label)
    up_to = F.sum("_n").over(of_class.orderBy("_bucket"))
    edges = (
        counted.withColumn("_upto", up_to)
        .withColumn("_all", F.sum("_n").over(of_class))
        .join(quotas, label)
        .withColumn("quota", F.least("quota", "_all"))
        .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(label, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    edges, _ = bounded_local(edges)
    up_to_key = F.sum("_same").over(Window.partitionBy(label, "_bucket", "_need").orderBy(_HASH, _KEY))
    cuts = (
        narrow.withColumn("_bucket", bucket)
        .join(edges, [label, "_bucket"])
        .groupBy(label, "_bucket", "_need", _HASH, _KEY)
        .agg(F.count(F.lit(1)).alias("_same"))
        .withColumn("_take", F.col("_need") - up_to_key + F.col("_same"))
        .where(F.col("_take").between(F.lit(1), F.col("_same")))
        .select(label, F.col(_HASH).alias(_CUT_HASH), F.col(_KEY).alias(_CUT_KEY), "_same", "_take")
    )
    cuts, local = bounded_local(cuts)
    split = not cuts.where("_take < _same").isEmpty()
    if local is not None:
        return cuts, [label], split
    return counted.select(label, "_bucket").join(cuts, label), [label, "_bucket"], split


def _within_cut() -> Column:
    here = F.struct(_HASH, _KEY)
    return here <= F.struct(F.col(_CUT_HASH).alias(_HASH), F.col(_CUT_KEY).alias(_KEY))


def flag_quota(
    df: DataFrame,
    quotas: DataFrame,
    label: str,
    key: Key = None,
    seed: int = 42,
    rows: int | None = None,
    into: str = "chosen",
) -> DataFrame:
    """Add a boolean: whether the row is among the first ``quota`` of its class."""
    return _flagged(df, quotas, label, key, seed, rows, into, "left")


def take_quota(df, quotas, label, key: Key = None, seed: int = 42, rows: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each class."""
    return _flagged(df, quotas, label, key, seed, rows, "_chosen", "inner").where("_chosen").select(*df.columns)


def _flagged(df, quotas, label, key: Key, seed: int, rows: int | None, into: str, how: str) -> DataFrame:
    cuts, on, split = hash_cutoffs(df, quotas, label, key, seed, rows)
    placed = _with_order(df, key, seed).withColumn("_bucket", F.substring(_HASH, 1, _bucket_digits(rows)))
    flagged = placed.join(cuts, on, how).withColumn(into, F.coalesce(_within_cut(), F.lit(False)))
    if not split:
        return flagged.select(*df.columns, into)
    at_cut = (F.col(_HASH) == F.col(_CUT_HASH)) & F.col(_KEY).eqNullSafe(F.col(_CUT_KEY))
    in_run = F.coalesce(at_cut & (F.col("_take") < F.col("_same")), F.lit(False))
    run, clear = flagged.where(in_run), flagged.where(~in_run).select(*df.columns, into)
    columns = [name for name in df.columns if name != _CLASS]
    if set(_names(df, key)) >= set(columns):
        parted = _copies_of_run(run, df.columns, label, into)
    else:
        needs = cuts.where("_take < _same").select(label, F.col("_take").alias("quota")).distinct()
        parted = _flagged(run.select(*df.columns), needs, label, columns, seed, rows, into, how)
    return clear.unionByName(parted)


def _copies_of_run(run: DataFrame, columns: list[str], label: str, into: str) -> DataFrame:
    """Rows equal in every column, one run a class: as many copies as there are, of which the first ``_take`` are chosen."""
    one = run.groupBy(label).agg(F.first(F.struct(*columns)).alias("_row"), F.first("_take").alias("_take"), F.first("_same").alias("_same"))
    parts = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1, F.lit(RUN_ROWS).cast("long"))))
    copies = parts.repartition(label, "_from").withColumn(
        "_nth", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + RUN_ROWS, F.col("_same"))))
    )
    return copies.select("_row.*", (F.col("_nth") <= F.col("_take")).alias(into))


def _local_totals(df: DataFrame, label: str) -> tuple[DataFrame, int | None]:
    """Rows per class as a local table where it is small, and the grand total then."""
    totals, local = bounded_local(class_totals(df, label).where(F.col(label).isNotNull()))
    rows = None if local is None else sum(local.column("n").to_pylist())
    return totals, rows


def _all_classes():
    """The window of the quota rules: it sees one row per class."""
    return Window.partitionBy()


def proportional_quotas(totals: DataFrame, label: str, target: int) -> DataFrame:
    """Per class ``min(n, max(1, round(n * target / N)))``, halves to even."""
    share = F.bround(F.col("n") * (F.lit(target) / F.sum("n").over(_all_classes()))).cast("long")
    return totals.select(label, F.least("n", F.greatest(F.lit(1), share)).alias("quota"))


def stratified_sample(
    df: DataFrame, label: str, target: int, key: Key = None, seed: int = 42
) -> DataFrame:
    """About ``target`` rows with the class shares of ``df``, at least one per class."""
    totals, rows = _local_totals(df, label)
    return take_quota(df, proportional_quotas(totals, label, target), label, key, seed, rows)


def split_quotas(totals: DataFrame, label: str, fraction: float) -> DataFrame:
    """Test rows per class: ``ceil(fraction * N)`` shared by largest remainder."""
    whole = F.sum("n").over(_all_classes())
    sized = totals.withColumn("_N", whole).withColumn("_T", F.ceil(F.col("_N") * F.lit(fraction)))
    # Exact integer arithmetic: n * T passes 64 bits on very large tables.
    product = "CAST(n AS DECIMAL(19,0)) * CAST(_T AS DECIMAL(19,0))"
    based = sized.withColumn("_base", F.expr(f"({product}) DIV CAST(_N AS DECIMAL(19,0))")).withColumn(
        "_rest", F.expr(f"CAST(({product}) % CAST(_N AS DECIMAL(19,0)) AS BIGINT)")
    )
    spare = F.col("_T") - F.sum("_base").over(_all_classes())
    rank = F.row_number().over(_all_classes().orderBy(F.desc("_rest"), label))
    return based.select(label, (F.col("_base") + F.when(rank <= spare, 1).otherwise(0)).alias("quota"))


def flag_split(df, label: str, fraction: float, key, seed: int = 42, into: str = "in_test") -> DataFrame:
    """Add a boolean that marks the test rows of an exact stratified split."""
    totals, rows = _local_totals(df, label)
    return flag_quota(df, split_quotas(totals, label, fraction), label, key, seed, rows, into)


def stratified_split(
    df: DataFrame, label: str, fraction: float, key: Key = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, together ``df``, class shares kept exactly."""
    flagged = flag_split(df, label, fraction, key, seed)
    return flagged.where(~F.col("in_test")).drop("in_test"), flagged.where("in_test").drop("in_test")


def fill_quotas(totals: DataFrame, label: str, total: int, named: dict[str, int]) -> DataFrame:
    """Fixed quotas for named classes, the remainder shared by size over the others.

    Shares are rounded (halves to even) and capped at the class size. Rounding can
    miss the remainder by at most half the number of classes, and at least twice as
    many classes were rounded the wrong way, so moving the first classes in name
    order by one row each always closes the gap.
    """
    want = F.lit(None).cast("long")
    for name, count in named.items():
        want = F.when(F.col(label) == name, F.lit(count).cast("long")).otherwise(want)
    fixed = totals.withColumn("_want", want).withColumn(
        "_fixed", F.when(F.col("_want").isNotNull(), F.least("_want", "n")).otherwise(0)
    )
    other = F.when(F.col("_want").isNull(), F.col("n")).otherwise(0)
    sized = fixed.withColumn(
        "_left", F.greatest(F.lit(total) - F.sum("_fixed").over(_all_classes()), F.lit(0))
    ).withColumn("_pool", F.sum(other).over(_all_classes()))
    share = F.bround(F.col("_left").cast("double") * F.col("n") / F.col("_pool")).cast("long")
    shared = sized.withColumn("_share", F.when(F.col("_want").isNull(), F.least(share, "n")))
    gapped = shared.withColumn("_gap", F.col("_left") - F.sum("_share").over(_all_classes()))
    movable = F.when(F.col("_gap") > 0, F.col("_share") < F.col("n")).otherwise(F.col("_share") > 0)
    movable = F.coalesce(movable, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_movable").orderBy(label))
    step = F.when(F.col("_movable") & (rank <= F.abs("_gap")), F.signum("_gap").cast("long")).otherwise(0)
    return gapped.withColumn("_movable", movable).select(
        label, F.when(F.col("_want").isNull(), F.col("_share") + step).otherwise(F.col("_fixed")).alias("quota")
    )


def quota_sample(
    df: DataFrame, label: str, total: int, named: dict[str, int], key: Key = None, seed: int = 42
) -> DataFrame:
    """``total`` rows: fixed numbers of the named classes, the rest by class size."""
    totals, rows = _local_totals(df, label)
    return take_quota(df, fill_quotas(totals, label, total, named), label, key, seed, rows)


def flag_quota_sample(
    df: DataFrame, label: str, total: int, named: dict[str, int], key, seed: int = 42, into: str = "chosen"
) -> DataFrame:
    """Add a boolean that marks the rows of ``quota_sample``, so that the others need no anti join."""
    totals, rows = _local_totals(df, label)
    return flag_quota(df, fill_quotas(totals, label, total, named), label, key, seed, rows, into)


def _whole(df: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``df`` as one class, and its quota."""
    quota = pa.table({_CLASS: pa.array([0], pa.int32()), "quota": pa.array([size], pa.int64())})
    return df.withColumn(_CLASS, F.lit(0)), df.sparkSession.createDataFrame(quota)


def _global_cuts(df: DataFrame, sizes: list[int], key: Key, seed: int, total: int) -> list[Column] | None:
    """For each size, the condition that a row is among that many first rows; None if a size ends in a run of one key."""
    keys = _names(df, key)
    sizes = [min(size, total) for size in sizes]
    wanted = sorted({size for size in sizes if size > 0})
    found = {0: F.lit(False)}
    if wanted:
        quotas = df.sparkSession.createDataFrame(
            pa.table({_CLASS: pa.array([0] * len(wanted), pa.int32()), "quota": pa.array(wanted, pa.int64())})
        )
        keyed = df.select(*keys).withColumn(_CLASS, F.lit(0))
        cuts, _, split = hash_cutoffs(keyed, quotas, _CLASS, keys, seed, total)
        if split:
            return None
        cuts = cuts.orderBy(_CUT_HASH, _CUT_KEY).collect()
        for size, cut in zip(wanted, cuts, strict=True):
            at_key = F.struct(*[F.lit(cut[_CUT_KEY][k]).cast(df.schema[k].dataType).alias(k) for k in keys])
            at = F.struct(F.lit(cut[_CUT_HASH]).alias(_HASH), at_key.alias(_KEY))
            found[size] = F.struct(_HASH, _KEY) <= at
    return [found[size] for size in sizes]


def shuffle(df: DataFrame, key: Key = None, seed: int = 42) -> DataFrame:
    """All rows in seeded order: a range-partitioned sort. Rows with one key follow each other in any order."""
    return _with_order(df, key, seed).orderBy(_HASH, _KEY).select(*df.columns)


def take_first(
    df: DataFrame, n: int, key: Key = None, seed: int = 42, total: int | None = None
) -> DataFrame:
    """The first ``n`` rows in seeded order, as a set, with no sort for large ``n``.

    ``total`` saves counting ``df`` where its size is known.
    """
    if n <= SMALL_TAKE:
        placed = _with_order(df, key, seed)
        return placed.orderBy(_HASH, _KEY, hash_order(df.columns, seed)).limit(n).select(*df.columns)
    total = df.count() if total is None else total
    cuts = _global_cuts(df, [n], key, seed, total)
    if cuts is None:
        whole, quota = _whole(df, n)
        return take_quota(whole, quota, _CLASS, _names(df, key), seed, total).select(*df.columns)
    return _with_order(df, key, seed).where(cuts[0]).select(*df.columns)


def sample_rows(df: DataFrame, n: int, key: Key = None, seed: int = 42) -> DataFrame:
    """A few rows to look at."""
    return take_first(df, n, key, seed)


def take_split(
    df: DataFrame, n_train: int, n_val: int, key: Key = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(first ``n_train`` rows, next ``n_val`` rows) in seeded order.

    Short tables give what they have, with a warning. Both parts are filters on the
    scan, whatever their size.
    """
    total = df.count()
    if total < n_train + n_val:
        log.warning("only %d rows for %d train and %d validation rows", total, n_train, n_val)
    cuts = _global_cuts(df, [n_train, n_train + n_val], key, seed, total)
    if cuts is None:
        # the first rows of the first rows: the same order holds in both steps
        both, quota = _whole(take_first(df, n_train + n_val, key, seed, total), n_train)
        flagged = flag_quota(both, quota, _CLASS, _names(df, key), seed, total, "_train")
        return flagged.where("_train").select(*df.columns), flagged.where("NOT _train").select(*df.columns)
    train, both = cuts
    placed = _with_order(df, key, seed)
    return placed.where(train).select(*df.columns), placed.where(both & ~train).select(*df.columns)


def balanced_holdout(
    df: DataFrame, label: str, k: int, per_class: int, total: int, key: Key = None, seed: int = 42
) -> DataFrame:
    """``per_class`` rows of each of the ``k`` largest classes, topped up to ``total``.

    The top-up takes any rows not yet chosen, in seeded order.
    """
    totals, rows = _local_totals(df, label)
    quotas = (
        totals.orderBy(F.desc("n"), label)
        .limit(k)
        .select(label, F.least("n", F.lit(per_class)).alias("quota"))
    )
    quotas, _ = bounded_local(quotas)
    chosen = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    flagged = flag_quota(df, quotas, label, key, seed, rows)
    held = flagged.where("chosen").drop("chosen")
    if chosen >= total:
        return held
    rest = flagged.where("NOT chosen").drop("chosen")
    left = df.count() - chosen
    return held.unionByName(take_first(rest, total - chosen, key, seed, left))
