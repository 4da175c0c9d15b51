import hashlib
import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.operators import sampling as S

COUNTS = {0: 939_851, 1: 380_504, 2: 577_313, 3: 196_668}


def totals(spark, counts, kind="label int"):
    return spark.createDataFrame(list(counts.items()), f"{kind}, n long")


def quotas(df):
    return {row[0]: row[1] for row in df.collect()}


def test_published_sample_counts(spark):
    got = quotas(S.proportional_quotas(totals(spark, COUNTS), "label", 175_000))
    assert got == {0: 78_533, 1: 31_794, 2: 48_240, 3: 16_433}


def test_published_split_counts(spark):
    got = quotas(S.split_quotas(totals(spark, {0: 78_533, 1: 31_794, 2: 48_240, 3: 16_433}), "label", 0.2))
    assert got == {0: 15_707, 1: 6_359, 2: 9_648, 3: 3_286}


def test_split_of_a_trillion_rows_is_exact(spark):
    counts = {0: 3 * 10**12 + 1, 1: 10**12 + 7, 2: 5}
    got = quotas(S.split_quotas(totals(spark, counts), "label", 0.2))
    assert sum(got.values()) == math.ceil(0.2 * sum(counts.values()))


def test_every_class_is_sampled(spark):
    assert quotas(S.proportional_quotas(totals(spark, {0: 1000, 1: 1}), "label", 10)) == {0: 10, 1: 1}
    assert quotas(S.proportional_quotas(totals(spark, {0: 3, 1: 1}), "label", 100)) == {0: 3, 1: 1}


FILLS = [
    ({"A": 50, "B": 30, "C": 20, "D": 3}, 40, {"A": 20, "B": 10}, {"A": 20, "B": 10, "C": 9, "D": 1}),
    ({"A": 50, "B": 30, "C": 20, "D": 3}, 60, {"A": 20, "B": 10}, {"A": 20, "B": 10, "C": 20, "D": 3}),
    ({"C": 5, "D": 5, "E": 5}, 10, {}, {"C": 4, "D": 3, "E": 3}),
    ({"C": 6, "D": 6, "E": 6}, 5, {}, {"C": 1, "D": 2, "E": 2}),
    ({"A": 5, "B": 4}, 3, {"A": 20}, {"A": 5, "B": 0}),
    ({"A": 5}, 3, {"Z": 20}, {"A": 3}),
]


@pytest.mark.parametrize(("counts", "total", "named", "expected"), FILLS)
def test_fill_quotas(spark, counts, total, named, expected):
    got = quotas(S.fill_quotas(totals(spark, counts, "label string"), "label", total, named))
    assert got == expected


def cycle_fill(counts, total):
    """The rule of cycling through the classes one row at a time, as an independent check."""
    share = {k: min(round(total * n / sum(counts.values())), n) for k, n in counts.items()}
    while sum(share.values()) < total and any(share[k] < counts[k] for k in counts):
        for k in counts:
            if sum(share.values()) < total and share[k] < counts[k]:
                share[k] += 1
    while sum(share.values()) > total:
        for k in counts:
            if sum(share.values()) > total and share[k] > 0:
                share[k] -= 1
    return share


def test_one_round_closes_every_gap(spark):
    import random

    rng = random.Random(3)
    for _ in range(12):
        counts = {f"k{n:02d}": rng.randint(1, 40) for n in range(rng.randint(1, 12))}
        total = rng.randint(1, sum(counts.values()) + 5)
        got = quotas(S.fill_quotas(totals(spark, counts, "label string"), "label", total, {}))
        assert got == cycle_fill(counts, total)


def place(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key


def skewed(spark, rows=3000, partitions=3):
    label = F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 7).cast("int"))
    return spark.range(rows).repartition(partitions).select("id", label.alias("label"))


def brute_sample(rows, target):
    sizes, out = Counter(label for _, label in rows), set()
    for label, size in sizes.items():
        quota = min(size, max(1, round(size * (target / len(rows)))))
        out |= set(sorted((place(i)[0], i) for i, other in rows if other == label)[:quota])
    return {i for _, i in out}


def test_sample_is_exact_on_any_partitioning(spark):
    rows = [(r["id"], r["label"]) for r in skewed(spark).collect()]
    wanted = brute_sample(rows, 500)
    for partitions in (1, 8, 50):
        got = S.stratified_sample(skewed(spark, partitions=partitions), "label", 500, "id")
        assert {r["id"] for r in got.collect()} == wanted


def test_split_parts(spark):
    train, test = S.stratified_split(skewed(spark), "label", 0.2, "id")
    train_ids, test_ids = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert len(test_ids) == 600 and not train_ids & test_ids and len(train_ids | test_ids) == 3000


def test_many_classes_take_the_lazy_path(spark, monkeypatch):
    from siftline import session

    monkeypatch.setattr(session.bounded_local, "__defaults__", (2,))
    wanted = brute_sample([(r["id"], r["label"]) for r in skewed(spark).collect()], 500)
    got = S.stratified_sample(skewed(spark), "label", 500, "id")
    assert "_bucket" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in got.collect()} == wanted
    train, test = S.stratified_split(skewed(spark), "label", 0.2, "id")
    assert (train.count(), test.count()) == (2400, 600)


@pytest.mark.parametrize("sizes", [(10, 5), (11_000, 500), (11_000, 0), (0, 5), (50_000, 10), (19_999, 10)])
def test_take_split_is_the_seeded_order(spark, sizes):
    ids = [i for _, i in sorted(place(i) for i in range(20_000))]
    train, val = S.take_split(spark.range(20_000), *sizes, "id")
    assert {r["id"] for r in train.collect()} == set(ids[: sizes[0]])
    assert {r["id"] for r in val.collect()} == set(ids[sizes[0] : sum(sizes)])


@pytest.mark.parametrize("n", [0, 3, 101, 10_001, 30_000])
def test_take_first(spark, n):
    ids = [i for _, i in sorted(place(i) for i in range(20_000))]
    assert {r["id"] for r in S.take_first(spark.range(20_000), n, "id").collect()} == set(ids[:n])


def test_shuffle_keeps_all_rows_in_order(spark):
    got = [r["id"] for r in S.shuffle(spark.range(100), "id", 7).collect()]
    assert got == [i for _, i in sorted(place(i, 7) for i in range(100))]


def test_holdout(spark):
    rows = [(r["id"], r["label"]) for r in skewed(spark).collect()]
    sizes = Counter(label for _, label in rows)
    top = sorted(sizes, key=lambda label: (-sizes[label], label))[:3]
    chosen = set()
    for label in top:
        chosen |= {i for _, i in sorted(place(i) for i, other in rows if other == label)[:20]}
    rest = [i for _, i in sorted(place(i) for i, _ in rows if i not in chosen)]
    got = {r["id"] for r in S.balanced_holdout(skewed(spark), "label", 3, 20, 100, "id").collect()}
    assert got == chosen | set(rest[: 100 - len(chosen)])


def test_empty_table(spark):
    empty = skewed(spark).limit(0)
    assert S.stratified_sample(empty, "label", 10, "id").count() == 0
    train, test = S.stratified_split(empty, "label", 0.2, "id")
    assert train.count() == test.count() == 0
    assert [part.count() for part in S.take_split(empty, 5, 5, "id")] == [0, 0]
    assert S.balanced_holdout(empty, "label", 3, 2, 10, "id").count() == 0


def test_wide_rows_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "wide")
    skewed(spark).withColumn("text", F.repeat(F.lit("x"), 100)).write.parquet(path)
    sample = S.stratified_sample(spark.read.parquet(path), "label", 500, "id")
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_local_tables_are_arrow(spark):
    from siftline.session import bounded_local

    df, local = bounded_local(spark.range(5))
    assert isinstance(local, pa.Table) and df.count() == 5


def test_a_quota_above_the_class_size_takes_the_class(spark):
    df = spark.range(10).selectExpr("id", "'a' AS label")
    quotas = spark.createDataFrame([("a", 50)], "label string, quota long")
    assert S.take_quota(df, quotas, "label", "id").count() == 10


def test_repeated_keys_give_exact_numbers(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_ROWS", 4)
    same = spark.range(20).selectExpr("1 AS id", "'a' AS label")
    assert S.stratified_sample(same, "label", 10, "id").count() == 10
    train, test = S.stratified_split(same.withColumn("n", F.lit(1.5)), "label", 0.25, None)
    assert (train.count(), test.count()) == (15, 5)
    assert [part.count() for part in S.take_split(same, 12, 5)] == [12, 5]
    assert S.take_first(same, 200).count() == 20


def test_a_hot_key_is_ordered_by_all_columns(spark):
    """A third of the rows share the null key; every size and quota is met, reruns and partitions agree, and parts are disjoint."""
    rows = [(None if i % 3 == 0 else i // 4, i // 2 * 2, "ab"[i % 2], f"t{i % 50}") for i in range(900)]
    frames = [spark.createDataFrame(rows, "id int, n int, label string, text string").repartition(p) for p in (1, 6)]
    for size in (101, 150, 333, 500, 640):
        first = [sorted(map(str, S.take_first(f, size, "id").collect())) for f in frames]
        assert len(first[0]) == size and first[0] == first[1]
        train, val = (sorted(map(str, p.collect())) for p in S.take_split(frames[1], size, 200, "id"))
        assert train == first[0] and train + val != val and sorted(train + val) == sorted(map(str, S.take_first(frames[0], size + 200, "id").collect()))
    for fraction in (0.1, 0.37, 0.5):
        train, test = (p.collect() for p in S.stratified_split(frames[0], "label", fraction, "id"))
        assert sorted(map(str, train + test)) == sorted(map(str, frames[0].collect())) and len(test) == -(-900 * fraction // 1)
    held = S.balanced_holdout(frames[0], "label", 2, 100, 300, "id")
    assert held.count() == 300
