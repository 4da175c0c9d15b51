import pytest
from pyspark.sql import functions as F

from siftline.operators import curate, filters, repair_text, skew
from siftline.operators.counts import balanced_weights, class_distribution, counters, most_common, value_counts


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_map_labels(spark):
    data = [
        ("a", "Correct", "variable_misuse_datasets"),
        ("b", "Variable misuse", "variable_misuse_datasets"),
        ("c", "Swapped operands", "variable_misuse_datasets"),
        ("d", None, "variable_misuse_datasets"),
        ("e", "Swapped operands", "swapped_operands_datasets"),
    ]
    raw = spark.createDataFrame(data, "function string, label string, source_task string")
    assert [r[:3] for r in rows(curate.map_labels(raw))] == [
        ("a", 0, "Clean"), ("b", 2, "Variable Misuse"), ("e", 3, "Swapped Operand"),
    ]
    assert rows(curate.skipped_labels(raw)) == [("variable_misuse_datasets", 2)]


def test_dedupe_first_keeps_the_first_and_one_null(spark):
    data = [(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None)]
    df = spark.createDataFrame(data, "id int, text string")
    assert sorted(r["id"] for r in curate.dedupe_first(df, F.md5("text"), "id").collect()) == [1, 2, 4]


def test_dedupe_with_one_hot_key(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = curate.dedupe_first(df, "k", "id")
    assert got.count() == 66_667 and got.where("k = 'hot'").first()["id"] == 0


def test_dedupe_clean_leaves_buggy_rows(spark):
    data = [(1, "f", 0), (2, "f", 0), (3, "f", 1), (4, "f", 1)]
    df = spark.createDataFrame(data, "id int, function string, label int")
    assert [r[0] for r in rows(curate.dedupe_clean(df, "function", "label", "id"))] == [1, 3, 4]


def test_exclude_and_overlap(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",), ("b",), (None,)], "k string")
    kept = [row["k"] for row in curate.exclude_seen(left, right, "k").collect()]
    assert sorted(kept, key=str) == [None, "a", "a"]
    assert rows(curate.overlap(left, right, "k")) == [("b",)]
    with pytest.raises(AssertionError):
        curate.assert_disjoint(left, right, "k")
    curate.assert_disjoint(left.where("k = 'a'"), right, "k")


def test_exclude_seen_with_hot_keys(spark):
    """A third of the rows share a key that is not seen, a sixth have none: every task gets a part."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for name, value in settings:
        spark.conf.set(name, value)
    try:
        n = F.col("id")
        key = F.when(n % 3 == 0, "hot").when(n % 6 == 1, F.lit(None)).when(n % 6 == 2, "seen").otherwise(n.cast("string"))
        df = spark.range(60_000).select("id", key.alias("k"))
        seen = spark.createDataFrame([("seen",), ("4",)], "k string").unionByName(spark.range(5, 30_000, 12).select(n.cast("string").alias("k")))
        assert "hot" in skew.hot_keys(df, "k")
        got = curate.exclude_seen(df, seen, "k")
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        gone = {"seen", "4"} | {str(i) for i in range(5, 30_000, 12)}
        wanted = {row["id"] for row in df.collect() if row["k"] not in gone}
        rows_of = got.groupBy(F.spark_partition_id()).count().collect()
        assert {row["id"] for row in got.collect()} == wanted
        assert max(row["count"] for row in rows_of) < len(wanted) / 2
    finally:
        for name, _ in settings:
            spark.conf.unset(name)


def test_counts(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    assert [tuple(r) for r in class_distribution(df).collect()] == [(0, 2, 66.7), (1, 1, 33.3)]
    assert [tuple(r) for r in value_counts(df, "label").collect()] == [(0, 2), (1, 1)]
    assert [tuple(r) for r in most_common(df, "label", 1).collect()] == [(0, 2)]
    assert sorted(r["weight"] for r in balanced_weights(df).collect()) == [0.75, 0.75, 1.5]


def test_counters(spark):
    assert counters(spark.range(10), odd=F.col("id") % 2 == 1).first().asDict() == {"total": 10, "odd": 5}


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.30), (2, 0.2999), (3, 0.9)], "id int, probability double")
    assert [r["id"] for r in filters.gate(filters.flag_binary(df)).collect()] == [1, 3]
    labels = spark.createDataFrame([(0,), (2,)], "label int")
    assert [r["label"] for r in filters.gate(filters.flag_multiclass(labels), "pass_on").collect()] == [2]


def test_repair_texts(spark):
    df = spark.createDataFrame([("c", ""), ("c", " add nums "), ("c", "  "), ("c", None)], "code string, intent string")
    got = [r["repair_input"] for r in repair_text.build_repair_input(df, "code", "intent").collect()]
    assert got == ["fix: c", "fix intent: add nums code: c", "fix intent:  code: c", "fix: c"]
    assert df.select(repair_text.repair_input(F.col("code"), prefix="")).first()[0] == "c"
    prompt = repair_text.build_review_prompt(spark.createDataFrame([("a %s", "b")], "x string, y string"), "x", "y").first()["prompt"]
    assert "Buggy Code: a %s\n" in prompt and "Fixed Code: b\n" in prompt


def test_blank_and_feedback(spark):
    df = spark.createDataFrame([("a",), (" \t\u3000",), ("",), (None,)], "code string")
    assert filters.drop_blank(df).count() == 1
    data = [(" x ", "y"), (None, "y\n"), (None, None)]
    got = repair_text.coalesce_feedback(spark.createDataFrame(data, "a string, b string"), ["a", "b"])
    assert [r["feedback"] for r in got.collect()] == ["x", "y", None]


def test_bitmap_never_loses_a_key(spark):
    from siftline.operators.bitmaps import ROW_BITS, bitmap_bits, key_bitmap, maybe_among

    keys = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    bits = bitmap_bits(5000)
    assert bits % ROW_BITS == 0 and 5000 * 16 <= bits <= 5000 * 64
    rows = spark.range(50_000).withColumn("id", F.when(F.col("id") % 100 < 99, F.col("id")))
    found, may = maybe_among(rows, key_bitmap(keys, bits), F.when(F.col("id").isNotNull(), F.xxhash64("id")), bits)
    got = found.select("id", may.alias("may"))
    assert got.where("id < 5000 AND NOT may").count() == 0 and got.where("id IS NULL AND may").count() == 0
    assert got.count() == 50_000 and got.where("id >= 5000 AND may").count() < 3000
    empty, none = maybe_among(rows, key_bitmap(keys.limit(0), bits), F.xxhash64("id"), bits)
    assert empty.where(none).count() == 0


def test_rows_surely_unseen_stay_out_of_the_shuffle(spark):
    from siftline.operators.skew import surely_apart

    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("_salt"))
    df = df.unionByName(spark.createDataFrame([(None, "n")], "k string, _salt string"))
    seen = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 3).alias("k"))
    apart, rest = surely_apart(df, seen, "k")
    assert apart.where("k IS NULL").count() == 1 and rest.count() < 2500 and apart.count() + rest.count() == 20_001
    assert rest.join(seen, "k").count() == 300
