import pytest
from pyspark.sql import functions as F

from siftline.operators.diffs import extract_diff
from siftline.operators.filters import LOOSE, STRICT, filter_likely_bug, filter_pattern
from siftline.plans import fix_pairs
from siftline.plans.fix_pairs import filter_funnel, loose_sets, mine_fix_pairs, strict_sets, training_columns
from siftline.sources import parse_records

DIFFS = [
    ("--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n def f():\n-  return 1  \n+  return 2\n # end", ("return 1", "return 2"), ("def f():\n  return 1\n# end", "return 1", "return 2")),
    ("-a\n-b\n+c", ("a\nb", "c"), ("a\nb", "a\nb", "c")),
    ("---x\n-y\n+z", ("y", "z"), ("y", "y", "z")),
    ("-a\n\\ No newline at end of file\n+b", ("a", "b"), ("a\n\\ No newline at end of file", "a", "b")),
    ("+c", ("", "c"), ("", "", "c")),
    ("-a  \n-b \n+c", ("a  \nb", "c"), ("a\nb", "a\nb", "c")),
    ("", ("", ""), ("", "", "")),
    (None, (None, None), (None, None, None)),
]


def test_sides_by_hand(spark):
    rows = [(number, diff) for number, (diff, _, _) in enumerate(DIFFS)]
    df = spark.createDataFrame(rows, "id int, diff string")
    for row in extract_diff(df).collect():
        assert (row["buggy"], row["fixed"]) == DIFFS[row["id"]][1]
    for row in extract_diff(df, context=True).collect():
        assert (row["input_with_context"], row["buggy"], row["fixed"]) == DIFFS[row["id"]][2]


def test_filters_read_computed_sides_once(spark):
    sides = extract_diff(spark.createDataFrame([(1, "-a\n+b")], "id int, diff string"))
    plan = sides.where("buggy <> fixed AND length(buggy) < 400")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


RECORDS = [
    ('{"sstub_pattern": "CHANGE_X", "likely_bug": true}', True, True),
    ('{"sstub_pattern": "SINGLE_STMT", "likely_bug": true}', False, False),
    ('{"sstub_pattern": "  ", "likely_bug": true}', False, True),
    ('{"sstub_pattern": "", "likely_bug": true}', False, False),
    ('{"sstub_pattern": 5, "likely_bug": true}', False, True),
    ('{"sstub_pattern": null, "likely_bug": true}', False, False),
    ('{"likely_bug": true}', False, False),
    *[('{"sstub_pattern": "P", "likely_bug": %s}' % flag, False, True) for flag in ("1", '"yes"', '"0"', "[0]", '{"a":0}', "0.5", "-1", "1e3")],
    *[('{"sstub_pattern": "P", "likely_bug": %s}' % flag, False, False) for flag in ("false", "0", "0.0", '""', "[]", "{}", "null", "-0", "0e5")],
    ('{"sstub_pattern": "P"}', False, False),
]


@pytest.mark.parametrize(("mode", "place"), [(STRICT, 1), (LOOSE, 2)])
def test_record_filters(spark, mode, place):
    lines = spark.createDataFrame([(n, row[0]) for n, row in enumerate(RECORDS)], "id int, value string")
    kept = filter_likely_bug(filter_pattern(parse_records(lines), mode), mode)
    assert sorted(row["id"] for row in kept.collect()) == [n for n, row in enumerate(RECORDS) if row[place]]


def test_typed_records(spark):
    df = spark.createDataFrame([(1, "P", True), (2, " ", True), (3, None, True), (4, "P", False)], "id int, sstub_pattern string, likely_bug boolean")
    strict = filter_likely_bug(filter_pattern(df, STRICT), STRICT)
    loose = filter_likely_bug(filter_pattern(df, LOOSE), LOOSE)
    assert [r["id"] for r in strict.collect()] == [1]
    assert sorted(r["id"] for r in loose.collect()) == [1, 2]


def _records(spark, count=400):
    n = F.col("id")
    diff = F.concat(F.lit("-a + x"), (n % 150).cast("string"), F.lit("\n+a - x"), n.cast("string"))
    pattern = F.concat(F.lit("P"), (n % 5).cast("string"))
    return spark.range(count).select(n, diff.alias("diff"), pattern.alias("sstub_pattern"), F.lit(True).alias("likely_bug"))


def test_mining_keeps_the_first_copy(spark):
    pairs = mine_fix_pairs(_records(spark), STRICT, "id").collect()
    assert len(pairs) == 150
    assert all(row["target_text"] == row["input_text"].replace("+", "-") for row in pairs)


def test_length_caps(spark):
    rows = [(1, "-" + "a" * 400 + "\n+b"), (2, "-" + "a" * 401 + "\n+b"), (3, " " + "c" * 199 + "\n-" + "e" * 400 + "\n+b"), (4, " " + "c" * 200 + "\n-" + "d" * 400 + "\n+b")]
    df = spark.createDataFrame(rows, "id int, diff string").withColumn("sstub_pattern", F.lit("P")).withColumn("likely_bug", F.lit(True))
    assert len(mine_fix_pairs(df, STRICT, "id").collect()) == 3
    assert sorted(len(r["input_text"]) for r in mine_fix_pairs(df, LOOSE, "id").collect()) == [400, 401, 600]


def test_funnel(spark):
    row = filter_funnel(_records(spark)).first().asDict()
    assert row == {"raw": 400, "specific_pattern": 400, "likely_bug": 400, "both_sides": 400, "changed": 400, "short_enough": 400, "distinct_pairs": 150}


def test_training_sets(spark):
    pairs = mine_fix_pairs(_records(spark), STRICT, "id")
    train, val = strict_sets(pairs, 60, {"P1": 10, "P2": 5}, (2, 5, 20))
    assert train.count() == 60 and val.count() == 20
    assert train.where("sstub_pattern = 'P1'").count() == 10
    assert training_columns(train).columns == ["input_text", "target_text", "sstub_pattern"]
    first, second = loose_sets(pairs, 100, 100)
    assert (first.count(), second.count()) == (100, 50)
    assert first.join(second, "pair_hash").count() == 0


def test_prepared_sets_are_written_once(spark, tmp_path):
    pairs = spark.range(30).selectExpr("concat('a', id) AS input_text", "'b' AS target_text", "concat('P', id % 2) AS sstub_pattern", "md5(string(id)) AS pair_hash")
    train, val = fix_pairs.loose_sets(pairs, 20, 10)
    first = fix_pairs.prepare_sets(train, val, str(tmp_path))
    again = fix_pairs.prepare_sets(val, train, str(tmp_path))
    assert (first.train.count(), first.val.count(), again.train.count()) == (20, 10, 20)
    assert first.train.columns == ["input_text", "target_text", "sstub_pattern"]
    assert sum(r["n"] for r in first.train_distribution.collect()) == 20
    assert first.examples.count() == 3
