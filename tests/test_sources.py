import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftline import schemas
from siftline.operators.curate import map_labels
from siftline.operators.sampling import stratified_sample, stratified_split
from siftline.plans.fix_pairs import mine_fix_pairs
from siftline.session import shared_folder, written
from siftline.sources import (
    parse_records,
    read_code_csv,
    read_commit_records,
    read_labelled_functions,
    read_lint_reports,
    read_source_files,
    write_code_csv,
    write_once,
)
from siftline.sources.records import RECORD_ORDER


def record(diff, **more):
    return json.dumps({"diff": diff, "sstub_pattern": "P", "likely_bug": True, **more}).encode()


def test_sharded_records(spark, tmp_path):
    first = [record("-a\n+1", project="p", comodified=False, edit_script=[["Insert", 1]]), b"", b"   ", b"not json", b'{"diff": "-c'] 
    second = [record("-a\n+2"), record("-b\n+2"), b'{"diff": 5, "sstub_pattern": "P\xff", "likely_bug": true}', b"\xc2\xa0" + record("-z\n+y")]
    for name, lines in (("file-1.jsonl.gz", second), ("file-0.jsonl.gz", first)):
        with gzip.open(tmp_path / name, "wb") as out:
            out.write(b"\n".join(lines) + b"\n")
    for partitions in (None, 5):
        records = read_commit_records(spark, str(tmp_path / "*.jsonl.gz"), partitions)
        got = records.orderBy(*RECORD_ORDER).collect()
        assert [row["diff"] for row in got] == ["-a\n+1", "-a\n+2", "-b\n+2", "5", "-z\n+y"]
        assert (got[0]["project"], got[0]["comodified"], got[0]["edit_script"]) == ("p", False, '[["Insert",1]]')
        assert got[0]["in_function"] is None
        assert records.select(F.to_json("sstub_pattern")).distinct().collect() == [('"P"',)]
        pairs = mine_fix_pairs(records, "strict", RECORD_ORDER).collect()
        assert sorted((r["input_text"], r["target_text"]) for r in pairs) == [("a", "1"), ("b", "2"), ("z", "y")]


def test_no_shards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_commit_records(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        read_commit_records(spark, str(tmp_path / "*.gz"))


def test_labelled_splits(spark, tmp_path):
    frame = spark.createDataFrame([("f", "Correct")], schemas.RAW_LABELLED)
    frame.write.parquet(str(tmp_path / "train"))
    paths = {"t": {"train": str(tmp_path / "train"), "dev": str(tmp_path / "dev")}}
    assert [tuple(r) for r in read_labelled_functions(spark, paths).collect()] == [("f", "Correct", "t", "train")]
    with pytest.raises(FileNotFoundError):
        read_labelled_functions(spark, {"t": {"dev": str(tmp_path / "dev")}})


def test_row_keys_tell_equal_rows_apart(spark, tmp_path):
    frame = spark.createDataFrame([("f", "Correct")] * 30 + [("g", "Wrong binary operator")] * 10, schemas.RAW_LABELLED)
    frame.write.parquet(str(tmp_path / "parquet"))
    frame.write.json(str(tmp_path / "json"))
    for fmt in ("parquet", "json"):
        paths = {"wrong_binary_operator_datasets": {"train": str(tmp_path / fmt)}}
        rows = map_labels(read_labelled_functions(spark, paths, fmt, row_key="row"))
        assert rows.select("row").distinct().count() == 40
        sample = stratified_sample(rows, "label", 20, "row")
        assert sorted(map(tuple, sample.groupBy("label").count().collect())) == [(0, 15), (1, 5)]
        train, test = stratified_split(rows, "label", 0.2, "row")
        assert (train.count(), test.count()) == (32, 8)


def test_csv_keeps_text(spark, tmp_path):
    texts = ['a "quoted", b', "line\nbreak\n", "  spaces  ", "cr\r\nlf", "back\\slash \\\" x", "NA", "null", '"', "é "]
    df = spark.createDataFrame([(t, t, "P") for t in texts], schemas.FIX_PAIR)
    write_code_csv(df, str(tmp_path / "csv"))
    got = read_code_csv(spark, str(tmp_path / "csv"), schemas.FIX_PAIR).collect()
    assert sorted(r["input_text"] for r in got) == sorted(texts)
    assert all(r["input_text"] == r["target_text"] for r in got)


def test_source_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "pkg" / "b.py").write_text("z = 3")
    (tmp_path / "c.txt").write_text("no")
    got = {row["path"].rsplit("/", 1)[1]: row["code"] for row in read_source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\ny = 2\n", "b.py": "z = 3"}


def test_lint_reports(spark):
    data = [(1, '[{"line": 3}, {"line": 4}]'), (2, "[]"), (3, "oops"), (4, None)]
    got = read_lint_reports(spark.createDataFrame(data, "id int, report string"))
    rows = got.select("id", "position", F.try_variant_get("finding", "$.line", "int").alias("line")).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 0, 3), (1, 1, 4), (2, None, None), (3, None, None), (4, None, None)]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    write_once(spark.range(3), path)
    write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_written_tables_live_in_the_shared_folder(spark):
    df = written(spark.range(3).withColumn("wide", F.lit("x")))
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark).replace("file://", ""))
    assert "ReadSchema: struct<id:bigint>" in df.select("id")._jdf.queryExecution().executedPlan().toString()


def test_own_folder_only_where_none_is_named():
    class Session:
        def __init__(self, named, given=None, master="local[8]"):
            self.conf = {"spark.checkpoint.dir": named} if named else {}
            parts = {"applicationId": "app-1", "master": master, "getCheckpointDir": lambda: given}
            self.sparkContext = type("Context", (), parts)

    assert shared_folder(Session("hdfs://x/y/")) == "hdfs://x/y"
    own = shared_folder(Session(None))
    assert own.startswith("file:///") and own == shared_folder(Session(None))
    assert shared_folder(Session(None, "hdfs://given", "spark://host")) == "hdfs://given"
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, None, "spark://host"))


def test_records_are_read_as_python_reads_them(spark):
    """Trailing text and joined objects are no records; repeated names, NaN and very long lines are."""
    long = "x" * 20_000_000
    lines = [
        ("junk", '{"diff":"x"} junk'),
        ("joined", '{"diff":"x"}{"diff":"y"}'),
        ("brace", '{"diff":"x"}}'),
        ("list", '{"diff":"x"},{"diff":"y"}'),
        ("name", '{"diff":"x","diff":"y"}'),
        ("nan", '{"diff":"x","likely_bug":true,"s":NaN,"t":[-Infinity]}'),
        ("long", '{"diff":"x","before":"' + long + '"}'),
        ("plain", '{"diff":"x"}'),
    ]
    got = {r["id"]: r for r in parse_records(spark.createDataFrame(lines, "id string, value string")).collect()}
    assert sorted(got) == ["long", "name", "nan", "plain"]
    assert [got[k]["diff"] for k in sorted(got)] == ["x", "y", "x", "x"]
    assert len(got["long"]["before"]) == len(long)


def test_fields_of_other_types_become_null_and_the_record_stays(spark):
    lines = {
        "flag": '{"diff":"x","comodified":"yes","in_function":true}',
        "number": '{"diff":5,"before":1.50,"after":true,"project":null}',
        "open": '{"diff":"x","sstub_pattern":7,"likely_bug":"true","edit_script":{"b":[1,"c"]}}',
        "nan": '{"diff":"x","likely_bug":NaN,"comodified":Infinity,"edit_script":null}',
        "escape": '{"diff":"a\\u00e9\\n\\"q\\"","unknown":{"diff":"inner"}}',
        "empty": "{}",
        "text": '"{}"', "five": "5", "none": "null", "array": '[{"diff":"x"}]', "open end": '{"diff":"x"', "quote": "{'diff':'x'}",
        "marked": '{"diff":"x"},"end":"end-of-line"', "nested": '{"record":{"diff":"x"}}',
    }
    records = parse_records(spark.createDataFrame(list(lines.items()), "id string, value string"))
    got = {r["id"]: r for r in records.withColumn("open", F.to_json("sstub_pattern")).collect()}
    assert sorted(got) == ["empty", "escape", "flag", "nan", "nested", "number", "open"]
    assert (got["flag"]["diff"], got["flag"]["comodified"], got["flag"]["in_function"]) == ("x", None, True)
    assert [got["number"][c] for c in ("diff", "before", "after", "project")] == ["5", "1.5", "true", None]
    assert (got["open"]["open"], got["open"]["edit_script"]) == ("7", '{"b":[1,"c"]}')
    assert (got["nan"]["diff"], got["nan"]["comodified"]) == ("x", None)
    assert got["escape"]["diff"] == 'a\u00e9\n"q"' and got["empty"]["diff"] is None and got["nested"]["diff"] is None


def test_records_are_read_without_python(spark):
    plan = parse_records(spark.createDataFrame([('{"diff":"x"}',)], "value string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_half_written_table_is_not_prepared(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert write_once(spark.range(9), path) and not write_once(spark.range(3), path)
    assert spark.read.parquet(path).count() == 9


def test_source_files_are_written_by_all_cores(spark, tmp_path):
    """One input partition, and keys that repeat: one file a key, from many tasks, that the tasks themselves put in place."""
    from siftline.sources import write_source_files

    rows = [(n % 40, f"text {n % 40}") for n in range(80)] + [(None, "none")]
    path = str(tmp_path / "files")
    write_source_files(spark.createDataFrame(rows, "key int, value string").coalesce(1), "key", path)
    files = sorted(tmp_path.glob("files/key=*/part-*"))
    assert len(files) == 41 and len({f.parent for f in files}) == 41
    assert len({f.name.split("-")[1] for f in files}) > 8
    assert all(f.read_text().count("\n") == (1 if "HIVE" in str(f) else 2) for f in files)
    assert (tmp_path / "files" / "_SUCCESS").exists()


def test_orders_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    """However large the table is: partitions grow with it, and rows are shared evenly."""
    from siftline import session
    from siftline.catalog.inputs import tagged_code

    orders = spark.range(4000).selectExpr("id AS o_orderkey", "id % 70 AS o_custkey", "repeat('x', 50) AS o_comment")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(session, "SMALL_SHARE", 512)
    code = tagged_code(spark, str(tmp_path))
    sizes = [r["count"] for r in code.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > spark.sparkContext.defaultParallelism and sum(sizes) == 4000 and max(sizes) < 4000 // 8
