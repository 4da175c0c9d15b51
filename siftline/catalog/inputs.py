"""Operator inputs derived by Spark from the given tables, always from all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import dealt, spread

# The operators of the templated functions.
TEMPLATE_OPERATORS = ("+", "-", "*", "/", "%", "**", "//", "&", "|", "^", "<<", ">>")
BLANKS = "\t\x0b \u2003\u3000\x85"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table in enough partitions for work that is heavy on each row."""
    return spread(table(spark, sf_dir, name))


def dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of orders, dealt out evenly: code of many bytes is built, parsed and scored for each."""
    return dealt(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def four_class_label() -> Column:
    return (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), 1)
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), 2)
        .otherwise(3)
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the four-class label of the labels table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", four_class_label().alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id")


def order_class() -> Column:
    """An uneven four-class label for orders."""
    slot = F.col("o_orderkey") % 20
    return F.when(slot < 9, 0).when(slot < 13, 1).when(slot < 18, 2).otherwise(3)


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", order_class().alias("label"))


def rule_prediction() -> Column:
    """A predicted class that depends on the text length only."""
    size = F.col("n_chars")
    return F.when(size < 600, 0).when(size < 1500, 1).when(size < 3500, 2).otherwise(3)


def predicted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).select("doc_id", "label", rule_prediction().alias("prediction"))


def templated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated function per order: (o_orderkey, code, label)."""
    operator = F.element_at(
        F.array(*[F.lit(text) for text in TEMPLATE_OPERATORS]), (F.col("o_custkey") % 12 + 1).cast("int")
    )
    guard = F.when(
        F.col("o_orderkey") % 3 == 0, F.lit("    if a == 0 and not b:\n        return 10\n")
    ).otherwise("")
    swapped = F.col("o_orderkey") % 4 == 3
    left, right = F.when(swapped, "b").otherwise("a"), F.when(swapped, "a").otherwise("b")
    code = F.concat(
        F.lit("def f_"), F.col("o_orderkey").cast("string"), F.lit("(a, b):\n"), guard,
        F.lit("    return "), left, F.lit(" "), operator, F.lit(" "), right, F.lit("\n"),
    )
    return dealt_orders(spark, sf_dir).select(
        "o_orderkey", code.alias("code"), (F.col("o_orderkey") % 4).cast("int").alias("label")
    )


#: Columns of lines whose text form is the same in every engine.
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]


def tagged_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated function per order whose text shows its class: (o_orderkey, code, label).

    Clean code adds and so on; class 1 shifts or masks instead, class 2 uses one variable twice,
    class 3 has its operands the other way round.
    """
    label = (F.col("o_orderkey") % 4).cast("int")
    choose = lambda some: F.element_at(F.array(*map(F.lit, some)), (F.col("o_custkey") % len(some) + 1).cast("int"))
    operator = F.when(label == 1, choose(TEMPLATE_OPERATORS[7:])).otherwise(choose(TEMPLATE_OPERATORS[:5]))
    left, right = F.when(label == 3, "b").otherwise("a"), F.when(label.isin(2, 3), "a").otherwise("b")
    code = F.concat(
        F.lit("def f_"), F.col("o_orderkey").cast("string"), F.lit("(a, b):\n    return "),
        left, F.lit(" "), operator, F.lit(" "), right, F.lit("\n"),
    )
    return dealt_orders(spark, sf_dir).select("o_orderkey", code.alias("code"), label.alias("label"))


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order: its tagged function, and the same as a method below a decorator that is none of its own."""
    method = F.regexp_replace(F.regexp_replace("code", "def f_", "def g_"), "\n    return", "\n        return")
    text = F.concat(F.col("code"), F.lit("\n\nclass C:\n    @wrap(a << b, c ^ d)\n    "), method)
    return tagged_code(spark, sf_dir).select("o_orderkey", text.alias("code"))


def templated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order: a class with a method, a function, an async function;
    every seventh file does not parse and every eleventh has no function."""
    key = F.col("o_orderkey").cast("string")
    method = F.concat(F.lit("def m_"), key, F.lit("(self):\n        def inner(x):\n            return x\n        return inner(1)"))
    top = F.concat(F.lit("def top_"), key, F.lit("(a, b):\n    return a + b"))
    whole = F.concat(
        F.lit("class C:\n    @wrap\n    "), method, F.lit("\n\nasync def z():\n    pass\n\n"), top, F.lit("\n")
    )
    text = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("def broken_"), key, F.lit("(:\n")))
        .when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("x = "), key, F.lit("\n")))
        .otherwise(whole)
    )
    return dealt_orders(spark, sf_dir).select("o_orderkey", text.alias("code"))


def _conversation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as the old text and the next assistant turn as the new one."""
    turns = spread_table(spark, sf_dir, "conversations")
    before = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("old"))
    after = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new")
    )
    pairs = before.join(after, ["conv_id", "turn"])
    diff = F.concat(
        F.lit("--- a/x\n+++ b/x\n@@ -1 +1 @@\n def f():  \n-"),
        F.regexp_replace("old", "\n", " \n-"),
        F.lit("\n+"),
        F.regexp_replace("new", "\n", "\n+"),
        F.lit("\n\\ No newline at end of file"),
    )
    return pairs.select(((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("record_id"), diff.alias("diff"))


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small change per order; orders of one customer and class repeat each other."""
    name = F.concat(F.lit("    return a + v_"), (F.col("o_custkey") % 500).cast("string"))
    fixed = F.when(F.col("o_orderkey") % 6 == 0, name).otherwise(F.regexp_replace(name, "\\+", "-"))
    removed = F.when(F.col("o_orderkey") % 10 == 0, F.lit("+")).otherwise(F.concat(F.lit("-"), name))
    diff = F.concat(
        F.lit("--- a/m.py\r\n+++ b/m.py\r\n@@ -1,3 +1,3 @@\r\n def g(a):\r\n"), removed, F.lit("  \r\n+"), fixed,
        F.lit("\r\n # end"),
    )
    return dealt_orders(spark, sf_dir).select((F.col("o_orderkey") * 2).alias("record_id"), diff.alias("diff"))


def built_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, diff) from conversations and orders."""
    return _conversation_changes(spark, sf_dir).unionByName(_order_changes(spark, sf_dir))


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, value): JSON lines with every kind of pattern and fix flag, and bad lines."""
    slot, kind = F.col("record_id") % 9, F.col("record_id") % 17
    pattern = (
        F.when(slot == 0, '"SINGLE_STMT"').when(slot == 1, '"  "').when(slot == 2, "null").when(slot == 3, "5")
        .otherwise(F.concat(F.lit('"CHANGE_'), slot.cast("string"), F.lit('"')))
    )
    flag = (
        F.when(kind == 0, "false").when(kind == 1, "1").when(kind == 2, '"yes"').when(kind == 3, "0")
        .when(kind == 4, '""').when(kind == 5, "null").when(kind == 6, "[]").when(kind == 7, "[0]")
        .when(kind == 8, "{}").when(kind == 9, '{"a":1}').when(kind == 10, "0.0").otherwise("true")
    )
    start = F.to_json(F.struct("diff"))
    line = F.concat(
        F.substring(start, 1, F.length(start) - 1), F.lit(', "sstub_pattern": '), pattern,
        F.lit(', "likely_bug": '), flag, F.lit("}"),
    )
    every = lambda n: F.col("record_id") % n == 0
    bad = F.when(every(29), "not json").when(every(31), "  ")
    bad = bad.when(every(37), F.concat(line, F.lit(" junk"))).when(every(41), F.concat(line, line))
    # these are records all the same: a value that strict JSON lacks, and a name twice, of which the last counts
    line = (
        F.when(every(43), F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(', "s": NaN}')))
        .when(every(47), F.concat(F.lit('{"diff": "old", '), F.substring(line, F.lit(2), F.length(line))))
        .otherwise(line)
    )
    return built_diffs(spark, sf_dir).select("record_id", F.coalesce(bad, line).alias("value"))


def raw_labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, function, text label, source_task), unknown and missing labels included."""
    slot = F.col("doc_id") % 3
    task = (
        F.when(slot == 0, "wrong_binary_operator_datasets")
        .when(slot == 1, "variable_misuse_datasets")
        .otherwise("swapped_operands_datasets")
    )
    bug = (
        F.when(slot == 0, "Wrong binary operator").when(slot == 1, "Variable misuse").otherwise("Swapped operands")
    )
    part = F.col("doc_id") % 7
    label = F.when(part < 3, "Correct").when(part < 5, bug).when(part == 5, "Unknown")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("function"), label.alias("label"), task.alias("source_task")
    )


def blank_edged(column: str) -> Column:
    """Text with unusual blanks put around it."""
    return F.concat(F.lit(BLANKS), F.col(column), F.lit(BLANKS))
