"""Every registered query: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.catalog import inputs as I
from siftline.functions.code import register_sql
from siftline.functions.text import md5_hex, parse_json, rstrip, split_lines, strip
from siftline.functions.tokens import ngrams, tokenize_bug_aware, tokenize_legacy
from siftline.operators import curate, diffs, evaluate, features, filters, learn, repair_text, sampling
from siftline.operators.counts import (
    balanced_weights,
    class_distribution,
    counters,
    most_common,
    value_counts,
    with_label_name,
)
from siftline.plans import fix_pairs
from siftline.plans.classifier import run_classifier_pipeline
from siftline.plans.review import review_corpus, review_multiclass as review_classes
from siftline.schemas import CLEAN_TEXT, TASK_LABELS
from siftline.session import shared_folder
from siftline.sources import (
    parse_records,
    read_code_csv,
    read_labelled_functions,
    read_lint_reports,
    read_source_files,
    write_code_csv,
    write_once,
    write_source_files,
)
from siftline.streaming import batch_folders

SEED = 42
QUERIES: dict = {}


def _own_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A place in the shared folder for what one query writes and reads back."""
    return f"{shared_folder(spark)}/siftline/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def query(function):
    QUERIES[function.__name__] = function
    return function


# ---- curation ---------------------------------------------------------------


@query
def curated_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keep the first copy of every text, then the class distribution."""
    hashed = I.labelled_documents(spark, sf_dir).select("doc_id", "label", md5_hex(F.col("text")).alias("text_md5"))
    return with_label_name(class_distribution(curate.dedupe_first(hashed, "text_md5", "doc_id")))


@query
def class_distribution_orders(spark, sf_dir):
    return class_distribution(I.labelled_orders(spark, sf_dir))


@query
def dedupe_first(spark, sf_dir):
    hashed = I.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", md5_hex(F.col("text")).alias("text_md5")
    )
    return curate.dedupe_first(hashed, "text_md5", "doc_id")


@query
def dedupe_clean(spark, sf_dir):
    mapped = curate.map_labels(I.raw_labelled_documents(spark, sf_dir))
    return curate.dedupe_clean(mapped, "function", "label", "doc_id").select("doc_id", "label", "bug_type")


@query
def map_labels(spark, sf_dir):
    return curate.map_labels(I.raw_labelled_documents(spark, sf_dir)).select(
        "doc_id", "label", "bug_type", "source_task"
    )


@query
def skipped_labels(spark, sf_dir):
    return curate.skipped_labels(I.raw_labelled_documents(spark, sf_dir))


@query
def labelled_splits(spark, sf_dir):
    """Write each task's splits as tables of their own, read them back (one is not there), map labels."""
    split = F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")
    raw = I.raw_labelled_documents(spark, sf_dir).withColumn("split", split)
    root = _own_path(spark, sf_dir, "splits")
    raw.drop("doc_id").write.mode("overwrite").partitionBy("source_task", "split").parquet(root)
    paths = {
        task: {part: f"{root}/source_task={task}/split={part}" for part in ("train", "dev", "test")}
        for task in curate.TASK_LABELS
    }
    mapped = curate.map_labels(read_labelled_functions(spark, paths))
    return mapped.select("source_task", "label", "bug_type", md5_hex(F.col("function")).alias("function_md5"), "split")


@query
def label_counters(spark, sf_dir):
    raw = I.raw_labelled_documents(spark, sf_dir)
    unknown = F.col("label").isNull() | (F.col("label") == "Unknown")
    return counters(raw, skipped=unknown, clean=F.col("label") == "Correct")


@query
def union_all(spark, sf_dir):
    raw = curate.map_labels(I.raw_labelled_documents(spark, sf_dir))
    tasks = [raw.where(F.col("source_task") == task) for task in curate.TASK_LABELS]
    return class_distribution(curate.union_all(tasks))


@query
def label_names(spark, sf_dir):
    return with_label_name(I.labelled_documents(spark, sf_dir)).select("doc_id", "label", "bug_type")


@query
def event_type_counts(spark, sf_dir):
    return value_counts(I.table(spark, sf_dir, "events"), "event_type")


@query
def most_common_users(spark, sf_dir):
    return most_common(I.table(spark, sf_dir, "events"), "user_id", 10)


@query
def class_weights(spark, sf_dir):
    return balanced_weights(I.labelled_orders(spark, sf_dir)).select(
        "o_orderkey", "label", F.round("weight", 9).alias("weight")
    )


def _with_hash(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", md5_hex(F.col("text")).alias("text_md5"))


@query
def exclude_seen(spark, sf_dir):
    hashed = _with_hash(I.table(spark, sf_dir, "documents"))
    seen = hashed.where(F.col("doc_id") % 3 == 0)
    return curate.exclude_seen(hashed.where(F.col("doc_id") % 3 != 0), seen, "text_md5")


@query
def overlap_keys(spark, sf_dir):
    hashed = _with_hash(I.table(spark, sf_dir, "documents"))
    return curate.overlap(hashed.where(F.col("doc_id") % 3 == 0), hashed.where(F.col("doc_id") % 3 != 0), "text_md5")


# ---- sampling ---------------------------------------------------------------


@query
def stratified_sample(spark, sf_dir):
    orders = I.labelled_orders(spark, sf_dir)
    return sampling.stratified_sample(orders, "label", 1000, "o_orderkey", SEED)


@query
def stratified_sample_documents(spark, sf_dir):
    return sampling.stratified_sample(
        I.table(spark, sf_dir, "documents"), "lang", 150, "doc_id", SEED
    ).select("doc_id", "lang", "n_chars")


@query
def stratified_split(spark, sf_dir):
    return sampling.flag_split(I.labelled_orders(spark, sf_dir), "label", 0.2, "o_orderkey", SEED)


@query
def quota_sample(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    named = {"1-URGENT": 300, "2-HIGH": 200}
    return sampling.quota_sample(orders, "o_orderpriority", 2000, named, "o_orderkey", SEED)


@query
def balanced_holdout(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 37).alias("bucket"))
    return sampling.balanced_holdout(orders, "bucket", 10, 30, 1000, "o_orderkey", SEED)


@query
def take_split(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    train, val = sampling.take_split(items, 20_000, 5_000, key, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query
def stratified_sample_lines(spark, sf_dir):
    """The key repeats: order and line number do not tell lines apart."""
    lines = I.table(spark, sf_dir, "lineitem").select(*I.LINE_COLUMNS)
    return sampling.stratified_sample(lines, "l_returnflag", 3001, ["l_orderkey", "l_linenumber"], SEED)


@query
def split_lines_by_order(spark, sf_dir):
    """Test lines by a key that each order's lines share, so that quotas end inside orders."""
    lines = I.table(spark, sf_dir, "lineitem").select(*I.LINE_COLUMNS)
    return sampling.flag_split(lines, "l_returnflag", 0.2, "l_orderkey", SEED)


@query
def take_split_without_key(spark, sf_dir):
    """No key at all: lines equal in both columns cannot be told apart, their numbers are exact all the same."""
    lines = I.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber")
    train, val = sampling.take_split(lines, 2500, 700, None, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query
def seeded_order(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.shuffle(documents, "doc_id", SEED).withColumn("place", sampling.hash_order("doc_id", SEED))


@query
def example_rows(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_rows(documents, 3, "doc_id", SEED)


# ---- diffs and records ------------------------------------------------------


def _side(name: str):
    return md5_hex(F.col(name)).alias(f"{name}_md5"), F.length(name).alias(f"{name}_size")


@query
def extract_diff_strict(spark, sf_dir):
    sides = diffs.extract_diff(I.built_diffs(spark, sf_dir))
    return sides.select("record_id", *_side("buggy"), *_side("fixed"))


@query
def extract_diff_loose(spark, sf_dir):
    sides = diffs.extract_diff(I.built_diffs(spark, sf_dir), context=True)
    return sides.select("record_id", *_side("input_with_context"), *_side("buggy"), *_side("fixed"))


def _records(spark, sf_dir) -> DataFrame:
    return parse_records(I.commit_lines(spark, sf_dir))


def _filtered(spark, sf_dir, mode) -> DataFrame:
    kept = filters.filter_likely_bug(filters.filter_pattern(_records(spark, sf_dir), mode), mode)
    return kept.select("record_id", "sstub_pattern")


@query
def record_filter_strict(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.STRICT)


@query
def record_filter_loose(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.LOOSE)


@query
def changed_and_short(spark, sf_dir):
    sides = diffs.extract_diff(I.built_diffs(spark, sf_dir))
    return filters.filter_length(filters.filter_changed(sides), "buggy", 400).select("record_id")


@query
def filter_funnel(spark, sf_dir):
    return fix_pairs.filter_funnel(_records(spark, sf_dir))


def _pairs(spark, sf_dir, mode) -> DataFrame:
    return fix_pairs.mine_fix_pairs(_records(spark, sf_dir), mode, "record_id")


def _shown(pairs: DataFrame) -> DataFrame:
    text = [md5_hex(F.col(name)).alias(f"{name}_md5") for name in ("input_text", "target_text")]
    return pairs.select(*text, "sstub_pattern", "pair_hash")


@query
def mine_fix_pairs_strict(spark, sf_dir):
    return _shown(_pairs(spark, sf_dir, filters.STRICT))


@query
def mine_fix_pairs_loose(spark, sf_dir):
    return _shown(_pairs(spark, sf_dir, filters.LOOSE))


@query
def fix_sets_strict(spark, sf_dir):
    train, val = fix_pairs.strict_sets(
        _pairs(spark, sf_dir, filters.STRICT), 600, {"CHANGE_4": 100, "CHANGE_5": 80}, (3, 20, 100), SEED
    )
    return train.select("pair_hash", F.lit("train").alias("part")).unionByName(
        val.select("pair_hash", F.lit("val").alias("part"))
    )


@query
def fix_sets_loose(spark, sf_dir):
    train, val = fix_pairs.loose_sets(_pairs(spark, sf_dir, filters.LOOSE), 400, 100, SEED)
    return train.select("pair_hash", F.lit("train").alias("part")).unionByName(
        val.select("pair_hash", F.lit("val").alias("part"))
    )


@query
def parse_json_safe(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = I.table(spark, sf_dir, "events").select("event_id", parse_json(text).alias("parsed"))
    return parsed.select("event_id", F.try_variant_get("parsed", "$.k", "bigint").alias("k"))


@query
def lint_findings(spark, sf_dir):
    finding = F.concat(F.lit('{"line": '), F.col("p_size").cast("string"), F.lit(', "symbol": "'), "p_brand", F.lit('"}'))
    slot = F.col("p_partkey") % 4
    report = (
        F.when(slot == 0, F.concat(F.lit("["), finding, F.lit(", "), finding, F.lit("]")))
        .when(slot == 1, F.concat(F.lit("["), finding, F.lit("]")))
        .when(slot == 2, F.lit("[]"))
        .otherwise(F.concat(F.lit("["), finding))
    )
    parts = I.table(spark, sf_dir, "part").select("p_partkey", report.alias("report"))
    return read_lint_reports(parts).select(
        "p_partkey",
        F.col("position").cast("int").alias("position"),
        F.try_variant_get("finding", "$.line", "int").alias("line"),
        F.try_variant_get("finding", "$.symbol", "string").alias("symbol"),
    )


@query
def csv_round_trip(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select("doc_id", I.blank_edged("text").alias("text"))
    path = _own_path(spark, sf_dir, "csv")
    write_code_csv(documents, path, mode="overwrite")
    return read_code_csv(spark, path, documents.schema).select("doc_id", md5_hex(F.col("text")).alias("text_md5"))


@query
def source_files(spark, sf_dir):
    """One file for each supplier, written and read back whole."""
    text = F.concat(F.lit("def f():\n    return '"), "s_name", F.lit("'\n# end"))
    root = _own_path(spark, sf_dir, "sources")
    suppliers = I.table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value"))
    write_source_files(suppliers, "s_suppkey", root)
    key = F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("long").alias("s_suppkey")
    return read_source_files(spark, root, "*.txt").select(key, md5_hex(F.col("code")).alias("code_md5"))


@query
def write_once_read_back(spark, sf_dir):
    """A half-written folder is replaced, a finished one is left alone."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path = _own_path(spark, sf_dir, "once")
    half = orders.where(F.col("o_orderkey") % 2 == 0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    half.parquet(path)
    first, second = write_once(orders, path), write_once(orders.where("false"), path)
    return spark.read.parquet(path).select("*", F.lit(first).alias("first"), F.lit(second).alias("second"))


# ---- text functions ---------------------------------------------------------


@query
def text_strip(spark, sf_dir):
    edged = I.spread_table(spark, sf_dir, "documents").select("doc_id", I.blank_edged("text").alias("text"))
    text = F.col("text")
    return edged.select(
        "doc_id",
        md5_hex(strip(text)).alias("stripped_md5"),
        F.length(strip(text)).alias("stripped_size"),
        F.length(rstrip(text)).alias("rstripped_size"),
    )


@query
def text_lines(spark, sf_dir):
    mixed = F.translate("text", " ", "\u2028")
    lines = I.spread_table(spark, sf_dir, "documents").select("doc_id", split_lines(mixed).alias("lines"))
    return lines.select(
        "doc_id", F.size("lines").alias("n_lines"), md5_hex(F.array_join("lines", "|")).alias("lines_md5")
    )


@query
def drop_blank(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(I.BLANKS)).otherwise(F.col("text"))
    return filters.drop_blank(
        I.table(spark, sf_dir, "documents").select("doc_id", text.alias("code"))
    ).select("doc_id")


def _token_digest(spark, sf_dir, tokenize) -> DataFrame:
    pages = I.spread_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page "), F.col("page_id")).alias("key"), F.col("html").alias("text")
    )
    documents = I.spread_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id")).alias("key"), "text"
    )
    code = I.templated_code(spark, sf_dir).select(
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("key"), F.col("code").alias("text")
    )
    tokens = curate.union_all([pages, documents, code]).select("key", tokenize(F.col("text")).alias("tokens"))
    return tokens.select(
        "key", F.size("tokens").alias("n_tokens"), md5_hex(F.array_join("tokens", "\n")).alias("tokens_md5")
    )


@query
def tokens_legacy(spark, sf_dir):
    return _token_digest(spark, sf_dir, tokenize_legacy)


@query
def tokens_bug_aware(spark, sf_dir):
    return _token_digest(spark, sf_dir, tokenize_bug_aware)


@query
def ngram_runs(spark, sf_dir):
    tokens = I.spread_table(spark, sf_dir, "documents").select("doc_id", tokenize_bug_aware(F.lower("text")).alias("tokens"))
    grams = tokens.select("doc_id", ngrams(F.col("tokens"), 1, 4).alias("grams"))
    return grams.select(
        "doc_id", F.size("grams").alias("n_grams"), md5_hex(F.array_join("grams", "\n")).alias("grams_md5")
    )


# ---- features ---------------------------------------------------------------


@query
def term_stats(spark, sf_dir):
    documents = I.spread_table(spark, sf_dir, "documents")
    return features.term_stats(documents, "text", features.BUG_AWARE)


@query
def document_terms(spark, sf_dir):
    return features.terms(I.spread_table(spark, sf_dir, "documents"), "doc_id", "text", features.BUG_AWARE)


@query
def vocabulary_legacy(spark, sf_dir):
    code = I.templated_code(spark, sf_dir)
    legacy = features.LEGACY
    return features.fit_vocab(features.term_stats(code, "code", legacy), legacy.min_df, legacy.max_features)


@query
def vocabulary_bug_aware(spark, sf_dir):
    documents = I.spread_table(spark, sf_dir, "documents")
    aware = features.BUG_AWARE
    return features.fit_vocab(features.term_stats(documents, "text", aware), aware.min_df, aware.max_features)


@query
def vocabulary_pruned(spark, sf_dir):
    """The 2,000 most used runs of up to four tokens; rarer ones are dropped before the shuffle."""
    documents = I.spread_table(spark, sf_dir, "documents")
    stats = features.frequent_term_stats(documents, "text", features.LEGACY, 3, 2000)
    return features.fit_vocab(stats, 3, 2000)


def _weights(train: DataFrame, whole: DataFrame, key: str, code: str, profile) -> DataFrame:
    long = features.fit_tfidf(train, code, profile).long(whole, key, code)
    return long.select(key, "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_bug_aware(spark, sf_dir):
    """Weights fitted on the training part and applied to every document."""
    documents = I.spread_table(spark, sf_dir, "documents")
    train = documents.where(F.col("doc_id") % 5 != 0)
    return _weights(train, documents, "doc_id", "text", features.BUG_AWARE)


@query
def tfidf_legacy(spark, sf_dir):
    code = I.templated_code(spark, sf_dir)
    return _weights(code, code, "o_orderkey", "code", features.LEGACY)


@query
def encode_fixed(spark, sf_dir):
    documents = I.spread_table(spark, sf_dir, "documents").withColumn("tokens", tokenize_bug_aware(F.lower("text")))
    words = features.Profile("words", tokenize_bug_aware, 1, 1, 2, features.BUG_AWARE.max_features, True)
    model = features.fit_tfidf(documents, "text", words)
    coded = features.encode_fixed(documents.select("doc_id", "tokens"), "tokens", model.vocabulary)
    joined = [F.concat_ws(",", F.col(name).cast("array<string>")).alias(name) for name in ("input_ids", "attention_mask", "labels")]
    return coded.select("doc_id", *joined)


@query
def ast_features(spark, sf_dir):
    code = features.with_ast_features(I.templated_code(spark, sf_dir), "code")
    return code.select("o_orderkey", "ast.*")


@query
def extract_functions(spark, sf_dir):
    return features.split_functions(I.templated_files(spark, sf_dir))


@query
def extract_functions_sql(spark, sf_dir):
    """The same in SQL: a lateral join keeps the file's own columns."""
    register_sql(spark)
    files = I.templated_files(spark, sf_dir)
    return spark.sql(
        "SELECT f.o_orderkey, c.ordinal, c.function_name, c.function_code FROM {files} f, LATERAL code_functions(f.code) c", files=files
    )


# ---- evaluation -------------------------------------------------------------


@query
def accuracy(spark, sf_dir):
    return evaluate.accuracy(I.predicted_documents(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(I.predicted_documents(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return evaluate.classification_report(I.predicted_documents(spark, sf_dir))


@query
def exact_match(spark, sf_dir):
    guess = F.when(F.col("doc_id") % 4 == 0, F.lower("text")).otherwise(I.blank_edged("text"))
    documents = I.table(spark, sf_dir, "documents").select(guess.alias("prediction"), F.col("text").alias("target"))
    return evaluate.exact_match(documents).select(F.round("exact_match_pct", 6).alias("exact_match_pct"))


@query
def gate_threshold(spark, sf_dir):
    chance = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    documents = I.table(spark, sf_dir, "documents").select("doc_id", chance.alias("probability"))
    return filters.gate(filters.flag_binary(documents, threshold=0.30))


@query
def gate_classes(spark, sf_dir):
    flagged = filters.flag_multiclass(I.labelled_documents(spark, sf_dir).select("doc_id", "label"))
    return filters.gate(flagged, "pass_on")


# ---- repair texts -----------------------------------------------------------


@query
def repair_input(spark, sf_dir):
    intent = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "  ").otherwise(" add nums ")
    turns = I.table(spark, sf_dir, "conversations").withColumn("intent", intent)
    asked = repair_text.build_repair_input(turns, "text", "intent")
    return asked.select("conv_id", "turn", md5_hex(F.col("repair_input")).alias("input_md5"))


@query
def review_prompt(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations").withColumn("fixed", F.upper("role"))
    asked = repair_text.build_review_prompt(turns, "text", "fixed")
    return asked.select("conv_id", "turn", md5_hex(F.col("prompt")).alias("prompt_md5"))


@query
def coalesce_feedback(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "role")).alias("first"),
        F.when(F.col("turn") % 3 == 0, F.lit("second\n")).alias("second"),
    )
    return repair_text.coalesce_feedback(turns, ["first", "second"]).select("conv_id", "turn", "feedback")


# ---- learning ---------------------------------------------------------------

#: About how many labelled rows grow a query's trees, drawn by hash order; terms come from all rows, and every row is scored.
FIT_ROWS = 2000


def _swapped(spark, sf_dir):
    return I.tagged_code(spark, sf_dir).withColumn("label", (F.col("label") == 3).cast("int"))


@query
def forest_scores(spark, sf_dir):
    code = _swapped(spark, sf_dir)
    model = learn.fit_forest(code, "code", "label", fit_rows=FIT_ROWS, key="o_orderkey")
    return learn.score_binary(code, model, "code").select("o_orderkey", "label", "is_buggy")


@query
def saved_pipeline(spark, sf_dir):
    """Predictions of a forest that was saved and loaded as one ML pipeline with its vectorizer."""
    code = _swapped(spark, sf_dir)
    path = _own_path(spark, sf_dir, "pipeline")
    learn.save_model(spark, learn.fit_forest(code, "code", "label", fit_rows=FIT_ROWS, key="o_orderkey"), path)
    scored = PipelineModel.load(path).transform(code)
    return scored.select("o_orderkey", "label", F.col("prediction").cast("int").alias("prediction"))


@query
def boosted_scores(spark, sf_dir):
    code = I.tagged_code(spark, sf_dir)
    bounded = {"fit_rows": FIT_ROWS, "key": "o_orderkey"}
    model = learn.fit_boosted(code, "code", "label", subset="sqrt", **bounded)
    scored = learn.score_multiclass(code, model, "code")
    return scored.select("o_orderkey", "label", "prediction", "bug_type", "pass_on")


@query
def classifier_run(spark, sf_dir):
    code = I.tagged_code(spark, sf_dir)
    texts = [CLEAN_TEXT, *(text for text, _ in sorted(TASK_LABELS.values(), key=lambda pair: pair[1]))]
    tasks = {label: task for task, (_, label) in TASK_LABELS.items()}
    task = F.lit(tasks[1])
    for label, name in tasks.items():
        task = F.when(F.col("label") == label, name).otherwise(task)
    raw = code.select(
        "o_orderkey",
        F.col("code").alias("function"),
        F.element_at(F.array(*[F.lit(text) for text in texts]), F.col("label") + 1).alias("label"),
        task.alias("source_task"),
    )
    run = run_classifier_pipeline(raw, "o_orderkey", target=None, subset="sqrt")
    return run.report


@query
def review_files(spark, sf_dir):
    model = learn.fit_forest(_swapped(spark, sf_dir), "code", "label", fit_rows=FIT_ROWS, key="o_orderkey")
    path = _own_path(spark, sf_dir, "model")
    learn.save_model(spark, model, path)
    return review_corpus(I.templated_files(spark, sf_dir), learn.load_model(spark, path))


@query
def review_binary(spark, sf_dir):
    """Verdicts on functions whose class their text shows, by a saved and loaded forest."""
    model = learn.fit_forest(_swapped(spark, sf_dir), "code", "label")
    path = _own_path(spark, sf_dir, "model")
    learn.save_model(spark, model, path)
    reviewed = review_corpus(I.tagged_files(spark, sf_dir), learn.load_model(spark, path))
    above = (F.col("probability") >= 0.30).alias("above_threshold")
    return reviewed.select("o_orderkey", "ordinal", "function_name", "function_code", "is_buggy", "status", "repair_input", above)


@query
def review_multiclass(spark, sf_dir):
    """Class and confidence of every function of every file, from one parse of the file."""
    bounded = {"fit_rows": FIT_ROWS, "key": "o_orderkey"}
    model = learn.fit_boosted(I.tagged_code(spark, sf_dir), "code", "label", rate=0.3, subset="sqrt", **bounded)
    reviewed = review_classes(I.tagged_files(spark, sf_dir), model)
    sure = (F.col("confidence").between(0.5, 1.0)).alias("sure")
    names = ["o_orderkey", "ordinal", "function_name", "function_code", "prediction", "bug_type", "pass_on", "repair_input"]
    return reviewed.select(*names, sure)


@query
def review_streamed(spark, sf_dir):
    """Files that arrive in parts; one batch dies after its write, is played again, and counts once."""
    model = learn.fit_forest(_swapped(spark, sf_dir), "code", "label", fit_rows=FIT_ROWS, key="o_orderkey")
    source, target = (_own_path(spark, sf_dir, name) for name in ("arriving", "reviewed"))
    files = I.tagged_files(spark, sf_dir)
    # each of three parts is a file for every core, so that a batch is read and scored by all of them
    files.repartition(3 * spark.sparkContext.defaultParallelism, "o_orderkey").write.parquet(source)
    a_part = max(1, -(-len(spark.read.schema(files.schema).parquet(source).inputFiles()) // 3))
    put, died = batch_folders(target, lambda batch: review_corpus(batch, model)), []

    def put_and_die_once(batch, number):
        put(batch, number)
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("dies on purpose")

    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", a_part).parquet(source)
    writer = arriving.writeStream.foreachBatch(put_and_die_once).option("checkpointLocation", f"{target}/_checkpoint")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException:
        writer.trigger(availableNow=True).start().awaitTermination()
    reviewed = spark.read.parquet(target)
    return reviewed.select("o_orderkey", "ordinal", "function_name", "is_buggy", "status", F.lit(len(died)).alias("deaths"))
