import subprocess
import sys
from functools import partial
from pathlib import Path

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siftline.operators import features, learn
from siftline.operators.learn import load_model, save_model, score_binary, score_multiclass
from siftline.plans.classifier import run_classifier_pipeline, run_forest_pipeline
from siftline.plans.review import review_corpus, review_multiclass, review_summary
from siftline.streaming import review_stream

VOCAB = {"min_df": 1, "max_features": 50}


@pytest.fixture(scope="module")
def code(spark):
    operator = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*"), F.lit("/")), (F.col("id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("def f"), F.col("id") % 5, F.lit("(a, b):\n    return a "), operator, F.lit(" b"))
    return spark.range(200).select("id", text.alias("code"), (F.col("id") % 4).cast("int").alias("label"))


@pytest.fixture(scope="module")
def forest(code):
    binary = code.withColumn("label", (F.col("label") == 1).cast("int"))
    return learn.fit_forest(binary, "code", "label", trees=5, depth=4, **VOCAB)


def test_forest(code, forest):
    scored = score_binary(code, forest, "code")
    wrong = scored.where((F.col("label") == 1) != (F.col("is_buggy") == 1)).count()
    assert wrong == 0 and scored.columns == ["id", "code", "label", "probability", "is_buggy"]
    assert score_binary(code, forest, "code", threshold=0.0).where("is_buggy = 0").count() == 0


def test_boosted(code):
    model = learn.fit_boosted(code, "code", "label", rounds=3, depth=3, **VOCAB)
    scored = score_multiclass(code, model, "code").collect()
    assert all(row["prediction"] == row["label"] for row in scored)
    assert all(0.25 < row["confidence"] <= 1 and row["pass_on"] == (row["label"] != 0) for row in scored)
    assert {row["bug_type"] for row in scored} == {"Clean", "Wrong Binary Operator", "Variable Misuse", "Swapped Operand"}


def test_models_come_back_the_same(spark, code, forest, tmp_path):
    save_model(spark, forest, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.tfidf.profile == forest.tfidf.profile and again.tfidf.vocabulary.to_pylist() == forest.tfidf.vocabulary.to_pylist()
    left, right = (score_binary(code, model, "code").orderBy("id").collect() for model in (forest, again))
    assert left == right
    with pytest.raises(FileNotFoundError, match="classifier"):
        load_model(spark, str(tmp_path / "nothing"))


def test_a_pipeline_loads_in_a_fresh_session(spark, code, forest, tmp_path):
    """Another process knows the folder only, and gives the same scores."""
    boosted = learn.fit_boosted(code, "code", "label", rounds=2, depth=3, **VOCAB)
    code.write.parquet(str(tmp_path / "code"))
    for name, model in (("forest", forest), ("boosted", boosted)):
        save_model(spark, model, str(tmp_path / name))
        learn.code_pipeline(model, "code").transform(code).select("id", "prediction").write.parquet(str(tmp_path / f"{name}-here"))
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.ml import PipelineModel
from siftline.session import build_session
spark = build_session("fresh", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
code = spark.read.parquet({str(tmp_path / "code")!r})
for name in ("forest", "boosted"):
    scored = PipelineModel.load({str(tmp_path)!r} + "/" + name).transform(code)
    scored.select("id", "prediction").write.parquet({str(tmp_path)!r} + f"/{{name}}-there")
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300, capture_output=True)
    for name in ("forest", "boosted"):
        here, there = (sorted(spark.read.parquet(str(tmp_path / f"{name}-{side}")).collect()) for side in ("here", "there"))
        assert here == there and len(here) == 200


def test_a_profile_of_ones_own_is_not_saved(spark, code, tmp_path):
    own = features.Profile("words", features.BUG_AWARE.tokenize, 1, 1, 1, 50, True)
    model = learn.fit_forest(code, "code", "label", trees=2, depth=2, profile=own, **VOCAB)
    with pytest.raises(ValueError, match="words"):
        save_model(spark, model, str(tmp_path / "own"))


def test_review_and_stream(spark, forest, tmp_path):
    files = tmp_path / "src"
    files.mkdir()
    (files / "a.py").write_text("def f1(a, b):\n    return a - b\n\ndef f2(a, b):\n    return a + b\n")
    (files / "b.py").write_text("  \n")
    (files / "pkg").mkdir()
    (files / "n.txt").write_text("def no(a, b):\n    return a - b\n")
    corpus = spark.createDataFrame([("a", (files / "a.py").read_text()), ("b", " \n")], "path string, code string")
    got = {row["function_name"]: row for row in review_summary(review_corpus(corpus, forest)).collect()}
    assert {name: row["status"] for name, row in got.items()} == {"f1": "BUGGY", "f2": "CLEAN"}
    assert got["f1"]["repair_input"] == "fix: def f1(a, b):\n    return a - b" and got["f2"]["repair_input"] is None
    assert got["f2"]["verdict"].startswith("f2: CLEAN (Confidence: ")

    target = str(tmp_path / "out")
    for added, total in ((None, 2), ("def f3(a, b):\n    return a - b\n", 3)):
        if added:
            (files / "pkg" / "c.py").write_text(added)
        review_stream(spark, str(files), target, forest).awaitTermination()
        assert spark.read.parquet(target).count() == total


def test_boosting_ends_where_held_texts_gain_no_more(spark):
    rows = [(i, f"def f{i}(a, b):\n    return a {'+-'[i % 2]} b", i % 2) for i in range(120)]
    many = spark.createDataFrame(rows, "id long, code string, label int")
    free = learn.rounds_used(learn.fit_boosted(many, "code", "label", rounds=60, rate=0.5, depth=2, tolerance=0.2, **VOCAB))
    assert len(free) == 2 and max(free) < 60
    assert learn.rounds_used(learn.fit_boosted(many, "code", "label", rounds=4, depth=2, tolerance=None, **VOCAB)) == [4, 4]
    # all texts equal: none can be held back, so all rounds run
    same = many.withColumn("code", F.lit("x = 1"))
    assert learn.rounds_used(learn.fit_boosted(same, "code", "label", rounds=2, depth=2, **VOCAB)) == [2, 2]


def test_forest_run_and_multiclass_review(spark, code, tmp_path):
    binary = code.withColumn("label", (F.col("label") == 1).cast("int"))
    run = run_forest_pipeline(binary, "id", code="code", trees=5, store=str(tmp_path / "m"), **VOCAB)
    assert (run.train.count(), run.test.count()) == (160, 40)
    assert run.accuracy.first()[0] == 1.0 and run.confusion.count() == 4
    assert load_model(spark, str(tmp_path / "m")).tfidf.documents == 160

    model = learn.fit_boosted(code, "code", "label", rounds=3, depth=3, **VOCAB)
    files = spark.createDataFrame([("def f1(a, b):\n    return a - b\n\ndef f2(a, b):\n    return a + b\n",), (" ",)], "code string")
    got = {r["function_name"]: r for r in review_multiclass(files, model).collect()}
    assert {k: (r["prediction"], r["pass_on"]) for k, r in got.items()} == {"f1": (1, True), "f2": (0, False)}
    assert got["f1"]["repair_input"].startswith("fix: def f1") and got["f2"]["repair_input"] is None


def test_classifier_run(code):
    texts = F.array(*[F.lit(t) for t in ("Correct", "Wrong binary operator", "Variable misuse", "Swapped operands")])
    task = (
        F.when(F.col("label") == 2, "variable_misuse_datasets")
        .when(F.col("label") == 3, "swapped_operands_datasets")
        .otherwise("wrong_binary_operator_datasets")
    )
    raw = code.select("id", F.col("code").alias("function"), F.element_at(texts, F.col("label") + 1).alias("label"), task.alias("source_task"))
    run = run_classifier_pipeline(raw, "id", target=100, rounds=2, depth=3, **VOCAB)
    assert run.train.count() + run.test.count() == pytest.approx(100, abs=2)
    assert run.train.join(run.test, "id").count() == 0
    assert run.accuracy.first()[0] > 0.9 and run.report.count() == 7


def test_bounded_fit_keeps_all_terms(code):
    model = learn.fit_forest(code, "code", "label", trees=2, fit_rows=20, key="id", **VOCAB)
    assert model.tfidf.documents == 200 and learn.labelled_rows(code, "label", 20, "id", 42).count() == 20
    with pytest.raises(ValueError, match="key"):
        learn.fit_forest(code, "code", "label", fit_rows=20)


def test_classifier_query_reports_the_whole_test_part(spark, monkeypatch):
    from siftline.catalog import queries

    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "FIT_ROWS", 100)
    monkeypatch.setattr(queries, "run_classifier_pipeline", partial(run_classifier_pipeline, rounds=1))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # no two functions are equal
    report = {r["row"]: r["support"] for r in queries.classifier_run(spark, sf_dir).collect()}
    assert report["accuracy"] == -(-orders // 5)


@pytest.mark.parametrize("name", ["forest_scores", "boosted_scores", "review_files"])
def test_queries_take_terms_from_all_rows(spark, monkeypatch, name):
    from siftline.catalog import queries

    class Seen(Exception):
        pass

    def spy(df, *args, **vocab):
        raise Seen(df.count())

    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "FIT_ROWS", 100)
    monkeypatch.setattr(learn, "fit_tfidf", spy)
    with pytest.raises(Seen) as seen:
        queries.QUERIES[name](spark, sf_dir)
    assert seen.value.args[0] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def own_orders(spark, folder, rows):
    """Orders of a table of our own, one of them without a key."""
    keys = spark.range(1, rows + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 31).alias("o_custkey"))
    keys.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS o_orderkey, 5L AS o_custkey")).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_every_train_row_grows_the_boosted_trees(spark, monkeypatch, tmp_path):
    from siftline.catalog import queries

    seen, fit = [], learn.GBTClassifier.fit

    def spy(self, rows, params=None):
        model = fit(self, rows, params)
        seen.append((self.isSet(self.validationIndicatorCol), rows.count(), model.getNumTrees, self.getMaxBins()))
        return model

    monkeypatch.setattr(learn.GBTClassifier, "fit", spy)
    monkeypatch.setattr(queries, "FIT_ROWS", 100)
    monkeypatch.setattr(queries, "run_classifier_pipeline", partial(run_classifier_pipeline, rounds=2))
    report = {r["row"]: r["support"] for r in queries.classifier_run(spark, own_orders(spark, tmp_path, 400)).collect()}
    assert report["accuracy"] == 80
    # texts held back only tell the number of rounds; the model is then grown on them too
    assert sorted(seen) == [(False, 320, 2, 32)] * 4 + [(True, 320, 2, 32)] * 4


def test_every_row_grows_the_forest_of_the_review(spark, monkeypatch, tmp_path):
    from siftline.catalog import queries

    seen, fit = [], learn._fit

    def spy(learner, rows):
        seen.append(rows.count())
        return fit(learner, rows)

    monkeypatch.setattr(learn, "_fit", spy)
    monkeypatch.setattr(queries, "FIT_ROWS", 100)
    got = queries.review_binary(spark, own_orders(spark, tmp_path, 400)).collect()
    assert seen == [400] and len(got) == 800  # the order without a key has no text and no label
    assert all((r["is_buggy"] == 1) == (r["o_orderkey"] % 4 == 3) == r["above_threshold"] for r in got)


def test_cut_offs_come_from_all_rows(spark):
    """One feature a marked row, and no other row that shows where to cut it."""
    rows, marked = 40_000, 12
    own = F.transform(F.sequence(F.lit(0), F.lit(marked - 1)), lambda i: (F.col("id") == i * 3001).cast("double"))
    table = spark.range(rows).select((F.col("id") % 3001 == 0).cast("int").alias("label"), array_to_vector(own).alias("features"), "id")
    marks = table.where(f"id < {marked * 3001}").select("label", "features")
    rest = table.where(f"id >= {marked * 3001}").select(F.lit(0).alias("label"), "features")
    learner = learn.RandomForestClassifier(
        labelCol="label", numTrees=1, maxDepth=30, bootstrap=False, featureSubsetStrategy="all", seed=1
    )
    data = marks.unionByName(rest)
    wrong = learn._fit(learner, data).transform(data).where("label <> prediction").count()
    assert wrong == 0
    assert [learn.bins_for(n) for n in (0, 1, 10_000, 10_001, 40_000, 40_001)] == [32, 32, 32, 101, 200, 201]
