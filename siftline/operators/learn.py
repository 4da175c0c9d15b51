"""Training, scoring and storing classifiers over code features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import isqrt

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRestModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.code import AST_FEATURES
from siftline.operators.counts import balanced_weights, with_label_name
from siftline.operators.features import (
    BUG_AWARE,
    LEGACY,
    Profile,
    TfidfModel,
    fit_tfidf,
)
from siftline.operators.filters import flag_binary, flag_multiclass
from siftline.operators.sampling import stratified_sample
from siftline.operators.stages import CodeFeatures, code_features
from siftline.session import written

#: One in so many texts is kept from boosted trees, to end their rounds.
HELD_SHARE = 10
#: Rows of a task of a boosting round, at least.
ROWS_A_TASK = 10_000
#: Bytes of binned rows that classes fitted side by side may hold; the library bins a row into four bytes a feature.
BINNED_BYTES = 1 << 30
#: Cut-offs a term may have, and the rows up to which the library takes them from all rows at that number.
BINS, BINNED_ROWS = 32, 10_000


@dataclass(frozen=True)
class CodeModel:
    """A fitted vectorizer and classifier that belong together."""

    tfidf: TfidfModel
    model: object
    with_ast: bool

    def features(self, df: DataFrame, code: str, ast: str | None = None) -> DataFrame:
        return code_features(df, code, self.tfidf, self.with_ast, ast)


def labelled_rows(df: DataFrame, label: str, fit_rows: int | None, key: list[str] | str | None, seed: int) -> DataFrame:
    """About ``fit_rows`` rows with the class shares of ``df``, drawn by ``key``, which tells rows apart; without a bound all that have a label."""
    if fit_rows is None:
        return df.where(F.col(label).isNotNull())
    if key is None:
        raise ValueError("a bound on the rows of the fit needs the key that tells rows apart")
    return stratified_sample(df, label, fit_rows, key, seed)


def bins_for(rows: int) -> int:
    """Bins by which the library takes cut-offs from all ``rows``: it draws as many as their square, or ``BINNED_ROWS`` if that is more."""
    return BINS if rows <= BINNED_ROWS else isqrt(rows - 1) + 1


def fit_forest(
    df: DataFrame,
    code: str = "code_snippet",
    label: str = "label",
    trees: int = 150,
    depth: int = 30,
    seed: int = 42,
    profile: Profile = LEGACY,
    fit_rows: int | None = None,
    key: list[str] | str | None = None,
    **vocab,
) -> CodeModel:
    """Random forest over legacy TF-IDF terms, for two or more classes.

    Trees grow until leaves are pure; 30 levels are the most that the library grows.
    With ``fit_rows``, about so many rows grow the trees; see ``labelled_rows``. Terms and their
    weights come from all rows either way, and a term's cut-offs from all rows that grow the trees.
    """
    tfidf = fit_tfidf(df, code, profile, **vocab)
    some = labelled_rows(df, label, fit_rows, key, seed)
    prepared = code_features(some.select(code, label), code, tfidf, with_ast=False)
    learner = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
    )
    return CodeModel(tfidf, _fit(learner, prepared.select(label, "features")), with_ast=False)


def fit_boosted(
    df: DataFrame,
    code: str = "function",
    label: str = "label",
    rounds: int = 500,
    rate: float = 0.05,
    depth: int = 7,
    seed: int = 42,
    parallelism: int = 4,
    subset: str = "all",
    tolerance: float | None = 0.01,
    profile: Profile = BUG_AWARE,
    fit_rows: int | None = None,
    key: list[str] | str | None = None,
    **vocab,
) -> CodeModel:
    """Boosted trees over TF-IDF terms and syntax features, one model per class.

    Depth 7 bounds a tree at 128 leaves. Classes are weighted against their size. A
    node's statistics over all terms pass the driver; with tens of thousands of terms
    give ``subset="sqrt"``, by which each node looks at a random few. ``fit_rows`` bounds
    the rows of the trees and their cut-offs only, as in ``fit_forest``.

    ``rounds`` is a cap. A tenth of the texts, chosen by hash, so that copies fall on one side, is kept from the
    trees; a class's rounds end once its loss there gets better by less than ``tolerance`` of itself in a round. With
    the best number of rounds its model is then grown anew on all rows. ``tolerance=None`` runs all rounds on all rows,
    and so does a table too small to hold rows of either class back.
    """
    tfidf = fit_tfidf(df, code, profile, **vocab)
    some = labelled_rows(df, label, fit_rows, key, seed)
    weighted = balanced_weights(some.select(code, label), label)
    held = F.pmod(F.xxhash64(F.lit(seed), F.col(code)), F.lit(HELD_SHARE)) == 0
    prepared = code_features(weighted.withColumn("held", held), code, tfidf, with_ast=True)
    learner = GBTClassifier(
        labelCol="_is", weightCol="weight", maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed,
        featureSubsetStrategy=subset, maxMemoryInMB=1024,
    )
    # the library keeps binned rows of its own; every task of every round brings along what these were made from
    kept = written(prepared.select(F.col(label).cast("int").alias(label), "weight", "held", "features"), "boosted-rows")
    counts = {(r[label], r["held"]): r["n"] for r in kept.groupBy(label, "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = range(max((c for c, _ in counts), default=-1) + 1)
    rows = sum(counts.values())
    whole = learner.copy({learner.maxBins: bins_for(rows)})
    # each round is several jobs over all rows, so a task should have more to do than to start
    tasks = max(1, rows // ROWS_A_TASK)
    binned = 4 * rows * (tfidf.vocabulary.num_rows + len(AST_FEATURES))

    def fit_one(c: int):
        marked = kept.withColumn("_is", (F.col(label) == c).cast("double")).coalesce(tasks)
        own, all_held = counts.get((c, True), 0), sum(n for (_, h), n in counts.items() if h)
        rows_left = [counts.get((c, False), 0), sum(n for (x, h), n in counts.items() if not h and x != c)]
        if tolerance is None or not own or own == all_held or not all(rows_left):
            return whole.fit(marked)
        tried = whole.copy({learner.validationIndicatorCol: "held", learner.validationTol: tolerance}).fit(marked)
        return whole.copy({learner.maxIter: tried.getNumTrees}).fit(marked)

    # classes wait on many small jobs each, so some are fitted at a time, as far as their rows stay in memory
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, BINNED_BYTES // max(1, binned)))) as pool:
        models = list(pool.map(inheritable_thread_target(kept.sparkSession)(fit_one), classes))
    both = OneVsRestModel(models)._set(featuresCol="features", classifier=learner)  # a model without its classifier cannot be saved
    return CodeModel(tfidf, both, with_ast=True)


def rounds_used(code_model: CodeModel) -> list[int]:
    """Trees that each class's boosted model kept."""
    return [m.getNumTrees for m in code_model.model.models]


def _fit(learner, prepared: DataFrame):
    """Every round rereads the features, so they are kept, spilling to disk, meanwhile."""
    kept = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return learner.copy({learner.maxBins: bins_for(kept.count())}).fit(kept)
    finally:
        kept.unpersist()


def _class_probabilities(df: DataFrame, code_model: CodeModel, code: str, ast: str | None = None) -> tuple[DataFrame, Column]:
    """Scored rows and their ``ARRAY<DOUBLE>`` of class probabilities."""
    featured = code_model.features(df, code, ast)
    model = code_model.model
    if not isinstance(model, OneVsRestModel):
        return model.transform(featured), vector_to_array("probability")
    scored = model.setRawPredictionCol("rawPrediction").transform(featured)
    # A boosted margin m stands for the probability 1 / (1 + exp(-2m)).
    chances = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    spread = scored.withColumn("_chances", chances)
    total = F.aggregate("_chances", F.lit(0.0), lambda so_far, chance: so_far + chance)
    return spread.withColumn("_total", total), F.transform("_chances", lambda chance: chance / F.col("_total"))


def score_multiclass(df: DataFrame, code_model: CodeModel, code: str = "function", ast: str | None = None) -> DataFrame:
    """Add ``prediction``, ``bug_type``, ``confidence`` (4 places) and ``pass_on``."""
    scored, chances = _class_probabilities(df, code_model, code, ast)
    named = scored.withColumn("_chances_of", chances).withColumn("prediction", F.col("prediction").cast("int"))
    sure = F.round(F.element_at("_chances_of", F.col("prediction") + 1), 4)
    flagged = flag_multiclass(with_label_name(named, "prediction").withColumn("confidence", sure), "prediction")
    return flagged.select(*df.columns, "prediction", "bug_type", "confidence", "pass_on")


def score_binary(
    df: DataFrame, code_model: CodeModel, code: str = "code_snippet", threshold: float = 0.30
) -> DataFrame:
    """Add ``probability`` of a bug and ``is_buggy`` at the threshold, inclusive."""
    scored, chances = _class_probabilities(df, code_model, code)
    return flag_binary(
        scored.withColumn("_chances_of", chances).select(
            *df.columns, F.element_at("_chances_of", 2).alias("probability")
        ),
        threshold=threshold,
    )


def code_pipeline(code_model: CodeModel, code: str = "code") -> PipelineModel:
    """The vectorizer and the classifier as one pipeline, which reads the column ``code``."""
    return PipelineModel([CodeFeatures(tfidf=code_model.tfidf, with_ast=code_model.with_ast, inputCol=code), code_model.model])


def save_model(spark: SparkSession, code_model: CodeModel, path: str, code: str = "code") -> None:
    """Write all of a model as one ML pipeline; ``PipelineModel.load(path)`` reads it too."""
    code_pipeline(code_model, code).write().session(spark).overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> CodeModel:
    """Read what ``save_model`` wrote; a folder without it is named in the error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"no features and classifier under {path}; train and save a model first")
    features, classifier = PipelineModel.read().session(spark).load(path).stages
    return CodeModel(features.tfidf, classifier, features.with_ast)
