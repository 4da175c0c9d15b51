"""From raw labelled functions to an evaluated classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from siftline.operators.curate import dedupe_clean, map_labels
from siftline.operators.evaluate import evaluate
from siftline.operators.learn import CodeModel, fit_boosted, fit_forest, save_model, score_binary, score_multiclass
from siftline.operators.sampling import stratified_sample, stratified_split
from siftline.session import written


@dataclass(frozen=True)
class ClassifierRun:
    train: DataFrame
    test: DataFrame
    model: CodeModel
    scored: DataFrame
    accuracy: DataFrame
    report: DataFrame
    confusion: DataFrame


def curate_functions(raw: DataFrame, order: list[str] | str, target: int | None, seed: int = 42) -> DataFrame:
    """Map labels, drop repeated clean texts, and draw the stratified sample.

    ``order`` identifies a row and says which copy counts as the first. The deduplicated rows
    are written once, since sampling reads their narrow columns several times.
    """
    deduped = written(dedupe_clean(map_labels(raw), "function", "label", order), "functions")
    if target is None:
        return deduped
    return stratified_sample(deduped, "label", target, order, seed)


def run_classifier_pipeline(
    raw: DataFrame,
    order: list[str] | str,
    target: int | None = 175_000,
    test_fraction: float = 0.2,
    seed: int = 42,
    store: str | None = None,
    **training,
) -> ClassifierRun:
    """Curate, split, train on the train part, and evaluate on the rest; ``store`` keeps the model there.

    ``fit_rows`` among ``training`` bounds the train rows that grow the trees; the whole rest is scored and reported.
    """
    sample = written(curate_functions(raw, order, target, seed), "sample")
    # Both parts are filters on the scan of the sample, so they are not written again.
    train, test = stratified_split(sample, "label", test_fraction, order, seed)
    model = fit_boosted(train, "function", "label", seed=seed, key=order, **training)
    if store:
        save_model(raw.sparkSession, model, store)
    scored = written(score_multiclass(test.drop("bug_type"), model, "function"), "scored")
    return ClassifierRun(train, test, model, scored, *evaluate(scored))


def run_forest_pipeline(
    snippets: DataFrame,
    key: list[str] | str,
    test_fraction: float = 0.2,
    seed: int = 42,
    store: str | None = None,
    code: str = "code_snippet",
    label: str = "label",
    **training,
) -> ClassifierRun:
    """Split labelled snippets, fit the forest on the train part, and evaluate the more likely class on the rest."""
    train, test = stratified_split(written(snippets, "snippets"), label, test_fraction, key, seed)
    model = fit_forest(train, code, label, seed=seed, **training)
    if store:
        save_model(snippets.sparkSession, model, store)
    scored = score_binary(test, model, code, threshold=0.5).withColumnRenamed("is_buggy", "prediction")
    scored = written(scored, "scored")
    return ClassifierRun(train, test, model, scored, *evaluate(scored, label))
