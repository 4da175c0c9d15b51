import pytest

from siftline.operators import evaluate as E

# The published confusion matrix of 35,000 test rows.
MATRIX = [[8235, 1546, 5330, 596], [909, 4919, 46, 485], [2297, 22, 7310, 19], [277, 533, 14, 2462]]
REPORT = {
    "0": (0.7028, 0.5243, 0.6005, 15707),
    "1": (0.7007, 0.7735, 0.7353, 6359),
    "2": (0.5756, 0.7577, 0.6542, 9648),
    "3": (0.6912, 0.7492, 0.7190, 3286),
    "accuracy": (0.6550, 0.6550, 0.6550, 35000),
    "macro avg": (0.6676, 0.7012, 0.6773, 35000),
    "weighted avg": (0.6662, 0.6550, 0.6509, 35000),
}


@pytest.fixture(scope="module")
def scored(spark):
    cells = [(a, p, n) for a, row in enumerate(MATRIX) for p, n in enumerate(row)]
    df = spark.createDataFrame(cells, "label int, prediction int, n int")
    return df.selectExpr("label", "prediction", "explode(sequence(1, n)) AS copy")


def test_published_report(scored):
    got = {r["row"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in E.classification_report(scored).collect()}
    assert got == REPORT


def test_published_matrix_and_accuracy(scored):
    assert [list(r)[1:] for r in E.confusion_matrix(scored).collect()] == MATRIX
    assert round(E.accuracy(scored).first()[0], 4) == 0.6550
    overall, report, _ = E.evaluate(scored)
    assert round(overall.first()[0], 4) == 0.6550 and report.count() == 7


def test_missing_classes_count_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "label int, prediction int")
    got = {r["row"]: r for r in E.classification_report(df).collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["support"]) == (0.0, 0.0, 0)
    assert [list(r) for r in E.confusion_matrix(df).collect()][2:] == [[2, 0, 0, 0, 0], [3, 0, 0, 0, 0]]


def test_exact_match(spark):
    df = spark.createDataFrame([(1, " a", "a"), (2, "b", "c")], "id int, prediction string, target string")
    assert E.exact_match(df).first()[0] == 50.0
    assert E.exact_match(df, limit=1, order="id").first()[0] == 100.0
    assert E.exact_match(df.limit(0)).first()[0] == 0.0


def test_classes_outside_the_list_are_kept(spark):
    df = spark.createDataFrame([(0, 0), (7, 1), (1, 9)], "label int, prediction int")
    for matrix in (E.confusion_matrix(df), E.evaluate(df)[2]):
        rows = {r["actual"]: r.asDict() for r in matrix.collect()}
        assert sorted(rows) == [0, 1, 2, 3, 7, 9]
        assert rows[7]["predicted_1"] == rows[1]["predicted_9"] == rows[0]["predicted_0"] == 1
        assert sum(v for r in rows.values() for k, v in r.items() if k != "actual") == 3
