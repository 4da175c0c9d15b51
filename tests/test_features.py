import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.functions import term_sketch
from siftline.functions.tokens import tokenize_bug_aware
from siftline.operators import features as X

DOCS = ["a = b + 1", "A = b - 1", "return a + b", "", None, "zzz", "a a a b"]
TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[=+-]")


def grams(text):
    tokens = TOKEN.findall((text or "").lower())
    return tokens + [f"{x} {y}" for x, y in zip(tokens, tokens[1:], strict=False)]


def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, code string")


def by_hand(min_df=2, size=20_000):
    counts = [Counter(grams(text)) for text in DOCS]
    cf, df = sum(counts, Counter()), Counter(term for count in counts for term in count)
    kept = sorted(sorted((t for t in cf if df[t] >= min_df), key=lambda t: (-cf[t], t))[:size])
    idf = {t: math.log((1 + len(DOCS)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for row, count in enumerate(counts):
        weights = {t: (1 + math.log(count[t])) * idf[t] for t in kept if count[t]}
        length = math.sqrt(sum(w * w for w in weights.values()))
        out |= {(row, t): w / length for t, w in weights.items()}
    return kept, cf, df, out


def test_terms_and_stats(spark):
    got = {(r["id"], r["term"]): r["tf"] for r in X.terms(docs(spark), "id", "code", X.BUG_AWARE).collect()}
    assert got == {(n, t): c for n, text in enumerate(DOCS) for t, c in Counter(grams(text)).items()}
    _, cf, df, _ = by_hand()
    stats = X.term_stats(docs(spark).repartition(3), "code", X.BUG_AWARE).collect()
    assert {r["term"]: (r["df"], r["cf"]) for r in stats} == {t: (df[t], cf[t]) for t in cf}


def test_tfidf_by_hand(spark):
    for size in (20_000, 3):
        kept, _, _, weights = by_hand(size=size)
        model = X.fit_tfidf(docs(spark), "code", X.BUG_AWARE, max_features=size)
        assert model.vocabulary.column("term").to_pylist() == kept
        got = {(r["id"], r["term"]): r["weight"] for r in model.long(docs(spark), "id", "code").collect()}
        assert got.keys() == weights.keys()
        assert all(abs(got[k] - weights[k]) < 1e-12 for k in got)
        for row in model.vector(docs(spark), "code").collect():
            dense = [weights.get((row["id"], t), 0.0) for t in kept]
            assert np.allclose(row["tfidf"].toArray(), dense)


def test_rare_terms_dropped_before_the_shuffle(spark, monkeypatch):
    """Ties at the cut, terms spread thinly over tasks, and counters shared by many terms change nothing."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(n)}" for n in rng.zipf(1.3, 12) % 900) for _ in range(400)]
    texts += [" ".join(f"tie{n}" for n in range(n % 5, 60, 5)) for n in range(40)] + [f"once{n} once{n}" for n in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, code string").repartition(7)
    everything = X.term_stats(df, "code", X.BUG_AWARE).collect()
    monkeypatch.setattr(term_sketch, "HELD", 2)
    for size, width in ((30, 64), (60, 4096), (80, 1 << 16), (10_000, 4096)):
        want = X.fit_vocab(X.term_stats(df, "code", X.BUG_AWARE), 2, size).collect()
        few = X.frequent_term_stats(df, "code", X.BUG_AWARE, 2, size, width)
        assert X.fit_vocab(few, 2, size).collect() == want
        kept = {r["term"]: (r["df"], r["cf"]) for r in few.collect()}
        assert kept.items() <= {r["term"]: (r["df"], r["cf"]) for r in everything}.items()
        assert len(kept) < len(everything) / 4 or width == 64 or size == 10_000
    nothing = df.where("id < 0")
    assert X.fit_vocab(X.frequent_term_stats(nothing, "code", X.BUG_AWARE, 2, 5), 2, 5).count() == 0
    monkeypatch.setattr(X, "PRUNE_BYTES", 0)
    pruned = X.fit_tfidf(df, "code", X.BUG_AWARE, max_features=50)
    monkeypatch.undo()
    assert pruned.vocabulary.equals(X.fit_tfidf(df, "code", X.BUG_AWARE, max_features=50).vocabulary)


def test_no_known_terms(spark):
    model = X.fit_tfidf(docs(spark), "code", X.BUG_AWARE, min_df=99)
    assert model.vocabulary.num_rows == 0
    assert all(r["tfidf"].size == 0 for r in model.vector(docs(spark), "code").collect())
    assert model.long(docs(spark), "id", "code").count() == 0


def test_legacy_profile_uses_plain_counts(spark):
    df = spark.createDataFrame([(n, "x x y") for n in range(3)], "id int, code string")
    model = X.fit_tfidf(df, "code", X.LEGACY)
    assert model.vocabulary.column("term").to_pylist() == ["x", "x x", "x x y", "x y", "y"]
    row = model.vector(df, "code").first()["tfidf"].toArray()
    assert np.allclose(row, np.array([2, 1, 1, 1, 1]) / math.sqrt(8))


def test_assembled_vector(spark):
    model = X.fit_tfidf(docs(spark), "code", X.BUG_AWARE)
    both = X.assemble_features(X.with_ast_features(model.vector(docs(spark), "code"), "code"))
    for row in both.collect():
        joined = np.concatenate([row["tfidf"].toArray(), list(row["ast"])])
        assert np.allclose(row["features"].toArray(), joined)


def test_encoding(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([0] * 0,), ([1] * 9,)], "ids array<int>")
    got = [(r["input_ids"], r["attention_mask"], r["labels"]) for r in X.fix_length(df, "ids", "ids", 6, 6).collect()]
    assert got[0] == ([5, 6, 7, 0, 0, 0], [1, 1, 1, 0, 0, 0], [5, 6, 7, -100, -100, -100])
    assert got[1] == ([0] * 6, [0] * 6, [-100] * 6)
    assert got[2] == ([1] * 6, [1] * 6, [1] * 6)


def test_encoding_of_input_and_target(spark):
    words = pa.table({"term": ["+", "a", "b"]})
    df = spark.createDataFrame([("a + c + b", "b")], "x string, y string").select(
        tokenize_bug_aware(F.col("x")).alias("x"), tokenize_bug_aware(F.col("y")).alias("y")
    )
    row = X.encode_fixed(df, "x", words, "y", 6, 3).first()
    assert (row["input_ids"], row["attention_mask"]) == ([2, 1, 1, 3, 0, 0], [1, 1, 1, 1, 0, 0])
    assert row["labels"] == [3, -100, -100]


def test_weights_need_no_shuffle(spark):
    model = X.fit_tfidf(docs(spark), "code", X.BUG_AWARE)
    plan = model.long(docs(spark), "id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_what_is_counted_together_is_bounded_by_tokens(monkeypatch):
    import pyarrow as pa

    from siftline.functions import term_sketch, terms

    monkeypatch.setattr(terms, "SLICE_TOKENS", 50)
    given, counted = [], terms._counted
    for module in (terms, term_sketch):
        monkeypatch.setattr(module, "_counted", lambda lists, *span: given.append(len(lists.flatten())) or counted(lists, *span))

    class Rows:
        """Keeps the function of mapInArrow."""

        def select(self, *names):
            return self

        def mapInArrow(self, function, schema):
            return function

    rows = [[f"t{n % 7}"] * (n % 9) for n in range(200)] + [None, [], ["long"] * 80]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["tokens"])
    got = {}
    for part in terms.batch_term_stats(Rows(), "tokens", 1, 1)(iter([batch])):
        for term, df, cf in zip(*(column.to_pylist() for column in part.columns), strict=True):
            got[term] = (got.get(term, (0, 0))[0] + df, got.get(term, (0, 0))[1] + cf)
    flat = [token for row in rows for token in row or []]
    assert got == {t: (sum(t in (row or []) for row in rows), flat.count(t)) for t in set(flat)}
    assert sum(given) == len(flat) and len(given) > 10 and sorted(given)[-2:] == sorted([80, max(n for n in given if n < 80)])
    assert max(n for n in given if n != 80) <= 50
    given.clear()
    list(term_sketch.sketch_terms(Rows(), "tokens", 1, 1, 3, 1024)(iter([batch])))
    assert max(n for n in given if n != 80) <= 50


def test_vectors_of_sliced_batches(spark, monkeypatch):
    import numpy as np

    from siftline.functions import terms

    texts = [" ".join(f"w{n % k}" for n in range(k * 2)) for k in range(1, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, code string").coalesce(1)
    model = X.fit_tfidf(df, "code", X.BUG_AWARE, 1, 100)
    whole = {r["id"]: r["tfidf"] for r in model.vector(df, "code").collect()}
    monkeypatch.setattr(terms, "SLICE_TOKENS", 10)
    assert len(whole) == 29
    sliced = {r["id"]: r["tfidf"] for r in model.vector(df, "code").collect()}
    assert all(np.allclose(whole[i].toArray(), sliced[i].toArray()) for i in whole)
    assert {r["id"] for r in X.terms(df, "id", "code", X.BUG_AWARE).collect()} == set(whole)
