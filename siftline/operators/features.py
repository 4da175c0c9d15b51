"""Terms, vocabulary, TF-IDF weights and code features of whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.code import AST_FEATURES, ast_features, extract_featured_functions, extract_functions
from siftline.functions.term_sketch import WIDTH, heavy_counters, heavy_table, heavy_term_stats, sketch_terms
from siftline.functions.terms import (
    batch_term_stats,
    term_counts,
    tfidf_vector,
    tfidf_weights,
    vocabulary_ids,
)
from siftline.functions.tokens import tokenize_bug_aware, tokenize_legacy
from siftline.session import planned_bytes, written

#: Input bytes from which a vocabulary takes a pass more to keep rare terms out of the shuffle; the result is the same.
PRUNE_BYTES = 4 << 30


@dataclass(frozen=True)
class Profile:
    """How code becomes terms and weights."""

    name: str
    tokenize: Callable[[Column], Column]
    shortest: int
    longest: int
    min_df: int
    max_features: int
    sublinear: bool

    def tokens(self, code: str) -> Column:
        """Tokens of the lower-cased text."""
        return self.tokenize(F.lower(F.col(code)))

    @property
    def weighting(self) -> tuple[int, int, bool]:
        return self.shortest, self.longest, self.sublinear


# Settings of the two vectorizers.
BUG_AWARE = Profile("bug_aware", tokenize_bug_aware, 1, 2, 2, 20_000, True)
LEGACY = Profile("legacy", tokenize_legacy, 1, 4, 3, 15_000, False)
PROFILES = {profile.name: profile for profile in (BUG_AWARE, LEGACY)}


def terms(df: DataFrame, key: str, code: str, profile: Profile) -> DataFrame:
    """(key, term, tf): one row per distinct term of a document, counted within the row."""
    counted = term_counts(profile.tokens(code), profile.shortest, profile.longest)
    return df.select(key, F.inline(counted))


def term_stats(df: DataFrame, code: str, profile: Profile) -> DataFrame:
    """(term, df, cf): documents holding the term, and its uses in all.

    Counts are combined per batch, again per task, and only then shuffled by term, so
    a term found in every document costs no more than a rare one.
    """
    tokens = df.select(profile.tokens(code).alias("tokens"))
    partial = batch_term_stats(tokens, "tokens", profile.shortest, profile.longest)
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def frequent_term_stats(
    df: DataFrame, code: str, profile: Profile, min_df: int, max_features: int, width: int = WIDTH
) -> DataFrame:
    """The rows of ``term_stats`` that can be among the ``max_features`` most used terms, with exact counts.

    A first pass gives each task's most used terms, whose sums are lower bounds, and a
    count sketch, whose counters are upper bounds. As many terms as wanted reach the
    last of the best lower bounds, so a term that a counter keeps below it cannot be
    chosen, ties included. The second pass drops such terms inside the task and counts
    the others exactly. With fewer terms than wanted nothing is dropped.
    """
    tokens = df.select(profile.tokens(code).alias("tokens"))
    span = (profile.shortest, profile.longest)
    sketches = written(sketch_terms(tokens, "tokens", *span, max_features, width), "term-sketch")
    sums = sketches.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    best = sums.where(F.col("df") >= min_df).orderBy(F.desc("cf")).limit(max_features).select("cf")
    bound = best.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("least")).first()
    if bound["n"] < max_features:
        return term_stats(df, code, profile)
    heavy = heavy_table(heavy_counters(sketches, bound["least"]).toArrow(), width)
    partial = heavy_term_stats(tokens, "tokens", *span, heavy, width)
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def fit_vocab(stats: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """(idx, term, df, cf) of the most used terms; index in term order, from 0.

    Ties at the cut go to the earlier term. The numbering window sees at most
    ``max_features`` rows.
    """
    top = stats.where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
    index = (F.row_number().over(Window.orderBy("term")) - 1).alias("idx")
    return top.select(index, "term", "df", "cf")


def with_idf(vocab: DataFrame, documents: int) -> DataFrame:
    """Add the smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1``."""
    return vocab.withColumn("idf", F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1.0)


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary with its weights; transforms rows without any shuffle."""

    profile: Profile
    documents: int
    vocabulary: pa.Table  # idx, term, df, cf, idf in index order

    def vector(self, df: DataFrame, code: str, into: str = "tfidf") -> DataFrame:
        """Add the sparse unit-length TF-IDF vector of each row."""
        tokens = self.profile.tokens(code)
        return df.withColumn(into, tfidf_vector(tokens, self.profile.weighting, self.vocabulary))

    def long(self, df: DataFrame, key: str, code: str) -> DataFrame:
        """(key, term, weight), one row per known term of a document."""
        tokens = self.profile.tokens(code)
        return df.select(key, F.inline(tfidf_weights(tokens, self.profile.weighting, self.vocabulary)))

    def terms_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.vocabulary)


def fit_tfidf(
    df: DataFrame,
    code: str,
    profile: Profile = BUG_AWARE,
    min_df: int | None = None,
    max_features: int | None = None,
) -> TfidfModel:
    """Fit vocabulary and weights on one table; apply them to any other.

    The vocabulary holds at most ``max_features`` rows, so bringing it to the driver
    and into the tasks is bounded by a parameter and not by the data.
    """
    min_df = profile.min_df if min_df is None else min_df
    max_features = profile.max_features if max_features is None else max_features
    if planned_bytes(df) >= PRUNE_BYTES:
        stats = frequent_term_stats(df, code, profile, min_df, max_features)
    else:
        stats = term_stats(df, code, profile)
    vocab = fit_vocab(stats, min_df, max_features)
    documents = df.count()
    return TfidfModel(profile, documents, with_idf(vocab, documents).orderBy("idx").toArrow())


def with_ast_features(df: DataFrame, code: str, into: str = "ast") -> DataFrame:
    """Add the STRUCT of the 34 syntax features."""
    return df.withColumn(into, ast_features(F.col(code)))


def assemble_features(
    df: DataFrame, tfidf: str = "tfidf", ast: str = "ast", into: str = "features"
) -> DataFrame:
    """One vector of TF-IDF weights followed by the syntax features, row by row."""
    dense = array_to_vector(F.array(*[F.col(ast)[name] for name in AST_FEATURES]))
    assembler = VectorAssembler(inputCols=[tfidf, "_ast_vector"], outputCol=into)
    return assembler.transform(df.withColumn("_ast_vector", dense)).drop("_ast_vector")


def split_functions(df: DataFrame, code: str = "code", with_ast: bool = False) -> DataFrame:
    """One row per function of each source text, in breadth-first order.

    Text without functions, or that does not parse, gives one row with all of it.
    ``with_ast`` adds the syntax features of each function as ``ast``, from the same parse.
    """
    functions = extract_featured_functions if with_ast else extract_functions
    return df.select(*[name for name in df.columns if name != code], F.inline(functions(F.col(code))))


def encode_fixed(
    df: DataFrame,
    tokens: str,
    vocabulary: pa.Table,
    target_tokens: str | None = None,
    max_input: int = 256,
    max_label: int = 128,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels`` of fixed lengths.

    Ids are the token's place in the vocabulary plus one, 0 pads, and tokens outside
    the vocabulary are left out before cutting. The lookup happens within the row.
    """
    coded = df.withColumn("_ids", vocabulary_ids(F.col(tokens), vocabulary))
    target = "_ids"
    if target_tokens is not None:
        target = "_target_ids"
        coded = coded.withColumn(target, vocabulary_ids(F.col(target_tokens), vocabulary))
    return fix_length(coded, "_ids", target, max_input, max_label).drop("_ids", "_target_ids")


def fix_length(
    df: DataFrame, ids: str, target_ids: str, max_input: int = 256, max_label: int = 128, pad: int = 0
) -> DataFrame:
    """Cut or pad id arrays; the mask marks real ids and labels hide padding as -100."""

    def fitted(column: str, size: int) -> Column:
        return F.slice(F.concat(F.col(column), F.array_repeat(F.lit(pad), size)), 1, size)

    real = F.least(F.size(ids), F.lit(max_input))
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(max_input) - real))
    labels = F.transform(
        fitted(target_ids, max_label), lambda value: F.when(value == pad, -100).otherwise(value)
    )
    return df.select(
        "*", fitted(ids, max_input).alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels")
    )
