"""A corpus pipeline over ``documents``: reject toxic and poor texts, drop near copies, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import line_crf, near_text, pair_index_bpe, systematic_mix, toxicity
from siftline.llm.common import read_table
from siftline.llm.queries import tokenizer_path
from siftline.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; learned from the labelled ones among ``docs``."""
    judged = toxicity.toxicity(docs, read_table(spark, sf_dir, "labels"), COLUMNS)
    return judged.where("predicted = 0").select(*COLUMNS)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field judges good; learned from the labelled ones among ``docs``."""
    judged = line_crf.quality(docs, read_table(spark, sf_dir, "labels"), COLUMNS)
    return judged.where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that with the smallest doc_id, null last.

    Near copies have a Jaccard similarity of 0.8 or more of their shingles of five words. Repeated rows
    and rows with a null id are rows like any other.
    """
    return near_text.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return systematic_mix.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each row."""
    return pair_index_bpe.encoded(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The trained stages and the encoding are beyond SQL; tests check each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
