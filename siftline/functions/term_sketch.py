"""Count sketches of terms, so that terms too rare for a vocabulary stay out of the shuffle.

A sketch is ``ROWS`` tables of ``width`` counters. A term adds its uses to one counter
of each table, so the smallest of its counters is never below its true count, however
sketches of tasks are summed. The module travels inside the task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.terms import _counted, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 2
#: Counters of each table: 16 MB a task at most, whatever the number of terms.
WIDTH = 1 << 20
#: Counters that travel as one row.
CHUNK = 1024
#: Distinct terms a task holds, as a multiple of those wanted, before it keeps its most used ones only.
HELD = 8

SKETCHED = "chunk int, counters binary, term string, df bigint, cf bigint"


def _places(terms: pa.Array, width: int) -> list[np.ndarray]:
    """Counter of every term in each table, from two halves of one hash."""
    values = terms.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, "uint64")
    return [((hashes >> np.uint64(32 * row)) % np.uint64(width)).astype("int64") for row in range(ROWS)]


def _most_used(held: pa.Table, size: int) -> pa.Table:
    """The ``size`` most used terms, each with what was counted of it."""
    summed = held.group_by("term").aggregate([("df", "sum"), ("cf", "sum")]).rename_columns(["term", "df", "cf"])
    return summed.sort_by([("cf", "descending"), ("term", "ascending")]).slice(0, size)


def sketch_terms(df: DataFrame, tokens: str, shortest: int, longest: int, size: int, width: int = WIDTH) -> DataFrame:
    """One pass over ``tokens``: each task's sketch in chunks, and its most used terms with counts.

    A task drops terms beyond ``HELD`` times ``size`` on the way, so the counts of its
    terms are lower bounds. Rows are chunks (``term`` null) or terms (``chunk`` null).
    """
    names = ["chunk", "counters", "term", "df", "cf"]
    types = [pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def rows_of(n: int, **given) -> pa.RecordBatch:
        arrays = [given.get(name, pa.nulls(n, kind)) for name, kind in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(arrays, types, strict=True)], names=names)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((ROWS, width), "int64")
        held, waiting = pa.table({"term": pa.array([], pa.string()), "df": pa.array([], pa.int64()), "cf": pa.array([], pa.int64())}), 0
        for lists in (some for batch in batches for some in slices(batch.column(0))):
            _, places, uses, dictionary = _counted(lists, shortest, longest)
            documents = np.bincount(places, minlength=len(dictionary)).astype("int64")
            total = np.bincount(places, weights=uses, minlength=len(dictionary)).astype("int64")
            for row, at in enumerate(_places(dictionary, width)):
                np.add.at(counters[row], at, total)
            fresh = pa.table({"term": dictionary, "df": pa.array(documents), "cf": pa.array(total)})
            held, waiting = pa.concat_tables([held, fresh]), waiting + len(dictionary)
            if waiting > HELD * size:
                held, waiting = _most_used(held, HELD * size // 2), 0
        most = _most_used(held, size)
        if most.num_rows:
            most = most.combine_chunks()
            columns = {name: most.column(name).chunk(0) for name in ("term", "df", "cf")}
            yield rows_of(most.num_rows, **columns)
        chunks = counters.reshape(-1, min(CHUNK, width))
        used = np.flatnonzero(chunks.any(axis=1))
        if len(used):
            yield rows_of(len(used), chunk=pa.array(used.astype("int32")), counters=pa.array([chunks[i].tobytes() for i in used], pa.binary()))

    return df.select(tokens).mapInArrow(sketch, SKETCHED)


def heavy_counters(sketches: DataFrame, least: int) -> DataFrame:
    """``(chunk, bits)``: which counters of the summed sketches reach ``least``; chunks without one are left out.

    Chunks meet by number and are summed as they stream by, so a task holds its own chunks only.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counters in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                read = np.frombuffer(counters.as_buffer(), "int64")
                if chunk in summed:
                    summed[chunk] += read
                else:
                    summed[chunk] = read.copy()
        found = [(chunk, np.packbits(total >= least).tobytes()) for chunk, total in summed.items() if (total >= least).any()]
        if found:
            numbers, bits = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    chunks = sketches.where(F.col("chunk").isNotNull()).select("chunk", "counters")
    return chunks.repartition("chunk").mapInArrow(merge, "chunk int, bits binary")


def heavy_table(found: pa.Table, width: int = WIDTH) -> np.ndarray:
    """``heavy_counters``, brought together as one row of bits a table: ``ROWS`` * ``width`` / 8 bytes."""
    size = min(CHUNK, width)
    bits = np.zeros((ROWS * width // size, (size + 7) // 8), "uint8")
    for chunk, row in zip(found.column("chunk").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[chunk] = np.frombuffer(row, "uint8")
    return bits


def heavy_term_stats(
    df: DataFrame, tokens: str, shortest: int, longest: int, bits: np.ndarray, width: int = WIDTH
) -> DataFrame:
    """(term, df, cf) combined per batch, of the terms whose counters are all heavy."""
    size = min(CHUNK, width)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(bits, axis=1, count=size).reshape(ROWS, width).astype(bool)
        for lists in (some for batch in batches for some in slices(batch.column(0))):
            _, places, uses, dictionary = _counted(lists, shortest, longest)
            documents = np.bincount(places, minlength=len(dictionary)).astype("int64")
            total = np.bincount(places, weights=uses, minlength=len(dictionary)).astype("int64")
            kept = np.ones(len(dictionary), bool)
            for row, at in enumerate(_places(dictionary, width)):
                kept &= heavy[row][at]
            yield pa.RecordBatch.from_arrays(
                [dictionary.filter(pa.array(kept)), pa.array(documents[kept]), pa.array(total[kept])], names=["term", "df", "cf"]
            )

    return df.select(tokens).mapInArrow(combine, "term string, df bigint, cf bigint")
