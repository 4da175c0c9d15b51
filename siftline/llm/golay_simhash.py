"""SimHash fingerprints of word shingles, linked by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.session import written

#: Generator polynomial of the perfect [23, 12] Golay code, and its parameters.
GENERATOR = 0xC75
LENGTH, CHECKS = 23, 11
#: Two words at one bit's distance: the codeword nearest to one (at most 3 away) is at most this far from the other.
REACH = 4

HASH_SEED = 42
#: The bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint of one text: the majority of each hash bit over all shingles, repeats included."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    spans = zip(starts, ends[size - 1 :], strict=False)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], HASH_SEED) for a, b in spans]), dtype=np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row, fp as a signed long; null and word-less texts have zero."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([fingerprint(t.as_py()) for t in part.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(batches, "doc_id long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial; zero for codewords."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        left = np.where((left >> bit) & 1, left ^ (GENERATOR << (bit - CHECKS)), left)
    return left


class GolayIndex:
    """For each remainder, the error patterns of weight up to ``REACH`` that turn a word into a codeword."""

    def __init__(self) -> None:
        from itertools import combinations

        patterns = [sum(1 << b for b in c) for k in range(REACH + 1) for c in combinations(range(LENGTH), k)]
        by_remainder: dict[int, list[int]] = {}
        for pattern, rest in zip(patterns, _remainders(np.array(patterns)).tolist(), strict=True):
            by_remainder.setdefault(rest, []).append(pattern)  # lightest first: the first one decodes
        width = max(map(len, by_remainder.values()))
        self.errors = np.full((1 << CHECKS, width), -1, dtype=np.int64)
        for rest, found in by_remainder.items():
            self.errors[rest, : len(found)] = found

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index of the one codeword within three bits of each word."""
        return (words ^ self.errors[_remainders(words), 0]) >> CHECKS

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, codeword index)`` for all codewords within ``REACH`` of each word."""
        errors = self.errors[_remainders(words)]
        row, slot = np.nonzero(errors >= 0)
        return row, (words[row] ^ errors[row, slot]) >> CHECKS


def segment_keys(fps: np.ndarray, index: GolayIndex, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of fingerprints, for the stored side or the probing side.

    With three differing bits at most, one of the four 16-bit blocks is equal, and
    of the two halves of the other 48 bits one differs in one bit at most. A key is
    the equal block joined with a codeword near such a half, cut to 23 of its 24
    bits (which only brings halves nearer). The stored side has the nearest
    codeword, the probing side all within ``REACH``: one of them is equal.
    """
    rows, keys = [], []
    for block in range(4):
        same = (fps >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        low = fps & np.uint64((1 << 16 * block) - 1)
        high = (fps >> np.uint64(16 * block + 15) >> np.uint64(1)) << np.uint64(16 * block)
        rest = low | high
        for half in range(2):
            word = ((rest >> np.uint64(24 * half)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
            row, code = index.nearby(word) if probe else (np.arange(len(fps)), index.nearest(word))
            rows.append(row)
            keys.append((((block * 2 + half) << 28) | (same[row].astype(np.int64) << 12)) | code)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame, probe: bool, name: str) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GolayIndex()
        for part in parts:
            fps = part.column(0).to_numpy(zero_copy_only=False)
            row, key = segment_keys(fps.view(np.uint64), index, probe)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", name])

    return prints.select("fp").mapInArrow(batches, f"key long, {name} long")


def linked_fingerprints(prints: DataFrame, most_bits: int = 3) -> DataFrame:
    """All pairs ``(a, b)`` of different fingerprints at ``most_bits`` (3 at most) differing bits, a < b.

    ``prints(fp)`` holds distinct fingerprints. A fingerprint has at most 43,744
    others within three bits, so pairs grow with the number of fingerprints, and
    the check sits in the join itself: no unverified pair is ever a row.
    """
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)
    # a pair meets once from each side, so every unordered pair is found with a < b
    stored, probing = _keyed(prints, False, "a"), _keyed(prints, True, "b")
    # keys outgrow the fingerprints they come from, whose size the planner goes by: never broadcast them
    keyed = stored.join(probing.hint("merge"), (stored["key"] == probing["key"]) & near)
    return keyed.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, text: str = "text", most_bits: int = 3) -> DataFrame:
    """Near-duplicate groups of ``docs``: ``(doc_id, fingerprint, component_id, fp_class_size)``, one row per row.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``most_bits`` bits. Copies share a fingerprint and are one node of the link
    graph, so a group of copies never meets itself. Whole texts are read.

    Null and empty texts have fingerprint zero and link like any other. Rows with a
    null doc_id are kept and take the smallest id of their group (null if it has
    none). Repeated rows are returned as often as they came. Columns beyond doc_id
    and text are not looked at. An empty table gives an empty result.
    """
    prints = written(with_fingerprint(docs, text), "simhash-fp")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-class")
    grouped = connected_components(linked_fingerprints(classes, most_bits))
    placed = written(
        classes.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "component", F.coalesce("component", "fp")
        ),
        "simhash-placed",
    )
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = written(
        placed.join(smallest, "component").select("fp", "component_id", F.col("n").alias("fp_class_size")), "simhash-group"
    )
    return prints.join(of_print, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "fp_class_size",
    )
