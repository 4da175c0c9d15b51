"""Near copies by exact Jaccard similarity of word shingles, with candidates from Golay keys and MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.llm.golay_simhash import _LOWER, HASH_SEED, fingerprint, linked_fingerprints
from siftline.operators.bitmaps import bitmap_bits, key_bitmap, maybe_among
from siftline.session import written

#: Words of a shingle, and the similarity from which two texts are near copies.
SIZE, LEAST = 5, 0.8
#: Bands of so many minima each. Two texts at similarity s share none with probability (1 - s ** ROWS) ** BANDS: 0.0001 at 0.8.
BANDS, ROWS = 24, 5
#: A pair goes on to the exact check if so many of its minima agree (in their last byte); at 0.8 fewer do with probability 0.00008.
AGREE = round(0.65 * BANDS * ROWS)
#: Shingles whose hashes are mixed at a time; texts whose sketches a task keeps, for copies that follow.
_STEP, _KEPT = 8192, 4096
#: Rows of a bucket part, and shingles of the sets that meet a leader in one group.
PART_ROWS, GROUP_SHINGLES = 1024, 1_000_000
_MIX = np.random.default_rng(5).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_hashes(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of all words, if there are fewer than ``size``."""
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :], strict=False) if len(words) > size else [(0, len(joined))]
    return np.unique(np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of BANDS * ROWS mixings."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        mixed = hashes[at : at + _STEP, None] * _MIX + _ADD
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the band's number and minima."""
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i + 1) for i, row in enumerate(rows)], dtype=np.uint64)


def content_hash(docs: DataFrame) -> Column:
    """A hash of all columns in which a null differs from any value."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))])


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, content, node, fp, keys, sig, n)`` of each row, without its text.

    ``node`` numbers texts as their words see them, ``fp`` is the SimHash fingerprint, ``keys`` are the bands',
    ``sig`` the last bytes of the minima, ``n`` the distinct shingles.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for part in parts:
            found = []
            for value in part.column(2):
                content = value.as_py()
                words = words_of(content)
                node = xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED) if words else 0
                if node not in known:
                    if len(known) >= _KEPT:
                        known = {}
                    hashes = shingle_hashes(words)
                    least = minima(hashes)
                    known[node] = (fingerprint(content, SIZE), band_keys(least), least.astype(np.uint8).tobytes(), len(hashes))
                found.append((node, *known[node]))
            nodes, prints, keys, sigs, sizes = zip(*found, strict=True) if found else ([], [], [], [], [])
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            flat = pa.array(np.concatenate(keys).view(np.int64)) if found else pa.array([], pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), flat)
            arrays = [part.column(0), part.column(1), signed(nodes), signed(prints), listed, pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "content", "node", "fp", "keys", "sig", "n"])

    narrow = docs.select(F.col("doc_id").cast("long"), content_hash(docs).alias("content"), F.col(text).alias("text"))
    return narrow.mapInArrow(batches, "doc_id long, content long, node long, fp long, keys array<long>, sig binary, n long")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(nth, key, first, node)`` of nodes that share a key with another: bands, equal fingerprints, fingerprints near by Golay keys."""
    banded = nodes.select("node", F.posexplode("keys").alias("nth", "key"))
    near = linked_fingerprints(nodes.select("fp").distinct())
    ends = near.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    by_golay = ends.join(nodes.select("fp", "node").hint("merge"), "fp").select("node", F.lit(BANDS + 1).alias("nth"), "key")
    equal = nodes.select("node", F.lit(BANDS).alias("nth"), F.col("fp").alias("key"))
    keyed = banded.unionByName(equal).unionByName(by_golay)
    shared = keyed.groupBy("nth", "key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return written(keyed.join(shared.hint("merge"), ["nth", "key"]), "near-buckets")


def alike(sig: np.ndarray, n: int, sigs: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which rows may be as similar to one as ``least``: sizes in that ratio, and enough minima agree."""
    ratio = np.minimum(n, sizes) >= least * np.maximum(n, sizes)
    return ratio & ((sig == sigs).sum(axis=1) >= AGREE * least / LEAST)


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches do not rule a link out."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (2, 3))
            n, m = (part.column(i).to_numpy() for i in (4, 5))
            fine = ((left == right).sum(axis=1) >= AGREE * least / LEAST) & (np.minimum(n, m) >= least * np.maximum(n, m))
            yield part.select(["a", "b"]).filter(pa.array(fine))

    side = lambda name: nodes.select(F.col("node").alias(name), F.col("sig").alias("sig_" + name), F.col("n").alias("n_" + name))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(batches, "a long, b long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` for ``wanted(node, content)``: shingle hashes of that row's text as bytes.

    A bitmap of the wanted rows keeps most of the others out of the one shuffle of
    texts; rows equal in all columns are one before it.
    """
    bits = bitmap_bits(wanted.count())
    bitmap = key_bitmap(wanted, bits, "content")
    rows = docs.select(content_hash(docs).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    passed, may = maybe_among(rows, bitmap, F.col("content"), bits)
    once = passed.where(may).groupBy("content").agg(F.first("text").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 64):  # texts may be long
                some = part.slice(at, 64)
                sets = [shingle_hashes(words_of(t.as_py())).tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = once.join(wanted.hint("merge"), "content").select("node", "text")
    return written(texts.mapInArrow(batches, "node long, shingles binary"), "near-sets")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose shingle sets have a Jaccard similarity of ``least`` or more.

    The partners of each ``a`` are dealt into groups of about GROUP_SHINGLES shingles; a group gets the set of ``a`` once and its
    partners' sets, and gives links only.
    """
    either = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _shingle_sets(docs, written(nodes.select("node", F.col("first.content").alias("content")).join(either.hint("merge"), "node"), "near-wanted"))
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n").hint("merge"), "b")
    groups = sized.groupBy("a").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("groups"))
    dealt = written(pairs.join(groups.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("nth")), "near-dealt")
    leaders = dealt.select("a", "nth").distinct().withColumn("b", F.col("a"))
    members = dealt.unionByName(leaders).join(sets.withColumnRenamed("node", "b").hint("merge"), "b")

    def check(table: pa.Table) -> pa.Table:
        one = table["a"][0].as_py()
        others = table["b"].to_pylist()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
        own = sets[others.index(one)]
        found = []
        for b, other in zip(others, sets, strict=True):
            both = len(np.intersect1d(own, other, assume_unique=True)) if b != one else 0
            if both and both >= least * (len(own) + len(other) - both):
                found.append(b)
        return pa.table({"a": pa.array([one] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return written(members.groupBy("a", "nth").applyInArrow(check, "a long, b long"), "near-links")


def spanning_links(of: np.ndarray, left: np.ndarray, right: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` that join their components ``of``, no more than components.

    A row's set is marked over all shingles at hand, so one pass counts what it shares with all rows
    that its sketch does not rule out and that no link has joined to it yet.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(len(number), bool)
    root = np.unique(of, return_inverse=True)[1]
    links = []
    for a in left.tolist():
        some = right[root[right] != root[a]]
        some = some[alike(sigs[a], sizes[a], sigs[some], sizes[some], least)]
        if not len(some):
            continue
        own = number[ends[a] - sizes[a] : ends[a]]
        marked[own] = True
        lengths = sizes[some]
        begins = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(ends[some] - lengths - begins, lengths)
        both = np.add.reduceat(marked[number[at]], begins, dtype=np.int64)
        marked[own] = False
        for b in some[both >= least * (sizes[a] + lengths - both)].tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                links.append((a, b))
    return links


def _across(docs: DataFrame, mixed: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between components that share a bucket of ``mixed(nth, key, of, node)``.

    A bucket of any size is dealt into parts, of about PART_ROWS rows and GROUP_SHINGLES shingles, that meet in pairs. Sets come
    to the parts and are compared there; what leaves a task are links that join components, fewer than its rows.
    """
    wanted = nodes.select("node", F.col("first.content").alias("content")).join(mixed.select("node").distinct().hint("merge"), "node")
    sets = _shingle_sets(docs, written(wanted, "near-wanted"))
    sized = mixed.join(nodes.select("node", "sig", "n").hint("merge"), "node")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    cells = (
        sized.join(mixed.join(nodes.select("node", "n").hint("merge"), "node").groupBy("nth", "key").agg(parts.alias("parts")).hint("merge"), ["nth", "key"])
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("nth", "key", "of", "node", "sig", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .join(sets.hint("merge"), "node")
    )

    def meet(table: pa.Table) -> pa.Table:
        node, of, part = (table[c].to_numpy() for c in ("node", "of", "part"))
        order = np.argsort(node)  # the same links whatever the order of rows
        node, of, part = node[order], of[order], part[order]
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), -1)[order]
        sets = [np.frombuffer(table["shingles"][i].as_py(), np.uint64) for i in order.tolist()]
        low, high = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links = spanning_links(of, left, right, sigs, sets, least) if len(left) and len(right) else []
        ends = node[np.array(links, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return written(cells.groupBy("nth", "key", "i", "j").applyInArrow(meet, "a long, b long"), "near-more")


def near_groups(docs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """``(node, component)`` of every node with a near copy.

    Nodes that share a key are candidates. Each bucket's nodes are first compared with its
    smallest, which settles a bucket of near copies of any size in as many comparisons as it has
    nodes. Where a bucket still holds several components, its nodes are compared across them inside tasks,
    so no pair that shares a key is passed over unless its sketches rule it out, and pairs are never rows.
    Every link is an exact Jaccard check.
    """
    buckets = _buckets(nodes)
    led = buckets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(_likely(led, nodes, least), "near-pairs")
    links = _linked(docs, nodes, pairs, least)
    groups = connected_components(links)
    placed = buckets.join(groups.hint("merge"), "node", "left").withColumn("of", F.coalesce("component", "node"))
    several = placed.groupBy("nth", "key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("nth", "key")
    mixed = written(placed.join(several.hint("merge"), ["nth", "key"]).select("nth", "key", "of", "node"), "near-mixed")
    if mixed.isEmpty():
        return groups
    return connected_components(links.unionByName(_across(docs, mixed, nodes, least)))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null last), then the smallest content hash.

    Groups are the connected components of links at Jaccard similarity ``least`` of shingles of five words, after
    lowering ASCII letters. Texts equal but for ASCII case and blanks are one node. Null and word-less texts are equal.
    Of rows equal in all columns one stays. Texts are shuffled once for the rows that stay, and those of likely
    pairs once more for the check.
    """
    rows = sketched(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "fp", "keys", "sig", "n")
    firsts = rows.groupBy("node").agg(F.min(place).alias("at"))
    # the rank of a row of a group: smallest id, then content
    rank = F.struct("at.no_id", "at.doc_id", "at.content").alias("first")
    nodes = written(firsts.select("node", rank, "at.fp", "at.keys", "at.sig", "at.n"), "near-nodes")
    groups = near_groups(docs, nodes, least)
    grouped = nodes.select("node", "first").join(groups.hint("merge"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    kept = written(grouped.groupBy("group").agg(F.min("first").alias("first")).select("first.content"), "near-kept")
    whole = docs.groupBy(content_hash(docs).alias("content")).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return whole.join(kept.hint("merge"), "content", "left_semi").select("row.*")
