"""Centroid clustering over space-filling-curve zone maps: Hilbert-ordered blocks, box bounds, exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.session import written

CLUSTERS, ROUNDS, DIMENSIONS = 8, 10, 64
#: Rows of a block with one box.
BLOCK = 256
#: The curve runs through the most varied components, cut into 2**LEVELS parts each: a key of 60 bits.
CURVE_DIMENSIONS, LEVELS = 15, 4
#: Integer components stay below this, so a squared distance of 64 components fits a long.
LARGEST = 1 << 27
#: Below this, sums of 64 products are exact in doubles and the matrix product of doubles is used.
_EXACT = 1 << 22


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2**levels) along the Hilbert curve through all of them.

    From the top level down, a cell's bits name one corner of a cube. The cube is
    turned so that the curve enters it at corner 0 and leaves along the first axis; there
    corners follow each other in Gray code, and the corner's rank gives the key's next digits and the next turn.
    """
    n = cells.shape[1]
    mask = (1 << n) - 1
    weights = 1 << np.arange(n)
    rotl = lambda x, k: ((x << k) | (x >> (n - k))) & mask
    key, entry, axis = (np.zeros(len(cells), np.int64) for _ in range(3))
    for level in range(levels - 1, -1, -1):
        corner = (((cells >> level) & 1) * weights).sum(axis=1)
        turn = (axis + 1) % n
        gray = rotl(corner ^ entry, (n - turn) % n)
        rank, half = gray.copy(), 1
        while half < n:
            rank ^= rank >> half
            half *= 2
        key = (key << n) | rank
        lower = np.maximum((rank - 1) // 2 * 2, 0)
        entry ^= rotl(lower ^ (lower >> 1), turn)
        odd = np.where(rank % 2 == 0, rank - 1, rank)
        ones = np.zeros(len(cells), np.int64)  # trailing ones of the odd number next to the rank
        rest = np.maximum(odd, 0)
        while (rest & 1).any():
            ones += rest & 1
            rest = np.where(rest & 1, rest >> 1, 0)
        axis = (axis + ones + 1) % n
    return key


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, ``v`` the integers floor(1024 * x)."""
    raw = F.col(embedding).cast("array<double>")
    fine = (F.size(raw) == dimensions) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(raw, lambda x: F.floor(x * 1024).cast("double"))
    refused = F.raise_error(F.lit(f"a component is past {LARGEST}, so that distances may not fit a long"))
    checked = F.when(F.exists(scaled, lambda x: F.abs(x) >= LARGEST), refused).otherwise(F.transform(scaled, lambda x: x.cast("int")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), checked.alias("v"))


def first_centroids(whole: DataFrame, clusters: int, seed: int = 3) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = whole.select(digest.alias("at"), "vec_id", "v").orderBy("at", "vec_id", "v").limit(clusters).collect()
    return [list(r["v"]) for r in rows]


def box_distances(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance from a box to each centroid, exactly."""
    under, over = low - centroids, centroids - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of a box: none is surely nearer to all of it."""
    least, largest = box_distances(low, high, centroids)
    return np.flatnonzero(least <= largest.min())


def nearest(v: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``numbers`` (ascending; ties to the smaller) and squared distance, in whole numbers."""
    some = centroids[numbers]
    if max(np.abs(v).max(initial=0), np.abs(some).max(initial=0)) < _EXACT:
        a, b = v.astype(np.float64), some.astype(np.float64)
        apart = ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    else:
        apart = np.stack([((v - c) ** 2).sum(axis=1) for c in some], axis=1)
    best = apart.argmin(axis=1)
    return numbers[best], apart[np.arange(len(v)), best]


def zone_mapped(whole: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, v, low, high)``: rows in Hilbert order; the first of each BLOCK rows of a partition holds their box.

    The curve takes the components that vary most, each cut evenly within two
    deviations of its mean. Rows are range-partitioned by key, id and row number, so
    equal vectors, however many, spread over partitions like any others.
    """
    stats = (
        whole.select(F.posexplode("v").alias("at", "x")).groupBy("at")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).collect()
    )
    widest = sorted(stats, key=lambda r: (-r["spread"], r["at"]))[:CURVE_DIMENSIONS]
    axes = np.array([r["at"] for r in widest], dtype=np.int64)
    base = np.array([r["mean"] - 2 * r["spread"] for r in widest])
    unit = np.maximum(np.array([r["spread"] for r in widest]) * 4, 1e-9) / (1 << LEVELS)

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimensions).astype(np.int32)
            cells = np.clip((v[:, axes] - base) / unit, 0, (1 << LEVELS) - 1).astype(np.int64)
            packed = pa.array([row.tobytes() for row in v], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array(hilbert_keys(cells, LEVELS))], ["vec_id", "v", "key"])

    def boxed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(block: list[tuple]) -> pa.RecordBatch:
            v = np.frombuffer(b"".join(x[1] for x in block), np.int32).reshape(len(block), dimensions)
            box = [[edge.tobytes()] + [None] * (len(block) - 1) for edge in (v.min(axis=0), v.max(axis=0))]
            arrays = [pa.array([x[0] for x in block], pa.int64()), pa.array([x[1] for x in block], pa.binary()), *(pa.array(e, pa.binary()) for e in box)]
            return pa.RecordBatch.from_arrays(arrays, ["vec_id", "v", "low", "high"])

        block: list[tuple] = []
        for part in parts:
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                block.append(row)
                if len(block) == BLOCK:
                    yield made(block)
                    block = []
        if block:
            yield made(block)

    placed = written(whole.mapInArrow(keyed, "vec_id long, v binary, key long").withColumn("row", F.monotonically_increasing_id()), "hilbert-keys")
    order = ["key", "vec_id", "row"]
    sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")
    return written(sorted_rows.mapInArrow(boxed, "vec_id long, v binary, low binary, high binary"), "hilbert-blocks")


def _blocks(parts: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, vectors, low, high)`` of each block in a task; a block that is cut off its box gets one of its own."""
    ids: list = []
    packed: list[bytes] = []
    box: tuple = (None, None)

    def made():
        v = np.frombuffer(b"".join(packed), np.int32).reshape(len(packed), dimensions).astype(np.int64)
        low, high = (np.frombuffer(e, np.int32).astype(np.int64) for e in box) if box[0] is not None else (v.min(axis=0), v.max(axis=0))
        return ids, v, low, high

    for part in parts:
        for one, v, low, high in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if ids and (low is not None or len(ids) == BLOCK):
                yield made()
                ids, packed = [], []
            if not ids:
                box = (low, high)
            ids.append(one)
            packed.append(v)
    if ids:
        yield made()


def _sums(blocks: DataFrame, centroids: list[list[int]], dimensions: int) -> tuple[list[list[int]], int, int]:
    """Count, then component sums, of each cluster; and how many of all (block, centroid) pairs were compared."""
    clusters = len(centroids)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = np.array(centroids, dtype=np.int64), np.zeros((clusters, dimensions + 1), np.int64)
        pairs = [0, 0]
        for _, v, low, high in _blocks(parts, dimensions):
            numbers = candidates(low, high, at)
            pairs = [pairs[0] + (len(numbers) if len(numbers) > 1 else 0), pairs[1] + clusters]
            if len(numbers) == 1:  # the whole block belongs to one
                total[numbers[0], 0] += len(v)
                total[numbers[0], 1:] += v.sum(axis=0)
                continue
            mine = nearest(v, at, numbers)[0]
            for c in numbers:
                total[c, 0] += (mine == c).sum()
                total[c, 1:] += v[mine == c].sum(axis=0)
        rows = [*total.tolist(), [*pairs, *[0] * (dimensions - 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(range(clusters + 1), pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["cluster", "sums"])

    partial = blocks.mapInArrow(batches, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    out = [[0] * (dimensions + 1) for _ in range(clusters + 1)]
    for r in partial.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        out[r["cluster"]][r["at"]] = int(r["x"])
    return out[:clusters], out[clusters][0], out[clusters][1]


def fit(blocks: DataFrame, centroids: list[list[int]], rounds: int, dimensions: int = DIMENSIONS, pairs: list | None = None) -> list[list[int]]:
    """Centroids after ``rounds`` rounds; a non-empty one becomes the exact floor of its vectors' mean.

    A round brings one row of sums per cluster and component to the driver. ``pairs`` gathers ``(compared, all)`` of each round.
    """
    for _ in range(rounds):
        sums, compared, every = _sums(blocks, centroids, dimensions)
        centroids = [[x // own[0] for x in own[1:]] if own[0] else old for own, old in zip(sums, centroids, strict=True)]
        if pairs is not None:
            pairs.append((compared, every))
    return centroids


def assign(blocks: DataFrame, centroids: list[list[int]], dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, cluster, distance)`` of each row."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, dtype=np.int64).reshape(-1, dimensions)
        for ids, v, low, high in _blocks(parts, dimensions):
            cluster, distance = nearest(v, at, candidates(low, high, at))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(batches, "vec_id long, cluster int, distance long")


def clusters(
    vectors: DataFrame, n: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    embedding: str = "embedding", vec_id: str = "vec_id",
) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of each vector that takes part, and the final centroids.

    Vectors are laid out once in Hilbert order with a box for each block. In each
    pass, distances from a box to the centroids leave those that may be nearest to a
    vector of the block; if one is left, the block is its own without comparing, else its vectors are
    compared exactly, in whole numbers, with the ones left.

    Null vectors, those of another length, and those with null or non-finite
    components take no part; a component past LARGEST is an error. Null ids and repeated rows are rows
    like any other (null hashes as ``null``). With fewer vectors than ``n`` there are fewer centroids; an empty
    table gives an empty result and no centroids. Other columns are not looked at.
    """
    whole = written(whole_vectors(vectors, vec_id, embedding, dimensions), "hilbert-vectors")
    start = first_centroids(whole, n)
    if not start:
        schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema), []
    blocks = zone_mapped(whole, dimensions)
    centroids = fit(blocks, start, rounds, dimensions)
    return assign(blocks, centroids, dimensions), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and the digest of the cluster's centroid; one row per cluster is fetched."""
    rows = written(assigned, "hilbert-assigned")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    number = F.col("cluster")
    own, digest = F.lit(None).cast("decimal(38,0)"), F.lit(None).cast("string")
    for c, s in sums.items():
        own = F.when(number == c, F.lit(str(s)).cast("decimal(38,0)")).otherwise(own)
        digest = F.when(number == c, F.sha2(F.lit(",".join(map(str, centroids[c]))), 256)).otherwise(digest)
    return rows.select(
        "vec_id", "cluster", "distance",
        own.cast("long").alias("cluster_inertia"),
        F.lit(str(sum(sums.values()))).cast("decimal(38,0)").cast("long").alias("inertia"),
        digest.alias("centroid_sha256"),
    )
