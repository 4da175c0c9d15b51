"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, and a check of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.session import written

#: Vectors the rotation is learned from, and rounds of learning.
FIT_ROWS, FIT_ROUNDS = 10_000, 30
BITS, TABLES = 64, 8
#: Rows of a bucket that one task compares; larger buckets are dealt into parts of this size that meet in pairs.
PART_ROWS = 1024
#: Vector lengths, the most frequent ones, that get a rotation of their own. Classes of rarer lengths all meet within
#: their label and length, which is exact and, as they are rarer, no more work than one fitted length without codes.
FITTED_WIDTHS = 64


def fit_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = FIT_ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)`` of iterative quantisation: principal axes, turned so that signs lose least.

    Each round takes the signs of the turned vectors, then the rotation that brings
    the vectors nearest to them. With fewer dimensions than bits the rest of the bits
    come from further random axes through the same space.
    """
    width = sample.shape[1]
    mean = sample.mean(axis=0)
    # axes of the covariance, widest first: its size is that of a vector, not of the sample
    axes = np.linalg.eigh((sample - mean).T @ (sample - mean))[1][:, ::-1]
    rng = np.random.default_rng(seed)
    axes = axes[:, :bits]
    if axes.shape[1] < bits:
        extra = rng.normal(size=(width, bits - axes.shape[1])) / np.sqrt(width)
        axes = np.concatenate([axes, extra], axis=1)
    v = (sample - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(v.T @ signs)
        turn = a @ b
    return mean, axes @ turn


def code_bytes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The code of each (unit) vector: one byte for each table."""
    return np.packbits((vectors - mean) @ projection >= 0, axis=1)


def _link_cell(table: pa.Table, least: float) -> pa.Table:
    """Links inside one bucket, or between two parts of one: for each row its links and the smallest id it reaches here.

    A pair is counted in the first table its codes agree in, in no other.
    """
    ids = table["rep"].to_numpy()
    part, copies = table["part"].to_numpy(), table["copies"].to_numpy().astype(np.int64)
    nth = int(table["nth"][0].as_py())
    units = np.stack(table["unit"].to_pylist())
    codes = np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    crossing = part.min() != part.max()
    hit = units @ units.T >= least
    np.fill_diagonal(hit, False)
    if crossing:
        hit &= part[:, None] != part[None, :]
    elif table["both"][0].as_py():
        hit[:] = False  # the pair of parts has rows of one part only: they meet in their own cell
    a, b = np.nonzero(hit)
    if nth:
        earlier = (codes[a, :nth] == codes[b, :nth]).any(axis=1)
        first = ~earlier
    else:
        first = np.ones(len(a), bool)
    links = np.bincount(a[first], weights=copies[b[first]], minlength=len(ids)).astype(np.int64)
    root = np.arange(len(ids))
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while len(a):  # smallest rank over links, until nothing changes
        lower = root.copy()
        np.minimum.at(lower, a, root[b])
        if (lower == root).all():
            break
        root = lower
    some = np.zeros(len(ids), bool)
    some[a] = True
    return pa.table({"rep": ids[some], "links": links[some], "root": ids[order][root[some]]})


def vector_groups(
    vectors: DataFrame, least: float = 0.93, embedding: str = "embedding", vec_id: str = "vec_id", label: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row: links to vectors of equal label at cosine >= ``least``.

    Equal vectors of a label are one class and stand for all copies in every count,
    so copies never meet each other. The rotation is learned from at most FIT_ROWS
    classes, chosen by hash; every class is indexed under each byte of its code.
    Rows of a bucket are compared by their original vectors in double precision, whole
    buckets at a time; counts and reachable ids leave the task, never pairs. A bucket
    of any size is dealt into parts that meet in pairs of parts.

    Null, empty and zero vectors, null labels, and vectors with null or non-finite
    components link with nothing: no links, a component of their own. Vectors of
    different length never link. Rows that share a vec_id are separate vectors, with links and
    components of their own. Null ids are kept with a null component. Other columns are not
    looked at; an empty table gives an empty result.
    """
    raw = F.col(embedding).cast("array<double>")
    squares = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)
    fine = (
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(squares > 0, F.lit(False))
        & ~F.coalesce(F.isnan(squares) | (squares == float("inf")), F.lit(True))
    )
    rows = written(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), raw.alias("v"), fine.alias("fine")),
        "itq-rows",
    )
    valid = rows.where("fine")
    grouped = valid.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # the number is fixed by the written table; ids may be shared by classes, so they cannot stand for them
    classes = written(grouped.withColumn("rep", F.monotonically_increasing_id()), "itq-classes")
    frequent = classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(FITTED_WIDTHS)
    widths = [r["n"] for r in frequent.collect()]
    cells = None
    for width in widths:
        own = classes.where(F.size("v") == width)
        sample = own.orderBy(F.xxhash64("first", "v"), "first", "label").limit(FIT_ROWS).select("v").toPandas()["v"]
        units = np.stack(sample.to_list())
        units = units / np.linalg.norm(units, axis=1, keepdims=True)
        keyed = _keyed(own, width, *fit_rotation(units))
        cells = keyed if cells is None else cells.unionByName(keyed)
    if cells is None:
        found = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    if len(widths) == FITTED_WIDTHS:
        cells = cells.unionByName(_unkeyed(classes.where(~F.size("v").isin(widths))))
    hits = written(
        cells.groupBy("width", "label", "nth", "byte", "i", "j").applyInArrow(
            lambda t: _link_cell(t, least), "rep long, links long, root long"
        ),
        "itq-hits",
    )
    counts = hits.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(hits.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    rooted = written(
        classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
            "label", "v", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("at")
        ),
        "itq-rooted",
    )
    smallest = rooted.groupBy("at").agg(F.min("first").alias("component_id"))
    placed = written(rooted.join(smallest, "at").select("label", "v", "n_links", "component_id"), "itq-placed")
    linked = valid.select("vec_id", "label", "v").join(placed, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _keyed(classes: DataFrame, width: int, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """Every class under each table's byte, dealt into cells ``(i, j)`` of two parts of its bucket."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            v = np.stack(batch.column(2).to_pylist()) if batch.num_rows else np.empty((0, width))
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            codes = code_bytes(unit, mean, projection)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, width), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), flat, pa.array([c.tobytes() for c in codes], pa.binary())],
                ["rep", "label", "copies", "unit", "code"],
            )

    coded = written(
        classes.select("rep", "label", "v", "copies").mapInArrow(
            batches, "rep long, label string, copies long, unit array<double>, code binary"
        ),
        "itq-codes",
    )
    nth = F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1)))
    byte = F.hex(F.substring(F.col("code"), F.col("nth") + 1, F.lit(1)))
    tabled = coded.withColumn("nth", nth).withColumn("byte", byte).withColumn("width", F.lit(width))
    return _cells(tabled)


def _unkeyed(classes: DataFrame) -> DataFrame:
    """Classes without codes: one bucket for each label and length."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return _cells(
        classes.select(
            "rep", "label", "copies", F.transform("v", lambda x: x / norm).alias("unit"), F.lit(bytes(TABLES)).alias("code"),
            F.lit(0).alias("nth"), F.lit("").alias("byte"), F.size("v").alias("width"),
        )
    )


def _cells(tabled: DataFrame) -> DataFrame:
    """Every row of a bucket (width, label, nth, byte) in the cells ``(i, j)`` of its part and each other part."""
    bucket = ["width", "label", "nth", "byte"]
    sizes = tabled.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    parted = (
        tabled.join(sizes, bucket)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    return parted.select(
        *bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") != F.col("other")).alias("both"), "rep", "copies", "code", "unit", "part",
    )
