"""Exact top-k search by inner product: dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import written

K = 10
#: Rows of a block of data and of a block of queries, and query blocks that meet a block of data in one task.
DATA_BLOCK, QUERY_BLOCK, QUERY_BLOCKS = 4096, 1024, 8
#: Most centres that rows are dealt around. Further rows make more blocks of a centre.
MOST_CENTRES = 1024
#: A child covers points within its parent's radius divided by this.
BASE = 1.3
#: A node of no more points (of data, of queries), or whose children would be more than FAN_OUT or hold fewer than FEW points on average, is a leaf.
LEAF, QUERY_LEAF, FAN_OUT, FEW = 128, 16, 64, 4
#: Data blocks, those of the highest bounds, that give each query block its first k-th scores.
FIRST_BLOCKS = 2
#: Integer scores stay below this, so that they fit a long; below the other, sums of products are exact in doubles.
LARGEST, EXACT = float(1 << 62), float(1 << 52)

NODE = np.dtype([("centre", "<i8"), ("radius", "<f8"), ("low", "<i8"), ("high", "<i8"), ("first", "<i8"), ("children", "<i8")])
_TREE = "width int, block long, n long, centre array<double>, radius double, v binary, ids binary, rows binary, nodes binary"


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, nodes)``: a node's points are ``order[low:high]``, its children follow each other from ``first``.

    A node's radius is the distance to its furthest point. Its children's centres, the first of which is its own, lie
    more than radius / BASE apart, and every point is within that of the child that covers it. Where distances
    are all much alike, points would be children each by itself; such a node is a leaf.
    """
    order = np.arange(len(points))
    distance = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    nodes = [[0, float(distance.max()), 0, len(points), 0, 0]]
    waiting = [distance]
    at = 0
    while at < len(nodes):
        centre, radius, low, high, _, _ = nodes[at]
        near, waiting[at] = waiting[at], None
        at += 1
        own = order[low:high]
        most = min(FAN_OUT, len(own) // FEW)
        if len(own) <= leaf or radius == 0:
            continue
        reach, centres, child = radius / BASE, [centre], np.zeros(len(own), np.int64)
        while near.max() > reach and len(centres) <= most:  # the point furthest from all children becomes one
            fresh = int(own[near.argmax()])
            apart = np.sqrt(((points[own] - points[fresh]) ** 2).sum(axis=1))
            child[apart < near] = len(centres)
            near = np.minimum(near, apart)
            centres.append(fresh)
        if len(centres) > most:
            continue
        by_child = np.argsort(child, kind="stable")
        order[low:high], near = own[by_child], near[by_child]
        ends = np.cumsum(np.bincount(child, minlength=len(centres)))
        nodes[at - 1][4:] = [len(nodes), len(centres)]
        for c, begin, end in zip(centres, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            mine = near[begin:end]
            nodes.append([c, float(mine.max(initial=0.0)), low + begin, low + end, 0, 0])
            waiting.append(mine)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    packed = np.array([tuple(n) for n in nodes], NODE)
    packed["centre"] = place[packed["centre"]]  # as a place in the order
    return order, packed


class Tree:
    """A built tree: points, ids and row numbers in its order, and its nodes."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> None:
        self.points, self.ids, self.rows, self.nodes = points, ids, rows, nodes
        self.centres = points[nodes["centre"]]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    @classmethod
    def of(cls, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int) -> Tree:
        order, nodes = build_tree(points, leaf)
        return cls(points[order], ids[order], rows[order], nodes)

    def below(self, node: int) -> slice:
        return slice(int(self.nodes["low"][node]), int(self.nodes["high"][node]))

    def children(self, node: int) -> np.ndarray:
        first = int(self.nodes["first"][node])
        return np.arange(first, first + int(self.nodes["children"][node]))


class Best:
    """The k best rows of each query so far, ties to smaller ids, and floors that a better row has to reach."""

    def __init__(self, queries: int, k: int, floors: np.ndarray | None = None) -> None:
        self.k = k
        self.worst = np.full(queries, -np.inf) if floors is None else floors.copy()
        self.query, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries ``at`` onwards against rows ``ids``; -inf is no candidate."""
        floor = self.worst[at : at + len(scores)]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        if not len(row):
            return
        kept = (self.query < at) | (self.query >= at + len(scores))
        query = np.r_[self.query[~kept], row + at]
        found = np.r_[self.ids[~kept], ids[column]]
        score = np.r_[self.score[~kept], scores[row, column]]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        firsts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        nth = np.arange(len(query)) - np.repeat(firsts, np.diff(np.r_[firsts, len(query)]))
        full = nth == self.k - 1
        self.worst[query[full]] = np.maximum(self.worst[query[full]], score[full])
        top = nth < self.k
        self.query, self.ids, self.score = (np.r_[a[kept], b[top]] for a, b in ((self.query, query), (self.ids, found), (self.score, score)))


def upper_bounds(left: Tree, q: np.ndarray, right: Tree, r: np.ndarray) -> np.ndarray:
    """No point of node ``q`` and point of node ``r`` have a higher inner product: <q, r> + R_q |r| + R_r |q| + R_q R_r."""
    own, radius = left.nodes["radius"][q], right.nodes["radius"][r]
    upper = (left.centres[q] * right.centres[r]).sum(axis=1) + own * right.norms[r] + radius * left.norms[q] + own * radius
    return upper + 1e-9 * np.abs(upper) + 1e-3  # above any rounding; scores are whole numbers


def dual_search(left: Tree, right: Tree, best: Best) -> int:
    """Walk both trees together, pairs of high bounds first, into ``best``; how many pairs of points were scored.

    A pair of nodes is left out if its bound is below the worst k-th score of the query node's points. Two leaves are scored as one
    matrix. A query is no candidate of itself.
    """
    scored = 0
    wide = left.points.shape[1] * np.abs(left.points).max(initial=0) * np.abs(right.points).max(initial=0) >= EXACT
    root = np.zeros(1, np.int64)
    stack = [(0, 0, float(upper_bounds(left, root, right, root)[0]))]
    while stack:
        q, r, upper = stack.pop()
        mine = left.below(q)
        if upper < best.worst[mine].min():
            continue
        split_q, split_r = left.children(q), right.children(r)
        if not len(split_q) and not len(split_r):
            theirs = right.below(r)
            a, b = left.points[mine], right.points[theirs]
            scores = (a.astype(np.int64) @ b.astype(np.int64).T if wide else a @ b.T).astype(float)
            scores[left.rows[mine][:, None] == right.rows[theirs]] = -np.inf
            scored += scores.size
            best.add(mine.start, scores, right.ids[theirs])
            continue
        if len(split_q) and (not len(split_r) or left.nodes["radius"][q] > right.nodes["radius"][r]):
            qs, rs = split_q, np.full(len(split_q), r)
        else:
            qs, rs = np.full(len(split_r), q), split_r
        bounds = upper_bounds(left, qs, right, rs)
        for i in np.argsort(bounds).tolist():
            stack.append((int(qs[i]), int(rs[i]), float(bounds[i])))
    return scored


def _clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows whose vector takes part, each component turned into floor(1024 * x)."""
    raw = F.col(embedding).cast("array<double>")
    whole = F.transform(raw, lambda x: F.floor(1024 * x).cast("double"))
    fine = F.col(vec_id).isNotNull() & (F.size(raw) > 0) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform(whole, F.abs))
    refused = F.raise_error(F.lit(f"a vector whose scores may pass {LARGEST:.0f} and no long"))
    checked = F.when(F.size(whole) * largest * largest >= LARGEST, refused).otherwise(whole)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), checked.alias("v"), F.size(raw).alias("width"))


def _dealt(clean: DataFrame, rows: int) -> DataFrame:
    """``clean`` with ``cell``: the nearest of a bounded number of rows taken by hash, among those of a vector's own width."""
    wanted = min(MOST_CENTRES, -(-rows // DATA_BLOCK))
    taken = clean.orderBy(F.xxhash64("row")).limit(wanted).select("width", "v").collect()
    centres: dict[int, np.ndarray] = {w: np.array([r["v"] for r in taken if r["width"] == w]) for w in {r["width"] for r in taken}}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            width, v = part.column(2).to_numpy(), part.column(1)
            cell = np.full(len(width), -1, np.int64)
            for w in np.unique(width).tolist():
                own = centres.get(w)
                if own is not None:
                    mine = np.flatnonzero(width == w)
                    points = v.take(pa.array(mine)).flatten().to_numpy().reshape(-1, w)
                    cell[mine] = ((own * own).sum(axis=1) - 2 * points @ own.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], [*part.schema.names, "cell"])

    return clean.mapInArrow(batches, clean.withColumn("cell", F.lit(0).cast("long")).schema)


def _trees(dealt: DataFrame, size: int, leaf: int, label: str) -> DataFrame:
    """One row per block of about ``size`` rows of a cell, its tree built; a cell of more rows is several blocks."""
    parts = dealt.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    blocks = dealt.join(parts.hint("merge"), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        points = np.stack(table["v"].to_numpy())
        tree = Tree.of(points, table["vec_id"].to_numpy(), table["row"].to_numpy(), leaf)
        root = tree.nodes[0]
        block = (table["cell"][0].as_py() << 32) + table["part"][0].as_py()
        columns = {
            "width": pa.array([points.shape[1]], pa.int32()), "block": pa.array([block], pa.int64()), "n": pa.array([len(points)], pa.int64()),
            "centre": pa.array([tree.centres[0]], pa.list_(pa.float64())), "radius": pa.array([float(root["radius"])]),
        }
        for name, values in (("v", tree.points), ("ids", tree.ids), ("rows", tree.rows), ("nodes", tree.nodes)):
            columns[name] = pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
        return pa.table(columns)

    return written(blocks.select("width", "cell", "part", "vec_id", "v", "row").groupBy("width", "cell", "part").applyInArrow(build, _TREE), label)


def _tree(row: dict) -> Tree:
    points = np.frombuffer(row["v"], np.float64).reshape(row["n"], row["width"])
    return Tree(points, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), np.frombuffer(row["nodes"], NODE))


def _search(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``(row, query_id, vec_id, score, scored)`` of the k best rows in each pair of blocks ``pairs(width, q, d, floors)``.

    A block of data meets up to QUERY_BLOCKS blocks of queries in one task. ``floors`` are k-th scores that rows of the query block,
    in their tree's order, are known to have. ``scored`` counts the scored pairs of points, on one row of each block pair.
    """
    fields = ["n", "v", "ids", "rows", "nodes"]
    group = F.pmod(F.xxhash64("q"), F.ceil(F.lit(1.0) * F.col("qs") / QUERY_BLOCKS).cast("int")).cast("int")
    count = pairs.groupBy("width", "d").agg(F.count(F.lit(1)).alias("qs"))
    dealt = pairs.join(count.hint("merge"), ["width", "d"]).withColumn("nth", group)
    asking = dealt.join(queries.withColumnRenamed("block", "q").hint("merge"), ["width", "q"]).select("width", "d", "nth", "floors", *fields)
    held = dealt.select("width", "d", "nth").distinct().join(data.withColumnRenamed("block", "d").hint("merge"), ["width", "d"])
    held = held.select("width", "d", "nth", F.lit(None).cast("array<double>").alias("floors"), *fields)

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        right = _tree(next(r for r in rows if r["floors"] is None))
        parts = []
        for row in rows:
            if row["floors"] is None:
                continue
            left = _tree(row)
            best = Best(row["n"], k, np.array(row["floors"], dtype=float))
            scored = dual_search(left, right, best)
            counts = np.zeros(len(best.query), np.int64)
            counts[:1] = scored
            parts.append((left.rows[best.query], left.ids[best.query], best.ids, best.score.astype(np.int64), counts))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table(dict(zip(["row", "query_id", "vec_id", "score", "scored"], columns, strict=True)))

    kinds = "row long, query_id long, vec_id long, score long, scored long"
    return asking.unionByName(held).groupBy("width", "d", "nth").applyInArrow(search, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ordered = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, every: int = 100, k: int = K, embedding: str = "embedding", vec_id: str = "vec_id", measured: list | None = None
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each query row, a row whose id divides by ``every``.

    Rows are dealt to the nearest of a bounded number of centres, so blocks hold near
    rows; a cell of many rows is several blocks, dealt by row number, so a vector of any frequency
    spreads. A cover tree is built once for each block of data and of queries. First each query block
    meets the few data blocks of the highest bounds, which gives its queries k-th scores; then only the pairs of blocks
    whose bound reaches the worst of them. In a pair, both trees are walked together.

    Null vectors, null ids, and vectors with null or non-finite components take no
    part; vectors of another length than the query's are no candidates for it. Rows repeated
    with id and vector are rows like any other: each is a candidate, each query row has a ranking of its own, and only the row
    itself is none of its candidates. Fewer candidates give fewer ranks. Vectors so large that a score may
    pass a long are an error. An empty table gives an empty result. ``measured`` gathers the scored pairs of points and all pairs.
    """
    clean = written(_clean(vectors, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asks = F.col("vec_id") % every == 0
    rows = clean.count()
    dealt = written(_dealt(clean, rows), "topk-dealt")
    data, queries = _trees(dealt, DATA_BLOCK, LEAF, "topk-data"), _trees(dealt.where(asks), QUERY_BLOCK, QUERY_LEAF, "topk-queries")
    side = lambda t, name: t.select("width", F.col("block").alias(name), F.col("centre").alias("c" + name), F.col("radius").alias("r" + name), F.col("n").alias("n" + name))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    upper = dot(F.col("cq"), F.col("cd")) + F.col("rq") * norm("cd") + F.col("rd") * norm("cq") + F.col("rq") * F.col("rd")
    bounded = side(queries, "q").join(side(data, "d"), "width").withColumn("bound", upper + F.abs(upper) * 1e-9 + 1e-3)
    nth = F.row_number().over(Window.partitionBy("width", "q").orderBy(F.desc("bound"), "d"))
    pairs = written(bounded.withColumn("nth", nth).select("width", "q", "d", "bound", "nth", "nq"), "topk-pairs")
    open_floors = F.transform(F.sequence(F.lit(1).cast("long"), F.col("nq")), lambda x: F.lit(float("-inf")))
    first = pairs.where(F.col("nth") <= FIRST_BLOCKS).select("width", "q", "d", open_floors.alias("floors"))
    found = written(_search(first, queries, data, k), "topk-first")
    kth = _ranked(found, k).where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("kth"))
    # each query block's k-th scores, in the order of its tree
    numbered = _rows_of(queries).join(kth.hint("merge"), "row", "left").select("width", "q", "place", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    floors = numbered.groupBy("width", "q").agg(F.array_sort(F.collect_list(F.struct("place", "kth"))).alias("all"))
    floors = floors.select("width", "q", F.col("all.kth").alias("floors"))
    later = pairs.where(F.col("nth") > FIRST_BLOCKS).join(floors.hint("merge"), ["width", "q"])
    later = later.where(F.col("bound") >= F.array_min("floors")).select("width", "q", "d", "floors")
    more = _search(later, queries, data, k)
    if measured is not None:
        more = written(more, "topk-more")
        scored = found.unionByName(more).agg(F.sum("scored")).first()[0] or 0
        measured.append((scored, clean.where(asks).count() * rows))
    return _ranked(found.unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def _rows_of(trees: DataFrame) -> DataFrame:
    """``(width, q, place, row)`` of every row of query blocks, ``place`` its number in the tree's order."""

    def unpack(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(table["rows"][0].as_py(), np.int64)
        n = len(rows)
        return pa.table({
            "width": pa.array([table["width"][0].as_py()] * n, pa.int32()), "q": pa.array([table["block"][0].as_py()] * n, pa.int64()),
            "place": np.arange(n), "row": rows,
        })

    return trees.select("width", "block", "rows").groupBy("width", "block").applyInArrow(unpack, "width int, q long, place long, row long")
