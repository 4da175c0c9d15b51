"""Sharding by minimax contiguous partition of groups of equal texts, with DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import ordinals
from siftline.session import written

SHARDS = 40
#: Bytes each row adds to its text's.
ROW_BYTES = 16
#: Hex digits of the first split of the order, and of each further one.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: About how many rows of one group share one window.
GROUP_ROWS = 20_000


def _greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut after as many atoms as fit, again and again; the last atom of each shard, or None if shards run out."""
    cuts, at = [], 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        upto = bisect_right(ends, base + capacity)
        if upto == at or len(cuts) == shards:
            return None
        cuts.append(upto - 1)
        at = upto
    return cuts


def _smallest(ends: list[int], shards: int) -> int:
    """The smallest capacity for which ``shards`` contiguous shards hold all atoms, by binary search."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def _even(ends: list[int], capacity: int, shards: int) -> list[int]:
    """First atom of every shard but the first: no load above ``capacity``, and loads as even as that allows.

    Each shard ends where its load is nearest to the mean of what is left, but not
    before the point from which the rest still fits the shards left.
    """
    needed = [len(ends)]  # first atom of the rest, at the earliest, that so many shards hold
    for _ in range(shards):
        top = ends[needed[-1] - 1] if needed[-1] else 0
        needed.append(0 if top <= capacity else bisect_left(ends, top - capacity) + 1)
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        base = ends[at - 1] if at else 0
        aim = base + (ends[-1] - base) / left
        upto = bisect_left(ends, aim, at)
        if upto > at and upto < len(ends) and aim - ends[upto - 1] <= ends[upto] - aim:
            upto -= 1
        upto = min(max(upto + 1, needed[left - 1]), bisect_right(ends, base + capacity))
        cuts.append(upto)
        at = upto
    return cuts


def cut_keys(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """First key of every shard but the first, for ``groups(key, bytes)`` in key order (hex digests).

    The smallest capacity is searched on runs of keys with a common prefix, of
    which at most 16**FIRST_DIGITS come to the driver. That gives a feasible
    capacity; the mean load and the largest group bound it from below. A cut of the best partition
    lies between where loads of the two bounds can end, so only runs of several
    groups there are split by further digits, and the search repeated, until all
    cuts lie between single groups. What is fetched is bounded by the digits and
    the number of shards, not by the number of groups.
    """
    def fetch(prefixes: list[str] | None, digits: int) -> list[tuple[str, int, bool, int]]:
        some = groups if prefixes is None else groups.where(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
        rows = (
            some.groupBy(F.substring("key", 1, digits).alias("p"))
            .agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m"), F.min("key").alias("k"))
            .collect()
        )
        return [(r["k"], int(r["s"]), r["n"] == 1, int(r["m"])) for r in rows]

    atoms = sorted(fetch(None, FIRST_DIGITS))
    size = {a[0]: FIRST_DIGITS for a in atoms}
    if not atoms:
        return []
    largest = max(a[3] for a in atoms)
    total = sum(a[1] for a in atoms)
    while True:
        ends = list(accumulate(a[1] for a in atoms))
        high = _smallest(ends, shards)
        low = max(largest, -(-total // shards))
        # ends of the j-th shard: no earlier than greedy on whole runs at the lower bound, no later than j full loads
        early = [0]
        for _ in range(shards):
            upto = bisect_right(ends, early[-1] + low)
            early.append(max(early[-1], ends[upto - 1] if upto else 0))
        open_runs = []
        for i, atom in enumerate(atoms):
            if atom[2]:
                continue
            begin, end = ends[i] - atom[1], ends[i]
            if any(begin < (j + 1) * high and end > early[j + 1] for j in range(shards)):
                open_runs.append(atom)
        if not open_runs:
            break
        by_digits: dict[int, list[str]] = {}
        for atom in open_runs:
            by_digits.setdefault(size[atom[0]], []).append(atom[0][: size[atom[0]]])
        gone = {a[0] for a in open_runs}
        atoms = [a for a in atoms if a[0] not in gone]
        for now, prefixes in by_digits.items():
            fresh = fetch(prefixes, now + MORE_DIGITS)
            for a in fresh:
                size[a[0]] = now + MORE_DIGITS
            atoms += fresh
        atoms.sort()
    return [atoms[c][0] for c in _even(ends, high, shards) if c < len(atoms)]


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of each row of ``docs``.

    Law ``bytes``: equal texts are one atomic group, groups are in order of their
    text's digest, and shards are contiguous in it with the smallest possible largest load,
    and within it as even as can be. A group heavier than the mean load sets that load, as it is not cut.
    slot numbers a shard's rows from 0 by digest; copies follow each other in parts
    dealt by doc_id, and by doc_id in a part, so no task holds a whole shard or group.

    A null text is an empty one. Repeated rows and null ids are kept (null first). Rows equal in id and
    text that are more than ``GROUP_ROWS`` make a part of their own, after the others, and travel as one with their number.
    Other columns are not looked at. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    cuts = cut_keys(groups, n_shards)
    most, count = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    parts = max(1, -(-(most or 0) // GROUP_ROWS))
    # rows before each part of a group: runs of keys, then parts inside a run
    digits = 1
    while digits < 4 and (count or 0) > 1000 * 16**digits:
        digits += 1
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part)
    same = None
    if parts > 1:
        heavy = groups.where(F.col("n") > GROUP_ROWS).select("key")
        equal = rows.join(heavy, "key", "left_semi").groupBy("key", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        nth = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
        same = written(equal.where(F.col("n") > GROUP_ROWS).withColumn("part", (nth + parts - 1).cast("int")), "shard-same")
        if same.isEmpty():
            same = None
        else:
            known = same.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc_id"))
            rows = rows.join(known, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_anti")
    counted = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    if same is not None:
        counted = counted.unionByName(same.select("key", "part", "n"))
    counted = written(counted, "shard-parts")
    counted = counted.withColumn("run", F.substring("key", 1, digits))
    runs = counted.groupBy("run").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("run").orderBy("key", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(F.broadcast(bases), "run")
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    starts = written(starts.select("key", "part", (F.col("base") + F.col("ahead")).alias("start"), shard.alias("shard")), "shard-starts")
    firsts = starts.groupBy("shard").agg(F.min("start").alias("first"))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("doc_id"))
    numbered = rows.withColumn("nth", (inside - 1).cast("long"))
    if same is not None:
        many = ordinals(same, ["key", "part"], "n", "nth", GROUP_ROWS)
        numbered = numbered.unionByName(many.select(*numbered.columns))
    return (
        numbered.join(starts, ["key", "part"])
        .join(F.broadcast(firsts), "shard")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int"),
            (F.col("start") - F.col("first") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
