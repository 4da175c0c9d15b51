"""Mixing of sources to target weights by systematic sampling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import ordinals, ranked, word_count
from siftline.session import written

#: No document is taken more often, and no target passes this multiple of its source's size.
MOST = 3
#: About how many documents share one window when documents are numbered.
GROUP_ROWS = 20_000


def source_targets(sources: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from ``sources(source, source_size)``, one row per source.

    Sources weigh 1, 2, .., ``cycle``, repeating by code point with null last. They
    share the sum of all sizes by weight; a target that reaches ``most`` times its
    source's size stops there and the excess is reshared until none is above. The
    level, target per weight of the sources not stopped, only rises from round to
    round, so the rounds end; each fetches one row of three sums.
    """
    keyed = sources.withColumn("_null", F.col("source").isNull())
    numbered = written(
        ranked(keyed, ["_null", "source"], "_rank").select(
            "source", "source_size", (F.col("_rank") % cycle + 1).alias("weight")
        ),
        "mix-sources",
    )
    level, stopped = None, None
    while True:
        if level is None:
            below = F.lit(False)
        else:
            below = most * F.col("source_size") <= F.col("weight") * F.lit(level)
        row = numbered.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(below, most * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(below, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(F.when(below, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] == stopped or not row["weights"]:
            break
        stopped = row["n"]
        level = float(row["total"] - row["fixed"]) / row["weights"]
    share = F.col("weight") * F.lit(level if level is not None else 0.0)
    return numbered.withColumn("target", F.least(share, (most * F.col("source_size")).cast("double")))


def size_class(size: Column) -> Column:
    """Sizes within about a sixteenth of each other share a class; classes ascend with size."""
    power = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")))
    return (power * 16 + F.floor(size * 16 / F.pow(F.lit(2.0), power)) % 16).cast("int")


def copies(docs: DataFrame, seed: str = "mix", most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    Documents of a source are laid out by size class, then by a hash of id and
    ``seed``; each adds target / source_size expected copies, and one hashed offset
    per source is added to the running sum. A document is taken once for each
    integer the sum crosses, so each size class gets its share, and none is taken
    more than ``most`` times. Positions come in two steps, counts per group of (source,
    class, hash range) and then row numbers inside a group, so a source of any size
    is spread over many tasks. All of it depends on the rows alone: reruns agree.

    Null texts have size 0; size 0 is never taken. A null source is a source of its
    own, last in order. Repeated rows count each. Where many rows share an id, or have none, their
    hash range is split on by size and content, and rows equal in every column travel as one with their
    number, so no window holds them. Columns of ``docs`` must not be
    called size, source_size, target, copies or taken, nor begin with an underscore; others are
    kept as they are. An empty table stays empty.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    content = _content(docs)
    narrow = written(sized.select("doc_id", "source", "size", content.alias("_content")), "mix-sizes")
    return _copies(sized.withColumn("_content", content), narrow, seed, most)


def _content(docs: DataFrame) -> Column:
    """48 hex digits that tell rows apart which differ in any column."""
    plain = [c if not any(t in kind for t in ("map<", "variant")) else F.to_json(F.struct(c)) for c, kind in docs.dtypes]
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(*plain)), 16, "0")), F.md5(F.coalesce("text", F.lit(""))))


def _placed(sized: DataFrame, seed: str) -> DataFrame:
    """Adds the place of a row in its source: size class, then a key of hex digits from id, size and content."""
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    key = F.concat(hashed, F.lower(F.lpad(F.hex("size"), 16, "0")), F.col("_content"))
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null is a value of its own in joins and windows
    return sized.withColumn("_of", of).withColumn("_class", size_class(F.col("size"))).withColumn("_key", key)


#: Hex digits of a key that come from id and size.
_ID_DIGITS = 48


def _ranges(placed: DataFrame, digits: int, crowded: DataFrame | None, more: int, same: DataFrame | None) -> DataFrame:
    """Adds ``_range``, the leading digits of the key shared by a group, and ``_same``, whether all its rows are equal."""
    short = F.substring("_key", 1, digits) if digits else F.lit("")
    ranged = placed.withColumn("_range", short).withColumn("_same", F.lit(False))
    if crowded is None:
        return ranged
    longer = F.when(F.col("_crowded"), F.substring("_key", 1, _ID_DIGITS + more)).otherwise(F.col("_range"))
    ranged = ranged.join(crowded, ["_of", "_class", "_range"], "left").withColumn("_range", longer).drop("_crowded", "_same")
    ranged = ranged.join(same, ["_of", "_class", "_key"], "left").withColumn("_same", F.coalesce("_same", F.lit(False)))
    return ranged.withColumn("_range", F.when(F.col("_same"), F.col("_key")).otherwise(F.col("_range")))


def _copies(sized: DataFrame, narrow: DataFrame, seed: str, most: int) -> DataFrame:
    """``narrow``: doc_id, source, size and ``_content`` of the rows of ``sized``."""
    placed = _placed(narrow, seed)
    classes = written(
        placed.groupBy("source", "_of", "_class").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s")),
        "mix-classes",
    )
    targets = source_targets(classes.groupBy("source").agg(F.sum("_s").cast("long").alias("source_size")), most=most)
    targets = targets.withColumn("_of", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source", "weight")
    # hash ranges per class: enough for classes that hold too many rows for one window
    widest = classes.agg(F.max("_n")).first()[0] or 0
    digits = 0
    while widest > GROUP_ROWS * 16**digits:
        digits += 1
    group = ["_of", "_class", "_range"]
    groups = _ranges(placed, digits, None, 0, None).groupBy(*group, "_same").agg(F.count(F.lit(1)).alias("_n"))
    groups = written(groups, "mix-groups")
    # ranges far above the mean hold an id that repeats; at most one in GROUP_ROWS rows makes such a range
    crowded, same, more = None, None, 0
    most_rows = groups.agg(F.max("_n")).first()[0] or 0
    if most_rows > 2 * GROUP_ROWS:
        while most_rows > GROUP_ROWS * 16**more:
            more += 1
        crowded = groups.where(F.col("_n") > 2 * GROUP_ROWS).select(*group, F.lit(True).alias("_crowded"))
        ranged = _ranges(placed, digits, None, 0, None).join(crowded, group, "left_semi")
        equal = ranged.groupBy("_of", "_class", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS)
        same = written(equal.select("_of", "_class", "_key", F.lit(True).alias("_same")), "mix-same")
        groups = _ranges(placed, digits, crowded, more, same).groupBy(*group, "_same").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_of").orderBy("_class", "_range", "_same").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(targets, "_of")
    ranged = _ranges(_placed(sized, seed), digits, crowded, more, same)
    inside = Window.partitionBy(*group).orderBy("_key", "doc_id", "size")
    numbered = ranged.where(~F.col("_same")).withColumn("_row", F.row_number().over(inside))
    joined = numbered.join(starts.where(~F.col("_same")).drop("_n", "_same"), group)
    kept = [*sized.columns, "_of", "_start", "_row", "source_size", "target"]
    joined = joined.select(*kept)
    if same is not None:
        one = ranged.where("_same").groupBy(*group).agg(F.first(F.struct(*sized.columns)).alias("_one"))
        many = ordinals(one.join(starts.where("_same").drop("_same"), group), group, "_n", "_row", GROUP_ROWS)
        many = many.withColumn("_row", (F.col("_row") + 1).cast("int")).select("_one.*", *kept[len(sized.columns):])
        joined = joined.unionByName(many)
    offset_hex = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("_of"))), 1, 12)
    offset = F.conv(offset_hex, 16, 10).cast("double") / F.lit(float(16**12))
    each = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    upto = (F.col("_start") + F.col("_row")).cast("double")
    crossed = F.floor(upto * each + offset) - F.floor((upto - 1) * each + offset)
    times = F.when(F.col("size") > 0, F.least(crossed, F.lit(most))).otherwise(0).cast("int")
    own = [c for c in sized.columns if c != "_content"]
    return joined.withColumn("copies", times).select(
        *own, "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed_sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of each row, without carrying texts along."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit("").alias("_content"))
    narrow = written(sizes, "mix-sizes")  # words are counted once for all statistics; this table stands in for the texts
    return _copies(narrow, narrow, seed, MOST)


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns only."""
    taken = copies(docs, seed)
    repeated = taken.where("copies > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*docs.columns)
