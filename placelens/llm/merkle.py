"""Merkle manifest of a table: one tree for each group, and one over the groups' roots.

Each level is a window over runs of neighbouring nodes: the full frame of a
run, in order, is the preimage of its parent and holds the siblings of each of
its nodes; of each run one row goes on to the next level.  Runs are keyed by
group and parent, so that a group of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Consecutive nodes that become one.
ARITY = 3
#: Columns of a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree over the roots of all groups.
WHOLE = "*"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256 (binary) of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _hash_of(nodes: Column) -> Column:
    """SHA-256 (binary) of binary digests written as lowercase hex."""
    return F.unhex(F.sha2(F.lower(F.hex(nodes)), 256))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with place, from 0 in each ``key`` in ``order`` (nulls first), and size, the rows of its key.

    Rows are sorted by ranges, so that no task sorts a whole key; the places of
    a range follow from the counts of the ranges before it, one row for each
    range and key.
    """
    by = [F.asc_nulls_first(c) for c in ("key", *order)]
    own = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    own = cut(own, name).withColumn("part", F.shiftright("at", 33))
    parts = own.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("n").over(Window.partitionBy("key"))
    shift = F.coalesce(earlier, F.lit(0)) - F.col("first")
    parts = cut(parts.select("key", "part", shift.alias("shift"), size.alias("size")), f"{name}-ranges")
    return own.join(parts, ["key", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over leaves (key, place, size, digest, ...), and (key, level, digest) of their roots.

    A level holds the nodes of the groups that still have several: key, place,
    size, the siblings to the left and right, and up, the parent's digest.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    out: list[DataFrame] = []
    roots = leaves.where("size = 1").select("key", F.lit(0).alias("level"), "digest")
    nodes = leaves
    while most > 1:
        parent = F.floor(F.col("place") / arity)
        run = F.collect_list("digest").over(Window.partitionBy("key", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        nodes = nodes.where("size > 1").withColumn("parent", parent).withColumn("run", run)
        at, none = F.col("place") % arity, F.lit(bytearray())
        members = [(i, F.coalesce(F.get("run", F.lit(i)), none)) for i in range(arity)]
        left = F.concat(*[F.when(at > i, x).otherwise(none) for i, x in members])
        right = F.concat(*[F.when(at < i, x).otherwise(none) for i, x in members])
        own = [left.alias("left"), right.alias("right"), _hash_of(F.concat(*[x for _, x in members])).alias("up")]
        level = cut(nodes.select(*[c for c in nodes.columns if c != "run"], *own), f"level-{len(out)}")
        out.append(level)
        size = F.ceil(F.col("size") / arity)
        nodes = level.where(F.col("place") % arity == 0).select("key", F.col("parent").alias("place"), size.alias("size"), F.col("up").alias("digest"))
        roots = roots.union(nodes.where("size = 1").select("key", F.lit(len(out)).alias("level"), "digest"))
        most = -(-most // arity)
    return out, cut(roots, "roots")


def paths(leaves: DataFrame, above: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """(key, place, ``carried``, path, top) of each leaf: siblings to the left and right of each level, from the leaf up.

    ``tops``: (key, level, path, top) of each root; its path is continued.
    Each level takes the path of its parents, so that a path is as long as its
    place is high and is never joined by group.
    """
    own = tops.select("key", F.lit(0).cast("long").alias("place"), "path", "top", "level")
    upper = None
    for k in range(len(above) - 1, -1, -1):
        ends = own.where(F.col("level") == k + 1).drop("level")
        upper = (ends if upper is None else ends.union(upper)).withColumnRenamed("place", "parent")
        more = carried if k == 0 else []
        step = F.array(F.struct("left", "right"))
        rows = above[k].join(upper, ["key", "parent"])
        upper = rows.select("key", "place", *more, F.concat(step, "path").alias("path"), "top") if k == 0 else rows.select("key", "place", F.concat(step, "path").alias("path"), "top")
    alone = leaves.where("size = 1").join(own.where("level = 0").drop("level", "place"), "key").select("key", "place", *carried, "path", "top")
    return alone if upper is None else alone.union(upper)


def folded(start: Column, path: Column) -> Column:
    """The root (binary) that a leaf and the siblings along its path give."""
    return F.aggregate(path, start, lambda h, x: _hash_of(F.concat(x["left"], h, x["right"])))


def siblings(path: Column) -> Column:
    """All siblings along a path, in order, as lowercase hex."""
    joined = F.aggregate(path, F.lit(bytearray()), lambda a, x: F.concat(a, x["left"], x["right"]))
    return F.lower(F.hex(joined))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, group_col: str = "source", id_col: str = "doc_id", arity: int = ARITY) -> DataFrame:
    """``id_col``, ``carried``, leaf, subroot, root (binary) and path (array of left, right) of each row.

    Leaves of a group ascend by id, null first, then by digest; groups by their
    key, null first, bytewise.  One row for each row of ``docs``; rows with
    equal ids or equal in all are leaves of their own.  A null in a column is a
    field of its own, apart from the empty text; a null group is a group.  An
    empty table gives an empty one and has no root.  A text is hashed where it
    is read, however long, and never shuffled.  Other columns are ignored,
    whatever their names.
    """
    carried = carried or {}
    names = [f"c{i}" for i in range(len(carried))]
    rows = docs.select(
        field(F.col(group_col)).alias("key"), F.col(id_col).alias("id"), leaf(*map(F.col, columns)).alias("digest"), *[x.alias(n) for n, x in zip(names, carried.values())]
    )
    leaves = placed(rows, ["id", "digest"], "leaves")
    above, roots = levels(leaves, arity)
    group = F.when(F.col("key") != "-", F.expr("substr(key, instr(key, ':') + 1)"))
    groups = roots.select(F.lit(WHOLE).alias("key"), group.alias("name"), F.col("key").alias("of"), "digest")
    groups = placed(groups, ["name"], "groups")
    over, whole = levels(groups, arity)
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    tops = whole.select("key", "level", empty.alias("path"), F.col("digest").alias("top"))
    ends = paths(groups, over, tops, ["of", "digest"])
    ends = cut(ends.select(F.col("of").alias("key"), "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top")), "groups-to-root")
    out = paths(leaves, above, roots.drop("digest").join(ends, "key"), ["id", "digest", *names])
    named = [F.col(n).alias(c) for n, c in zip(names, carried)]
    return out.select(F.col("id").alias(id_col), *named, F.col("digest").alias("leaf"), "top.subroot", "top.root", "path")
