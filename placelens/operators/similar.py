"""Exact nearest vectors by inverted lists: lists that cannot hold a better neighbour are skipped.

Distinct vectors are put into the list of their nearest pivot.  A vector's
k-th best product inside its own block is a floor; a list whose bound, by the
triangle inequality on distances to its pivot, lies below the floor holds no
neighbour of it.  Blocks of neighbouring lists meet only where some vector
needs it, and where few of them do, only the lists that they need are
multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, discard
from .products import products, slack

#: Vectors of a list on average, vectors of a block, and most lists; pivots and sums of lists go to every task.
PER_LIST, BLOCK, MOST_LISTS = 128, 2048, 10_000
#: Vectors that are held against all lists at a time.
AT_ONCE = 256


@dataclass
class _Lists:
    """By list: pivot, distance to it of the nearest and the farthest member, largest length, members, first block and number of blocks."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    length: np.ndarray
    size: np.ndarray
    block: np.ndarray
    blocks: np.ndarray

    def bounds(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """(vectors, lists): no product of a vector with a member of a list is larger."""
        c = self.pivots[lists]
        norm, dots = np.linalg.norm(v, axis=1)[:, None], v @ c.T
        d = np.sqrt(np.maximum(norm**2 + (c**2).sum(axis=1) - 2 * dots, 0))
        least = np.maximum(0, np.maximum(d - self.far[lists], self.near[lists] - d))
        return np.minimum(dots + norm * self.far[lists], (norm**2 + self.length[lists] ** 2 - least**2) / 2)


def distinct_vectors(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(vid, v, ids): each distinct vector with the k + 1 smallest of its keys; more can't be among k neighbours."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("vid"), "v", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots(own: DataFrame, count: int) -> np.ndarray:
    m = max(1, min(MOST_LISTS, count // PER_LIST))
    picked = own.select("v", F.xxhash64("vid").alias("h"), "vid").orderBy("h", "vid").limit(m).collect()
    return np.array([x["v"] for x in picked], float)


def _in_order(pivots: np.ndarray, count: int) -> np.ndarray:
    """Pivots with those near each other side by side, so that a block's lists have much in common."""
    few = pivots[: max(1, -(-count // BLOCK))]
    d = (few**2).sum(axis=1) - 2 * pivots @ few.T
    return pivots[np.lexsort((d.min(axis=1), d.argmin(axis=1)))]


def _listed(own: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds list, far (distance to the pivot) and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            at = np.concatenate([(half - v[i : i + AT_ONCE] @ pivots.T).argmin(axis=1) for i in range(0, len(v), AT_ONCE)])
            more = [pa.array(at.astype(np.int32)), pa.array(np.linalg.norm(v - pivots[at], axis=1)), pa.array(np.linalg.norm(v, axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("v"), *more], ["vid", "v", "list", "far", "length"])

    rows = own.select("vid", "v")
    return rows.mapInArrow(run, f"vid {rows.schema['vid'].dataType.simpleString()}, v array<double>, list int, far double, length double")


def _lists(listed: DataFrame, pivots: np.ndarray) -> _Lists:
    sums = listed.groupBy("list").agg(F.min("far"), F.max("far"), F.max("length"), F.count("*")).collect()
    near, far, length, size = np.full(len(pivots), np.inf), np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for at, *x in sums:
        near[at], far[at], length[at], size[at] = x
    block, blocks, now, filled = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0, 0
    for i, n in enumerate(size):
        if filled and filled + n > BLOCK:
            now, filled = now + 1, 0
        block[i], blocks[i] = now, max(1, -(-n // BLOCK))
        filled += n
        if blocks[i] > 1:
            now, filled = now + blocks[i], 0
    return _Lists(pivots, near, far, length, size, block, blocks)


def _blocks(listed: DataFrame, lists: _Lists, k: int) -> DataFrame:
    """(block, vid, list, v, floor): a block's vectors in order of list, each as one array, and the k-th best product of each inside it."""
    places = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(lists.block, lists.blocks))]
    table = listed.sparkSession.createDataFrame(places, "list int, first int, parts int")  # at most MOST_LISTS rows
    rows = listed.join(F.broadcast(table), "list").select((F.col("first") + F.pmod(F.xxhash64("vid"), F.col("parts"))).cast("int").alias("block"), "vid", "list", "v")
    kind = listed.schema["vid"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("vid").to_numpy(), table.column("list").to_numpy()))))
        v = _matrix(table.column("v").combine_chunks())
        floor = np.full(len(v), -np.inf)
        if len(v) >= k:
            for i in range(0, len(v), BLOCK):
                score = v[i : i + BLOCK] @ v.T
                floor[i : i + BLOCK] = np.partition(score, len(v) - k, axis=1)[:, len(v) - k]
        lists_ = lambda c: pa.array([c], pa.list_(c.type))
        whole = [table.column(c).combine_chunks() for c in ("vid", "list")]
        return pa.table([table.column("block")[:1].combine_chunks(), *map(lists_, whole), lists_(pa.array(v.ravel())), lists_(pa.array(floor))], names=["block", "vid", "list", "v", "floor"])

    return rows.groupBy("block").applyInArrow(run, f"block int, vid array<{kind}>, list array<int>, v array<double>, floor array<double>")


def _needed(lists: _Lists):
    """(a, b): the blocks that hold a list which some vector of block a needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.flatnonzero(lists.size)
        for batch in batches:
            for row in range(batch.num_rows):
                floor = batch.column("floor")[row].values.to_numpy(zero_copy_only=False)
                v = batch.column("v")[row].values.to_numpy(zero_copy_only=False).reshape(len(floor), -1)
                low = floor - slack(np.linalg.norm(v, axis=1), lists.length.max())
                any_of = np.zeros(len(every), bool)
                for i in range(0, len(v), AT_ONCE):
                    any_of |= (lists.bounds(v[i : i + AT_ONCE], every) >= low[i : i + AT_ONCE, None]).any(axis=0)
                wanted = every[any_of]
                to = np.unique(np.concatenate([np.arange(lists.block[x], lists.block[x] + lists.blocks[x]) for x in wanted]))
                a = np.full(len(to), batch.column("block")[row].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(to.astype(np.int32))], ["a", "b"])

    return run


def search(own: DataFrame, k: int) -> DataFrame:
    """A written table (vid, other, score, compared) with at least the k best of each distinct vector, itself included, and rows without ids that count compared pairs."""
    count = own.count()
    kind = own.schema["vid"].dataType.simpleString()
    if not count:
        return own.select("vid", F.col("vid").alias("other"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("compared"))
    pivots = _in_order(_pivots(own, count), count)
    listed = cut(_listed(own, pivots), "listed-vectors")
    lists = _lists(listed, pivots)
    blocks = cut(_blocks(listed, lists, k), "blocks-of-lists")
    pairs = cut(blocks.mapInArrow(_needed(lists), "a int, b int"), "pairs-of-blocks")
    out = cut(products(blocks, k, pairs, lists), "candidates")
    discard(listed, blocks, pairs)
    return out


def pairs_compared(found: DataFrame) -> int:
    return found.where("vid is null").agg(F.sum("compared")).first()[0] or 0


def top_similar(rows: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(key, other, score, rank): the k largest dot products of each row with the others, rounded to nine digits, ties by key.

    Exact for vectors of any length; keys are numbers and told apart by row.
    Equal vectors are searched once, however many there are, and each row gets
    the shared list without itself.  Lists are many and short where vectors
    crowd, and nothing is skipped where they do not.  Pivots and sums of lists
    are at most ``MOST_LISTS``; a task holds a strip of blocks of about ``BLOCK``
    vectors (``products``).  A null vector or key is left out; an empty table gives an empty
    one.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    own = cut(distinct_vectors(rows, key, vector, k), "distinct-vectors")
    found = search(own, k + 1)
    best = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("score"), "other"))
    near = found.where("vid is not null").withColumn("place", best).where(F.col("place") <= k + 1)
    named = near.join(own.select(F.col("vid").alias("other"), "ids"), "other").select("vid", F.explode("ids").alias("id"), "score")
    order = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("score"), "id"))
    named = named.withColumn("place", order).where(F.col("place") <= k + 1)
    shared = named.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "score"))), lambda x: F.struct(x["id"].alias("other"), x["score"].alias("score"))).alias("near"))
    lists = own.join(shared, "vid").select("v", "near")
    each = rows.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).join(lists, "v")
    others = each.select("key", F.slice(F.filter("near", lambda x: x["other"] != F.col("key")), 1, k).alias("near"))
    return others.select(F.col("key").alias(key), F.posexplode("near").alias("p", "x")).select(key, "x.other", "x.score", (F.col("p") + 1).alias("rank"))


def with_neighbours(top: DataFrame, catalogue: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, similar, missing) of ``top`` (key, other, score, rank).

    similar lists the neighbours in order of rank as (rank, other, score, named),
    where named holds ``columns`` of the neighbour's row in ``catalogue``, so that
    a reader needs no second lookup; columns must be of kinds that can be
    ordered.  A neighbour that the catalogue lacks is left out and counted in
    missing; a row all of whose neighbours are missing has an empty list, a row
    without neighbours is absent.  Keys of the catalogue stand once.
    """
    named = catalogue.select(F.col(key).alias("other"), F.struct(*columns).alias("named"))
    met = top.select(key, "other", "score", "rank").join(named, "other", "left")
    known = F.when(F.col("named").isNotNull(), F.struct("rank", "other", "score", "named"))
    return met.groupBy(key).agg(F.array_sort(F.collect_list(known)).alias("similar"), F.count_if(F.col("named").isNull()).alias("missing"))
