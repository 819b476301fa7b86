"""Products of all blocks of vectors: a task holds a strip of blocks while others stream past it.

A block is a row that holds the vectors of many keys.  Products are found in
single precision, less what that may be off by; only those that may count are
computed again in double precision.  Where k are wanted, the k-th best so far
of each vector is the bar for what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors of a strip, blocks that stream past it in one task, rows of a strip and pairs that are multiplied at a time.
STRIP_BYTES, STREAMED, TILE, EXACT = 32 << 20, 128, 512, 1 << 16
#: Products are compared to so many digits; what a bound may be off by.
DIGITS, SLACK = 9, 1e-7
#: Above this product of lengths single precision is not used.
LARGEST = 1e30
#: Above this share of needed pairs a tile is multiplied as a whole.
MOSTLY = 0.5


def slack(lengths: np.ndarray, longest: float) -> np.ndarray:
    """What a product or bound of vectors of these lengths with one of at most ``longest`` may be off by in double precision."""
    return SLACK + 1e-12 * (lengths**2 + longest**2)


class _Block:
    """A block of a strip: its vectors, the bar of each, and what has been found so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bar: np.ndarray, k: int | None):
        self.ids, self.v, self.bar, self.k = ids, v, bar.copy(), k
        self.length = np.linalg.norm(v, axis=1)
        with np.errstate(over="ignore"):
            self.single = v.astype(np.float32)
        self.kept = (np.zeros(0, np.int64), ids[:0], np.zeros(0))
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def tile(self, rows: np.ndarray | slice, others: np.ndarray, w: np.ndarray, single: np.ndarray, longest: float, same: bool) -> None:
        """Products of some of its vectors with ``w``; those that pass the bar are kept."""
        bar, length = self.bar[rows], self.length[rows]
        wide = not length.max() * longest < LARGEST
        v = self.v[rows]
        off = 0.0 if wide else (v.shape[1] + 8) * 2.0**-24 * length * longest
        with np.errstate(invalid="ignore", over="ignore"):
            least = bar - slack(length, longest) - off - np.abs(bar) * 2.0**-22
            score = v @ w.T if wide else self.single[rows] @ single.T
            at = np.flatnonzero((score >= least.astype(score.dtype)[:, None]).ravel())
        x, y = np.divmod(at, len(w))
        if wide:
            exact = score.ravel()[at]
        elif len(at) > score.size // 16:
            exact = (v @ w.T).ravel()[at]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", v[x[i : i + EXACT]], w[y[i : i + EXACT]]) for i in range(0, len(at), EXACT)] or [np.zeros(0)])
        exact = np.round(exact, DIGITS)
        place = np.arange(len(self.ids))[rows][x]
        good = np.isfinite(exact) & (exact >= (bar - slack(length, longest))[x])
        if same:
            good &= self.ids[place] != others[y]
        if good.any():
            self.fresh.append((place[good], others[y[good]], exact[good]))
            self.pending += int(good.sum())
            if self.k is not None and self.pending > max(EXACT // 4, self.k * len(self.ids) // 4):
                self.settle()

    def settle(self) -> None:
        """Keeps the k best of each vector, and raises its bar to the k-th."""
        place, other, score = (np.concatenate(x) for x in zip(self.kept, *self.fresh))
        self.fresh, self.pending = [], 0
        order = np.lexsort((other, -score, place))
        place, other, score = place[order], other[order], score[order]
        rank = np.arange(len(place)) - np.searchsorted(place, np.arange(len(self.ids)))[place]
        last = rank == self.k - 1
        self.bar[place[last]] = np.maximum(self.bar[place[last]], score[last])
        good = rank < self.k
        self.kept = place[good], other[good], score[good]

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, other, score) of all that is found and has not been taken."""
        if self.k is not None:
            self.settle()
            found, self.kept = self.kept, (self.kept[0][:0], self.kept[1][:0], self.kept[2][:0])
        else:
            found = tuple(np.concatenate(x) for x in zip(self.kept, *self.fresh))
            self.fresh, self.pending = [], 0
        return self.ids[found[0]], found[1], found[2]


def _meet(block: _Block, others: np.ndarray, of: np.ndarray, w: np.ndarray, single: np.ndarray, longest: float, lists, same: bool) -> int:
    """Multiplies a block of a strip with one that streams past; how many pairs were compared."""
    n, rows = len(block.ids), [slice(i, i + TILE) for i in range(0, len(block.ids), TILE)]
    if lists is not None:
        own, starts = np.unique(of, return_index=True)
        ends = np.append(starts[1:], len(of))
        need = lists.bounds(block.v, own) >= (block.bar - slack(block.length, longest))[:, None]
        compared = int((need * (ends - starts)).sum())
        if compared <= MOSTLY * n * len(w):
            for i in np.flatnonzero(need.any(axis=0)):
                part, who = slice(starts[i], ends[i]), np.flatnonzero(need[:, i])
                for j in range(0, len(who), TILE):
                    block.tile(who[j : j + TILE], others[part], w[part], single[part], longest, same)
            return compared
    for part in rows:
        block.tile(part, others, w, single, longest, same)
    return n * len(w)


def shape(count: int, size: int, tasks: int) -> tuple[int, int, int]:
    """Blocks of a strip, strips, and parts of the blocks that stream past each, for ``count`` blocks of ``size`` bytes and about so many tasks.

    A block is sent strips + parts times; both grow with the root of ``tasks``,
    and with the table only where a strip or a stream is as large as may be.
    """
    per = max(1, min(STRIP_BYTES // max(1, size), ceil(count / ceil(sqrt(tasks)))))
    strips = max(1, ceil(count / per))
    return per, strips, max(1, min(count, max(ceil(count / STREAMED), ceil(tasks / strips))))


def products(blocks: DataFrame, k: int | None, pairs: DataFrame | None = None, lists=None, same: bool = False) -> DataFrame:
    """(vid, other, score, compared) of a written table of blocks, and rows without ids that count compared pairs.

    ``blocks`` (block, vid, list, v, floor) has a row for each block of some
    thousand vectors, each column but the first an array, v of the vectors one
    after the other, in order of list.  A product below the floor of its vector
    is left out; with k, a task keeps the k best of each vector, ties by id, and
    without all of them.  ``pairs`` (a, b) names the blocks that meet, all
    without it; ``lists`` bounds the products with a list.  With ``same``, no
    vector meets one of its own id.

    Strips and the parts of the blocks that stream past them make the tasks, some
    for each core: vectors are sent once for each strip and once for each part,
    not once for each pair of blocks.
    """
    spark = blocks.sparkSession
    most, size = blocks.agg(F.max("block"), F.max(F.array_size("v"))).first()
    kind = blocks.schema["vid"].dataType.elementType.simpleString()
    count = (most if most is not None else -1) + 1
    per, strips, parts = shape(count, 8 * (size or 1), 3 * spark.sparkContext.defaultParallelism)
    strip = lambda c: F.floor(F.col(c) / per).cast("int")
    held = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    held = held.select((strip("block") * parts + F.col("part")).alias("task"), F.lit(0).alias("phase"), "block", "vid", "v", "floor")
    if pairs is None:
        meets = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), "vid", "list", "v")
    else:
        meets = blocks.join(pairs.select(strip("a").alias("strip"), F.col("b").alias("block")).distinct(), "block")
    passing = meets.select((F.col("strip") * parts + F.col("block") % parts).alias("task"), F.lit(1).alias("phase"), "block", "vid", "list", "v")
    stream = held.unionByName(passing, allowMissingColumns=True).repartitionById(strips * parts, F.col("task").cast("int"))
    stream = stream.sortWithinPartitions("task", "phase", "block").select("task", "phase", "vid", "list", "v", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, strip, compared, id_kind = None, [], 0, None

        def out(compared: int) -> Iterator[pa.RecordBatch]:
            for block in strip:
                ids, others, score = block.take()
                if len(ids) or compared:
                    extra = [None] if compared else []
                    columns = [pa.concat_arrays([pa.array(extra, id_kind), pa.array(x, id_kind)]) for x in (ids, others)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.array(extra, pa.float64()), pa.array(score, pa.float64())]), pa.array([compared] * len(extra) + [0] * len(ids), pa.int64())], ["vid", "other", "score", "compared"])
                    compared = 0

        for batch in batches:
            id_kind = batch.schema.field("vid").type.value_type
            for row in range(batch.num_rows):
                values = lambda c: batch.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                if (own := batch.column("task")[row].as_py()) != now:
                    yield from out(compared)
                    now, strip, compared = own, [], 0
                ids = values("vid")
                v = values("v").reshape(len(ids), -1)
                if batch.column("phase")[row].as_py() == 0:
                    strip.append(_Block(ids, v, values("floor"), k))
                    continue
                of, longest = values("list"), float(np.linalg.norm(v, axis=1).max())
                with np.errstate(over="ignore"):
                    single = v.astype(np.float32)
                compared += sum(_meet(block, ids, of, v, single, longest, lists, same) for block in strip)
                if k is None:
                    yield from out(compared)
                    compared = 0
        yield from out(compared)

    return stream.mapInArrow(run, f"vid {kind}, other {kind}, score double, compared long")
