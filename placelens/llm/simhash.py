"""SimHash near-duplicates by a self-join of a binary trie over the fingerprints.

Pairs of trie nodes are traversed together from the root: the bits in which
their prefixes differ are added up, and a pair is pruned as soon as it exceeds
the error budget.  The upper levels are traversed as a table of node pairs
until the fingerprints below each pair fit one task; the rest of each pair's
traversal runs in that task.

``near_duplicates`` links 64-bit fingerprints within a few bits, completely.
Texts of a similarity of 0.8 differ in about a sixth of their bits, beyond what
a trie can prune, so ``similar_texts`` takes a longer fingerprint and several
tries, each over its own few bits; texts that meet in one of them are compared
over many more bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..sources.shared import cut
from .batches import mix, run_hashes, slices, text_bytes, texts

SEED = 42
#: Fingerprints below a pair of nodes that one task takes; pairs with more are split further down the trie.
TASK_FINGERPRINTS = 8192
#: Levels by which a pair is split at a time.
STEP = 4
#: Pairs of nodes with at most so many pairs of fingerprints are compared directly.
DIRECT = 16
#: Pairs of nodes, and pairs of fingerprints, that a task holds at a time.
FRONT, COMPARED = 1 << 15, 1 << 17

#: Bits of a wide fingerprint, how many tries share them, bits of a code of a trie, bits that it branches on, and bits in which linked codes may differ.
WIDE, TRIES, CODE, BRANCH, TOTAL = 512, 12, 128, 24, 26
#: Parts of those bits; codes within a budget of fewer bits than there are parts agree in one of them, and a trie is made for each to stand first.
PARTS = 3
#: Pairs of nodes with more pairs of codes are walked from text to text.
PAIRWISE = 1 << 14

_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is one if it is one in over half of the shingle hashes."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII separators
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    else:
        grams = [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in grams], "<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fingerprint (long, the 64 bits) of each whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = np.array([fingerprint(x.encode(), shingle) for x in texts(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long").withColumnRenamed("id", id_col)


def _halves(prints: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the children of each node part: the first fingerprint with a one at ``depth``."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    top = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    return np.clip(np.searchsorted(prints, (prints[low] & top) | bit), low, high)


def node_pairs(prints: np.ndarray, prefixes: tuple[int, int], depth: int, budget: int, bits: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of nodes below two nodes at ``depth`` that are small or ``bits`` deep: (a, b, c, d), arrays of places in ``prints``.

    ``prints``: sorted fingerprints.  Pairs that differ in more than ``budget``
    bits of their prefixes are pruned.  With one node given twice, pairs inside
    it.  Works on pieces of the traversal, deepest first, so that memory stays
    bounded.
    """
    shift = np.uint64(64 - depth)
    ends = [(np.searchsorted(prints, np.uint64(p) << shift), np.searchsorted(prints, (np.uint64(p) << shift) | ((np.uint64(1) << shift) - np.uint64(1)), side="right")) if depth else (0, len(prints)) for p in prefixes]
    (a, b), (c, d) = ends
    if a == b or c == d:
        return
    stack = [(depth, *(np.array([x]) for x in (a, b, c, d, (prefixes[0] ^ prefixes[1]).bit_count())))]
    while stack:
        depth, a, b, c, d, off = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, b, c, d, off))), (depth, *(x[:half] for x in (a, b, c, d, off)))]
            continue
        direct = ((b - a) * (d - c) <= DIRECT) | (depth >= bits)
        if direct.any():
            yield a[direct], b[direct], c[direct], d[direct]
        go = ~direct
        if not go.any():
            continue
        a, b, c, d, off = (x[go] for x in (a, b, c, d, off))
        same = a == c
        m, n = _halves(prints, a, b, depth), _halves(prints, c, d, depth)
        children = [(a, m, c, n, off, off >= 0), (m, b, n, d, off, off >= 0), (a, m, n, d, off + 1, off >= 0), (m, b, c, n, off + 1, ~same)]
        parts = []
        for p, q, r, s, o, ok in children:
            ok = ok & (p < q) & (r < s) & (o <= budget) & ~((p == r) & (q - p < 2))
            parts.append([x[ok] for x in (p, q, r, s, o)])
        joined = [np.concatenate(x) for x in zip(*parts)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))


def _all_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place of [a, b) with each later one of [c, d), of all node pairs, about ``COMPARED`` at a time."""
    n = (b - a) * (d - c)
    part = np.cumsum(n) // COMPARED
    for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
        w, v = n[rows], (d - c)[rows]
        place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        v = np.repeat(v, w)
        x, y = np.repeat(a[rows], w) + place // v, np.repeat(c[rows], w) + place % v
        keep = x < y
        yield x[keep], y[keep]


def near_pairs(prints: np.ndarray, prefixes: tuple[int, int], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller, larger) of sorted distinct fingerprints below two nodes that differ in at most ``budget`` bits."""
    for nodes in node_pairs(prints, prefixes, depth, budget):
        for x, y in _all_pairs(*nodes):
            x, y = prints[x], prints[y]
            close = np.bitwise_count(x ^ y) <= budget
            if close.any():
                yield x[close], y[close]


def _linked(codes: np.ndarray, left: np.ndarray, right: np.ndarray | None, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the same rows of ``codes`` as all pairs within ``total`` bits, between two lists of places or inside one.

    A walk from text to text: what has been reached is not compared again, so
    that a group of near copies costs about as many comparisons as it has texts.
    """
    rest = [left, left if right is None else right]
    while len(rest[0]) and len(rest[1]):
        reached = [(int(rest[0][0]), 0)]
        rest[0] = rest[0][1:]
        if right is None:
            rest[1] = rest[0]
        while reached:
            at, side = reached.pop()
            other = 0 if right is None else 1 - side
            if not len(rest[other]):
                continue
            close = np.bitwise_count(codes[rest[other]] ^ codes[at]).sum(axis=1) <= total
            found = rest[other][close]
            if len(found):
                yield np.full(len(found), at), found
                rest[other] = rest[other][~close]
                if right is None:
                    rest[1] = rest[0]
                reached += [(x, other) for x in found.tolist()]


def similar_pairs(codes: np.ndarray, prefixes: tuple[int, int], depth: int, budget: int, bits: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the rows of ``codes`` (sorted by the first column) below two nodes, within ``total`` bits of all columns."""
    for a, b, c, d in node_pairs(codes[:, 0].copy(), prefixes, depth, budget, bits):
        large = (b - a) * (d - c) > PAIRWISE
        for x, y in _all_pairs(*(z[~large] for z in (a, b, c, d))):
            close = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1) <= total
            if close.any():
                yield x[close], y[close]
        for i in np.flatnonzero(large):
            yield from _linked(codes, np.arange(a[i], b[i]), None if a[i] == c[i] else np.arange(c[i], d[i]), total)


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that link what the given edges link: each node to the smallest node of its part."""
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while (p := parent.setdefault(n, n)) != n:
            parent[n] = parent[p]
            n = p
        return n

    for a, b in zip(x.tolist(), y.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(n, root(n)) for n in list(parent) if root(n) != n]


def _prefix(depth: int):
    return F.shiftrightunsigned("fingerprint", 64 - depth) if depth else F.lit(0).cast("long")


def _node_pairs(prints: DataFrame, budget: int, bits: int, depth: int) -> DataFrame:
    """(trie, depth, a, b): pairs of nodes of one depth within the budget, each small enough for a task, a <= b.

    The first pairs are of each node at ``depth`` with itself.
    """
    first = prints.groupBy("trie", _prefix(depth).alias("a")).agg(F.count("*").alias("n"))
    pairs = first.select("trie", "a", F.col("a").alias("b"), "n", F.col("n").alias("m"))
    done = None
    while True:
        pairs = cut(pairs.select("trie", F.lit(depth).alias("depth"), "a", "b", "n", "m"), "node-pairs")
        fits = F.col("n") + F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("m")) <= TASK_FINGERPRINTS
        small = pairs if depth >= bits - STEP else pairs.where(fits)
        done = small if done is None else done.union(small)
        large = pairs.where(~fits)
        if depth >= bits - STEP or large.isEmpty():
            return done.select("trie", "depth", "a", "b", "n", "m")
        depth += STEP
        nodes = prints.groupBy("trie", _prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        level = cut(nodes.withColumn("up", F.shiftright("node", STEP)), "nodes")
        first = level.select("trie", F.col("up").alias("a"), F.col("node").alias("c"), F.col("n").alias("cn"))
        second = level.select("trie", F.col("up").alias("b"), F.col("node").alias("d"), F.col("n").alias("dn"))
        pairs = large.select("trie", "a", "b").join(first, ["trie", "a"]).join(second, ["trie", "b"])
        pairs = pairs.where((F.bit_count(F.col("c").bitwiseXOR(F.col("d"))) <= budget) & (F.col("c") <= F.col("d")))
        pairs = pairs.select("trie", F.col("c").alias("a"), F.col("d").alias("b"), F.col("cn").alias("n"), F.col("dn").alias("m"))


def _tasks(prints: DataFrame, budget: int, bits: int, carried: list[str], depth: int = 0) -> DataFrame | None:
    """(trie, depth, a, b, x, y): each small pair of nodes with what is below them; y is null where both are one.

    A node that is too large at the last level is dealt into parts, and each
    part meets each other one in a task of its own.
    """
    pairs = cut(_node_pairs(prints, budget, bits, depth), "tasks")
    depths = [x[0] for x in pairs.select("depth").distinct().collect()]  # at most 16
    if not depths:
        return None
    parts = lambda n: F.when(F.col(n) <= TASK_FINGERPRINTS, 1).otherwise(F.ceil(2 * F.col(n) / TASK_FINGERPRINTS))
    heads = [pairs.select("trie", "depth", F.col(c).alias("head"), parts(n).cast("long").alias("parts")) for c, n in (("a", "n"), ("b", "m"))]
    wanted = heads[0].union(heads[1]).distinct()
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("head")) for d in depths]))
    below = prints.select("trie", *carried, at.alias("at")).select("trie", *carried, "at.depth", "at.head").join(wanted, ["trie", "depth", "head"])
    part = F.pmod(F.xxhash64(*carried), F.col("parts"))
    below = below.groupBy("trie", "depth", "head", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("prints"))
    below = cut(below, "nodes-of-tasks")
    each = pairs.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), parts("n").cast("long") - 1)))
    each = each.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), parts("m").cast("long") - 1))).where("a < b or p <= q")
    first = below.select("trie", "depth", F.col("head").alias("a"), F.col("part").alias("p"), F.col("prints").alias("x"))
    second = below.select("trie", "depth", F.col("head").alias("b"), F.col("part").alias("q"), F.col("prints").alias("y"))
    alone = (F.col("a") == F.col("b")) & (F.col("p") == F.col("q"))
    one = each.where(alone).join(first, ["trie", "depth", "a", "p"]).select("trie", "depth", "a", "b", "x", F.lit(None).cast(below.schema["prints"].dataType).alias("y"))
    two = each.where(~alone).join(first, ["trie", "depth", "a", "p"]).join(second, ["trie", "depth", "b", "q"])
    return one.union(two.select("trie", "depth", "a", "b", "x", "y"))


def _below(batch: pa.RecordBatch, row: int, carried: list[str]) -> list[np.ndarray]:
    """The carried columns of the fingerprints below both nodes of a row, in order of the first."""
    sides = [batch.column(i)[row].values for i in (4, 5) if batch.column(i)[row].is_valid]
    columns = [np.concatenate([x.field(c).to_numpy(zero_copy_only=False) for x in sides]) for c in carried]
    order = np.argsort(columns[0].view(np.uint64), kind="stable")
    return [x[order] for x in columns]


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join the same ones as all pairs within ``budget`` bits.

    ``prints``: a written table with one column, fingerprint, without repeats.
    Each task keeps of the pairs that it finds a forest only; a fingerprint has
    at most 2,080 others within two bits, so the pairs grow with the number of
    distinct fingerprints, not with its square.
    """
    rows = _tasks(prints.select(F.lit(0).alias("trie"), "fingerprint"), budget, 64, ["fingerprint"])
    if rows is None:
        return prints.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                depth, a, b = (batch.column(i)[row].as_py() for i in range(1, 4))
                [own] = _below(batch, row, ["fingerprint"])
                found = list(near_pairs(own.view(np.uint64), (a, b), depth, budget))
                if found:
                    edges = np.array(forest(*(np.concatenate(x) for x in zip(*found))), np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (long) and component_id of each document.

    Documents whose fingerprints differ in at most ``budget`` bits are linked;
    component_id is the smallest id that links reach.  One row for each row of
    ``docs``; an empty table gives an empty one; other columns are ignored,
    whatever their names.  A null or empty text has fingerprint zero and links
    like any other.  A null id is never the smallest, unless all of a component
    are null.  Equal texts share a fingerprint and never form pairs.  A task
    holds about a megabyte of texts, or one longer text.
    """
    own = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = cut(own.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = connected_components(links(least.select("fingerprint"), budget))
    roots = least.join(roots, least["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    # written apart, so that the join with a component of many fingerprints can be split
    first = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")), "first-of-components")
    by_print = roots.join(first, "root").select("fingerprint", "component_id")
    return own.join(by_print, "fingerprint").select(id_col, "fingerprint", "component_id")


def wide_codes(data: np.ndarray, offsets: np.ndarray, shingle: int = 5) -> np.ndarray:
    """SimHash of ``WIDE`` bits of each text, as bytes; a text of fewer words is one shingle, one of none has no bit set."""
    letters = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    bytes_before = np.cumsum(inside) - inside
    hashes = run_hashes(letters[inside], np.diff(np.append(bytes_before[at], int(inside.sum()))))
    before = np.searchsorted(at, offsets)
    lanes = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    out = np.zeros((len(offsets) - 1, WIDE // 8), np.uint8)
    for row, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
        k = min(shingle, b - a)
        if not k:
            continue
        grams = np.zeros(b - a - k + 1, np.uint64)
        for i in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[a + i : a + i + len(grams)]
        grams = np.unique(grams)  # a shingle counts once, however often it is repeated
        ones = np.zeros(WIDE, np.int64)
        for i in range(0, len(grams), 4096):
            bits = np.unpackbits(mix(grams[i : i + 4096, None] + lanes).view(np.uint8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint16)
        out[row] = np.packbits(2 * ones > len(grams), bitorder="little")
    return out


def _tries(codes: np.ndarray) -> np.ndarray:
    """(rows, TRIES * PARTS, CODE / 64): of each wide code the bits of each trie, first those that it branches on, each of its parts leading once."""
    bits = np.unpackbits(codes, axis=1)
    head = np.arange(BRANCH).reshape(PARTS, -1)
    orders = [np.concatenate([np.roll(head, -r, axis=0).ravel(), np.arange(BRANCH, CODE)]) for r in range(PARTS)]
    places = np.concatenate([(t * (WIDE // TRIES) + np.stack(orders)) % WIDE for t in range(TRIES)])
    return np.packbits(bits[:, places], axis=2).view(">u8").astype(np.uint64)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 2, total: int = TOTAL) -> tuple[DataFrame, DataFrame]:
    """(``id_col``, code) of each row, and (code, component_id) of each distinct code; both are written tables.

    Texts of a similarity of 0.8 or more on ``shingle`` words are linked where
    a trie over ``BRANCH`` bits finds them within ``budget`` bits (at most one
    less than ``PARTS``) and the ``CODE`` bits of that trie differ in at most
    ``total``; each of ``TRIES`` sets of bits branches on bits of its own, so
    that about 19 of 20 such pairs meet in one.
    component_id is the smallest id that links reach.

    Equal codes are one node.  A node of a trie that a task can't hold is dealt
    into parts of which each meets each other one, so no link depends on the
    size of the table.  Nulls, ids, empty tables and other columns are treated
    as in ``near_duplicates``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes = wide_codes(*text_bytes(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in codes], pa.binary())], ["id", "code"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = cut(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, code binary").withColumnRenamed("id", id_col), "codes")
    least = own.groupBy("code").agg(F.min(id_col).alias("least"))
    least = cut(least.withColumn("node", F.monotonically_increasing_id()), "distinct-codes")
    roots = connected_components(_similar_links(least.select("code", "node"), budget, total))
    roots = least.join(roots, "node", "left").select("code", "least", F.coalesce("root", "node").alias("root"))
    # written apart, so that the join with a component of many codes can be split
    first = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")), "first-of-components")
    return own, cut(roots.join(first, "root").select("code", "component_id"), "components-of-codes")


def _similar_links(codes: DataFrame, budget: int, total: int) -> DataFrame:
    """Edges (a, b) between the nodes of distinct codes."""

    def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _tries(np.stack([np.frombuffer(x, np.uint8) for x in batch.column("code").to_pylist()])).view(np.int64)
                for t in range(TRIES * PARTS):
                    columns = [pa.array(np.full(batch.num_rows, t, np.int32)), *(pa.array(parts[:, t, i]) for i in range(2)), batch.column("node")]
                    yield pa.RecordBatch.from_arrays(columns, ["trie", "fingerprint", "rest", "node"])

    carried = ["fingerprint", "rest", "node"]
    prints = cut(codes.mapInArrow(branches, "trie int, fingerprint long, rest long, node long"), "tries")
    rows = _tasks(prints, budget, BRANCH, carried, BRANCH // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                depth, a, b = (batch.column(i)[row].as_py() for i in range(1, 4))
                head, rest, node = _below(batch, row, carried)
                found = list(similar_pairs(np.stack([head, rest], axis=1).view(np.uint64), (a, b), depth, budget, BRANCH, total))
                if found:
                    x, y = (node[np.concatenate(z)] for z in zip(*found))
                    ends = np.array(forest(x, y), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    if rows is None:
        return codes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return rows.mapInArrow(run, "a long, b long")
