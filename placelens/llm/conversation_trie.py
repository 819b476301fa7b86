"""Prefix trie of conversations: a Cartesian tree over the LCP array of the sorted ones.

Every prefix of a conversation is named by a digest chained over its turns.
Distinct conversations are sorted by these names, so that a node of the trie is
a range of places, and the longest common prefixes (LCP) of neighbours say
where ranges end: those of an LCP v reach from the nearest smaller value on the
left to the nearest smaller one on the right.

Nearest smaller values are found in parallel.  A block of places closes what
lies inside it and hands on only its minima seen from either end; the minima of
some blocks together make a block of the next round.  Equal values without a
smaller one between them are one node.  What a range sums up is folded on the
way.  Depths between branching nodes are filled in afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, discard

#: Places of a block, and blocks whose minima make one block of the next round.
BLOCK, FAN = 1 << 11, 64
#: Conversations of a group, and the number below which the turns lie that its members share.
GROUP, SHARED = 20, 4

#: Sums over a range of places: smallest conversation, conversations, leaves, saved words.
SUMS = ("conv", "n", "leaves", "saved")
_NONE = ((1 << 63) - 1, 0, 0, 0)
#: A closed value: the range [left, right) of places shares ``depth`` turns, the node above ``low``; branches ends of it are in the LCP array.
_NODE = ("left", "low", "depth", "right", "branches", *SUMS)
#: An open value: first and last place of it, words of the prefix, sums from first to last and from last to the next open value.
_OPEN = ("value", "first", "last", "ends", "words", *(f"mid_{x}" for x in SUMS), *(f"tail_{x}" for x in SUMS))
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 (binary) of a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of turn, digest, words), by turn, null first, then by digest; rows without a conv_id are of no conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = F.struct(F.col("turn").isNotNull().alias("known"), "turn", turn_digest(role, text).alias("digest"), words.alias("words"))
    rows = turns.where("conv_id is not null").select("conv_id", each.alias("x"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))


def rebuilt(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """``ordered_turns`` with the first turns of each conversation c taken from the first conversation of its group, c - c % ``group``.

    h = crc32 of the decimal id modulo ``shared``: the first h turns come from
    there (fewer if it has fewer, none if it is absent), then c's own after its
    first h.
    """
    own = ordered_turns(turns)
    first = F.col("conv_id") % group
    heads = own.where(first == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, shared).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    joined = own.join(heads, own["conv_id"] - first == heads["head_id"], "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _named(conversations: DataFrame) -> DataFrame:
    """(conv_id, last, keys, words): the digest of each prefix, that of the whole, and the words up to each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, last = [], [], []
            for turns in batch.column("turns").to_pylist():
                key, total, own, sums = b"", 0, [], []
                for x in turns:
                    key = hashlib.sha256(key + x["digest"]).digest()
                    total += x["words"]
                    own.append(key)
                    sums.append(total)
                keys.append(own)
                words.append(sums)
                last.append(key)
            columns = [batch.column("conv_id"), pa.array(last, pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "last", "keys", "words"])

    return conversations.mapInArrow(run, f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, last binary, keys array<binary>, words array<long>")


def _shared(a: list, b: list) -> int:
    """How many leading keys are equal; a key names all of its prefix, so the equal ones come first."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[at - 1] == b[at - 1] else (low, at - 1)
    return low


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part, place, lcp with the row before (null for the first) and next with the row after (null for the last) of a sorted partition."""
    part, place = TaskContext.get().partitionId(), 0
    held = None

    def out(rows: pa.RecordBatch, at: int, lcp: list, after: list) -> pa.RecordBatch:
        own = [pa.array([part] * len(lcp), pa.int32()), pa.array(range(at, at + len(lcp)), pa.int64()), pa.array(lcp, pa.int32()), pa.array(after, pa.int32())]
        return pa.RecordBatch.from_arrays([*rows.columns, *own], [*rows.schema.names, "part", "place", "lcp", "next"])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("keys").to_pylist()
        lcp = [None if x is None else _shared(x, y) for x, y in zip([before, *keys], keys)]
        if held is not None:
            yield out(*held, lcp[:1])
        n = len(keys) - 1
        if n:
            yield out(batch.slice(0, n), place, lcp[:n], lcp[1:])
        held, before = (batch.slice(n, 1), place + n, lcp[n:]), keys[-1]
        place += n + 1
    if held is not None:
        yield out(*held, [None])


def _sequences(named: DataFrame) -> DataFrame:
    """(pos, lcp, next, len, conv, n, last, keys, words) of each distinct conversation in sorted order; lcp is -1 at the first, next at the last."""
    counts = named.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    distinct = counts.join(named, ["last", "conv_id"]).select(F.col("conv_id").alias("conv"), "n", "last", "keys", "words")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    sorted_rows = distinct.repartitionByRange("keys").sortWithinPartitions("keys")
    rows = cut(sorted_rows.mapInArrow(_neighbours, f"{kinds}, part int, place long, lcp int, next int"), "sorted-conversations")
    # one row for each task of the sort: how many came before, and the LCP across its ends
    first = rows.where("place = 0").select("part", F.col("keys").alias("first"))
    parts = rows.where("next is null").select("part", F.col("keys").alias("end"), (F.col("place") + 1).alias("rows")).join(first, "part")
    order = Window.partitionBy(F.lit(1)).orderBy("part")
    lcp = F.coalesce(F.size(F.array_intersect("first", F.lag("end").over(order))), F.lit(-1))
    parts = parts.select("part", lcp.alias("part_lcp"), (F.sum("rows").over(order) - F.col("rows")).alias("before"))
    parts = parts.select("*", F.coalesce(F.lead("part_lcp").over(order), F.lit(-1)).alias("part_next"))
    rows = rows.join(F.broadcast(cut(parts, "parts-of-sort")), "part")
    return rows.select(
        (F.col("before") + F.col("place")).alias("pos"), F.coalesce("lcp", "part_lcp").alias("lcp"), F.coalesce("next", "part_next").alias("next"),
        F.size("keys").alias("len"), "conv", "n", "last", "keys", "words",
    )


def _words(depth: Column | str) -> Column:
    """Words of the first ``depth`` turns."""
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.coalesce(F.get("words", depth - 1), F.lit(0).cast("long"))


def _add(a: tuple, b: tuple) -> tuple:
    return (min(a[0], b[0]), a[1] + b[1], a[2] + b[2], a[3] + b[3])


class _Entry:
    """A value on the stack: left is the last place of the next smaller one, head sums up [left, last), tail [last, the next entry)."""

    __slots__ = ("value", "first", "last", "ends", "words", "mid", "tail", "left", "head")

    def __init__(self, row: tuple, below: _Entry | None):
        self.value, self.first, self.last, self.ends, self.words = row[:5]
        self.mid, self.tail = row[5:9], row[9:13]
        self.left = None if below is None else below.last
        self.head = None if below is None else _add(below.tail, self.mid)

    def row(self) -> tuple:
        return (self.value, self.first, self.last, self.ends, self.words, *self.mid, *self.tail)


def nearest_smaller(rows: list[tuple], end: int | None) -> tuple[list[tuple], list[tuple]]:
    """Nodes closed among open values in order of place, and the values that stay open: minima seen from the left or the right end.

    ``end``: the place behind all values, if ``rows`` are all that is left.
    """
    nodes: list[tuple] = []
    still: list[tuple] = []
    stack: list[_Entry] = []

    def close(value: int, words: int, right: int) -> None:
        while stack and stack[-1].value > value:
            top = stack.pop()
            if top.left is None:
                still.append(top.row())
                continue
            below = stack[-1]
            low, low_words = (below.value, below.words) if below.value >= value else (value, words)
            total = _add(top.head, top.tail)
            nodes.append((top.left, low, top.value, right, top.ends, *total))
            below.tail = (*total[:3], total[3] + (total[1] - 1) * (top.words - low_words))

    for row in rows:
        close(row[0], row[4], row[1])
        top = stack[-1] if stack else None
        if top is not None and top.value == row[0]:
            more = _add(top.tail, row[5:9])
            top.mid = _add(top.mid, more)
            top.head = top.head and _add(top.head, more)
            top.last, top.tail, top.ends = row[2], row[9:13], top.ends + row[3]
        else:
            stack.append(_Entry(row, top))
    if end is not None:
        close(-1, 0, end)
    return nodes, still + [x.row() for x in stack]


def _branching(sequences: DataFrame) -> DataFrame | None:
    """The nodes of the Cartesian tree: where at least two distinct conversations meet or one goes on."""
    count = sequences.agg(F.max("pos")).first()[0]
    if count is None:
        return None
    count += 1
    leaf = F.when(F.col("next") < F.col("len"), 1).otherwise(0)
    saved = (F.col("n") - 1) * (_words("len") - _words(F.greatest("lcp", "next")))
    tail = [F.col("conv"), F.col("n"), leaf, saved]
    own = [F.col("lcp"), F.col("pos"), F.col("pos"), F.lit(1), _words("lcp"), *map(F.lit, _NONE), *tail]
    open_values = sequences.select(*[x.cast("long").alias(c) for x, c in zip(own, _OPEN)])
    names = [*_NODE, *_OPEN]
    kinds = ", ".join(f"{c} long" for c in names)
    closed, size = None, BLOCK
    while True:
        end = count if size >= count else None
        done = open_values.withColumn("block", F.floor(F.col("first") / size)).groupBy("block").applyInArrow(_block(end, names), kinds)
        done = cut(done, "nearest-smaller")
        new = done.where("left is not null").select(*_NODE)
        closed = new if closed is None else closed.union(new)
        if end is not None:
            return closed
        open_values, size = done.where("left is null").select(*_OPEN), size * FAN


def _block(end: int | None, names: list[str]):
    """``nearest_smaller`` of one block: closed nodes, then open values, each with nulls for the columns of the other."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        nodes, still = nearest_smaller(list(zip(*(table.column(c).to_pylist() for c in _OPEN))), end)
        left = [[x[i] for x in nodes] + [None] * len(still) for i in range(len(_NODE))]
        right = [[None] * len(nodes) + [x[i] for x in still] for i in range(len(_OPEN))]
        return pa.table([pa.array(x, pa.int64()) for x in (*left, *right)], names=names)

    return run


def _ends(named: DataFrame) -> DataFrame:
    """(last, ends): SHA-256 of the ids, ascending and joined by commas, of the conversations that are equal to the last turn.

    Ids are joined in pieces where ranges of them are sorted; a conversation
    with many copies sends few rows to the task that hashes its pieces in order.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, ids = batch.column("last").to_pylist(), batch.column("conv_id").to_pylist()
            starts = [i for i, x in enumerate(last) if not i or x != last[i - 1]]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)])]
            columns = [pa.array([last[i] for i in starts], pa.binary()), pa.array([ids[i] for i in starts], pa.int64()), pa.array(texts, pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["last", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for batch in batches:
            out = []
            for last, ids in zip(batch.column("last").to_pylist(), batch.column("ids").to_pylist()):
                if last == own:
                    total.update(b"," + ids.encode())
                    continue
                if total is not None:
                    out.append((own, total.hexdigest()))
                own, total = last, hashlib.sha256(ids.encode())
            yield _pairs(out)
        if total is not None:
            yield _pairs([(own, total.hexdigest())])

    rows = named.select("last", F.col("conv_id").cast("long")).repartitionByRange("last", "conv_id").sortWithinPartitions("last", "conv_id")
    pieces = rows.mapInArrow(joined, "last binary, first long, ids string").repartition("last").sortWithinPartitions("last", "first")
    return pieces.mapInArrow(hashed, "last binary, ends string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.string())], ["last", "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, turns: array of digest and words), one row each, all longs.

    A node is a distinct sequence of first turns, the root that of none; its
    members are the conversations that start with it.  conv_id: the smallest
    member; depth: turns; parent_conv_id: the parent's conv_id, null at the
    root; n_convs: members; n_children; n_leaves: nodes without children in its
    subtree, itself included; saved_tokens: over its subtree the words of the
    last turn of each node times its members but one; ends_sha256: SHA-256 of
    the ids of the members that end there, ascending, joined by commas.

    A conversation without turns belongs to the root only.  Copies are one
    conversation of several members, however many.  An empty table gives no
    node, not even a root.  A conversation's digests are one row: 40 bytes a
    turn.
    """
    named = cut(_named(conversations), "named-prefixes")
    sequences = cut(_sequences(named).join(_ends(named), "last"), "conversations-in-order")
    discard(named)
    inner = _branching(sequences)
    chain = ["conv", "n", "leaves", "saved", "low", "depth", "ends_of", "parent_key", "len", "words", "ends"]
    key = lambda depth: F.coalesce(F.get("keys", depth - 1), F.lit(bytearray()))
    low = F.greatest("lcp", "next")
    own = sequences.where(F.col("len") > low).select(
        "conv", "n", F.lit(1).alias("leaves"), F.lit(0).alias("saved"), low.alias("low"), F.col("len").alias("depth"), F.lit(0).alias("ends_of"), key(low).alias("parent_key"), "len", "words", "ends"
    )
    if inner is not None:
        prefixes = sequences.select(F.col("pos").alias("left"), "keys", "len", "words", "ends")
        inner = inner.withColumns({"low": F.col("low").cast("int"), "depth": F.col("depth").cast("int")})
        inner = cut(inner.join(prefixes, "left").select("conv", "n", "leaves", "saved", "low", "depth", F.col("branches").alias("ends_of"), key(F.col("low")).alias("parent_key"), key(F.col("depth")).alias("key"), "len", "words", "ends"), "branching-nodes")
        own = own.select(*chain).union(inner.select(*chain))
        parents = inner.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent"))
    else:
        own = own.select(*chain)
        parents = own.select("parent_key", F.col("conv").alias("parent")).limit(0)
    smallest = sequences.agg(F.min("conv")).first()[0]
    # a chain hangs from a branching node, most of them from the root, whose smallest member is known
    root, deep = own.where("low <= 0").withColumn("parent", F.when(F.col("low") == 0, F.lit(smallest))), own.where("low > 0").join(parents, "parent_key", "left")
    rows = root.select(*chain, "parent").union(deep.select(*chain, "parent"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.col("low") + 1, F.col("depth"))))
    top, end = F.col("d") == F.col("low") + 1, F.col("d") == F.col("depth")
    children = F.when(end, F.col("ends_of") + (F.col("depth") < F.col("len")).cast("int")).otherwise(1)
    saved = F.col("saved") + (F.col("n") - 1) * (_words("depth") - _words(F.col("d") - 1))
    out = {
        "conv_id": F.col("conv"), "depth": F.col("d"), "parent_conv_id": F.when(F.col("d") > 0, F.when(top, F.col("parent")).otherwise(F.col("conv"))),
        "n_convs": F.col("n"), "n_children": children, "n_leaves": F.col("leaves"), "saved_tokens": saved,
    }
    ends = F.when(F.col("d") == F.col("len"), F.col("ends")).otherwise(_EMPTY)
    return rows.select(*[x.cast("long").alias(c) for c, x in out.items()], ends.alias("ends_sha256"))
