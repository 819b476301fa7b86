"""Byte-pair encoding and decoding with an index of pair occurrences.

The pieces of a batch that are not yet known are laid out in one array of
symbols.  An index maps each rank to all positions of its pair; the active
ranks are applied in ascending order, each to its whole list, and the lists of
the pairs around a merge are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .batches import slices, texts
from .vocabulary import Vocabulary

#: Entries that each table of a Python worker may hold; a full table starts anew.
REMEMBERED = 300_000
LONG = 64


def encode_pieces(pieces: Iterable[bytes], v: Vocabulary) -> list[array]:
    """Ids of each piece; all pieces are merged together, rank by rank."""
    symbols: list[int] = []
    starts: list[int] = []
    for piece in pieces:
        starts.append(len(symbols))
        symbols += [v.inner[x] for x in piece]
        symbols.append(-1)  # no pair reaches over it
    n, width, rank_of = len(symbols), v.width, v.ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: defaultdict[int, list[int]] = defaultdict(list)
    for i, rank in enumerate(map(rank_of, [a * width + b for a, b in zip(symbols, symbols[1:])])):
        if rank is not None:
            index[rank].append(i)
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        a, b, whole = v.pairs[rank]
        to_right = whole * width
        places = index.pop(rank)
        places.sort()
        for i in places:
            j = after[i]
            if symbols[i] != a or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            k, h = after[j], before[i]
            symbols[i], symbols[j] = whole, -2
            after[i], before[k] = k, i
            if (x := symbols[k]) >= 0 and (r := rank_of(to_right + x)) is not None:
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(i)
            if (x := symbols[h]) >= 0 and (r := rank_of(x * width + whole)) is not None:
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(h)
    out = []
    for i in starts:
        ids = []
        while (x := symbols[i]) >= 0:
            ids.append(x)
            i = after[i]
        out.append(array("I", ids))
    return out


class Recent(dict):
    """A table of bounded size: what was used since it last filled up, and what was used before that."""

    def __init__(self):
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The keys that it doesn't know; those that it knows of old become recent again."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        new = [x for x in keys if x not in self]
        if self.old:
            self.update((x, self.old[x]) for x in new if x in self.old)
            new = [x for x in new if x not in self]
        return new

    def forget_long(self, keys: Iterable) -> None:
        for x in keys:
            if len(x) > LONG:
                del self[x]


#: A space that does not begin what follows it: white space before it, and white space or the end after it.
_TANGLED = re.compile(r"\s (?!\S)").search


class Encoder:
    """Encodes batches of texts and decodes ids.

    A text is cut before each space.  The vocabulary's own pieces never reach
    over such a cut unless white space stands on both sides of the space; such
    a text, and one with a special string, is split into pieces as a whole.
    """

    def __init__(self, path: str):
        self.v = vocabulary.load(path)
        self.split = vocabulary.splitter(path, vocabulary.BYTE_PIECES)
        self.pieces, self.first, self.spaced = Recent(), Recent(), Recent()

    def learn(self, wanted: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces, as bytes."""
        known = self.pieces
        new = known.missing(set(chain.from_iterable(wanted)))
        known.update(zip(new, map(array.tobytes, encode_pieces([x.encode() for x in new], self.v))))
        out = [b"".join([known[x] for x in pieces]) for pieces in wanted]
        known.forget_long(new)
        return out

    def whole(self, text: str) -> bytes:
        out = []
        for x in self.v.special.split(text):
            if x:
                out.append(array("I", [self.v.specials[x]]).tobytes() if x in self.v.specials else self.learn([self.split(x)])[0])
        return b"".join(out)

    def encode(self, batch: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(batch)
        cuts: list[tuple[int, str, list[str]]] = []
        for i, text in enumerate(batch):
            if _TANGLED(text) or self.v.special.search(text):
                out[i] = self.whole(text)
            else:
                head, *rest = text.split(" ")
                cuts.append((i, head, rest))
        heads = self.first.missing({head for _, head, _ in cuts})
        rests = self.spaced.missing(set(chain.from_iterable(rest for *_, rest in cuts)))
        ids = self.learn([self.split(x) for x in heads] + [self.split(" " + x) for x in rests])
        self.first.update(zip(heads, ids))
        self.spaced.update(zip(rests, ids[len(heads) :]))
        look = self.spaced.__getitem__
        for i, head, rest in cuts:
            out[i] = self.first[head] + b"".join(map(look, rest))
        self.first.forget_long(heads)
        self.spaced.forget_long(rests)
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids; parts that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.v.bytes.__getitem__, array("I", ids)))
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _mapped(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {columns}")
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (array of int) of each text under the byte vocabulary in ``tokenizer``.

    A null or empty text has no ids; special strings inside a text become their
    id; one row for each row, repeated ones too, and none for an empty table.
    Rows are neither joined nor shuffled; a task holds about a megabyte of
    text at a time, or one text if that is longer.  Other columns, whatever
    their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder(tokenizer).encode(texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([array("i", x).tolist() for x in ids], pa.list_(pa.int32()))], ["id", "ids"])

    return _mapped(docs, id_col, text_col, run, "ids array<int>")


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text, what each array of ids stands for.

    A null or empty array gives an empty text; parts that are no UTF-8 become
    replacement characters.  One row for each row, repeated ones too, and none
    for an empty table.  A task holds about a megabyte of ids at a time, or
    one array if that is longer.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                text = [encoder(tokenizer).decode(array("I", x or []).tobytes()).decode() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(text, pa.string())], ["id", "text"])

    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids again and returns digests of both.

    Returns ``id_col``, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (of the decoded text in UTF-8),
    same (the decoded text equals the text).  One row for each row.  A null
    text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "text"):
                own = texts(part.column("text"))
                ids = e.encode(own)
                back = [e.decode(x) for x in ids]
                columns = [
                    part.column("id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(x).hexdigest() for x in ids]),
                    pa.array([sha(x).hexdigest() for x in back]),
                    pa.array([x == y.encode() for x, y in zip(back, own)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return _mapped(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
