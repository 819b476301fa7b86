"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

Each piece of a text starts as a list of byte symbols.  The adjacent pair of
lowest rank is popped from a heap again and again and merged; the count is the
number of initial symbols less the number of merges.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .batches import slices, texts

#: Entries that a Python worker remembers; beyond it starts anew, so memory stays bounded.
REMEMBERED = 400_000
#: Longer strings are counted but not remembered.
LONG = 64
#: White space to Python's split() but not to the vocabulary's pattern, or the other way round.
UNSURE = "\x1c\x1d\x1e\x1f᠎"


def merges(symbols: list[int], ranks: dict[int, int], pairs: list[tuple[int, int, int]], width: int) -> int:
    """How many merges byte-pair encoding makes in one piece."""
    n, done = len(symbols), 0
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(symbols[i] * width + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        left, right, whole = pairs[rank]
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        done += 1
        symbols[i], symbols[j] = whole, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(whole * width + symbols[k])) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get(symbols[h] * width + whole)) is not None:
            heapq.heappush(heap, (r, h))
    return done


class _Pieces(dict):
    """piece -> number of its tokens."""

    def __init__(self, path: str):
        self.v = vocabulary.load(path)

    def __missing__(self, piece: str) -> int:
        v, data = self.v, piece.encode()
        n = len(data)
        symbols = [v.inner[b] for b in data]
        symbols[-1] = v.last[data[-1]]
        count = n - merges(symbols, v.ranks, v.pairs, v.width)
        if len(self) >= REMEMBERED:
            self.clear()
        if n <= LONG:
            self[piece] = count
        return count


class WordCounter(dict):
    """Stretch of text without white space -> number of its tokens."""

    def __init__(self, path: str):
        self.pieces, self.v = _Pieces(path), vocabulary.load(path)
        self.split = vocabulary.splitter(path, vocabulary.WORD_PIECES)

    def __missing__(self, word: str) -> int:
        count = self.plain(word) if "<|" not in word else self.with_specials(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= LONG:
            self[word] = count
        return count

    def plain(self, text: str) -> int:
        if text.isascii() or text.isprintable():
            text = unicodedata.normalize("NFC", text)
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # no final sigma
        return sum(map(self.pieces.__getitem__, self.split(text)))

    def with_specials(self, text: str) -> int:
        parts = [x for x in self.v.special.split(text) if x]
        return sum(1 if x in self.v.specials else self.plain(x) for x in parts)

    def count(self, text: str) -> int:
        if any(x in text for x in UNSURE):
            return self.with_specials(text)
        return sum(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each text under the word vocabulary in the file ``tokenizer``.

    Returns ``id_col``, n_bytes, n_tokens, over_limit; one row for each row of
    ``docs``, whose other columns are ignored.  A null text counts as empty
    (0 tokens); repeated rows stay; an empty table gives an empty result.
    There is no shuffle: what a worker remembers is bounded by ``REMEMBERED``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            for part in slices(batch, "text"):
                n = [count(x) for x in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
