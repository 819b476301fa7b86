"""Benchmark decontamination by winnowing.

Of each run of ``window`` words only the smallest of its k-gram hashes is kept
as a fingerprint.  Two texts that share ``window`` consecutive words share all
k-grams of that stretch and so its smallest hash: every shared stretch of that
length shows as an equal fingerprint.  Fingerprints of documents and of
benchmark items meet in a join that keeps the places in the document; each hit
is then extended to both sides as far as windows of the item follow, compared
by words, so that hashes never decide.

A run of neighbouring fingerprints that are equal, as repeated words give, is
one hit, and hits are not paired with the places in the item: work and memory
grow with the length of the texts, whatever repeats in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, discard
from .batches import mix, run_hashes, slices, text_bytes

#: Words of a k-gram, and words of a window.
K, WINDOW = 5, 13
#: Candidates, with the texts of their items, are broadcast up to this measured size; beyond it the documents are shuffled to them.
BROADCAST_BYTES = 32_000_000

#: Lower-cases A-Z; what is no part of a word becomes zero.
_LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: str) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return _WORDS(text.encode().lower())


def _word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, the length of each word, and for each text the number of words before it."""
    letters = _LETTERS[data]
    inside = letters != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    bytes_before = np.cumsum(inside) - inside
    lengths = np.diff(np.append(bytes_before[at], int(inside.sum())))
    return letters[inside], lengths, np.searchsorted(at, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed fingerprints of the texts: (index of the text, word at which the k-gram begins, fingerprint).

    ``lengths``: spans of so many words are guaranteed to show; a fingerprint
    is only equal to one made for the same length.  Of equal k-grams in a
    window the last one counts, so that equal windows choose the same place.
    """
    values, sizes, before = _word_runs(data, offsets)
    hashes = run_hashes(values, sizes)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    end_of_word = np.repeat(before[1:], np.diff(before))
    for length in lengths:
        k = min(K, length)
        count = len(hashes) - length + 1
        if count <= 0:
            continue
        grams = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(grams)]
        grams = mix(grams + np.uint64(length))
        least, at, span = grams, np.arange(len(grams)), 1
        while span < length - k + 1:  # the smallest of ``span`` grams from each place
            step = min(span, length - k + 1 - span)
            later = least[step:] <= least[:-step]
            least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
            span += step
        place = np.arange(count)
        whole = place + length <= end_of_word[:count]  # the window lies in one text
        at = at[:count][whole]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        at = at[new]
        owner = np.searchsorted(before, at, side="right") - 1
        out.append((owner, at - before[owner], grams[at]))
    return tuple(map(np.concatenate, zip(*out)))


def hit_runs(owner: np.ndarray, place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first place, last place, fingerprint) of the runs of neighbouring equal fingerprints of a text."""
    if not len(prints):
        return owner, place, place, prints
    new = np.ones(len(prints), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1]) | (place[1:] <= place[:-1])
    starts = np.flatnonzero(new)
    return owner[starts], place[starts], place[np.append(starts[1:], len(prints)) - 1], prints[starts]


def _fingerprint_rows(rows: DataFrame, lengths: list[int] | None, window: int) -> DataFrame:
    """Columns of a table (..., text) but the text, with first, last and print of each run of equal fingerprints.

    Without ``lengths`` each text is cut to windows of its own length, at most ``window``.
    """
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                if lengths is None:
                    own = np.minimum(np.diff(_word_runs(data, offsets)[2]), window)
                    found = [(x, fingerprints(data, offsets, [int(x)])) for x in np.unique(own) if x]
                    found = [[y[own[each[0]] == x] for y in each] for x, each in found]  # a text counts only with its own length
                    owner, place, prints = map(np.concatenate, zip(*found)) if found else fingerprints(data, offsets, [])
                else:
                    owner, place, prints = fingerprints(data, offsets, lengths)
                owner, first, last, prints = hit_runs(owner, place, prints)
                kept = [part.column(c).take(pa.array(owner)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(prints.view(np.int64))], [*names, "first", "last", "print"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, first int, last int, print long")


def window_names(tokens: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of ``length`` tokens; two windows have the same one only if all their tokens are equal.

    Windows of twice the length are pairs of windows; the last pair overlaps.
    """
    names, span = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while span < length and len(names):
        step = min(span, length - span)
        names = names[:-step] * (int(names.max()) + 1) + names[step:]
        names, span = np.unique(names, return_inverse=True)[1].astype(np.int64), span + step
    return names


def _occurring(doc: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[list[tuple[int, int]]]:
    """For each item (its words, and hits: first and last place in the document) the spans of ``doc`` that its windows of ``length`` cover around a hit."""
    count = len(doc) - length + 1
    if count <= 0:
        return [[] for _ in others]
    ends = -2 - np.arange(len(others) + 1)  # keep windows across two texts apart from all others
    pieces = [doc, ends[:1]]
    for i, (words_, _) in enumerate(others):
        pieces += [words_, ends[i + 1 : i + 2]]
    names = window_names(np.concatenate(pieces), length)
    own, at, out = names[:count], len(doc) + 1, []
    for words_, hits in others:
        same = np.isin(own, names[at : at + len(words_) - length + 1])
        at += len(words_) + 1
        near = np.zeros(count + 1, np.int64)  # windows that hold the k-gram of a hit
        np.add.at(near, np.clip(hits[:, 0] - (length - min(K, length)), 0, count), 1)
        np.add.at(near, np.clip(hits[:, 1] + 1, 0, count), -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        held = np.concatenate([[0], np.cumsum(same & (np.cumsum(near)[:-1] > 0))])
        out.append([(int(a), int(b) + length - 1) for a, b in zip(edges[::2], edges[1::2]) if held[b] > held[a]])
    return out


def hit_words(doc: list[bytes], items: list[tuple[str, list[bytes], np.ndarray]], window: int = WINDOW) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of words of ``doc`` inside an occurrence of a window of an item, merged, and the items that occur.

    ``items``: name, words and hits (first and last place of a run in the document).
    """
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(x, len(numbers)) for x in doc], np.int64)
    found, runs = [], []
    for length in sorted({min(window, len(other)) for _, other, _ in items}):
        group = [x for x in items if min(window, len(x[1])) == length]
        others = [(np.array([numbers.get(x, -1) for x in other], np.int64), hits) for _, other, hits in group]
        for (name, _, _), spans in zip(group, _occurring(own, others, length)):
            if spans:
                found.append(name)
                runs += spans
    spans: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans, found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window.  Returns ``id_col``, n_words, n_hit,
    hit_spans (array of word ranges, end exclusive), item_ids (sorted strings
    of the items that occur); one row for each row of ``docs``.

    A null text has no words, a null item id is the empty string.  Rows of one
    item id count as one item; rows of one document id, null included, each get
    their own row.  Repeated rows get equal results.  Empty tables give no rows
    or no hits.  Other columns are ignored, whatever their names.  Memory holds
    about a megabyte of texts, or one longer text, and the items that it meets;
    a text of one repeated word, or of any period, costs no more than another.

    Spark chooses how to join the fingerprints of the benchmark; a hot one can
    be split like any skewed join, since only places leave the join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("item_text"))
    # rows of one item are told apart by their texts
    items = cut(items.distinct().withColumn("row", F.monotonically_increasing_id()), "items")
    prints = cut(_fingerprint_rows(items.select("row", F.col("item_text").alias("text")), None, window).select("row", "print").distinct(), "item-prints")
    n_words = F.array_size(F.filter(F.split("item_text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != ""))
    lengths = sorted(x[0] for x in items.select(F.least(n_words, F.lit(window))).distinct().collect() if x[0])
    met = _fingerprint_rows(own, lengths, window).join(prints, "print")
    met = met.groupBy("id", "version", "row").agg(F.collect_set(F.struct("first", "last")).alias("hits"))
    each = F.struct("item", "item_text", "hits")
    candidates = cut(met.join(items, "row").groupBy("id", "version").agg(F.collect_list(each).alias("items")), "candidates")
    taken = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["item_text"]) + 100 + 8 * F.size(x["hits"]))
    size = candidates.select(F.sum(taken)).first()[0] or 0
    discard(items, prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = np.diff(_word_runs(*text_bytes(part.column("text")))[2])
                spans: list[list] = [[] for _ in counts]
                found: list[list] = [[] for _ in counts]
                near = part.column("items")
                for i in np.flatnonzero(near.is_valid().to_numpy(zero_copy_only=False)):
                    own = [(x["item"], words(x["item_text"]), np.array([(h["first"], h["last"]) for h in x["hits"]])) for x in near[i].as_py()]
                    got, names = hit_words(words(part.column("text")[i].as_py()), own, window)
                    spans[i] = [{"start": a, "end": b} for a, b in got]
                    found[i] = sorted(set(names))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))], ["id", "n_words", "hit_spans", "item_ids"])

    near = candidates.withColumnsRenamed({"id": "near", "version": "near_version"})
    met = own["id"].eqNullSafe(near["near"]) & (own["version"] == near["near_version"])
    joined = own.join(F.broadcast(near) if size <= BROADCAST_BYTES else near, met, "left").select("id", "text", "items")
    out = joined.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_words long, hit_spans array<struct<start:long,end:long>>, item_ids array<string>")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "hit_spans", "item_ids")


def contaminated(n_hit, n_words, part: int = 20):
    """At least one hit word, and at least one word in ``part``."""
    return (n_hit > 0) & (part * n_hit >= n_words)
