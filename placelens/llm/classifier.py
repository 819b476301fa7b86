"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by cyclic boosting: in
each round every feature in turn gets a shallow tree on the gradients summed by
bin, added at a small rate.  Tables of pairs of features follow on what is left.
A score is a sum of table entries, so a document is scored by additions only.
Several models are fitted in tasks of their own, each held to the rows that it
leaves out, and their tables are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .batches import mix, run_hashes, slices, text_bytes
from .line_dedup import line_table

#: Labelled rows that a model is fitted on, about; of more a share is taken by a hash of the id.
SAMPLE_ROWS = 20_000
#: Models that are averaged; each leaves one fold of the sample out.
BAGS = 8
#: Bins of a feature, and of each side of a pair; pairs of a model.
BINS, PAIR_BINS, PAIRS = 64, 16, 6
#: Rate of a tree, most rounds, and rounds without a gain on the rows left out after which a model is done.
RATE, ROUNDS, PATIENCE = 0.05, 400, 30
#: Least sum of second derivatives in a leaf, and what is added to it in a leaf's value.
LEAST, RIDGE = 2.0, 1.0

FEATURES = (
    "words", "word_length", "longest_word", "symbols", "ends", "commas", "exclaims", "digits", "capitals", "beyond_ascii",
    "distinct_words", "repeated_runs", "stutters", "line_words", "repeated_lines", "short_lines", "short_words",
)


def _class(letters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(letters))


_SPACE, _SYMBOL, _END, _COMMA = (_class(x) for x in (b" \t\n\x0b\x0c\r", b"#*$%&|<>{}[]=~^_\\@", b".!?", b",;:"))
_DIGIT, _CAPITAL, _HIGH, _INSIDE = (_class(range(a, b)) for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x80, 0x100), (0x80, 0xC0)))
_LETTER = _CAPITAL | _class(range(0x61, 0x7B)) | _HIGH


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each of ``n`` owners has."""
    _, at = np.unique(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner[at], minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, ``FEATURES``) of whole texts; all zero for an empty one."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    bytes_before = np.cumsum(inside) - inside
    sizes = np.diff(np.append(bytes_before[at], int(inside.sum())))
    before = np.searchsorted(at, offsets)
    words = np.diff(before)
    owner = np.repeat(np.arange(n), words)
    hashes = run_hashes(data[inside], sizes)
    same = owner[1:] == owner[:-1]
    stutters = np.bincount(owner[1:][same & (hashes[1:] == hashes[:-1])], minlength=n)
    triples = mix(hashes[:-2] + np.uint64(3) * hashes[1:-1] + np.uint64(5) * hashes[2:]) if len(hashes) > 2 else np.zeros(0, np.uint64)
    whole = owner[2:] == owner[:-2]
    runs = np.maximum(words - 2, 0)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, sizes)
    line_hashes, line_words, line_of = line_table(data, offsets)
    of = np.repeat(np.arange(n), np.diff(line_of))
    filled = line_words > 0
    lines = np.bincount(of[filled], minlength=n)
    letters, chars = count(_LETTER[data] & ~_INSIDE[data]), count(inside & ~_INSIDE[data])
    columns = (
        np.log1p(words), _share(chars, words), np.log1p(longest), _share(count(_SYMBOL[data]), chars), _share(count(_END[data]), words), _share(count(_COMMA[data]), words),
        _share(count(data == 0x21), words), _share(count(_DIGIT[data]), chars), _share(count(_CAPITAL[data]), letters), _share(count(_HIGH[data] & ~_INSIDE[data]), chars),
        _share(_distinct(owner, hashes, n), words), 1 - _share(_distinct(owner[2:][whole], triples[whole], n) + (runs == 0), np.maximum(runs, 1)), _share(stutters, words),
        np.log1p(_share(words, lines)), 1 - _share(_distinct(of[filled], line_hashes[filled], n) + (lines == 0), np.maximum(lines, 1)),
        _share(np.bincount(of[filled & (line_words <= 3)], minlength=n), lines), _share(np.bincount(owner[sizes <= 3], minlength=n), words),
    )
    return np.stack(columns, axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, x: array of ``FEATURES``) of each row; a null text counts as empty.

    A task holds about a megabyte of texts, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = measures(*text_bytes(part.column("text")))
                offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>").withColumnRenamed("id", id_col)


@dataclass
class Model:
    """Cuts between the bins of each feature, and tables: of the features, and of pairs of them over every few bins."""

    cuts: list[np.ndarray]
    start: float = 0.0
    single: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), BINS)))
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of ``FEATURES``."""
        bins = binned(x, self.cuts)
        total = np.full(len(x), self.start)
        for i in range(len(FEATURES)):
            total += self.single[i, bins[:, i]]
        coarse = bins // (BINS // PAIR_BINS)
        for (i, j), table in self.pairs.items():
            total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, np.int64)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best gain of a cut of the bins [low, high) and the first bin behind it."""
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    if not len(left_g):
        return 0.0, low
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    gains[(left_h < LEAST) | (all_h - left_h < LEAST)] = 0
    best = int(np.argmax(gains))
    return float(gains[best]), low + best + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most three leaves on sums of derivatives by bin."""
    gain, at = _split(g, h, 0, len(g))
    if gain <= 0:
        return np.zeros(len(g))
    sides = [(*_split(g, h, 0, at),), (*_split(g, h, at, len(g)),)]
    edges = {0, at, len(g)}
    better = max(sides)
    if better[0] > 0:
        edges.add(better[1])
    edges = sorted(edges)
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values by pair of bins of a tree that cuts the first feature once and each of its sides by the second."""
    best, out = 0.0, np.zeros_like(g)
    rows_g, rows_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    whole = float(_gain(g.sum(), h.sum()))
    for at in range(1, len(g)):
        leaves, total = [], -whole
        for a, b, side_g, side_h in ((0, at, rows_g[at - 1], rows_h[at - 1]), (at, len(g), rows_g[-1] - rows_g[at - 1], rows_h[-1] - rows_h[at - 1])):
            gain, cut_at = _split(side_g, side_h, 0, len(side_g))
            total += gain + float(_gain(side_g.sum(), side_h.sum()))
            parts = ((0, cut_at), (cut_at, len(side_g))) if gain > 0 else ((0, len(side_g)),)
            leaves += [(a, b, c, d, -side_g[c:d].sum() / (side_h[c:d].sum() + RIDGE)) for c, d in parts]
        if total > best:
            best, out = total, np.zeros_like(g)
            for a, b, c, d, value in leaves:
                out[a:b, c:d] = value
    return best, out


def _loss(score: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(label > 0, -score, score)))) if len(score) else 0.0


def fit_bag(bins: np.ndarray, label: np.ndarray, left_out: np.ndarray) -> tuple[float, np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """Start, tables and tables of pairs, fitted on the rows that are not left out, as long as those left out gain."""
    y, own, held = label.astype(float), ~left_out, left_out
    start = float(np.log((y[own].sum() + 1) / ((1 - y[own]).sum() + 1)))
    score = np.full(len(y), start)
    single = np.zeros((bins.shape[1], BINS))
    pairs: dict[tuple[int, int], np.ndarray] = {}

    def derivatives() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score[own]))
        return p - y[own], p * (1 - p)

    def boost(terms: list, step, tables) -> None:
        """Rounds over all terms; the tables go back to the best round."""
        nonlocal score
        best, kept, since = _loss(score[held], y[held]), ([tables[t].copy() for t in terms], score.copy()), 0
        for _ in range(ROUNDS):
            for t in terms:
                place, value = step(t, *derivatives())
                tables[t] += RATE * value
                score = score + RATE * value[place]
            loss = _loss(score[held], y[held])
            if loss < best - 1e-6:
                best, kept, since = loss, ([tables[t].copy() for t in terms], score.copy()), 0
            elif (since := since + 1) >= PATIENCE:
                break
        for t, table in zip(terms, kept[0]):
            tables[t][...] = table
        score = kept[1]

    def one(t: int, g: np.ndarray, h: np.ndarray):
        place = bins[:, t]
        return place, shallow_tree(np.bincount(place[own], g, BINS), np.bincount(place[own], h, BINS))

    coarse = bins // (BINS // PAIR_BINS)

    def sums(t: tuple[int, int], g: np.ndarray, h: np.ndarray):
        place = coarse[:, t[0]] * PAIR_BINS + coarse[:, t[1]]
        return place, *(np.bincount(place[own], x, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for x in (g, h))

    def two(t: tuple[int, int], g: np.ndarray, h: np.ndarray):
        place, g, h = sums(t, g, h)
        return (coarse[:, t[0]], coarse[:, t[1]]), pair_tree(g, h)[1]

    boost(list(range(bins.shape[1])), one, single)
    left = derivatives()
    gains = {t: pair_tree(*sums(t, *left)[1:])[0] for t in combinations(range(bins.shape[1]), 2)}
    chosen = sorted(gains, key=lambda t: (-gains[t], t))[:PAIRS]
    pairs |= {t: np.zeros((PAIR_BINS, PAIR_BINS)) for t in chosen}
    boost(chosen, two, pairs)
    return start, single, pairs


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, bags: int = BAGS) -> Model:
    """A model from rows (id, x, label), of about ``sample_rows`` of them; with one label only, or none, a constant.

    Every bag is one task over the bounded sample; the driver gets cuts and
    tables only.
    """
    count = labelled.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample_rows / max(count, 1))
    sample = cut(labelled.where(share).select("id", "x", "label"), "sample")
    points = [i / BINS for i in range(1, BINS)]
    found = sample.select(*[F.percentile(F.get("x", F.lit(i)), F.array(*map(F.lit, points))).alias(f"q{i}") for i in range(len(FEATURES))]).first()
    cuts = [np.unique(np.array(q or [], float)) for q in found]
    if not count:
        return Model(cuts)

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("place").to_numpy(),))
        table = table.take(pa.array(order))
        x = np.stack(table.column("x").to_numpy()) if table.num_rows else np.zeros((0, len(FEATURES)))
        start, single, pairs = fit_bag(binned(x, cuts), table.column("label").to_numpy(), table.column("fold").to_numpy() == table.column("bag").to_numpy())
        rows = [(-1, -1, [start]), *((i, -1, v.tolist()) for i, v in enumerate(single)), *((i, j, v.ravel().tolist()) for (i, j), v in pairs.items())]
        return pa.table([pa.array(list(z), k) for z, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["i", "j", "entries"])

    place = F.xxhash64(F.lit("order"), "id", "x")
    rows = sample.select("x", "label", place.alias("place"), F.pmod(place, F.lit(bags)).cast("int").alias("fold"), F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    model = Model(cuts)
    for i, j, values in sorted(map(tuple, rows.groupBy("bag").applyInArrow(run, "i int, j int, entries array<double>").collect())):
        values = np.array(values) / bags
        if i < 0:
            model.start += float(values[0])
        elif j < 0:
            model.single[i] += values
        else:
            model.pairs[i, j] = model.pairs.get((i, j), 0) + values.reshape(PAIR_BINS, PAIR_BINS)
    return model


def scored(rows: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score) of rows of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(x), pa.float64())], ["id", "score"])

    own = rows.select(F.col(id_col).alias("id"), "x")
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is never learned from: a third of all ids, by their CRC-32; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col``, held_out, score and predicted (1 from a score of 0.5) of each row of ``docs``.

    Learned from the labels (0 or 1) of ids that are not held out; an id with
    both labels, a null label and a null id teach nothing.  Only the text is an
    input of a score: null counts as empty, equal texts get equal scores.
    Without labels every score is 0.5.  One row for each row of ``docs``,
    repeated ones too; an empty table gives an empty one; other columns are
    ignored, whatever their names.
    """
    own = cut(features(docs, id_col, text_col), "features").withColumnRenamed(id_col, "id")
    taught = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    taught = taught.agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other")
    model = fit(own.join(taught.select("id", "label"), "id"), sample_rows)
    rows = scored(own, model, "id").withColumnRenamed("id", id_col)
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
