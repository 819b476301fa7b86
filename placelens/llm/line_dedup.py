"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of a line and those before it says where a chunk
ends, so that boundaries move with the lines when others are put in or taken
out.  There are two scales.  At the coarse one about one line in four ends a
chunk; chunks of several lines that repeat anywhere in the table are compared
byte by byte and all but the first copy go.  At the fine scale every line ends
a segment, and each two neighbouring ones are a chunk: what is left of repeated
passages, beside the coarse chunks and where passages are too short for a
boundary, goes by these.  A line of many words is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, discard
from .batches import mix, run_hashes, slices, text_bytes, texts

#: Lines of a chunk of the fine scale; a shorter passage never goes, unless it is one line of more than so many words.
WINDOW, LONG_LINE = 2, 50
#: Lines that the rolling hash of a boundary covers; one in ``EVERY`` lines ends a coarse chunk.
ROLLING, EVERY = 2, 4
#: Lists of chunks by document are broadcast up to this measured size; beyond it the texts are shuffled to them.
BROADCAST_BYTES = 64_000_000

_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each line, how many words it has, and for each text the number of lines before it.

    Lines are what ``split`` by the line feed gives: an empty text is one empty line.
    """
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    # a text's end lies before a line feed that begins the next text; equal places sort so that both give a line
    starts = np.empty(len(ends), np.int64)
    text_of = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    starts[1:] = ends[:-1] + 1
    if len(starts):
        starts[text_of[:-1]] = offsets[:-1]
    sizes = ends - starts
    filled = sizes > 0
    joined = np.ones(len(data), bool)
    joined[breaks] = False
    hashes = np.full(len(ends), 0x5BD1E995, np.uint64)
    hashes[filled] = run_hashes(data[joined], sizes[filled])
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = letter[edges]
    words = np.concatenate([[0], np.cumsum(begins)])
    return hashes, words[ends] - words[starts], text_of


def chunk_ends(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a coarse chunk ends behind each line: by the hash of the last ``ROLLING`` lines of its text, and at the end of a text."""
    rolled = hashes.copy()
    for i in range(1, ROLLING):
        rolled[i:] += hashes[:-i] * np.uint64(2 * i + 1)
    ends = mix(rolled) % np.uint64(EVERY) == 0
    for i in range(ROLLING - 1):  # a hash that would reach back into the text before
        ends[np.minimum(before[:-1] + i, len(ends) - 1)] = False
    ends[before[1:] - 1] = True
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, first_line, n_lines, coarse, value) of the chunks of both scales that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, words, before = line_table(*text_bytes(part.column("text")))
                if not len(hashes):
                    continue
                text_of = np.repeat(np.arange(len(before) - 1), np.diff(before))
                n = max(len(hashes) - WINDOW + 1, 0)
                value, word = np.zeros(n, np.uint64), np.zeros(n, bool)
                for i in range(WINDOW):
                    value = mix(value + hashes[i : i + n] * np.uint64(2 * i + 1))
                    word |= words[i : i + n] > 0
                at = np.flatnonzero(word & (text_of[:n] == text_of[WINDOW - 1 : WINDOW - 1 + n]))
                alone = np.flatnonzero(words > LONG_LINE)
                ends = np.flatnonzero(chunk_ends(hashes, before))
                starts = np.append(0, ends[:-1] + 1)
                has_word = np.add.reduceat(words, starts) > 0
                large = has_word & (ends - starts + 1 > WINDOW)
                place = np.arange(len(hashes)) - np.repeat(starts, ends - starts + 1)
                whole = np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
                value = np.concatenate([value[at], hashes[alone], mix(whole)[large]])
                sizes = np.concatenate([np.full(len(at), WINDOW), np.ones(len(alone), int), (ends - starts + 1)[large]]).astype(np.int32)
                coarse = np.repeat([False, True], [len(at) + len(alone), int(large.sum())])
                at = np.concatenate([at, alone, starts[large]])
                rows = text_of[at]
                taken = pa.array(rows, pa.int64())
                columns = [part.column("id").take(taken), part.column("version").take(taken), pa.array(at - before[rows], pa.int32()), pa.array(sizes), pa.array(coarse), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "first_line", "n_lines", "coarse", "value"])

    rows = _versioned(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, version long, first_line int, n_lines int, coarse boolean, value long")


def _bodies(rows: DataFrame) -> DataFrame:
    """(id, version, first_line, n_lines, body) of the chunks ``starts`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                starts = part.column("starts")
                taken, first = pc.list_parent_indices(starts), starts.flatten()
                at, size = first.field("first_line"), first.field("n_lines")
                lines = [x.split("\n") for x in texts(part.column("text"))]
                body = ["\n".join(lines[row][i : i + n]) for row, i, n in zip(taken.to_pylist(), at.to_pylist(), size.to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id").take(taken), part.column("version").take(taken), at, size, pa.array(body, pa.string())], ["id", "version", "first_line", "n_lines", "body"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, version long, first_line int, n_lines int, body string")


def _versioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _side(table: DataFrame, parts: str) -> DataFrame:
    """A written table of ids and small arrays, to be broadcast if it has been measured to be small."""
    size = table.select(F.sum(40 + 24 * F.size(parts))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _later_copies(docs: DataFrame, found: DataFrame, gone: DataFrame | None, name: str) -> DataFrame:
    """(near, near_version, drop: array of first_line, n_lines) of the chunks that are equal in bytes to an earlier one.

    Chunks inside what ``gone`` lists are left out: an earlier copy of each
    stands in the earlier copy of what holds it.
    """
    place = F.struct("id", "version", "first_line")
    places = found.groupBy("value", "n_lines").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written apart, so that the join with a value of many chunks can be split
    values = cut(places.where("first <> last").select("value", "n_lines"), f"{name}-values")
    several = found.join(values, ["value", "n_lines"])
    wanted = several.groupBy("id", "version").agg(F.collect_set(F.struct("first_line", "n_lines")).alias("starts"))
    wanted = wanted.withColumnsRenamed({"id": "near", "version": "near_version"})
    if gone is not None:
        earlier = gone.select(F.col("near").alias("of"), F.col("near_version").alias("of_version"), _lines_of("drop").alias("lines"))
        wanted = wanted.join(earlier, F.col("near").eqNullSafe(F.col("of")) & (F.col("near_version") == F.col("of_version")), "left")
        inside = lambda x: F.size(F.array_except(F.sequence(x["first_line"], x["first_line"] + x["n_lines"] - 1), F.coalesce("lines", F.array().cast("array<int>")))) == 0
        wanted = wanted.select("near", "near_version", F.filter("starts", lambda x: ~inside(x)).alias("starts")).where(F.size("starts") > 0)
    near = cut(wanted, f"{name}-repeated")
    discard(values)
    # the bytes of those chunks only
    own = _versioned(docs, id_col="id", text_col="text")
    listed = _side(near, "starts")
    own = own.join(listed, own["id"].eqNullSafe(listed["near"]) & (own["version"] == listed["near_version"]))
    lines = cut(_bodies(own.select("id", "version", "text", "starts")), f"{name}-bytes")
    discard(near)
    # groups of equal bytes; a digest then stands for the bytes of a group
    groups = lines.groupBy("body", "n_lines").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    groups = cut(groups.select(F.sha2("body", 256).alias("digest"), "n_lines", "first"), f"{name}-bodies")
    members = lines.select("id", "version", "first_line", "n_lines", F.sha2("body", 256).alias("digest"))
    later = members.join(groups, ["digest", "n_lines"]).where(~place.eqNullSafe(F.col("first")))
    drop = later.groupBy("id", "version").agg(F.collect_set(F.struct("first_line", "n_lines")).alias("drop"))
    drop = cut(drop.withColumnsRenamed({"id": "near", "version": "near_version"}), f"{name}-dropped")
    discard(lines, groups)
    return drop


def _lines_of(ranges: str):
    """The numbers of all lines of an array of (first_line, n_lines)."""
    return F.array_distinct(F.flatten(F.transform(ranges, lambda x: F.sequence(x["first_line"], x["first_line"] + x["n_lines"] - 1))))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(near, near_version, drop: array of line numbers) of the texts that lose lines."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(chunks(rows, "id"), "chunks")
    coarse = _later_copies(rows, found.where("coarse"), None, "coarse")
    fine = _later_copies(rows, found.where("not coarse"), coarse, "fine")
    discard(found)
    both = coarse.union(fine).groupBy("near", "near_version").agg(F.flatten(F.collect_list("drop")).alias("drop"))
    out = cut(both.select("near", "near_version", _lines_of("drop").alias("drop")), "dropped-lines")
    discard(coarse, fine)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages of lines taken out of ``text_col``, and n_lines_removed added.

    The first copy stays: that of the smallest id, then the smallest text
    hash, then the first line; a null id counts as smallest.  Rows with equal
    id and text are one document and lose the same lines.  A line goes if it
    and a neighbour stand together at an earlier place too, or if it has more
    than ``LONG_LINE`` words and stands at an earlier place too; so of a line
    in several passages one copy stays somewhere.  A null text stays null;
    other single lines, and lines that have no word and none beside them, are
    never removed; a text may become empty.  An empty table gives an empty one.
    A column n_lines_removed of ``docs`` is replaced; other columns stay,
    whatever their names.  A task holds about a megabyte of texts, or one
    longer text.
    """
    drop = _side(repeated_lines(docs, id_col, text_col), "drop")
    order = [c for c in docs.columns if c != "n_lines_removed"]
    rows = docs.select(F.struct(*order).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"))
    rows = rows.join(drop, rows["id"].eqNullSafe(drop["near"]) & (rows["version"] == drop["near_version"]), "left")
    removed = F.coalesce(F.array_size("drop"), F.lit(0)).cast("long")
    # an array of the one array of lines names it, so that a text is split once
    lines = F.array(F.split("text", "\n"))
    kept = lambda x: F.array_except(F.sequence(F.lit(0), F.array_size(x) - 1), F.col("drop"))
    left = F.transform(lines, lambda x: F.array_join(F.transform(kept(x), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.get(left, F.lit(0)))
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in order], removed.alias("n_lines_removed"))
