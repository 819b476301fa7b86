"""Token ids as Arrow files of equal-length sequences.

Documents are encoded in ascending id order into shards.  A shard is an Arrow
IPC file whose record batches hold ``ROWS`` sequences each: a fixed-size list
of unsigned 16- or 32-bit ids and a fixed-size list of booleans (the mask, true
for ids of documents, false for padding at the end of the shard).  Batch and
row of any id follow from its place alone, so readers map the file into memory
and take slices without copying.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import running_counts
from ..sources.shared import cut, fresh_path
from .batches import slices, texts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core

#: Ids of a sequence, and sequences of a record batch.
LENGTH, ROWS = 2048, 64
#: Words that a Python worker remembers; a full table starts anew.
REMEMBERED = 300_000
LONG = 64
#: Bytes of text that a shard is planned to hold.
SHARD_BYTES = 32_000_000
#: Marks that are a piece of their own behind letters.
MARKS = frozenset(".,;:!?")
#: White space to Python's split() but not to the tokenizer's pattern, or the other way round.
UNSURE = "\x1c\x1d\x1e\x1f᠎"


class LibraryEncoder:
    """The tokenizers library with a memory of the stretches between white space.

    For a vocabulary whose pieces never hold white space and which drops it,
    the ids of a text are those of its stretches one after the other.  Letters
    and a mark behind them are two pieces; case does not count.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.wide = max(vocabulary.values()) >= 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def learn(self, batch: list[str]) -> list[bytes]:
        code = "I" if self.wide else "H"
        return [array(code, x.ids).tobytes() for x in self.library.encode_batch_fast(batch, add_special_tokens=False)]

    def learn_letters(self, batch: list[str]) -> list[bytes]:
        """Ids of strings of letters, each of which is one piece: the library takes them as one text, and ids that end a word part them."""
        if not batch:
            return []
        ids = np.array(self.library.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids, self.kind)
        ends = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
        if len(ends) != len(batch) or not len(ends) or ends[-1] != ids.nbytes:
            return self.learn(batch)
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def remember(self, new: list[str]) -> None:
        words = self.words
        letters = [x for x in new if x.isalpha() and "Σ" not in x and "İ" not in x]
        rest = set(new).difference(letters)
        marked = [x for x in rest if x[-1] in MARKS and (core := x[:-1]).isalpha() and "Σ" not in core and "İ" not in core]
        lower, lower_marked = list(map(str.lower, letters)), [x[:-1].lower() for x in marked]
        plain = list(rest.difference(marked).union({x[-1] for x in marked}).difference(words))
        words.update(zip(plain, self.learn(plain)))
        cores = list(set(chain(lower, lower_marked)).difference(words))
        words.update(zip(cores, self.learn_letters(cores)))
        words.update(zip(letters, map(words.__getitem__, lower)))
        words.update((x, words[core] + words[x[-1]]) for x, core in zip(marked, lower_marked))
        for own in (new, cores):
            if max(map(len, own), default=0) > LONG:
                self.forgotten += [x for x in own if len(x) > LONG]

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            self.words, self.old = {}, self.words
        words, old = self.words, self.old
        self.forgotten: list[str] = []
        plain = [None if any(x in text for x in UNSURE) else text.split() for text in batch]
        new = set(chain.from_iterable(filter(None, plain))).difference(words)
        if old:
            known = [x for x in new if x in old]
            words.update(zip(known, map(old.__getitem__, known)))
            new.difference_update(known)
        self.remember(list(new))
        out = [self.learn([text])[0] if own is None else b"".join(map(words.__getitem__, own)) for text, own in zip(batch, plain)]
        for x in self.forgotten:
            words.pop(x, None)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class ShardWriter:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.kind, self.length, self.rows = kind, length, rows
        ids = pa.from_numpy_dtype(kind.newbyteorder("="))
        self.schema = pa.schema([pa.field("ids", pa.list_(ids, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.pending: list[bytes] = []
        self.held = 0
        self.total = 0

    def add(self, ids: bytes) -> None:
        self.pending.append(ids)
        self.held += len(ids) // self.kind.itemsize
        self.total += len(ids) // self.kind.itemsize
        if self.held >= self.length * self.rows:
            self.flush()

    def flush(self, last: bool = False) -> None:
        own = np.frombuffer(b"".join(self.pending), self.kind)
        size = self.length * self.rows
        whole = len(own) // size * size
        for at in range(0, whole, size):
            self.batch(own[at : at + size], size)
        rest = own[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self.batch(padded, len(rest))
            rest = rest[:0]
        self.pending, self.held = [rest.tobytes()], len(rest)

    def batch(self, ids: np.ndarray, real: int) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < real)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self.flush(last=True)
        self.file.close()


class ShardReader:
    """Random access to a shard by the place of an id."""

    def __init__(self, path: str):
        files, inside = pa.fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(inside) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(inside)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.size = len(self.file.get_batch(0)) * self.length if self.file.num_record_batches else 0
        self.batch = lru_cache(maxsize=2)(lambda i: self.file.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True))

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Views of the ids ``start`` to ``start + count``, batch by batch."""
        while count:
            i, at = divmod(start, self.size)
            own = self.batch(i)[at : at + count]
            yield own
            start, count = start + len(own), count - len(own)

    def close(self) -> None:
        self.source.close()


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Encodes the documents and writes them as shards into ``folder``; returns the manifest.

    The manifest (``id_col``, shard, path, at, n_tokens) has a row for each
    document: its place in its shard and its number of ids with the end id.
    Shards hold ascending ranges of ids; documents of one id are in order of a
    hash of their texts, so that any number of them is dealt over shards; null
    ids come first.  A null text is just the end id.  An empty table writes
    nothing; other columns are ignored, whatever their names.  A task holds
    about a megabyte of texts, or one longer text.

    The file of a task has the number of the attempt in its name, and the
    manifest names the file of the attempt that Spark took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        files, inside = pa.fs.FileSystem.from_uri(folder)
        name = f"shard-{shard:05d}-{attempt}.arrow"
        e = encoder(tokenizer)
        end = np.array([end_id], e.kind).tobytes()
        rows = []
        files.create_dir(inside, recursive=True)
        with files.open_output_stream(f"{inside}/{name}") as sink:
            out = ShardWriter(sink, e.kind, length)
            for batch in batches:
                for part in slices(batch, "text"):
                    at = []
                    n = []
                    for ids in e.encode(texts(part.column("text"))):
                        at.append(out.total)
                        n.append(len(ids) // e.kind.itemsize + 1)
                        out.add(ids + end)
                    rows.append((part.column("id"), at, n))
            out.close()
        if not rows:
            files.delete_file(f"{inside}/{name}")
        for ids, at, n in rows:
            yield pa.RecordBatch.from_arrays([ids, pa.array([shard] * len(n), pa.int32()), pa.array([f"{folder}/{name}"] * len(n)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["id", "shard", "path", "at", "n_tokens"])

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = own.select(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    spark = docs.sparkSession
    shards = max(1, -(-size // SHARD_BYTES), spark.sparkContext.defaultParallelism if size > SHARD_BYTES else 1)
    dealt = own.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = dealt.repartitionByRange(int(shards), "id", "hash", "row").sortWithinPartitions("id", "hash", "row")
    manifest = ordered.select("id", "text").mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, shard int, path string, at long, n_tokens long")
    return cut(manifest, "manifest").withColumnRenamed("id", id_col)


def read_back(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads each document's ids from its shard: ``id_col``, start, n_tokens, ids_crc32.

    start counts the ids of all documents in earlier shards, added up by ranges
    of shards, and of those before it in its own shard.
    """
    totals = running_counts(manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")), [], ["shard"], "n")
    before = totals.select("shard", (F.col("_upto") - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = "", None
        for batch in batches:
            crc = []
            for own, at, n in zip(*(batch.column(x).to_pylist() for x in ("path", "at", "n_tokens"))):
                if own != path:
                    if shard:
                        shard.close()
                    path, shard = own, ShardReader(own)
                value = 0
                for ids in shard.ids(at, n):
                    value = zlib.crc32(ids.astype("<u4"), value)
                crc.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    rows = manifest.join(before, "shard").select(F.col(id_col).alias("id"), "path", "at", "n_tokens", (F.col("before") + F.col("at")).alias("start"))
    rows = rows.repartition("path").sortWithinPartitions("path", "at")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``write_ids`` into a new shared folder, then ``read_back``."""
    spark: SparkSession = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_back(write_ids(docs, tokenizer, folder, end_id, id_col, text_col), id_col)
