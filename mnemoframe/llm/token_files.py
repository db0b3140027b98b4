"""Token ids in Arrow stream files: batches of fixed-size lists, mapped into memory and read without copying.

A shard is one file `<n>.arrow` in the Arrow IPC stream format. Each row is one sequence of `length` ids and its mask,
both fixed-size lists; all batches but the last have the same number of rows, so row r lies in batch r // rows at
r % rows. The documents of a shard follow each other in ascending id order, sequences are cut regardless of their
borders, and the last sequence is filled up with the end id under mask 0. `<n>.docs.arrow` names each document's
first token and length within the shard. Ids are 16 bits wide where the vocabulary allows, else 32.

Documents are range-partitioned by id; every task streams one shard to a name of its own and renames it when it is
complete, so a repeated task replaces its file by an equal one. Null ids come first; null and empty texts have the end
id only. The folder must be one that all executors share: a local path of a shared mount or a store pyarrow knows.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LONG, Known, byte_symbols, runs_of, words_of
from .common import new_folder, text_of, written

LENGTH = 2048
ROWS = 64


class LibraryEncoder:
    """The tokenizers library's model, asked once per word: runs of non-blank characters are independent of each other,
    and so are their words. Special tokens and very long runs go through the whole library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.symbols = byte_symbols()
        self.word = Known(self._word)
        self.run = Known(self._run)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):
            word = "".join(map(self.symbols.__getitem__, word.encode("utf-8")))
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        if "<|" in run or len(run) > LONG:
            return array(self.code, self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        if run.isascii() and run.isalpha():
            return self.word[run.lower()]
        return b"".join(map(self.word.__getitem__, words_of(run)))

    def encode(self, text: str) -> bytes:
        ids = b"".join(map(self.run.__getitem__, runs_of(text)))
        return ids


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Streams ids into sequences; holds one batch at a time."""

    def __init__(self, sink, kind: pa.DataType, end: int, length: int = LENGTH, rows: int = ROWS):
        self.kind, self.end, self.length, self.rows = kind, end, length, rows
        self.numbers = np.dtype(kind.to_pandas_dtype())
        schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(sink, schema)
        self.held, self.size, self.total = [], 0, 0

    def _batch(self, ids: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(ids)) < used)
        self.stream.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length),
                                                 pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=pa.schema([("input_ids", pa.list_(self.kind, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])))

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.numbers.itemsize
        self.total += len(ids) // self.numbers.itemsize
        full = self.rows * self.length
        if self.size >= full:
            flat = np.frombuffer(b"".join(self.held), self.numbers)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at:at + full], full)
            rest = flat[len(flat) // full * full:]
            self.held, self.size = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.size:
            flat = np.frombuffer(b"".join(self.held), self.numbers)
            padded = np.full(-(-self.size // self.length) * self.length, self.end, self.numbers)
            padded[: self.size] = flat
            self._batch(padded, self.size)
        self.stream.close()


class Shard:
    """Random access to the sequences of one file; views into mapped memory where the file is local."""

    def __init__(self, uri: str):
        store, path = _place(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else pa.py_buffer(store.open_input_file(path).read())
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = len(self.batches[0]) if self.batches else 0
        self.length = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(map(len, self.batches))

    def __getitem__(self, r: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence r, without copying."""
        batch, row = self.batches[r // self.rows], r % self.rows
        return self._ids(r // self.rows)[row * self.length:(row + 1) * self.length], batch.column("mask").values.slice(row * self.length, self.length)

    def _ids(self, b: int) -> np.ndarray:
        return self.batches[b].column("input_ids").values.to_numpy()

    def tokens(self, start: int, count: int) -> np.ndarray:
        """`count` ids from place `start` of the shard; a copy only where they cross a batch."""
        full, parts = self.rows * self.length, []
        while count > 0:
            b, at = divmod(start, full)
            part = self._ids(b)[at:at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_shards(docs: DataFrame, path: str, folder: str, end: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Write all documents and return the manifest (shard, path, n_docs, n_tokens), itself a written table."""
    store, place = _place(folder)
    store.create_dir(place, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, writer, n_docs = library_encoder(path), TaskContext.get().partitionId(), None, 0
        last = np.array([end], own.kind).tobytes()
        store, place = _place(folder)
        name, mine = f"{place}/{number:08d}", f"{place}/.{number:08d}-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None:
                sink, index_sink = store.open_output_stream(f"{mine}.arrow"), store.open_output_stream(f"{mine}.docs.arrow")
                writer = ShardWriter(sink, pa.uint32() if own.wide else pa.uint16(), end, length)
                index = pa.ipc.new_stream(index_sink, DOCS)
            starts, counts = [], []
            for t in batch.column(1).to_pylist():
                ids = own.encode(t or "") + last
                starts.append(writer.total)
                counts.append(len(ids) // own.kind.itemsize)
                writer.add(ids)
            index.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))
            n_docs += len(counts)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            for ending in (".arrow", ".docs.arrow"):
                store.move(mine + ending, name + ending)
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": f"{folder}/{number:08d}", "n_docs": n_docs, "n_tokens": writer.total}])

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(shard, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. start counts over all shards.

    The manifest has one row per task that wrote, so its running total is taken on the driver.
    """
    rows, before, shards = manifest.orderBy("shard").collect(), 0, []
    for r in rows:
        shards.append((r.path, before))
        before += r.n_tokens

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                shard = Shard(f"{one['path']}.arrow")
                store, place = _place(f"{one['path']}.docs.arrow")
                with store.open_input_stream(place) as f:
                    for part in pa.ipc.open_stream(f):
                        starts, counts = part.column(1).to_pylist(), part.column(2).to_pylist()
                        sums = [zlib.crc32(shard.tokens(s, c).astype("<u4").tobytes()) for s, c in zip(starts, counts)]
                        yield pa.record_batch([part.column(0), pa.array([one["before"] + s for s in starts], pa.int64()), part.column(2), pa.array(sums, pa.int64())],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    table = spark.createDataFrame(shards or [("", 0)], "path string, before long").where("path <> ''")
    return table.repartition(max(1, len(shards))).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, end: int, folder: str | None = None, **columns) -> DataFrame:
    """Write and read back."""
    return read_documents(write_shards(docs, path, folder or new_folder(docs.sparkSession, "tokens"), end, **columns))
