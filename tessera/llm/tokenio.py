"""Token ids as Arrow stream files of fixed-size-list batches.

Documents go to files in ascending doc_id order: the rows are range-partitioned
by doc_id, each task writes one file, and the files' names rise with the ranges.
A file is an Arrow IPC stream whose batches hold `rows` sequences each: column
ids is a fixed-size list of `length` ids (two bytes each where the vocabulary
allows), column mask a fixed-size list of booleans. All batches but a short
last one are equally long, also in bytes, so sequence i lies at a computed place
(SequenceFile) and its ids and mask are views of a memory-mapped file, not
copies. The ids of a file's documents run on from sequence to sequence; the rest
of its last sequence is masked out. A second stream file beside it, `.docs`, holds doc_id, start and
n_tokens of each document, start counted within the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import PieceEncoder, id_type, public_path, worker_encoder
from tessera.session import Scratch, table

LENGTH, ROWS = 1024, 256
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_SUMMARY = "part int, name string, n_docs long, n_tokens long"


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to a stream of fixed-size sequences; holds one batch at a time."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        self.schema, self.kind, self.length, self.size = _schema(kind, length), kind, length, length * rows
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.parts)
            for at in range(0, len(flat) - self.size + 1, self.size):
                self._batch(flat[at : at + self.size], self.size)
            rest = flat[len(flat) // self.size * self.size :]
            self.parts, self.held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, n: int) -> None:
        full = np.zeros(-(-n // self.length) * self.length, dtype=self.kind)
        full[:n] = flat
        mask = np.arange(len(full)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts), self.held)
        self.out.close()


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, root: str, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    """One file per task, moved to its place when whole; a repeated task writes the same bytes."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    name, own = f"part-{part:08d}", f"{base}/.{uuid.uuid4().hex}"
    coder = worker_encoder(("io", path), lambda: PieceEncoder(path, limit=550_000))
    kind, docs, total = id_type(path), 0, 0
    end = np.array([end_id], dtype=kind).tobytes()
    with fs.open_output_stream(f"{own}.ids") as ids_sink, fs.open_output_stream(f"{own}.docs") as docs_sink:
        writer, index = SequenceWriter(ids_sink, kind, length, rows), pa.ipc.new_stream(docs_sink, _DOCS)
        for batch in batches:
            starts, sizes = [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(coder.records(text or "")) + end, dtype=kind)
                writer.append(ids)
                starts.append(total)
                sizes.append(len(ids))
                total += len(ids)
            docs += len(sizes)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_DOCS))
        writer.close()
        index.close()
    for kind_of in ("docs", "ids"):
        put_in_place(fs, f"{own}.{kind_of}", f"{base}/{name}.{kind_of}")
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "name", "n_docs", "n_tokens"])


def put_in_place(fs: pyarrow.fs.FileSystem, own: str, place: str) -> None:
    """Move a whole file to its place; where a repeated task finds the file of an earlier one, which has the same bytes, that one stays."""
    there = lambda: fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound
    if not there():
        try:
            fs.move(own, place)
            return
        except OSError:
            if not there():  # no other task was quicker
                raise
    fs.delete_file(own)


def write_token_files(docs: DataFrame, path: str, root: str, *, end_id: int, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Write docs (doc_id, text) below the URI root, on storage that all executors share.

    Returns one row per file: part, name, n_docs, n_tokens and start (ids of all
    files before it). Null texts are empty and have their end id only. A null
    doc_id comes first; rows of one doc_id follow each other by the hash of
    their texts, also from one file to the next. Texts of any length run on over
    as many sequences as they need. An empty table gives files without
    documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    write = partial(_write, path=path, end_id=end_id, root=root, length=length, rows=rows)
    files = ranged.mapInArrow(write, _SUMMARY).collect()  # a few bytes a file
    at, listed = 0, []
    for f in sorted(files, key=lambda f: f.part):
        listed.append((f.part, f.name, f.n_docs, f.n_tokens, at))
        at += f.n_tokens
    return spark.createDataFrame(listed, f"{_SUMMARY}, start long")


class SequenceFile:
    """Random access to the sequences of a token file, by its path (memory-mapped, no copies) or as an open pyarrow file.

    The first batch tells how many sequences and bytes a batch has; any other is
    then found at a multiple of that. Only batches that are asked for are read;
    the last one stays at hand.
    """

    def __init__(self, source: str | pa.NativeFile):
        self.source = pa.memory_map(source) if isinstance(source, str) else source
        self.schema = pa.ipc.read_schema(self.source)
        self.start = self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        self.at = 0
        self.batch = self._next()
        self.rows = self.batch.num_rows if self.batch else 0
        self.bytes = self.source.tell() - self.start
        self.reads = 1  # batches read so far

    def _next(self) -> pa.RecordBatch | None:
        try:
            return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        except EOFError:
            return None

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i; IndexError beyond the last."""
        at, row = divmod(i, self.rows) if self.rows and i >= 0 else (0, 0)
        if not self.rows or i < 0:
            raise IndexError(i)
        if at != self.at or self.batch is None:
            self.at, self.batch = at, None
            if self.start + at * self.bytes < self.source.size():
                self.source.seek(self.start + at * self.bytes)
                self.batch = self._next()
                self.reads += 1
        if self.batch is None or row >= self.batch.num_rows:
            raise IndexError(i)
        ids, mask = self.batch.columns
        return ids.values[row * self.length : (row + 1) * self.length].to_numpy(), mask.values[row * self.length : (row + 1) * self.length]

    def ids(self, start: int, size: int) -> np.ndarray:
        """Ids of the places start to start + size, counted through all sequences; a view where one sequence holds them."""
        parts = []
        while size > 0:
            i, at = divmod(start, self.length)
            parts.append(self.sequence(i)[0][at : at + size])
            start, size = start + len(parts[-1]), size - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint16), *parts])


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    for batch in batches:
        for name, before in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with fs.open_input_file(f"{base}/{name}.ids") as source, fs.open_input_stream(f"{base}/{name}.docs") as docs_source, pa.ipc.open_stream(docs_source) as index:
                sequences = SequenceFile(source)
                for docs in index:
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crcs = [zlib.crc32(sequences.ids(start, size).astype("<u4").tobytes()) for start, size in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + before), docs.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame, root: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids_crc32 of every document, from the files themselves.

    A file of no documents gives no rows.
    """
    n = max(1, files.count())
    listed = files.repartition(n, "name") if n > 1 else files
    return listed.mapInArrow(partial(_read, root=root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "tokens").root
    files = write_token_files(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), root, end_id=2)
    return read_token_files(files, root)
