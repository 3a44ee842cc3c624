"""BPE encoding and decoding with content-defined chunk reuse.

A gear hash rolls over each text's bytes and cuts it where the hash's low bits
are zero, so equal passages of different documents fall into equal chunks. A
worker encodes a chunk once and takes its ids from a cache of whole chunks, of
bounded bytes, when it meets it again. Chunks are cut anywhere, so the tokens at
their joins are not yet those of the whole text: a join inside a piece (see
pieces.py) is repaired by re-encoding, from the last place before it to the
first place after it where pieces meet. There the ids of both sides agree with
those of the whole text whatever lies beyond, so the repair is exact, and each
character is re-encoded once at most: a run without white space over many chunks
is encoded as one when it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import PieceEncoder, id_type, public_path, tokenizer, worker_encoder
from tessera.session import table

CHUNK_BITS = 9  # a cut every 512 bytes on average, after the smallest size
SMALLEST = 128
CACHE_BYTES = 24 << 20  # of each of two generations of chunks

_GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)


def cuts(data: np.ndarray, bits: int = CHUNK_BITS, smallest: int = SMALLEST) -> list[int]:
    """Ends of the chunks of some bytes. The hash sees the 32 bytes before a place and nothing else."""
    if len(data) <= smallest:
        return [len(data)]
    h = _GEAR[data]
    for i in range(5):  # windows of 2, 4, 8, 16, 32 bytes
        w = 1 << i
        h[w:] = h[w:] + (h[:-w] << np.uint64(w)) if len(h) > w else h[w:]
    mask = np.uint64((1 << bits) - 1) << np.uint64(40 - bits)
    out, last = [], 0
    for at in np.flatnonzero((h & mask) == 0).tolist():
        # never inside a code point
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= smallest and at < len(data):
            out.append(at)
            last = at
    return [*out, len(data)]


class Chunk:
    """A chunk's first and last piece as text, and the ids of the pieces between them (None: there is one piece or none)."""

    __slots__ = ("first", "last", "between", "opens", "ends", "ids")

    def __init__(self, text: str, encoder: PieceEncoder):
        pieces = encoder.split(text)
        self.opens, self.ends = _blank(text[0]), _blank(text[-1])  # whether it begins and ends with white space
        self.first, self.last = (pieces[0], pieces[-1]) if pieces else ("", "")
        self.between = pieces[1:-1]  # until they have their ids
        self.ids = b"" if len(pieces) > 1 else None


def _blank(char: str) -> bool:
    return char.isspace() and not "\x1c" <= char <= "\x1f"


class ChunkEncoder:
    """Whole texts to ids, by chunks."""

    def __init__(self, path: str, chunk_bits: int = CHUNK_BITS, smallest: int = SMALLEST):
        t = tokenizer(path)
        self.bits, self.smallest = chunk_bits, smallest
        self.encoder = PieceEncoder(path)
        self.kind = self.encoder.kind
        self.glue = t.decoder is None  # decoding then joins the tokens by spaces
        names = t.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.token[i] = name
        self.young: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.held = 0
        self.reused = self.encoded = 0

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes, special tokens included."""
        if self.glue:
            return " ".join([self.token[i] for i in ids.tolist()])
        return tokenizer(self.encoder.path).decode(ids.tolist(), skip_special_tokens=False)

    def _known(self, key: bytes) -> Chunk | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self._keep(key, got)
        return got

    def _keep(self, key: bytes, chunk: Chunk) -> None:
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = chunk
        self.held += 500 + len(chunk.ids or b"")

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, dtype=self.kind)
        raw, new = text.encode("utf-8"), {}
        out: list[Chunk | int] = []  # chunks, and places in `joins`
        joins: list[str] = []  # whole pieces at the chunks' edges
        open_: list[str] = []  # what the last piece so far is made of
        blank, at = True, 0  # blank: whether the text so far ends with white space

        def close(*more: str) -> None:
            out.append(len(joins))
            joins.append("".join([*open_, *more]))
            open_.clear()

        for end in cuts(np.frombuffer(raw, dtype=np.uint8), self.bits, self.smallest):
            key = xxhash.xxh3_128_digest(raw[at:end])
            part = self._known(key) or new.get(key)
            if part is None:
                part = new[key] = Chunk(raw[at:end].decode("utf-8"), self.encoder)
                self.encoded += 1
            else:
                self.reused += 1
            at = end
            # White space belongs to the piece that follows it, or to none.
            if open_ and (not part.first or part.opens and not blank):
                close()
            blank = part.ends
            if part.ids is None:
                open_ += [part.first] * bool(part.first)
            else:
                close(part.first)
                out.append(part)
                open_.append(part.last)
            if self.encoder.words and blank and open_:
                close()
        if open_:
            close()
        whole = self._encode(joins, new)
        return np.frombuffer(b"".join([whole[x] if type(x) is int else x.ids for x in out]), dtype=self.kind)

    def _encode(self, joins: list[str], new: dict[bytes, Chunk]) -> list[bytes]:
        """Ids of the joins; the new chunks get theirs and are kept. All go to the library together."""
        todo = [*joins, *(p for chunk in new.values() for p in chunk.between)]
        values = self.encoder.values(todo)
        at = len(joins)
        for key, chunk in new.items():
            if chunk.ids is not None:
                chunk.ids = b"".join(values[at : at + len(chunk.between)])
                at += len(chunk.between)
            chunk.between = ()
            self._keep(key, chunk)
        return values[: len(joins)]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, bits: int, digests: bool) -> Iterator[pa.RecordBatch]:
    coder = worker_encoder(("bpe", path, bits), lambda: ChunkEncoder(path, bits))
    wide = np.dtype("<u4")
    for batch in batches:
        rows = []
        for text in batch.column(1):
            ids = coder.ids(text.as_py() or "").astype(wide)
            decoded = coder.decode(ids)
            if digests:
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
            else:
                rows.append((len(ids), ids.astype(np.int32), decoded))
        n, ids, decoded = ([r[i] for r in rows] for i in range(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids) if digests else pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, path: str, *, chunk_bits: int = CHUNK_BITS, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded text of every row of docs (doc_id, text).

    With digests, ids and decoded are lowercase hex SHA-256 of the ids as
    little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    Null and empty texts have no ids. Rows are independent of each other:
    repeated and null ids and further columns change nothing; an empty table
    gives no rows. Texts of any length are encoded whole, in time proportional
    to their length, also without white space. No column is shuffled.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    ids = "string" if digests else "array<int>"
    return texts.mapInArrow(partial(_encoded, path=path, bits=chunk_bits, digests=digests), f"doc_id {kind}, n_tokens long, ids {ids}, decoded string")


def digests(docs: DataFrame) -> DataFrame:
    out = encode(docs, public_path("word_bpe_49k.json"), digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
