"""Token counts by a two-tier map-side lookup.

Tier one is a compact table of the corpus's frequent pre-tokens and their token
lengths, broadcast to all workers; its size is bounded by `table_size` entries
of at most 64 characters. Tier two is each worker's bounded cache of rarer
pre-tokens. What is in neither is encoded by the tokenizers library. Pre-tokens
are the white-space words of word-end vocabularies and the space-led pieces of
byte-level ones (see pieces.py); none is ever shuffled: the frequent ones are
found by one bounded summary a task over the whole corpus, merged in a tree.

A sentencepiece .model is encoded text by text, as its library does: there
pieces may cross words.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import LONGEST, PieceEncoder, public_path, worker_encoder
from tessera.llm.trees import SUMMARY, merged, summary
from tessera.session import Scratch, table

TABLE_SIZE = 1 << 15


def _trim(counts: Counter, size: int) -> Counter:
    """Frequent-items summary: take off the count of the first entry that does not fit."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    off = top[-1][1]
    return Counter({k: v - off for k, v in top if v > off})


def _summaries(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    split = worker_encoder(("split", path), lambda: PieceEncoder(path, len)).split
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                pieces = split(text.as_py())
                if max(map(len, pieces), default=0) > LONGEST:  # those are never in the table
                    pieces = [p for p in pieces if len(p) <= LONGEST]
                counts.update(pieces)
                if len(counts) > 8 * size:
                    counts = _trim(counts, size)
    yield summary(pickle.dumps(_trim(counts, size)))


def _join(a: bytes, b: bytes, size: int) -> bytes:
    return pickle.dumps(_trim(pickle.loads(a) + pickle.loads(b), size))


def frequent_lengths(texts: DataFrame, path: str, size: int) -> dict[str, int]:
    """Token lengths of at most `size` frequent pre-tokens of column text, of at most LONGEST characters each."""
    blobs = texts.select("text").mapInArrow(partial(_summaries, path=path, size=size), SUMMARY)
    blob = merged(blobs, partial(_join, size=size), Scratch(texts.sparkSession, "counts"), "summaries")
    words = list(pickle.loads(blob)) if blob else []
    return dict(zip(words, PieceEncoder(path, lengths=True).encoded(words), strict=True))


def _counted(batches: Iterator[pa.RecordBatch], path: str, lengths) -> Iterator[pa.RecordBatch]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(model.encode(text))
    else:
        encoder = worker_encoder(("counts", path, lengths.id), lambda: PieceEncoder(path, lengths=True, limit=250_000, fixed=lengths.value))
        count = lambda text: sum(encoder.records(text))
    for batch in batches:
        n = [count(x.as_py()) if x.is_valid else 0 for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


class _Lengths:
    """A broadcast table and its number, by which workers tell tables apart."""

    def __init__(self, spark: SparkSession, lengths: dict[str, int]):
        held = spark.sparkContext.broadcast(lengths)
        self.id, self._held = (spark.sparkContext.applicationId, held._jbroadcast.id()), held

    @property
    def value(self) -> dict[str, int]:
        return self._held.value


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row of docs (doc_id, text).

    Null and empty texts have no bytes and no tokens. Rows are independent:
    repeated ids, null ids and other columns change nothing; an empty table
    gives no rows. Special strings in a text count as the library's default has
    it. Texts of any length count whole; a piece above LONGEST characters is
    neither in the table nor in a cache but encoded each time.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lengths = {} if path.endswith(".model") else frequent_lengths(texts, path, table_size)
    held = _Lengths(docs.sparkSession, lengths)
    rows = texts.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_counted, path=path, lengths=held), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
