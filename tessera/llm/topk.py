"""Exact top-k search by inner product over an impact-ordered index.

Vectors are held as integers, floor(1024 x) of each component. The index is a
written table of blocks. A task packs its vectors in blocks, by falling norm,
and inverts each: postings (row, value) by dimension, cut into segments by
quantised impact, that is by the size of the value on a geometric scale. A block
whose norms prove that no pair reaches the score that a member needs is passed
over. Else its segments are processed by falling impact for a block of queries
at once, each adding its exact products to the accumulators. After a level a
pair can still gain what the rest of its vector allows: at most |q| |rest|
(Cauchy and Schwarz), and at most the level's largest value times the sum of
|q|. When that proves so many pairs to stay below the needed score that scoring
the others exactly takes less work than the postings that are left, processing
stops and they are scored. Nothing is approximate.

The needed score starts from some rows of the vectors and rises with each
block. Queries go out in broadcasts of bounded size, one pass over the vectors
each, so their number is not bounded by memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, table

ROWS = 2048  # vectors a block
SORTED = 1 << 15  # vectors that a task sorts by norm at a time
QUERY_BLOCK = 256
QUERY_BYTES = 16 << 20  # of one broadcast
PEERS = 1024  # rows of vectors that the first bound is taken from
LEVELS, STEP = 14, 0.82
RESCORE = 3.0  # work of scoring a pair exactly, in that of processing the postings of a vector
NONE = np.iinfo(np.int64).min
LIMIT = float(1 << 62)  # of products of norms: sums of products then fit 64 bits
_INDEX = "width int, ids binary, kind string, v binary, level binary, top double, norm double"


def vectors_of(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v (array<long>) of the rows that take part: no nulls, all components finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


class Block:
    """Impact-ordered postings of some vectors of one length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, level: np.ndarray | None = None):
        self.ids, self.v = ids, v
        size = np.abs(v.astype(float))
        self.top = float(size.max(initial=0))
        self.bounds = [self.top * STEP**i for i in range(LEVELS)] + [0.0]
        # level i holds sizes in (bounds[i + 1], bounds[i]]
        self.level = LEVELS - 1 - np.searchsorted(self.bounds[-2:0:-1], size).astype(np.int8) if level is None else level
        self.level[size == 0] = -1
        self.square = size**2
        self.norm = float(np.sqrt(self.square.sum(axis=1).max(initial=0)))
        self.seen = self.all = 0  # postings processed, rescored vectors counting whole; postings times queries

    @staticmethod
    def packed(ids: np.ndarray, v: np.ndarray) -> dict:
        """A row of the index table."""
        made = Block(ids, v)
        kind = next(k for k in ("<i2", "<i4", "<i8") if -np.iinfo(k).max <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(k).max or k == "<i8")
        return {"width": v.shape[1], "ids": ids.astype("<i8").tobytes(), "kind": kind, "v": v.astype(kind).tobytes(), "level": made.level.tobytes(), "top": made.top, "norm": made.norm}

    @staticmethod
    def unpacked(row: dict) -> Block:
        ids = np.frombuffer(row["ids"], dtype="<i8")
        shape = (len(ids), row["width"])
        return Block(ids, np.frombuffer(row["v"], dtype=row["kind"]).reshape(shape).astype(np.int64), np.frombuffer(row["level"], dtype=np.int8).reshape(shape).copy())

    def members(self, queries: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of every pair whose score is at least what its query needs."""
        norm = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        if self.norm * norm.max(initial=0) >= LIMIT:
            raise OverflowError("components are too large for inner products of 64 bits")
        counts = np.bincount(self.level.reshape(-1) + 1, minlength=LEVELS + 1)[1:]
        self.all += int(counts.sum()) * len(queries)
        able = np.flatnonzero(self.norm * norm * (1 + 1e-9) + 1 >= need)  # the others need more than the largest vector can give
        if not len(able):
            return able, able, able
        if len(able) < len(queries):
            query, row, score = self._members(queries[able], need[able], norm[able], counts)
            return able[query], row, score
        return self._members(queries, need, norm, counts)

    def _members(self, queries: np.ndarray, need: np.ndarray, norm: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = np.zeros((len(self.ids), len(queries)), dtype=np.int64)
        mass = np.abs(queries).sum(axis=1)
        columns = np.ascontiguousarray(queries.T)
        every = max(1, int(counts.sum()))
        left = int(counts.sum())
        for i in range(LEVELS):
            at = self.level == i
            for d in np.flatnonzero(at.any(axis=0)):  # a segment: the postings of a dimension on this level
                rows = np.flatnonzero(at[:, d])
                total[rows] += self.v[rows, d][:, None] * columns[d][None, :]
            self.seen += int(counts[i]) * len(queries)
            left -= int(counts[i])
            if not left:
                break
            if left > every / 2 or not counts[i]:
                continue
            rest = np.sqrt(np.where(self.level > i, self.square, 0).sum(axis=1))
            gain = np.minimum(rest[:, None] * norm[None, :], self.bounds[i + 1] * mass[None, :]) * (1 + 1e-9) + 1
            open_ = total + gain >= need[None, :]
            if open_.mean() * RESCORE <= left / every:
                row, query = np.nonzero(open_)
                self.seen += len(row) * (every // max(1, len(self.ids)))
                score = np.einsum("ij,ij->i", self.v[row], queries[query])
                hit = score >= need[query]
                return query[hit], row[hit], score[hit]
        row, query = np.nonzero(total >= need[None, :])
        return query, row, total[row, query]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def blocks(width: int) -> Iterator[pa.RecordBatch]:
        ids, v = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
        order = np.argsort(-(v.astype(float) ** 2).sum(axis=1), kind="stable")
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            yield pa.RecordBatch.from_pylist([Block.packed(ids[some], v[some])], schema=_INDEX_SCHEMA)

    for batch in batches:
        lists = batch.column(1)
        starts, size = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
        flat, ids = lists.values.to_numpy(), batch.column(0).to_numpy()
        for width in np.unique(size).tolist():
            rows = np.flatnonzero(size == width)
            held.setdefault(width, []).append((ids[rows], flat[starts[rows][:, None] + np.arange(width)]))
            if sum(len(x[0]) for x in held[width]) >= SORTED:
                yield from blocks(width)
    for width in list(held):
        yield from blocks(width)


_INDEX_SCHEMA = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("v", pa.binary()), ("level", pa.binary()), ("top", pa.float64()), ("norm", pa.float64())])


def index_of(vectors: DataFrame) -> DataFrame:
    """The blocks of vectors (vec_id, v), a row each."""
    return vectors.mapInArrow(_index, _INDEX)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids, and their ranks."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.concatenate(([True], q[1:] != q[:-1]))[: len(q)]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, dtype=int)
    top = rank < k
    return q[top], ids[top], score[top], rank[top]


def _search(batches: Iterator[pa.RecordBatch], held, k: int) -> Iterator[pa.RecordBatch]:
    query_ids, groups, need = held.value  # groups: by length, the places and the matrix of its queries
    need = need.copy()
    found = [np.zeros(0, dtype=np.int64)] * 3
    for batch in batches:
        for packed in batch.to_pylist():
            if packed["width"] not in groups:
                continue
            places, matrix = groups[packed["width"]]
            block = Block.unpacked(packed)
            for a in range(0, len(places), QUERY_BLOCK):
                part = places[a : a + QUERY_BLOCK]
                q, row, score = block.members(matrix[a : a + QUERY_BLOCK], need[part])
                q, row = part[q], block.ids[row]
                other = query_ids[q] != row
                found = [np.concatenate(x) for x in zip(found, (q[other], row[other], score[other]), strict=True)]
            q, row, score, rank = _best(*found, k)
            found = [q, row, score]
            full = rank == k - 1
            need[q[full]] = np.maximum(need[q[full]], score[full])
    q, row, score = found
    yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(row), pa.array(score)], ["query_id", "vec_id", "score"])


def _needed(places: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, need: np.ndarray, peer_ids: np.ndarray, peers: np.ndarray) -> None:
    """Scores that the queries reach with some rows of the vectors (peers): the k-th best is needed at least."""
    if len(peers) <= k:
        return
    for a in range(0, len(places), QUERY_BLOCK):
        score = matrix[a : a + QUERY_BLOCK] @ peers.T
        score[ids[places[a : a + QUERY_BLOCK]][:, None] == peer_ids[None, :]] = NONE
        need[places[a : a + QUERY_BLOCK]] = np.partition(score, len(peers) - k, axis=1)[:, len(peers) - k]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of vectors for each row of queries (both vec_id, v).

    Inner products of integers; where norms are so large that one might not fit
    64 bits, OverflowError is raised. Ties go to the smaller vec_id. Rows with a query's own vec_id are no candidates for it; of repeated
    query ids the least vector is searched for, repeated candidate rows all
    count. Only vectors of the query's length are candidates. Fewer candidates
    give fewer rows, no queries or vectors none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    asked = scratch.write(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    passes = max(1, -(-size // query_bytes))
    parts = []
    first: dict[int, list] = {}  # by length
    for r in vectors.limit(PEERS).collect():
        first.setdefault(len(r.v), []).append(r)
    index = scratch.write(index_of(vectors), "index")
    for i in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).collect()  # about query_bytes
        ids = np.array([r.vec_id for r in some], dtype=np.int64)
        need = np.full(len(ids), NONE)
        by_width: dict[int, list[int]] = {}
        for place, r in enumerate(some):
            by_width.setdefault(len(r.v), []).append(place)
        groups = {w: (np.array(p), np.array([some[x].v for x in p], dtype=np.int64).reshape(len(p), w)) for w, p in by_width.items()}
        for w, (places, matrix) in groups.items():
            peers = first.get(w, [])
            _needed(places, ids, matrix, k, need, np.array([r.vec_id for r in peers], dtype=np.int64), np.array([r.v for r in peers], dtype=np.int64).reshape(len(peers), w))
        held = spark.sparkContext.broadcast((ids, groups, need))
        found = index.mapInArrow(partial(_search, held=held, k=k), "query_id long, vec_id long, score long")
        if passes > 1:
            found = scratch.write(found, f"found{i}")
            held.destroy()
        parts.append(found)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP9_SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
