"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Document statistics are standardised and mapped to cosines of random
projections, which approximate a Gaussian kernel. Each task sums its share of
the normal equations; the sums are merged in a tree and solved on the driver,
whose part has a fixed size. Raw scores of calibration rows are counted by bin
and pooled to a rising step function, read between the steps by a straight line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textvec import slices, windows
from tessera.llm.trees import SUMMARY, merged, summary
from tessera.session import Scratch, table

_KINDS = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": (0x20, *range(0x09, 0x0E)), "stop": b".,;:", "mark": b"!?", "symbol": b"#*$%&|<>", "tail": range(0x80, 0xC0), "lead": range(0xC0, 0x100)}
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
for _i, _of in enumerate(_KINDS.values()):
    _KIND[list(_of)] = _i
_N = len(_KINDS) + 1
STATISTICS = ("log_words", "mean_word", "upper", "digit", "stop", "mark", "symbol", "other", "foreign", "lines", "distinct", "repeat")
FEATURES, WIDTH, RIDGE, BINS, THRESHOLD = 256, 0.3, 1.0, 2048, 0.3


def _statistics(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, statistics) of each slice."""
    for part in slices(column):
        n = part.n
        kinds = np.bincount(part.doc_of_bytes() * _N + _KIND[part.data], minlength=n * _N).reshape(n, _N).astype(float)
        of = dict(zip([*_KINDS, "other"], kinds.T, strict=True))
        lines = np.bincount(part.doc_of_bytes()[part.data == 0x0A], minlength=n)
        doc, starts, ends = part.words()
        words = np.bincount(doc, minlength=n).astype(float)
        h = part.word_hashes(starts, ends, lower=True)
        wdoc, wh = windows(doc, h, 5)
        distinct, repeat = np.zeros(n), np.zeros(n)
        cut, wcut = np.searchsorted(doc, np.arange(n + 1)), np.searchsorted(wdoc, np.arange(n + 1))
        for i in np.flatnonzero(words):
            distinct[i] = len(np.unique(h[cut[i] : cut[i + 1]]))
            repeat[i] = 1 - len(np.unique(wh[wcut[i] : wcut[i + 1]])) / (wcut[i + 1] - wcut[i])
        chars = np.maximum(kinds.sum(axis=1) - of["space"] - of["tail"], 1)
        some = np.maximum(words, 1)
        yield part.first, np.column_stack([np.log1p(words), chars / some, of["upper"] / chars, of["digit"] / chars, of["stop"] / some, of["mark"] / some, of["symbol"] / some, of["other"] / some, of["lead"] / chars, lines / some, distinct / np.sqrt(some), repeat])


def _statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, x in _statistics(batch.column(1)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), lists], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (array<double>, in the order of STATISTICS) of every row of docs (doc_id, text); null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_statistic_batches, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, len(STATISTICS) + 1))
    for batch in batches:
        if batch.num_rows:
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("x"))])
            total += [x.sum(axis=0), (x * x).sum(axis=0)]
    yield summary(total.tobytes())


def _sum(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


class Kernel:
    """Standardisation and random projection; the same for one seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1)
        self.w = rng.normal(0, width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.ones(len(x)), np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))])


def _normal(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    n = len(kernel.b) + 1
    total = np.zeros((n + 1, n))
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            z, y = kernel(_matrix(part.column("x"))), part.column("label").to_numpy(zero_copy_only=False).astype(float)
            total[:n] += z.T @ z
            total[n] += z.T @ y
    yield summary(total.tobytes())


def isotonic(at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and rising values of the least-squares step function."""
    pools: list[list[float]] = []
    for a, y, w in zip(at, label, weight, strict=True):
        pools.append([a * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


@dataclass(frozen=True)
class Model:
    """A fitted scorer: kernel, ridge weights and the steps of the calibration."""

    kernel: Kernel
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = [self.kernel(x[at : at + 2048]) @ self.weights for at in range(0, len(x), 2048)]
        return np.clip(np.interp(np.concatenate([np.zeros(0), *raw]), *self.steps), 0, 1)


def fit(statistics: DataFrame, labels: DataFrame, scratch: Scratch, *, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 4) -> Model:
    """A model from document_statistics and labels (doc_id, quality); what it learns from is said in quality_scores."""
    marked = labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("label")).filter("labelled IS NOT NULL AND label IS NOT NULL")
    fold = crc32_of("doc_id") % 5
    known = scratch.write(statistics.join(marked, F.col("doc_id") == F.col("labelled")).select("x", "label", fold.alias("fold")).filter("fold <> 0"), "known")
    first, tune = known.filter("fold <> 4"), known.filter("fold = 4")
    blob = merged(first.select("x").mapInArrow(_moments, SUMMARY), _sum, scratch, "moments") or np.zeros((2, len(STATISTICS) + 1)).tobytes()
    total = np.frombuffer(blob).reshape(2, -1)
    n = total[0, 0]
    mean = total[0, 1:] / max(n, 1)
    kernel = Kernel(mean, np.sqrt(np.maximum(total[1, 1:] / max(n, 1) - mean**2, 0)), features, width, seed)
    if not n:
        return Model(kernel, np.zeros(features + 1), (np.array([-1.0, 2.0]), np.array([0.5, 0.5])))
    normal = first.select("x", "label").mapInArrow(partial(_normal, kernel=kernel), SUMMARY)
    sums = np.frombuffer(merged(normal, _sum, scratch, "normal")).reshape(-1, features + 1)
    penalty = ridge * np.eye(features + 1)
    penalty[0, 0] = 1e-6
    weights = np.linalg.solve(sums[:-1] + penalty, sums[-1])
    raw = tune.select("label", "x").mapInArrow(partial(_raw, kernel=kernel, weights=weights), "label double, score double")
    place = F.least(F.greatest(F.floor((F.col("score") + 1) / 3 * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = raw.groupBy(place.alias("bin")).agg(F.avg("score").alias("at"), F.avg("label").alias("label"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    steps = isotonic(*(np.array([r[c] for r in bins], dtype=float) for c in ("at", "label", "n"))) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return Model(kernel, weights, steps)


def _raw(batches: Iterator[pa.RecordBatch], kernel: Kernel, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kernel(_matrix(batch.column(1))) @ weights)], ["label", "score"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column("x"))))], ["doc_id", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model: Model, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.concatenate([np.zeros(0), *(model.score(x) for _, x in _statistics(batch.column(at)))])
        yield batch.filter(pa.array(score >= threshold))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier) and predicted of every row of docs (doc_id, text).

    labels (doc_id, quality: 1 good, 0 bad) are learned from where the remainder
    of crc32(doc_id as text) by 5 is not 0: the weights where it is 1 to 3, the
    calibration where it is 4. Nulls among labels and ids are left out. Null and
    empty texts are scored as texts without words; a null doc_id is scored and
    not held out. Repeated rows get equal scores. Without labels every score is
    0.5; other columns are ignored. Texts of any length count whole; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    x = scratch.write(document_statistics(docs), "statistics")
    model = fit(x, labels, scratch, **settings)
    kind = x.schema["doc_id"].dataType.simpleString()
    out = x.mapInArrow(partial(_scored, model=model), f"doc_id {kind}, score double")
    held = F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows of docs that quality_scores() predicts to be good, unchanged; no text is shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(document_statistics(docs), labels, scratch, **settings)
    return docs.mapInArrow(partial(_kept, model=model, threshold=threshold, at=docs.columns.index("text")), docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
