"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of training texts.
A text is cut into blocks, each block is compressed with each dictionary, and
the language with the smallest sum of sizes wins. Where the smallest is not
smaller than the next by a margin, the text is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.classifier import crc32_of
from tessera.session import Scratch, table

# Bounds of the labelled sample that the dictionaries are fitted on; predictions have none.
LANGUAGES = 512  # those with most labelled rows are learned
SAMPLE = 400  # texts a language
SAMPLE_BYTES = 16 << 20  # of all languages together, in equal shares
LONGEST_SAMPLE = 1 << 16  # bytes of a text that may serve as a sample
DICTIONARY = 1 << 17  # bytes, at most; of all languages together DICTIONARY_BYTES
DICTIONARY_BYTES = 8 << 20

BLOCK = 4096  # characters that are compressed at a time
LEVEL = 9
MARGIN = 0.002
UNKNOWN = "und"

# Python's isalpha is true of the categories L. One set of characters below U+10000 without classes is quick to search.
_OTHER = re.compile("[" + "".join(re.escape(c) for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if not c.isalpha()) + "]+")
_HIGH = re.compile("[\U00010000-\U0010ffff]")


def letters(text: str) -> str:
    """Lower-cased runs of letters (Unicode categories L), one blank between."""
    text = text.lower()
    if len(text.encode("utf-16-le")) > 2 * len(text):
        text = _HIGH.sub(lambda m: m[0] if m[0].isalpha() else " ", text)
    return _OTHER.sub(" ", text).strip()


def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(contents)
        self.coders = [_coder(contents[name], level) for name in self.names]

    def sizes(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.coders))
        for at in range(0, len(text), BLOCK):
            raw = f" {text[at : at + BLOCK]} ".encode()
            total += [len(c.compress(raw)) for c in self.coders]
        return total

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        words = letters(text) if text else ""
        if not words or not self.coders:
            return UNKNOWN, 0.0, True
        size = self.sizes(words)
        best = int(size.argmin())
        scale = 1.0 + 0.01 * size[best]
        score = float(1 / np.exp((size[best] - size) / scale).sum())
        next_best = np.partition(size, 1)[1] if len(size) > 1 else np.inf
        return self.names[best], score, bool(next_best - size[best] < margin * size[best])


def samples(docs: DataFrame, sample: int, scratch: Scratch) -> dict[str, list[str]]:
    """Words of some texts by language, from columns doc_id, text and lang of training rows; in order of a hash.

    At most LANGUAGES languages, `sample` texts and an equal share of
    SAMPLE_BYTES of each, in texts of at most LONGEST_SAMPLE bytes: what comes
    to the driver has a fixed size. Rows are drawn by the hash of doc_id and
    text, some more than needed, and cut to the bounds by language.
    """
    fit = docs.filter(f"lang IS NOT NULL AND octet_length(text) BETWEEN 1 AND {LONGEST_SAMPLE}")
    fit = fit.select("lang", "text", (F.xxhash64("doc_id", "text").cast("double") / float(1 << 64) + 0.5).alias("u"))
    counts = fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    counts = scratch.write(counts.orderBy(F.col("n").desc(), "lang").limit(LANGUAGES), "languages")
    share = SAMPLE_BYTES // max(1, counts.count())
    odds = F.least(F.lit(1.0), F.greatest(F.lit(8.0) / F.col("n"), F.least(F.lit(1.5 * sample) / F.col("n"), F.lit(1.5 * share) / F.col("bytes"))))
    drawn = fit.join(F.broadcast(counts.select("lang", odds.alias("odds"))), "lang").filter("u <= odds").drop("odds")
    order = Window.partitionBy("lang").orderBy("u", "text")
    drawn = drawn.withColumns({"rank": F.row_number().over(order), "before": F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    texts: dict[str, list[str]] = {}
    for r in sorted(drawn.filter((F.col("rank") <= sample) & ((F.col("before") <= share) | (F.col("rank") == 1))).collect(), key=lambda r: (r.lang, r.rank)):
        if words := letters(r.text):
            texts.setdefault(r.lang, []).append(words)
    return texts


def dictionaries(texts: dict[str, list[str]], *, rounds: int = 2, level: int = LEVEL) -> dict[str, bytes]:
    """Dictionary content by language.

    Samples that the dictionaries of a round give to another language are left
    out in the next, so a few wrong labels do no harm.
    """
    kept, contents = texts, {}
    size = min(DICTIONARY, DICTIONARY_BYTES // max(1, len(texts)))
    for at in range(rounds):
        contents = {k: _content(v, size) for k, v in kept.items()}
        if at < rounds - 1 and len(contents) > 1:
            # every other text is judged without having been in the dictionary
            odd = Classifier({k: _content(v[1::2] or v, size) for k, v in kept.items()}, level)
            even = Classifier({k: _content(v[::2] or v, size) for k, v in kept.items()}, level)
            good = {k: [t for i, t in enumerate(v) if (odd, even)[i % 2].names[int((odd, even)[i % 2].sizes(t).argmin())] == k] for k, v in texts.items()}
            kept = {k: good[k] or texts[k] for k in texts}
    return contents


def _content(texts: list[str], limit: int = DICTIONARY) -> bytes:
    """Samples in turn up to the size of a dictionary; those first in order stand last, nearest to the text."""
    out, size = [], 0
    for t in texts:
        raw = t.encode()
        if out and size + len(raw) > limit:
            continue
        out.append(raw)
        size += len(raw)
    return b" ".join(reversed(out))[-limit:]


def _fold():
    return crc32_of("doc_id") % 4


_CODERS: dict[tuple, Classifier] = {}


class _Model:
    """Dictionaries learned from docs, as a broadcast; each worker makes its coders once."""

    def __init__(self, docs: DataFrame, margin: float, level: int, sample: int):
        spark = docs.sparkSession
        known = docs.filter(_fold() != 2).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        self.held = spark.sparkContext.broadcast(dictionaries(samples(known, sample, Scratch(spark, "language")), level=level))
        self.key = (spark.sparkContext.applicationId, self.held._jbroadcast.id())
        self.margin, self.level = margin, level

    def judge(self, column: pa.Array) -> list[tuple[str, float, bool]]:
        if self.key not in _CODERS:
            _CODERS.clear()
            _CODERS[self.key] = Classifier(self.held.value, self.level)
        return [_CODERS[self.key].judge(x.as_py(), self.margin) for x in column]


def _judged(batches: Iterator[pa.RecordBatch], model: _Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, scores, rejected = zip(*model.judge(batch.column(1)), strict=True) if batch.num_rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])


def _kept(batches: Iterator[pa.RecordBatch], model: _Model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not r for _, _, r in model.judge(batch.column(at))], pa.bool_()))


def identify(docs: DataFrame, *, margin: float = MARGIN, level: int = LEVEL, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of docs (doc_id, text, lang).

    Learns only from rows whose crc32(doc_id as text) mod 4 is not 2 and whose
    lang and text are not null. lang_pred is a learned language; `und`, rejected,
    where the text is null or has no letter, or nothing could be learned. score:
    share of the best language when sizes are read as log-likelihoods. rejected:
    the next language's size is within `margin` of the smallest. A null doc_id is
    neither learned from nor held out. Repeated rows get equal answers; other
    columns are ignored. Texts of any length are compressed whole, in blocks; an
    empty table gives no rows. Ties of sizes go to the first language by name.
    """
    model = _Model(docs, margin, level, sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = texts.mapInArrow(partial(_judged, model=model), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def identified(docs: DataFrame, *, margin: float = MARGIN, level: int = LEVEL, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that identify() does not reject, unchanged; no column is shuffled."""
    return docs.mapInArrow(partial(_kept, model=_Model(docs, margin, level, sample), at=docs.columns.index("text")), docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
