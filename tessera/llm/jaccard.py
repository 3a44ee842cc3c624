"""N-gram Jaccard join by parity sketches.

Each document's set of k-word shingles is dealt into m segments by the high bits
of the shingle hashes. In a segment every shingle flips one bit of a 64-bit
parity word, so the Hamming distance of two sketches never exceeds the sets'
symmetric difference. Sets of one size band that reach the similarity differ in
at most d shingles; with m = d + 2 segments at least two segments are untouched
and equal (pigeonhole), and documents that share a segment are candidates. A
segment's key also carries the XOR of its shingle hashes, which keeps segments
of few shingles apart. Segments without shingles say little: two of them together
are a key, and only of documents with so many that all their filled ones can be
touched.

Equal sets are one class from the start. Candidates first meet the most central
member of each bucket; buckets whose members are then still in several
components are compared by Hamming distance, in blocks, but for pairs within the
component that most members are in. Buckets that hold the same sets are compared
once, and by sketches of one word for SEGMENTS_A_WORD segments. Every pair that survives is verified on the sets. Nothing is capped, so no
component is torn. Then the links inside each component are counted, by
comparing the sets of all its members in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.mixing import free_name
from tessera.llm.textvec import mix, slices, windows
from tessera.session import Scratch

BLOCK = 1024  # sets that are compared with each other in one task at a time
BLOCK_SHINGLES = 1 << 20
FILTER_BITS = 1 << 29  # at most, of the broadcast filter of representatives: 64 MB
BITS_EACH = 16
PAGE = 1 << 15  # bits of one of Spark's bitmaps
SEGMENTS_A_WORD = 8  # a sketch for comparison then has some 8 bits for each shingle that a linked pair may differ in
_KEYS = "doc_id long, n_shingles long, h1 long, h2 long, own_keys array<long>, prev_keys array<long>"
_SETS = "doc_id long, n_shingles long, shingles array<long>, own array<long>, prev array<long>"


class Bands:
    """Size bands and segment counts for a similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        lo = [1]
        while lo[-1] < 1 << 40:
            lo.append(lo[-1] * den // num + 1)
        self.lo = np.array(lo, dtype=np.int64)
        # largest symmetric difference of a linked pair whose smaller set has a elements: a * (den - num) / num
        most = (self.lo[1:] - 1) * (den - num) // num
        self.segments = np.where(most > 0, most + 2, 0)  # 0: only equal sets link

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, sizes, side="right") - 1

    def most_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of a linked pair of these sizes."""
        total = a + b
        return total - 2 * -(-(self.num * total) // (self.num + self.den))

    def partner_apart(self, sizes: np.ndarray, level: np.ndarray, larger: bool) -> np.ndarray:
        """Bound of the symmetric difference with any linked partner on this level; larger: the sets are of the band above it.

        The difference is at most (den - num) / num of the smaller set and (den - num) / (den + num) of both sizes together.
        """
        if larger:
            return (sizes + self.lo[level + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        return sizes * (self.den - self.num) // self.num


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, shingle hashes sorted within each document) of each slice."""
    for part in slices(column):
        doc, starts, ends = part.words()
        doc, h = windows(doc, part.word_hashes(starts, ends, lower=True), k)
        cut = np.searchsorted(doc, np.arange(part.n + 1))
        for i in range(part.n):
            h[cut[i] : cut[i + 1]].sort()
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
        h, doc = h[new], doc[new]
        yield part.first, np.bincount(doc, minlength=part.n), h


def _sketch(sizes: np.ndarray, h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, parity words, XOR words) with m[i] segments for document i."""
    offsets = np.concatenate(([0], np.cumsum(m)))
    parity, xor = np.zeros(offsets[-1], dtype=np.uint64), np.zeros(offsets[-1], dtype=np.uint64)
    per = np.repeat(m, sizes).astype(np.uint64)
    used = per > 0
    segment = ((h >> np.uint64(32)) * per) >> np.uint64(32)
    at = np.repeat(offsets[:-1], sizes) + segment.astype(np.int64)
    at, h = at[used], h[used]
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        parity[at[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), first)
        xor[at[first]] = np.bitwise_xor.reduceat(mix(h), first)
    return offsets, parity, xor


def _segment_keys(offsets: np.ndarray, parity: np.ndarray, xor: np.ndarray, band: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, keys) of documents whose linked partners differ in at most most[i] shingles."""
    m = np.diff(offsets)
    doc = np.repeat(np.arange(len(m)), m)
    place = (np.arange(offsets[-1]) - offsets[:-1][doc]).astype(np.uint64)
    empty = (parity == 0) & (xor == 0)
    of = lambda content, where, doc: mix(mix(content) + mix(where * np.uint64(2654435761) + band[doc].astype(np.uint64) + np.uint64(1)))
    key, owner = [of(mix(xor) + parity, place, doc)[~empty]], [doc[~empty]]
    # With fewer empty segments some filled one is untouched. Otherwise two empty ones may be all that is untouched.
    count = np.bincount(doc[empty], minlength=len(m))
    for i in np.flatnonzero((count >= np.maximum(m - most, 2)) & (m > 0)):
        at = place[offsets[i] : offsets[i + 1]][empty[offsets[i] : offsets[i + 1]]]
        first, second = np.triu_indices(len(at), 1)
        owner.append(np.full(len(first), i))
        key.append(of(at[first] + np.uint64(1), at[second], owner[-1]))
    owner, key = np.concatenate(owner), np.concatenate(key)
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(m))))), key[np.argsort(owner, kind="stable")]


def _key_batches(batches: Iterator[pa.RecordBatch], bands: Bands, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sizes, h in _sets(batch.column(1), k):
            n = len(sizes)
            cut = np.concatenate(([0], np.cumsum(sizes)))
            full = np.flatnonzero(sizes)
            h1, h2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
            if len(full):
                h1[full] = np.add.reduceat(mix(h + np.uint64(11)), cut[full])
                h2[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), cut[full])
            band = bands.of(np.maximum(sizes, 1))
            columns = []
            for shift in (0, 1):
                level = np.maximum(band - shift, 0)
                m = np.where((sizes > 0) & (band >= shift), bands.segments[level], 0)
                most = bands.partner_apart(sizes, level, bool(shift))
                columns.append(_lists(*_segment_keys(*_sketch(sizes, h, m), level, most)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *columns], ["doc_id", "n_shingles", "h1", "h2", "own_keys", "prev_keys"])


class Bitmap:
    """A broadcast set of places, BITS_EACH bits for each that is in it; None from `of` where it would exceed FILTER_BITS."""

    def __init__(self, size: int, places: DataFrame):
        bits = np.zeros((size // PAGE, PAGE // 8), dtype=np.uint8)
        at = places.select((F.col("place") + 1).alias("at"))  # Spark's buckets and positions start from 1
        for r in at.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
            bits[r.page - 1] = np.frombuffer(r.bits, dtype=np.uint8)
        self.size, self.held = size, places.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    @staticmethod
    def of(rows: DataFrame, hashed: Column) -> Bitmap | None:
        n = rows.count()
        if n * BITS_EACH > FILTER_BITS:
            return None
        size = max(PAGE, 1 << (max(1, n * BITS_EACH) - 1).bit_length())
        return Bitmap(size, rows.select(F.pmod(hashed, F.lit(size)).alias("place")))

    def has(self, hashed: np.ndarray) -> np.ndarray:
        at = hashed & (self.size - 1)
        return ((self.held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _met(batches: Iterator[pa.RecordBatch], wanted: Bitmap | None) -> Iterator[pa.RecordBatch]:
    """(h1, key, own) of the keys that may be wanted."""
    for batch in batches:
        for own in (True, False):
            lists = batch.column("own_keys" if own else "prev_keys")
            key, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            if wanted is not None:
                hit = wanted.has(key)
                key, row = key[hit], row[hit]
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(pa.array(row)), pa.array(key), pa.array(np.full(len(key), own))], ["h1", "key", "own"])


def _set_batches(batches: Iterator[pa.RecordBatch], wanted: Bitmap | None, bands: Bands, k: int) -> Iterator[pa.RecordBatch]:
    """Sets and sketches of all rows, or of those whose hashed id, the third column, is wanted and of a few more."""
    for batch in batches:
        if wanted is not None:
            batch = batch.filter(pa.array(wanted.has(batch.column(2).to_numpy())))
        for first, sizes, h in _sets(batch.column(1), k):
            n = len(sizes)
            band = bands.of(np.maximum(sizes, 1))
            columns = []
            for shift in (0, 1):
                m = np.where((sizes > 0) & (band >= shift), bands.segments[np.maximum(band - shift, 0)], 0)
                offsets, parity, _ = _sketch(sizes, h, -(-m // SEGMENTS_A_WORD))
                columns.append(_lists(offsets, parity))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sizes), _lists(np.concatenate(([0], np.cumsum(sizes))), h), *columns], ["doc_id", "n_shingles", "shingles", "own", "prev"])


def _sets_of(texts: DataFrame, ids: DataFrame, bands: Bands, k: int) -> DataFrame:
    """Sets and sketches of the texts whose doc_id is in ids (rep), and of a few more where a bitmap of the ids goes out; else by a join."""
    wanted = Bitmap.of(ids, F.xxhash64("rep"))
    texts = texts.filter("doc_id IS NOT NULL").withColumn("hash", F.xxhash64("doc_id"))
    if wanted is None:
        texts = texts.join(ids, F.col("doc_id") == F.col("rep"), "left_semi")
    return texts.mapInArrow(partial(_set_batches, wanted=wanted, bands=bands, k=k), _SETS)


def _cells(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What work makes of whole cells (block pairs) and their first rows; rows come sorted by (key, i, j)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        both = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
        if not both:
            continue
        new = _changes(both[0])
        if len(new) > 1:
            yield work(both[0].slice(0, new[-1]), new[:-1])
        held = [both[0].slice(new[-1])]
    if held:
        yield work(held[0], _changes(held[0]))


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """First rows of the cells."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for c in ("key", "i", "j"):
        x = batch.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _near(batch: pa.RecordBatch, firsts: np.ndarray, bands: Bands) -> pa.RecordBatch:
    """Pairs of each cell whose sketches are near enough and whose components differ."""
    i, j, block, rep, label, size = (batch.column(c).to_numpy() for c in ("i", "j", "block", "rep", "label", "n_shingles"))
    lists = batch.column("sketch")
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    found = [np.zeros((2, 0), dtype=np.int64)]
    for a, b in zip(firsts, [*firsts[1:], batch.num_rows], strict=True):
        rows = np.arange(a, b)
        width = np.diff(at[a : b + 1])
        if (width != width[0]).any():  # two keys that are equal by chance
            lone = np.bincount(width)[width] == 1
            width, rows = width[~lone], rows[~lone]
        for w in np.unique(width):
            some = rows[width == w]
            if (label[some] == label[some[0]]).all():
                continue
            sketch = flat[at[some][:, None] + np.arange(w)]
            same = i[a] == j[a]
            left, right = (np.arange(len(some)),) * 2 if same else (np.flatnonzero(block[some] == i[a]), np.flatnonzero(block[some] == j[a]))
            found += [rep[some[p]] for p in _within(sketch, label[some], size[some], left, right, same, bands)]
    found = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found.max(axis=0)), pa.array(found.min(axis=0))], ["a", "b"])


def _within(sketch: np.ndarray, label: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, bands: Bands) -> Iterator[np.ndarray]:
    """Pairs (2, n) of rows of left and right with different labels, sizes that may link and sketches near enough."""
    if len(right):
        step = max(1, (1 << 18) // len(right))
        for x in range(0, len(left), step):
            some = left[x : x + step]
            p, q = size[some][:, None], size[right][None, :]
            near = (label[some][:, None] != label[right][None, :]) & (np.minimum(p, q) * bands.den >= np.maximum(p, q) * bands.num)
            if same:
                near &= some[:, None] < right[None, :]
            p, q = np.nonzero(near)
            p, q = some[p], right[q]
            chunk = max(1, (1 << 18) // max(1, sketch.shape[1]))
            for y in range(0, len(p), chunk):
                u, v = p[y : y + chunk], q[y : y + chunk]
                apart = np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1, dtype=np.int64)
                hit = apart <= bands.most_apart(size[u], size[v])
                if hit.any():
                    yield np.stack((u[hit], v[hit]))


def _degrees(batch: pa.RecordBatch, firsts: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """Number of links of each row inside its cell, by the sets."""
    i, j, block, rep = (batch.column(c).to_numpy() for c in ("i", "j", "block", "rep"))
    lists = batch.column("shingles")
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    degree = np.zeros(batch.num_rows, dtype=np.int64)
    for a, b in zip(firsts, [*firsts[1:], batch.num_rows], strict=True):
        size = np.diff(at[a : b + 1]).astype(np.int64)
        rows, same = np.arange(b - a), i[a] == j[a]
        left, right = (rows, rows) if same else (rows[block[a:b] == i[a]], rows[block[a:b] == j[a]])
        if b - a < 2 or not len(left) or not len(right):
            continue
        _, code, n = np.unique(flat[at[a] : at[b]], return_inverse=True, return_counts=True)
        owner, shared = np.repeat(rows, size), n[code] > 1  # shingles of one row only are in no intersection
        owner, code = owner[shared], (np.cumsum(n > 1) - 1)[code[shared]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        both = np.zeros((len(left), len(right)))
        for x in range(0, int(code[-1]) + 1 if len(code) else 0, 1024):
            some = slice(*np.searchsorted(code, (x, x + 1024)))
            has = np.zeros((b - a, 1024), dtype=np.float32)
            has[owner[some], code[some] - x] = 1
            both += has[left] @ has[right].T
        linked = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
        else:
            degree[a + right] += linked.sum(axis=0)
        degree[a + left] += linked.sum(axis=1)
    some = np.flatnonzero(degree)
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(degree[some])], ["rep", "n"])


def _link_counts(roots: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(rep, n_links) of every member of a component.

    All links are inside components. A component of two is one link; in larger
    ones every two members are compared on their sets once, in blocks of at most
    about BLOCK sets and BLOCK_SHINGLES shingles. Pairs are counted in the tasks
    and never become rows.
    """
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    nodes = scratch.write(nodes.join(sets.select(F.col("doc_id").alias("node"), "n_shingles"), "node"), "nodes")
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    sizes = scratch.write(sizes.select("root", "c", _blocks(F.col("c"), F.col("s")).alias("g")), "sizes")
    large = nodes.join(sizes.filter("c > 2"), "root").select(F.col("root").alias("key"), F.col("node").alias("rep"), "g")
    large = _in_blocks(large, "rep").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    large = large.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    counted = large.mapInArrow(partial(_cells, work=partial(_degrees, num=num, den=den)), "rep long, n long")
    two = nodes.join(sizes.filter("c = 2"), "root").select(F.col("node").alias("rep"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(two).groupBy("rep").agg(F.sum("n").alias("n_links"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.filter(f"{den} * n >= {num} * (size(sa) + size(sb) - n)").select("a", "b")


def _blocks(count, shingles):
    """Number of blocks of at most about BLOCK sets and BLOCK_SHINGLES shingles."""
    return F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _once(members: DataFrame) -> DataFrame:
    """The members of one bucket of those that hold the same sets; buckets of one set go.

    The same sets have the same candidates, whichever segment they share.
    """
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *(F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in range(2)))
    return members.join(held.filter("c > 1").groupBy("c", "x0", "x1").agg(F.min("key").alias("key")), "key", "left_semi")


def _open(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of the buckets with several labels, each with its bucket's plan.

    top: the label with most members; g and h: numbers of blocks of the others
    and of its own members; one: whether all are one block. Members of top need
    no comparison with each other.
    """
    met = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rows = scratch.write(rows.join(met, "key", "left_semi"), name)
    labels = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    plan = labels.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    plan = plan.select("key", F.col("top.label").alias("top"), _blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("g"), _blocks(F.col("top.c"), F.col("top.s")).alias("h"), (_blocks(F.col("c"), F.col("s")) == 1).alias("one"))
    return rows.join(plan, "key")


def _in_cells(rows: DataFrame) -> DataFrame:
    """rows of _open with block, i and j: blocks 0 to g - 1 hold the other labels, g to g + h - 1 the label top.

    Each block of others meets every block, so while those are one block a
    bucket's copies are in proportion to its members.
    """
    top, of = F.col("label") == F.col("top"), lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    block = F.when(F.col("one"), 0).when(top, F.col("g") + of("h")).otherwise(of("g")).cast("int")
    last = F.when(F.col("one"), 0).when(top, F.col("g") - 1).otherwise(F.col("g") + F.col("h") - 1)
    rows = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "g", "h", "top", "one")


def _in_blocks(rows: DataFrame, node: str) -> DataFrame:
    """rows with block, the block of the node, and i <= j, the two blocks of the cell that a copy of the row is for."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(node), F.col("g")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "g")


def similar_groups(docs: DataFrame, *, k: int = 3, num: int = 9, den: int = 10, label: str = "jaccard", count_links: bool = True) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of num/den or more.

    Takes columns doc_id and text; others are ignored. Words are split at ASCII
    white space after lower-casing A-Z; shingles count once per text. Returns
    doc_id, n_shingles, component_id (smallest doc_id reachable, itself
    included), set_id (smallest doc_id with the same set) and n_links (number
    of other classes of equal sets linked with this one, all of them; null if not count_links). Null or empty texts
    have no shingles and stand alone. Repeated rows give repeated results; a null
    doc_id keeps its row with its set's component, or null where it stands alone.
    Of different texts with one doc_id each is in a component, but only one of
    them is compared. Texts of any length are taken whole; an empty table gives
    no rows.
    """
    spark: SparkSession = docs.sparkSession
    bands, scratch = Bands(num, den), Scratch(spark, label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.write(texts.mapInArrow(partial(_key_batches, bands=bands, k=k), _KEYS), "keys")

    # Buckets with two different sets or more; equal sets meet in the map-side minimum and maximum.
    exploded = rows.select("h1", F.explode(F.concat("own_keys", "prev_keys")).alias("key"))
    mixed = exploded.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("key")
    mixed = scratch.write(mixed, "mixed")
    met = rows.select("h1", "own_keys", "prev_keys").mapInArrow(partial(_met, wanted=Bitmap.of(mixed, F.col("key"))), "h1 long, key long, own boolean")
    met = scratch.write(met.join(mixed, "key", "left_semi").distinct(), "met")
    rows = scratch.write(rows.drop("own_keys", "prev_keys"), "rows")
    scratch.drop("keys")
    classes = scratch.write(rows.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = scratch.write(met.join(classes.filter("rep IS NOT NULL"), "h1").select("key", "own", "rep", "n_shingles"), "all_members")
    scratch.drop("met")
    members = scratch.write(_once(members), "members")
    scratch.drop("all_members")

    # Sets of the representatives in such buckets.
    reps = scratch.write(members.select("rep").distinct(), "reps")
    # A few texts more than asked for do no harm; only a doc_id that repeats must not have two sets.
    sets = _sets_of(texts, reps, bands, k)
    if not rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        sets = sets.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = scratch.write(sets, "sets")

    # Round 1: each member with its bucket's most central member.
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    central = members.join(counts, "key").groupBy("rep").agg(F.sum("c").alias("c"))
    hubs = members.join(central, "rep").groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("c"), "rep")).alias("hub")).select("key", F.col("hub.rep").alias("hub"))
    pairs = members.join(hubs, "key").filter("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    links = scratch.write(_verified(pairs, sets, num, den), "links1")
    stars = components(links, scratch, "round1-")

    # Round 2: all pairs of different components in the buckets that still hold several.
    named = members.join(stars.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
    rest = _in_cells(_open(named, scratch, "open"))
    sketches = sets.select(F.col("doc_id").alias("rep"), "own", "prev").withColumnRenamed("own", "own_sketch")
    rest = rest.join(sketches, "rep").select("key", "i", "j", "block", "rep", "label", "n_shingles", F.when(F.col("own"), F.col("own_sketch")).otherwise(F.col("prev")).alias("sketch"))
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = rest.mapInArrow(partial(_cells, work=partial(_near, bands=bands)), "a long, b long").distinct()
    more = scratch.write(_verified(near, sets, num, den), "links2")
    links = links.unionByName(more)
    roots = components(links, scratch, "round2-")

    degree = _link_counts(roots, sets, scratch, num, den) if count_links else None
    none = F.lit(0 if count_links else None).cast("long")
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.join(degree, "rep", "left") if count_links else named.withColumn("n_links", none)
    named = scratch.write(named.select("h1", "h2", "n_shingles", F.coalesce("root", "rep").alias("root"), F.col("rep").alias("set_id"), F.coalesce("n_links", none).alias("n_links")), "named")
    out = rows.select("doc_id", "h1", "h2", "n_shingles").join(named, ["h1", "h2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", none).alias("n_links"))


def one_of_each_group(docs: DataFrame, **settings) -> DataFrame:
    """The row of the smallest doc_id of each component, unchanged.

    Rows without doc_id, and those of a repeated doc_id with another text than
    the first by hash, are told apart by their texts and come after all others:
    one of them stays where its component has no other row. Of rows with the
    same doc_id and text one stays. Texts without words stand alone and stay.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.join(_gone(docs, **settings), "doc_id", "left_anti").select(*docs.columns)
    row, first = free_name(docs, "row"), free_name(docs, "first")
    hashed = F.xxhash64("doc_id", "text")
    firsts = docs.join(odd, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(hashed).alias(first))
    # Numbers from 2 ** 62 on: larger than any doc_id that is counted up.
    other = F.shiftrightunsigned(hashed, 2) + F.lit(1 << 62)
    named = docs.join(firsts, "doc_id", "left")
    named = named.withColumn(row, F.when(F.col("doc_id").isNull() | (F.col(first) != hashed), other).otherwise(F.col("doc_id").cast("long")))
    gone = _gone(named.select(F.col(row).alias("doc_id"), "text"), **settings).withColumnRenamed("doc_id", row)
    return named.join(gone, row, "left_anti").dropDuplicates([row]).select(*docs.columns)


def _gone(docs: DataFrame, **settings) -> DataFrame:
    """doc_id of the rows that are not the smallest of their component."""
    return similar_groups(docs, count_links=False, **settings).filter("doc_id <> component_id").select("doc_id").distinct()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.session import table

    return similar_groups(table(spark, sf_dir, "documents"))


#: Words, sets, classes of equal sets, links of classes that share a shingle, and the smallest doc_id that links lead to.
OP5_SQL = """
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                            WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s
        FROM words),
    classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
    shingles AS MATERIALIZED (SELECT rep, len(s) AS n, hash(unnest(s)) AS x FROM classes),
    met AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, any_value(a.n + b.n) AS total, count(*) AS shared FROM shingles a JOIN shingles b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep),
    links AS MATERIALIZED (SELECT a, b FROM met WHERE 100 * shared >= 90 * (total - shared)),
    reached AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
    degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, coalesce(c.rep, s.doc_id) AS set_id, coalesce(d.n_links, 0) AS n_links
    FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN least l ON l.a = c.rep LEFT JOIN degrees d ON d.a = c.rep
"""
