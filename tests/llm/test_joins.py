"""Near duplicates, exact search, mixing and the pipeline against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import jaccard, langid, topk
from tessera.llm.classifier import quality_scores
from tessera.llm.jaccard import OP5_SQL, Bands, one_of_each_group, similar_groups
from tessera.llm.mixing import OP10_SQL, before_in_order, mix_plan, op10, mixed, source_targets
from tessera.llm.pieces import public_path
from tessera.llm.topk import OP9_SQL, op9, top_k, vectors_of
from tessera.session import Scratch, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def groups_of(rows, num=9, den=10):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets.append((i, frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and den * len(s & t) >= num * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted((str(i), len(s), str(least.get(find(a)))) for a, (i, s) in enumerate(sets))


def test_groups_of_odd_rows(odd_docs, no_docs):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_groups(odd_docs).collect())
    assert got == groups_of([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert similar_groups(no_docs).count() == 0 and one_of_each_group(no_docs).count() == 0


def test_groups_of_chains_and_large_groups(spark):
    """Copies with more and more changed words: links hang together in chains, and buckets exceed a block."""
    random.seed(2)
    rows = []
    for g in range(6):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([12, 40, 150]))]
        for _ in range(60):
            some = list(base)
            for _ in range(random.randrange(6)):
                some[random.randrange(len(some))] = f"v{random.randrange(30)}"
            rows.append((len(rows), " ".join(some)))
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    block, jaccard.BLOCK = jaccard.BLOCK, 16
    try:
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_groups(docs).collect())
    finally:
        jaccard.BLOCK = block
    assert got == groups_of(rows)


def test_two_documents_in_one_task_that_share_a_segment(spark):
    """One cell of two rows, which do not link."""
    words, shared = [f"w{i}" for i in range(40)], set()
    while not shared:
        other = [*words[:34], *(f"v{random.randrange(10**6)}" for _ in range(6))]
        batch = pa.record_batch({"doc_id": [1, 2], "text": [" ".join(words), " ".join(other)]})
        (keys,) = (x.to_pylist() for x in jaccard._key_batches(iter([batch]), Bands(9, 10), 3))
        shared = set(keys[0]["own_keys"]) & set(keys[1]["own_keys"])
    rows = batch.to_pylist()
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(docs).collect()) == [(1, 38, 1), (2, 38, 2)]


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_linked_pairs_share_a_key(k, num, den):
    """Pairs at the edge of the similarity, of all sizes, also such whose filled segments are all touched."""
    rng = np.random.default_rng(9)
    bands, tried = Bands(num, den), 0
    for _ in range(3000):
        n = int(rng.choice([*range(1, 70), 120, 400]))
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        out = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, n // 3 + 2))
        two = np.concatenate([one[out:], rng.integers(0, 2**63, new).astype(np.uint64)])
        if not len(two) or den * (n - out) < num * (n + new):
            continue
        tried += 1
        keys = []
        for h in (np.sort(one), np.sort(two)):
            size, both = np.array([len(h)]), set()
            for shift in (0, 1):
                if (band := bands.of(size) - shift)[0] >= 0:
                    most = bands.partner_apart(size, band, bool(shift))
                    both |= set(jaccard._segment_keys(*jaccard._sketch(size, h, bands.segments[band]), band, most)[1].tolist())
            keys.append(both)
        assert keys[0] & keys[1] or set(one.tolist()) == set(two.tolist())
    assert tried > 300


def test_cells_are_whole_however_the_batches_cut_them():
    """Each cell once and whole: one cell, a cell over several batches, and a last batch that only continues one."""
    for keys in ([7], [7] * 9, [1, 1, 2, 3, 3, 3, 3, 3], [1, 2, 3], []):
        for step in (1, 2, 3, 100):
            batch = pa.record_batch({"key": pa.array(keys, pa.int64()), "i": pa.array([0] * len(keys), pa.int32()), "j": pa.array([0] * len(keys), pa.int32())})
            parts = [batch.slice(at, step) for at in range(0, len(keys), step)] + [batch.slice(0, 0)]
            seen = []

            def work(some, firsts):
                for a, b in zip(firsts, [*firsts[1:], some.num_rows], strict=True):
                    seen.append(some.column("key").to_pylist()[a:b])
                return some

            assert sum(x.num_rows for x in jaccard._cells(iter(parts), work)) == len(keys)
            assert seen == [[k] * keys.count(k) for k in dict.fromkeys(keys)]


def test_cells_of_one_row_and_of_sketches_of_two_lengths():
    bands = Bands(9, 10)
    rows = [(0, 1, 20, [5, 6, 7]), (1, 2, 20, [5, 6, 7]), (2, 3, 30, [5, 6]), (3, 4, 30, [5, 7]), (4, 5, 90, [1, 2, 3, 4])]
    for some in (rows, rows[:1]):
        batch = pa.record_batch({"key": pa.array([1] * len(some)), "i": pa.array([0] * len(some)), "j": pa.array([0] * len(some)), "block": pa.array([0] * len(some)), "rep": pa.array([r[0] for r in some]), "label": pa.array([r[1] for r in some]), "n_shingles": pa.array([r[2] for r in some]), "sketch": pa.array([r[3] for r in some], pa.list_(pa.int64()))})
        got = sorted(jaccard._near(batch, np.array([0]), bands).to_pylist(), key=lambda r: r["a"])
        assert got == ([{"a": 1, "b": 0}, {"a": 3, "b": 2}] if len(some) > 1 else [])


def test_large_buckets_of_texts_that_do_not_link(spark, monkeypatch):
    """Texts of one template, most of them too far apart to link: buckets exceed a block. Sets are met by a join, not by a filter."""
    random.seed(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        some = list(base)
        for at in random.sample(range(60), random.choice([1, 4, 5, 6])):
            some[at] = f"v{random.randrange(10**6)}"
        rows.append((i, " ".join(some)))
    for name, value in {"BLOCK": 4, "FILTER_BITS": 8}.items():
        monkeypatch.setattr(jaccard, name, value)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == groups_of(rows) and len({x[2] for x in got}) > 100


def test_buckets_of_the_same_sets_are_kept_once(spark):
    buckets = {1: [10, 20], 2: [10, 20], 3: [10, 20, 30], 4: [10, 30], 5: [30], 6: [20, 30, 10]}
    rows = spark.createDataFrame([(k, r) for k, reps in buckets.items() for r in reps], "key long, rep long")
    assert sorted(map(tuple, jaccard._once(rows).collect())) == [(1, 10), (1, 20), (3, 10), (3, 20), (3, 30), (4, 10), (4, 30)]
    assert jaccard._once(rows.limit(0)).count() == 0


def test_bands_bound_the_difference_of_linked_sets():
    bands = Bands(9, 10)
    for a in (1, 8, 9, 17, 18, 150, 4000):
        band = bands.of(np.array([a]))[0]
        for b in range(a, a * 10 // 9 + 1):
            for inter in range(max(0, a - 8), a + 1):
                if 10 * inter >= 9 * (a + b - inter):
                    apart = a + b - 2 * inter
                    assert apart <= bands.most_apart(np.array([a]), np.array([b]))[0]
                    assert apart == 0 or apart + 2 <= bands.segments[band]
                    assert bands.of(np.array([b]))[0] - band in (0, 1)


def test_one_of_each_group(odd_docs):
    kept = one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    wanted = {int(i) for i, _, c in groups_of([(r.doc_id, r.text) for r in odd_docs.collect()]) if i == c and i != "None"}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(wanted)
    assert [r.text for r in rows if r.doc_id is None] == ["no id"]


def test_rows_without_an_id_of_their_own_are_kept(spark):
    """Null and repeated ids: different texts stay, of copies one, and of a group with an id the row of that id."""
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, f"{a} tail"), (None, b), (7, c), (7, d), (7, d), (9, b), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, row int, first int").repartition(4)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got in (sorted([(None, x), (7, c), (7, d), (9, b), (None, None), (3, "")], key=str) for x in (a, f"{a} tail"))


def test_every_link_is_counted(spark, odd_docs):
    """Large groups of mutually linked texts, chains, pairs and equal sets; one component exceeds a block."""
    random.seed(6)
    rows = []
    for size, n, most in ((50, 150, 2), (30, 60, 4), (3, 100, 1), (2, 100, 1), (1, 40, 0)):
        base = [f"w{random.randrange(4000)}" for _ in range(n)]
        for _ in range(size):
            some = list(base)
            for _ in range(random.randrange(most + 1)):
                some[random.randrange(n)] = f"v{random.randrange(1000)}"
            rows += [(len(rows), " ".join(some))] * random.choice([1, 1, 2])
    block, jaccard.BLOCK = jaccard.BLOCK, 16
    try:
        for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs.filter("doc_id IS NOT NULL")):
            sets = {}
            for r in docs.collect():
                w = WORD.findall((r.text or "").encode().lower())
                sets[r.doc_id] = frozenset(tuple(w[a : a + 3]) for a in range(max(1, len(w) - 2))) if w else frozenset()
            classes = set(sets.values()) - {frozenset()}
            want = {i: sum(s != t and 10 * len(s & t) >= 9 * len(s | t) for t in classes) if s else 0 for i, s in sets.items()}
            assert {r.doc_id: r.n_links for r in similar_groups(docs).collect()} == want
    finally:
        jaccard.BLOCK = block


def left_by_brute_force(rows, k, num, den):
    """Smallest doc_id of each component, by comparing all documents that share a shingle; every doc_id is there once."""
    sets, root, holders = {}, {}, {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
        root[i] = i
        for s in sets[i]:
            holders.setdefault(s, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in holders[s]:
                shared[j] = shared.get(j, 0) + (j < i)
        for j, n in shared.items():
            if j < i and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in sets if find(i) == i)


def test_near_duplicates_stage_takes_five_words_and_four_fifths(spark):
    random.seed(4)
    base = [[f"w{random.randrange(5000)}" for _ in range(n)] for n in (100, 150)]
    texts = [base[0], base[0] + [f"t{i}" for i in range(15)], base[0][:70] + ["x"] + base[0][71:], base[0] + [f"u{i}" for i in range(40)], base[1], [*base[1][:50], "y", *base[1][51:100], "z", *base[1][101:]], base[1][:4], base[1][:4]]
    small = [(i, " ".join(w)) for i, w in enumerate(texts)]
    assert left_by_brute_force(small, 5, 4, 5) == [0, 3, 4, 6]
    large = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    for rows in (small, large):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = corpus_pipeline.near_duplicates(spark, docs, "")
        assert sorted(r.doc_id for r in got.collect()) == left_by_brute_force(rows, 5, 4, 5)


def brute_top(rows, k=10, every=100):
    out = set()
    ok = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q, a in ok.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok.items() if i != q and len(a) == len(b))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(i, list(rows[3][1])) for i in range(700, 730)]  # ties
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (1000, [0.5, 0.25]), (1001, [0.1, -0.2]), (None, rows[0][1]), (1100, []), (1200, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, v int")
    v = vectors_of(df)
    for size in (1 << 24, 600):  # one broadcast of queries, then several
        got = top_k(v, v.filter("vec_id % 100 = 0"), query_bytes=size)
        assert {tuple(r) for r in got.collect()} == {x for x in brute_top(rows) if x[0] != 1100}
    assert top_k(v.limit(0), v.filter("vec_id % 100 = 0")).count() == 0
    assert top_k(v, v.limit(0)).count() == 0


def test_top_k_of_queries_that_are_no_candidates(spark):
    """The queries are like each other and unlike all vectors: what they reach among themselves proves nothing."""
    rng = np.random.default_rng(3)
    kind = "vec_id long, v array<long>"
    queries = [(1000 + i, [1000 + int(x) for x in rng.integers(0, 9, 4)]) for i in range(20)]
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 4)]) for i in range(40)]
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, kind), spark.createDataFrame(queries, kind), k=5).collect()}
    want = set()
    for q, a in queries:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert got == want


def test_products_that_do_not_fit_are_refused(spark):
    kind = "vec_id long, v array<long>"
    for big in (3 * 10**17, 2**31):
        rows = [(i, [big, -big + i]) for i in range(5)]
        with pytest.raises(Exception, match="64 bits"):
            top_k(spark.createDataFrame(rows, kind), spark.createDataFrame(rows[:1], kind)).collect()
    rows = [(i, [2**30 - i, -(2**30)]) for i in range(30)]
    got = top_k(spark.createDataFrame(rows, kind), spark.createDataFrame(rows[:1], kind), k=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 2**30 * (2**30 - i) + 2**60) for i in (1, 2)]


def test_blocks_are_kept_whole_and_processing_stops_on_proof(spark):
    """The vectors of sf0.1: packed and unpacked alike, members as by all products, less than 0.9 of the postings."""
    rows = vectors_of(table(spark, "/root/testdata/sf0.1", "embeddings")).orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    queries = v[ids % 100 == 0]
    score = v @ queries.T
    need = np.partition(score, -11, axis=0)[-11]  # the eleventh: a query meets itself
    one, two = topk.Block(ids, v), topk.Block.unpacked(topk.Block.packed(ids, v))
    assert (one.level == two.level).all() and (one.v == two.v).all() and (one.ids == two.ids).all() and one.bounds == two.bounds
    q, row, got = two.members(queries, need)
    assert set(zip(row.tolist(), q.tolist(), got.tolist(), strict=True)) == {(r, c, int(score[r, c])) for r, c in zip(*np.nonzero(score >= need), strict=True)}
    assert 0 < two.seen < 0.9 * two.all
    small = topk.Block(ids, v // 8)
    assert len(small.members(queries, need)[0]) == 0 and small.seen == 0  # passed over by its norm


@pytest.mark.parametrize("name, sql, query", [("embeddings", OP9_SQL, op9), ("documents", OP10_SQL, op10), ("documents", OP5_SQL, jaccard.op5)])
def test_sql(spark, name, sql, query):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    cur = con.execute(sql)
    columns = [x[0] for x in cur.description]
    df = query(spark, path)
    assert set(columns) == set(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(map(tuple, cur.fetchall()))


def test_targets_are_reshared(spark):
    random.seed(3)
    for sizes in ({"a": 10, "b": 1000, "c": 1, None: 500, "d": 0}, {None: 3}, {f"host{i}": random.choice([0, 1, 7, 7, 50, 10**6]) for i in range(3000)}):
        rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long").repartition(7)
        got = {r.source: r.target for r in source_targets(rows, Scratch(spark, "test")).collect()}
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
        assert all(got[k] <= 2 * v + 1e-9 for k, v in sizes.items())
        names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
        weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        open_ = {got[k] / weights[k] for k in sizes if got[k] < 2 * sizes[k] - 1e-9}
        assert max(open_, default=0) - min(open_, default=0) < 1e-6 * max(open_, default=1)


def test_sums_before_each_row_over_several_ranges(spark):
    rows = [(i * 7919 % 1000, float(i)) for i in range(1000)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(5)
    # ranges that adaptive execution does not put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: (r.n, r.s) for r in before_in_order(df, [F.col("k")], {"n": F.lit(1), "s": F.col("x")}, Scratch(spark, "test"), "rows").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at, want = 0.0, {}
    for n, (k, x) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        want[k], at = (n, at), at + x
    assert got == want


def test_null_ids_spread_over_ranges(spark):
    """Half of the ids are null, some repeat: the plan adds up, and no range holds all of them."""
    rows = [(None if i % 2 else i // 3, " ".join(f"w{j}" for j in range(i % 40)) + f" x{i}", "ab"[i % 5 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mix_plan(docs, range_rows=20)
    by = {}
    for r in plan.collect():
        by.setdefault(r.source, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    for of in by.values():
        assert sum(r.taken for r in of) == int(of[0].target) and sum(r.size for r in of) == of[0].source_size
        null = [r for r in of if r.doc_id is None]
        assert 0.2 < sum(r.part for r in null) / max(1, sum(r.part for r in of)) < 0.8 or not any(r.part for r in of)
    again = mix_plan(docs.repartition(11), range_rows=20)
    assert sorted(map(str, plan.collect())) == sorted(map(str, again.collect()))


def test_mix_of_odd_rows(odd_docs, no_docs):
    plan = mix_plan(odd_docs, range_rows=2).collect()
    assert len(plan) == odd_docs.count() and all(0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.part for r in plan)
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert sum(r.taken for r in rows) == int(rows[0].target) and sum(r.size for r in rows) == rows[0].source_size
    again = mix_plan(odd_docs.repartition(7), range_rows=2).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, plan)) == sorted(map(key, again))
    assert mix_plan(no_docs).count() == 0 and mixed(no_docs).count() == 0
    out = mixed(odd_docs.withColumnRenamed("x", "epochs").withColumnRenamed("t", "part"))
    assert out.columns[:2] == ["doc_id", "text"] and out.count() > 0


def words_by_row(rows):
    got = {}
    for r in rows:
        key = (r.doc_id, r.source, r.text.split()[0])
        got[key] = got.get(key, 0) + len(r.text.split())
    return got


def test_mixed_rows_hold_the_words_taken(spark):
    """Also where ids are null, repeat, or stand in two sources: the first word of a text tells it from the others."""
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(i + 1)), "abc"[i % 3], 0) for i in range(40)]
    odd = [(None if i % 2 else i // 4, " ".join(f"w{i}x{j}" for j in range(i + 1)), [None, "a", "b"][i % 3], 0) for i in range(40)]
    for rows in (plain, odd):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
        plan, got = mix_plan(docs), words_by_row(mixed(docs).collect())
        assert sum(got.values()) == sum(r.taken for r in plan.collect())
        assert sorted((str(i), str(s), n) for (i, s, _), n in got.items()) == sorted((str(r.doc_id), str(r.source), r.taken) for r in plan.collect() if r.taken)


def judged_by_hand(docs):
    """doc_id of the texts that one language's dictionary shortens more than all others', by the margin."""
    fit = docs.filter("crc32(cast(doc_id AS string)) % 4 <> 2")
    contents = langid.dictionaries(langid.samples(fit, langid.SAMPLE, Scratch(docs.sparkSession, "test")))
    coders = [zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for x in contents.values()]
    kept = []
    for r in docs.select("doc_id", "text").collect():
        t = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split())
        blocks = [f" {t[at : at + langid.BLOCK]} ".encode() for at in range(0, len(t), langid.BLOCK)]
        sizes = sorted(sum(len(c.compress(x)) for x in blocks) for c in coders)
        if blocks and sizes[1] - sizes[0] >= langid.MARGIN * sizes[0]:
            kept.append(r.doc_id)
    return sorted(kept)


def test_pipeline(spark):
    """The rows that each stage keeps, by plain versions of the stages on its own input; quality by the scores of its operator."""
    path = "/root/testdata/sf0.001"
    docs = table(spark, path, "documents")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given, docs = docs, stage(spark, docs, path).cache()
        assert docs.columns == columns, name
        left[name] = given, docs
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    given, kept = left["language"]
    assert 0 < kept.count() < given.count() and ids(kept) == judged_by_hand(given)
    given, kept = left["quality"]
    scores = quality_scores(given.repartition(5), table(spark, path, "labels"))
    assert 0 < kept.count() < given.count() and ids(kept) == ids(scores.filter("score >= 0.3"))
    given, kept = left["near_duplicates"]
    assert ids(kept) == left_by_brute_force([(r.doc_id, r.text) for r in given.collect()], 5, 4, 5)
    given, kept = left["mixture"]
    con = duckdb.connect()
    con.register("documents", given.select("doc_id", "text", "source").toPandas())
    want = {i: n for i, n in con.execute(f"SELECT doc_id, taken FROM ({OP10_SQL})").fetchall() if n}
    taken = {}
    for r in kept.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text.encode()))
    assert taken == want
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    tokens = []
    for r in kept.collect():
        found = library.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(found, dtype="<u4").tobytes(), library.decode(found, skip_special_tokens=False).encode())]
        tokens.append((r.doc_id, len(found), *digests))
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(tokens)


def test_stages_take_empty_tables_and_odd_rows(spark, odd_docs, no_docs):
    for docs in (no_docs, odd_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "/root/testdata/sf0.001").count() >= 0
