"""Language ID, quality rules, quality classifier and URL filters."""

import math
import re
import time
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import classifier, langid, rules, urls
from tessera.llm.langid import identified, identify
from tessera.session import table

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


def test_language_on_held_out_documents(docs):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs).collect()
    assert len(got) == len(lang) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in got) < 0.03 * len(got)


def test_language_of_odd_rows(odd_docs, no_docs):
    got = {(str(r.doc_id), r.lang_pred, r.rejected) for r in identify(odd_docs).collect()}
    assert {("0", "und", True), ("1", "und", True), ("15", "und", True)} <= got
    assert all(0 <= r.score <= 1 for r in identify(odd_docs).collect())
    assert identified(odd_docs).columns == odd_docs.columns
    assert identify(no_docs).count() == 0 and identified(no_docs).count() == 0


def test_letters_are_of_category_l():
    for c in map(chr, range(0x30000)):
        if not 0xD800 <= ord(c) < 0xE000:
            assert bool(langid.letters(c)) == any(unicodedata.category(x)[0] == "L" for x in c.lower()), hex(ord(c))


def test_numerals_are_no_letters(spark, docs):
    odd = spark.createDataFrame([(-1, "½ ² ①", None, "s", 0.5), (-2, "½ the house of the ½", None, "s", 0.5)], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in identify(docs.select("doc_id", "text", "lang", "source").withColumn("score", F.lit(0.5)).unionByName(odd)).filter("doc_id < 0").collect()}
    assert (got[-1].lang_pred, got[-1].score, got[-1].rejected) == ("und", 0.0, True) and got[-2].lang_pred != "und"


def test_predictions_equal_sizes_compressed_one_by_one(spark):
    """Each whole text, in blocks, against each language's dictionary by plain calls of the library."""
    some = table(spark, "/root/testdata/sf0.001", "documents")
    known = some.filter("crc32(cast(doc_id AS string)) % 4 <> 2")
    contents = langid.dictionaries(langid.samples(known, langid.SAMPLE, langid.Scratch(spark, "test")))
    got = {r.doc_id: r for r in identify(some).collect()}
    for r in some.collect():
        words = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = {}
        for name, raw in contents.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parts = [words[a : a + langid.BLOCK] for a in range(0, len(words), langid.BLOCK)]
            sizes[name] = sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(f" {x} ".encode())) for x in parts)
        best, second = sorted(sizes.values())[:2]
        assert sizes[got[r.doc_id].lang_pred] == best and got[r.doc_id].rejected == (second - best < langid.MARGIN * best)


def test_what_is_learned_from_is_bounded(spark, monkeypatch):
    """5,000 languages, and one with many long texts: bytes, texts and languages stay within the bounds."""
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 1 << 20)
    monkeypatch.setattr(langid, "LANGUAGES", 40)
    rows = [(i, f"words of text number {i}", f"l{i:04d}") for i in range(5000)]
    rows += [(5000 + i, "another long text " * 500, "l0007") for i in range(800)] + [(9000 + i, f"some text {i}", "l0008") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = langid.samples(docs, 300, langid.Scratch(spark, "test"))
    assert len(texts) == 40 and {"l0007", "l0008"} <= set(texts)
    assert 1 <= len(texts["l0007"]) <= 3 and 250 < len(texts["l0008"]) <= 300
    assert all(len(" ".join(v)) <= (1 << 20) / 40 + 100 for v in texts.values())
    assert sum(map(len, langid.dictionaries(texts).values())) <= langid.DICTIONARY_BYTES


def brute(text):
    words = WORD.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_quality_rules(odd_docs, docs, no_docs, labels, no_labels):
    for df in (odd_docs, docs):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.document_statistics(df).collect())
        assert got == sorted((str(r.doc_id), *brute(r.text)) for r in df.select("doc_id", "text").collect())
    assert rules.quality_rules(odd_docs, labels).count() == odd_docs.count()
    assert rules.quality_rules(no_docs, labels).count() == 0
    assert {r.kept == (not r.base_failed) for r in rules.quality_rules(odd_docs, no_labels).collect()} == {True}


def test_learned_rules_part_the_labels(spark, docs):
    quality = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    got = [r for r in rules.quality_rules(docs, table(spark, DATA, "labels")).collect() if r.doc_id in quality and not r.base_failed]
    assert sum(r.kept == bool(quality[r.doc_id]) for r in got) / len(got) > 0.95
    assert all(r.kept for r in got if quality[r.doc_id]) or sum(not r.kept for r in got if quality[r.doc_id]) < 0.02 * len(got)


def test_the_list_is_ordered_and_readable():
    some = rules.DecisionList(((rules.Test("upper_share", True, 0.5), rules.Test("n_words", False, 9.0)), (rules.Test("mark_share", True, 1.0),)))
    assert some.kept.index("upper") < some.kept.index("marks") and some.kept.endswith("ELSE true END")
    assert rules.DecisionList(()).kept == "true"


def test_classifier_on_held_out_documents(spark, docs):
    quality = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    got = classifier.quality_scores(docs, table(spark, DATA, "labels")).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_classifier_of_odd_rows(odd_docs, no_docs, labels, no_labels):
    got = classifier.quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classifier.quality_scores(odd_docs, no_labels).collect()} == {0.5}
    assert classifier.quality_scores(no_docs, labels).count() == 0
    kept = classifier.good_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in got)


def test_isotonic_is_the_least_squares_fit():
    at, value = classifier.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert (np.diff(value) > 0).all() and value.tolist() == pytest.approx([0, 0.5, 2.5 / 3])


def test_rules_for_urls(spark):
    cases = {
        "https://a.NET/x?q": ("a.net", "/x", "net/", "block"),
        "http://net": ("net", "", None, "model"),
        "http://b.example.net/en/1#f": ("b.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/enx": ("example.net", "/enx", "net/", "block"),
        "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "model"),
        "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "x://h.org/fr/a?://b": ("h.org", "/fr/a", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "http:///path": ("", "/path", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "<p>plain words of text</p>" if i % 2 else None, "t", "h", "p", "r", 1.0, 2, "x", 1) for i, u in enumerate(cases)] + [(None, "http://q.org/", *[None] * 9), (0, *[None] * 10), (0, *[None] * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tokens string, host string, path string, rule string, score double, word int, verdict string, n int")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule or not r.host else "model") for r in urls.judge_urls(pages).collect()]
    assert sorted(got, key=str) == sorted([(None, "q.org", "/", None, "model"), (0, "", "", None, "allow"), (0, "", "", None, "allow"), *((i, *c) for i, c in enumerate(cases.values()))], key=str)
    assert urls.judge_urls(pages.filter("page_id < 0")).count() == 0


def every_split(name):
    if not name:
        yield []
    for n in range(1, len(name) + 1):
        for rest in every_split(name[n:]):
            yield [name[:n], *rest]


def test_segmentation_takes_the_most_probable_of_all_splits():
    rng = np.random.default_rng(5)
    for _ in range(60):
        words = {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(7)}
        logs = {w: float(-rng.uniform(1, 9)) for w in words}
        name = "".join(rng.choice(list("abcd"), rng.integers(1, 10)))
        cost = lambda parts: sum(logs.get(p, -11.0 * len(p)) for p in parts)  # noqa: B023, E731
        got = urls.split(name, logs, -11.0)
        assert "".join(got) == name and cost(got) == pytest.approx(max(map(cost, every_split(name))))
    assert urls.split("betsfree", {"free": -3.0, "bets": -4.0, "be": -2.0, "freebets": -9.0}, -12.0) == ["bets", "free"]
    assert urls.split("zzfree", {"free": -3.0}, -12.0) == ["zz", "free"] and urls.split("", {}, -1.0) == []


def test_a_very_long_name_is_split_in_proportion_to_its_length():
    for n in (20_000, 400_000):
        began = time.process_time()
        assert urls.split("x" * n + "free", {"free": -3.0}, -12.0) == ["x" * n, "free"]
        took = time.process_time() - began
        assert n == 20_000 or took < 60 * max(first, 0.01)
        first = took


def test_words_of_any_length_and_count_split_names(spark):
    """60,000 more frequent words in the pages, a word of one letter and one of 30: each keeps its count."""
    letters = "abcdefghijklmnopqrst"
    filler = ["q" + a + b + c + d for a in letters for b in letters for c in letters for d in letters[:8]][:60_000]
    long = "pneumonoultramicroscopicsilico"
    pages = spark.createDataFrame([("www.example.org", f"<p>{' '.join(filler)}</p>")] * 3 + [("x", f"<p>zebrabetsky {long} I</p>"), (None, None)], "host string, html string")
    counts = urls.word_counts(pages)
    assert {r.word: r.n for r in counts.filter("n < 3").collect()} == {"zebrabetsky": 1, long: 1, "i": 1}
    names = {"zebrabetsky": ["zebrabetsky"], f"i{long}zebrabetsky": ["i", long, "zebrabetsky"], f"{filler[7]}i.{filler[9]}": [filler[7], "i", filler[9]], "1-!": [], "Éß7i": ["éß", "i"]}
    hosts = spark.createDataFrame([(x,) for x in names], "host string")
    assert {r.host: r.words for r in urls.segmented(hosts, counts).collect()} == names
    assert {r.host: r.words for r in urls.segmented(hosts.filter("host LIKE 'zebra%'"), counts.limit(0)).collect()} == {"zebrabetsky": ["zebrabetsky"]}


def test_verdicts_equal_bayes_by_hand(spark):
    """All pages, against a plain version of rules, unigrams, all parts of a name and naive Bayes."""
    pages = table(spark, DATA, "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    words_of = lambda x: re.findall(r"[^\W\d_]+", x.lower())
    parts = {}
    for i, url, _ in rows:
        rest = re.split("[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        parts[i] = host.lower(), slash + path
    counts = Counter(w for _, _, html in rows for w in words_of(re.sub("<[^>]*>", " ", html)))
    counts.update(w for host, _ in parts.values() for name in host.split(".") if "-" in name for w in words_of(name))
    total, unknown = sum(counts.values()), math.log(min(counts.values()) / sum(counts.values()) / 26)
    logs = {w: math.log(n / total) for w, n in counts.items()}

    def ruled(host, path):
        fit = [r for r in urls.RULES if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.text), default=None)

    def tokens(host, path):
        return [f"h:{w}" for name in words_of(host) for w in urls.split(name, logs, unknown)] + [f"p:{w}" for w in words_of(path)]

    seen, n = {"block": Counter(), "allow": Counter()}, Counter()
    for host, path in set(parts.values()):
        if r := ruled(host, path):
            n[r.verdict] += 1
            seen[r.verdict].update(tokens(host[: max(0, len(host) - len(r.host) - 1)], path[len(r.path) :]))
    every = set(seen["block"]) | set(seen["allow"])
    like = {v: {t: (seen[v][t] + 1) / (seen[v].total() + len(every)) for t in every} for v in seen}
    wanted = {}
    for i, (host, path) in parts.items():
        if r := ruled(host, path):
            wanted[i] = host, path, r.text, r.verdict
        else:
            score = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(math.log(like["block"][t] / like["allow"][t]) for t in tokens(host, path) if t in every)
            wanted[i] = host, path, None, "block" if score > 0 else "allow"
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got == wanted
    assert {v for _, _, rule, v in got.values() if rule is None} == {"block", "allow"}


def test_segments_decide_where_substrings_do_not(spark):
    """The model learns `bets` as a word of blocked hosts: `alphabetsoup` holds it as letters only, `freebets` as a word."""
    text = "<p>" + "alphabet soup free bets house garden " * 3 + "</p>"
    learned = [f"http://{x}.{top}/p{i}" for i in range(4) for x, top in (("freebets", "net"), ("betshouse", "net"), ("gardenhouse", "org/fr"), ("alphabetgarden", "org/fr"))]
    judged = ["http://www.alphabetsoup.info/", "http://www.bets.info/", "http://bets-garden-soup-bets.info/", "http://gardenalphabet.info/"]
    rows = [(i, u, text) for i, u in enumerate(learned + judged)]
    got = {r.host: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("rule IS NULL").collect()}
    assert got == {"www.alphabetsoup.info": "allow", "www.bets.info": "block", "bets-garden-soup-bets.info": "block", "gardenalphabet.info": "allow"}
    labels = spark.createDataFrame([(f"http://soup{i}.info/", "block") for i in range(9)] + [(None, "block"), ("http://x.y/", None)], "url string, verdict string")
    more = {r.host: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), labels=labels).filter("rule IS NULL").collect()}
    assert more["www.alphabetsoup.info"] == "block"
