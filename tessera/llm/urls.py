"""URL filters: host rules, then host word segmentation and naive Bayes.

Rules decide first, and what they decide is what the model learns from: a url
that a rule fits is a training example with the rule's verdict, without the part
of its host and path that the rule itself names, so the rules are not copied.
Names of hosts are split into words by a unigram model (Viterbi: the split of
highest probability) and the words, with those of the path, are scored by a
multinomial naive Bayes model.

Nothing is broadcast or collected that grows with the urls: the words that a
host's names may hold meet their counts in a join and each host is split with
its own; the weights of words meet the words of the urls in another.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch, table

LETTERS = 26  # an unknown letter is so many times less likely than the rarest word
_BATCH = 1 << 15
_OTHER = "[^\\p{L}]+"


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains and the paths that start with `path`."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return F.concat(F.lit("."), host).endswith(f".{self.host}") & path.startswith(self.path)


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path): what is between the first :// and /, ? or # with A-Z in lower case, and from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls (host, path, ...) with rule and ruling, the text and verdict of the longest rule that fits, and with
    own_host and own_path, what is left of both without what that rule names."""
    host, path = F.col("host"), F.col("path")
    out = {"rule": F.lit(None).cast("string"), "ruling": F.lit(None).cast("string"), "own_host": host, "own_path": path}
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        here = {"rule": F.lit(r.text), "ruling": F.lit(r.verdict), "own_host": F.expr(f"left(host, greatest(0, length(host) - {len(r.host) + 1}))"), "own_path": F.expr(f"substring(path, {len(r.path) + 1})")}
        out = {k: F.when(r.fits(host, path), here[k]).otherwise(v) for k, v in out.items()}
    return urls.withColumns(out)


def words_of(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.filter(F.split(F.lower(text), _OTHER), lambda w: w != "")


def split(name: str, logs: dict[str, float], unknown: float) -> list[str]:
    """Most probable split of a name into words of logs; a letter outside words costs `unknown`, and such letters in a
    row are one word. Of equally probable splits the one whose last words are longest. Work: letters by word lengths."""
    lengths = sorted({len(w) for w in logs})
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        top, start = best[end - 1] + unknown, end - 1
        for n in lengths:
            if n > end:
                break
            if (p := logs.get(name[end - n : end])) is not None and best[end - n] + p >= top:
                top, start = best[end - n] + p, end - n
        best.append(top)
        back.append(start)
    out: list[str] = []
    end = loose = len(name)  # name[end:loose] are letters outside words
    while end:
        start = back[end]
        if name[start:end] in logs:
            if loose > end:
                out.append(name[end:loose])
            out.append(name[start:end])
            loose = start
        end = start
    if loose:
        out.append(name[:loose])
    return out[::-1]


def _names(host: str) -> list[str]:
    """As words_of has them."""
    return [x for x in "".join(c if c.isalpha() else " " for c in host.lower()).split(" ") if x]


def _candidates(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """(host, word) of every part of a host's names that has the length of some word, once."""

    def parts(host: str) -> Iterable[str]:
        names = set(_names(host))
        for n in lengths:
            yield from {name[a : a + n] for name in names for a in range(len(name) - n + 1)}

    for batch in batches:
        held: list[tuple[str, str]] = []
        for host in batch.column(0).to_pylist():
            for word in parts(host):
                held.append((host, word))
                if len(held) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], ["host", "word"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], ["host", "word"])


def _split_hosts(batches: Iterator[pa.RecordBatch], total: int, unknown: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for host, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            logs = {x["word"]: math.log(x["n"] / total) for x in known or ()}
            out.append([w for name in _names(host) for w in split(name, logs, unknown)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["host", "words"])


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of all words of page texts (html) and of the parts of hyphened host names."""
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), "<[^>]*>", " ")
    words = pages.select(F.explode(words_of(text)).alias("word"))
    names = pages.select(F.explode(F.split("host", "[.]")).alias("name")).filter("name LIKE '%-%'").select(F.explode(words_of(F.col("name"))).alias("word"))
    return words.unionByName(names).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of each of some distinct hosts, by the unigram model of a table of counts (word, n).

    Only words that a host holds can be in its split, so each host takes the
    counts of its own parts. Without counts a name is one word.
    """
    known = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.collect_set(F.length("word")).alias("lengths")).first()
    total, least = (known.total or 1), (known.least or 1)
    parts = hosts.mapInArrow(partial(_candidates, lengths=sorted(known.lengths)), "host string, word string")
    held = parts.join(counts, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    every = hosts.join(held, "host", "left")
    return every.mapInArrow(partial(_split_hosts, total=total, unknown=math.log(least / total) - math.log(LETTERS)), "host string, words array<string>")


def log_odds(tokens: DataFrame) -> DataFrame:
    """(token, odds) of a multinomial naive Bayes model: log P(token | block) - log P(token | allow), each plus one.

    tokens: ruling and tokens of each training url. Odds are decimals, so that
    their sums do not depend on the order of rows.
    """
    each = tokens.select("ruling", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(F.col("ruling") == "block").alias("bad"), F.count_if(F.col("ruling") == "allow").alias("good"))
    every = each.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count(F.lit(1)).alias("size"))
    of = lambda x: F.ln((F.col(x) + 1) / (F.col(f"all_{x}") + F.col("size")))
    return each.join(F.broadcast(every)).select("token", (of("bad") - of("good")).cast("decimal(20,12)").alias("odds"))


def judge_urls(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url, html).

    The longest rule that fits decides; else the model: block where the log odds
    (score) are above 0. The model learns from the distinct urls that a rule
    fits and from labels (url, verdict: block or allow), if given; a token that
    it has not met weighs nothing, and with nothing to learn from all is
    allowed. A null url or one without :// has an empty host and path, which no
    rule fits and which is allowed. Null html has no words. Hosts, names and
    words of any length are taken whole. Repeated rows are judged alike; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parts_of(F.col("url").cast("string"))
    parsed = scratch.write(ruled(pages.select("page_id", host.alias("host"), path.alias("path")), rules), "parsed")
    counts = scratch.write(word_counts(pages.select(host.alias("host"), "html")), "words")
    urls = parsed.filter("host <> ''").drop("page_id").distinct()
    known = urls.filter("rule IS NOT NULL").select(F.col("own_host").alias("host"), F.col("own_path").alias("path"), "ruling")
    if labels is not None:
        known = known.unionByName(labels.filter("verdict IN ('block', 'allow')").select(host.alias("host"), path.alias("path"), F.col("verdict").alias("ruling")).distinct())
    hosts = urls.select("host").union(known.select("host")).filter("host <> ''").distinct()
    hosts = scratch.write(segmented(hosts, counts), "hosts")

    def tokens(rows: DataFrame) -> DataFrame:
        of = lambda c, kind: F.transform(c, lambda w: F.concat(F.lit(kind), w))
        words = F.concat(of(F.coalesce("words", F.array().cast("array<string>")), "h:"), of(words_of(F.col("path")), "p:"))
        return rows.join(hosts, "host", "left").withColumn("tokens", words).drop("words")

    known = scratch.write(tokens(known).select("ruling", "tokens"), "known")
    odds = scratch.write(log_odds(known), "odds")
    n = known.agg(F.count_if(F.col("ruling") == "block").alias("bad"), F.count_if(F.col("ruling") == "allow").alias("good")).first()
    prior = math.log((n.bad + 1) / (n.good + 1))
    left = tokens(urls.filter("rule IS NULL").select("host", "path")).select("host", "path", F.explode("tokens").alias("token"))
    scores = left.join(odds, "token").groupBy("host", "path").agg(F.sum("odds").cast("double").alias("odds"))
    score = F.when(F.col("rule").isNull() & (F.col("host") != ""), F.lit(prior) + F.coalesce("odds", F.lit(0.0)))
    verdict = F.coalesce("ruling", F.when(F.col("score") > 0, "block").otherwise("allow"))
    out = parsed.join(scores, ["host", "path"], "left").withColumn("score", score)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
