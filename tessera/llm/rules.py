"""Quality rules as learned decision lists, in DataFrame operations only.

Document statistics are Spark expressions. Rules for low quality are learned by
sequential covering: a conjunction of threshold tests grows test by test on one
part of the labelled documents, loses tests again as long as that helps on the
other part, and the documents that it covers are set aside before the next one
grows. Each step is one small aggregation over binned statistics, of which only
counts by statistic and bin come to the driver. The list is emitted as one
ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch, table

SPACE = "\\x20\\x09-\\x0D"
WINDOW = 5
#: Name and expression of each statistic that a rule may test.
TESTED = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def _without(column: str, chars: str) -> Column:
    """Code points of a text that are among chars."""
    return F.length(column) - F.length(F.regexp_replace(column, f"[{chars}]+", ""))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of every row of docs (doc_id, text): n_words, word_chars, n_symbols, n_upper, n_marks,
    n_digits, n_lines, n_dup_lines, n_distinct_words, n_repeat_words.

    Null and empty texts count nothing. n_repeat_words counts the words that lie
    in a window of five words found twice or more in the text. Windows are told
    apart by 64-bit hashes. The work for a text is a sort of its windows at most.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    one = text.select(
        "doc_id",
        F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        F.length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        _without("t", "#*$%&|<>").cast("long").alias("n_symbols"),
        _without("t", "A-ZÀ-ÖØ-Þ").cast("long").alias("n_upper"),
        _without("t", "!?").cast("long").alias("n_marks"),
        _without("t", "0-9").cast("long").alias("n_digits"),
    )
    counts = ["word_chars", "n_symbols", "n_upper", "n_marks", "n_digits"]
    two = one.select("doc_id", *counts, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    counts += ["n_lines", "n_dup_lines"]
    last = F.size("h") - WINDOW
    window = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    three = two.select("doc_id", *counts, F.size("h").cast("long").alias("n_words"), F.size(F.array_distinct("h")).cast("long").alias("n_distinct_words"), F.when(last >= 0, window).otherwise(F.array().cast("array<long>")).alias("w"))
    counts += ["n_words", "n_distinct_words"]
    # Only texts with a repeated window go on to sort them.
    repeated = F.size(F.array_distinct("w")) < F.size("w")
    four = three.select("doc_id", *counts, F.when(repeated, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda i, j: F.get("s", i).getField("h") == F.get("s", j).getField("h")
    found = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    five = four.select("doc_id", *counts, F.when(F.col("s").isNotNull(), F.array_sort(F.transform(found, lambda i: F.get("s", i).getField("i")))).alias("p"))
    covers = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW))).cast("long"))
    return five.select("doc_id", *counts, F.coalesce(F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Test:
    """statistic > threshold, or <= threshold."""

    name: str
    above: bool
    threshold: float

    @property
    def sql(self) -> str:
        return f"({TESTED[self.name]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; a document that meets one is rejected."""

    rules: tuple[tuple[Test, ...], ...]

    @property
    def kept(self) -> str:
        """SQL over document_statistics."""
        cases = "".join(f" WHEN {' AND '.join(t.sql for t in rule)} THEN false" for rule in self.rules)
        return f"CASE{cases} ELSE true END" if cases else "true"


def learn(labelled: DataFrame, *, bins: int = 24, max_rules: int = 6, max_tests: int = 3, precision: float = 0.9, least: int = 3) -> DecisionList:
    """A decision list from document_statistics with a column label (1 good, 0 bad).

    A rule must be right on at least `precision` of what it covers in both parts
    and cover `least` bad documents where it grows. Null labels are left out; with
    no labels, or one kind of label only, the list is empty.
    """
    names = list(TESTED)
    rows = labelled.filter("label IS NOT NULL").selectExpr("cast(label = 0 AS int) AS bad", "pmod(xxhash64(doc_id), 3) = 0 AS held", *[f"{e} AS {n}" for n, e in TESTED.items()])
    scratch = Scratch(labelled.sparkSession, "rules")
    rows = scratch.write(rows, "labelled")
    parts = rows.groupBy("bad").agg(*[F.percentile_approx(n, [i / bins for i in range(bins + 1)], 1000).alias(n) for n in names]).collect()
    cuts = {}
    for n in names:  # quantiles of either kind, and the middles between neighbours
        at = sorted({float(x) for part in parts for x in part[n]})
        cuts[n] = sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:], strict=False))})
    if len(parts) < 2:
        return DecisionList(())
    # The bin is the number of cuts below the value.
    binned = [sum((F.col(n) > x).cast("int") for x in cuts[n]).alias(n) for n in names]
    cells = rows.select("bad", "held", *binned).groupBy("held", *names).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    cells = scratch.write(cells, "cells")

    def test_filter(t: Test) -> Column:
        at = cuts[t.name].index(t.threshold)
        return F.col(t.name) > at if t.above else F.col(t.name) <= at

    def meets(rule: tuple[Test, ...]) -> Column:
        out = F.lit(True)
        for t in rule:
            out = out & test_filter(t)
        return out

    def table_of(df: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        """bad and good by statistic and bin."""
        each = df.select("bad", "good", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("b")) for n in names])).alias("x"))
        out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in each.groupBy("x.n", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
            out[r.n][r.b] = (r.bad, r.good)
        return out

    def best(df: DataFrame) -> Test | None:
        """The test with the most gain of information over what the rule covers so far."""
        counts = table_of(df)
        bad, good = (sum(x[i] for x in counts[names[0]].values()) for i in (0, 1))
        if not bad or not good:
            return None
        start, found, most = math.log2(bad / (bad + good)), [], 1e-9
        for n in names:
            for at, cut in enumerate(cuts[n]):
                lo = [sum(x[i] for b, x in counts[n].items() if b <= at) for i in (0, 1)]
                for above, (p, q) in ((False, lo), (True, (bad - lo[0], good - lo[1]))):
                    if p >= least and (gain := p * (math.log2(p / (p + q)) - start)) >= most:
                        found = [x for x in found if gain == most] + [Test(n, above, cut)]
                        most = gain
        same = [x for x in found if (x.name, x.above) == (found[0].name, found[0].above)]
        return same[len(same) // 2] if same else None  # the middle of cuts that part the documents alike

    def score(df: DataFrame, rules: list[tuple[Test, ...]]) -> list[tuple[int, int]]:
        """(bad, good) that each rule covers, in one pass."""
        r = df.agg(*[F.coalesce(F.sum(F.when(meets(x), F.col(c))), F.lit(0)).alias(f"{c}{i}") for i, x in enumerate(rules) for c in ("bad", "good")]).first()
        return [(r[f"bad{i}"], r[f"good{i}"]) for i in range(len(rules))]

    rules: list[tuple[Test, ...]] = []
    left = cells
    while len(rules) < max_rules:
        grow, prune = left.filter("NOT held"), left.filter("held")
        rule: tuple[Test, ...] = ()
        while len(rule) < max_tests and (t := best(grow.filter(meets(rule)))):
            rule += (t,)
        if not rule:
            break
        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in score(prune, shorter)]
        rule = shorter[worth.index(max(worth))]
        (p, q), (hp, hq) = score(grow, [rule])[0], score(prune, [rule])[0]
        if p < least or p < precision * (p + q) or hp < precision * (hp + hq):
            break
        rules.append(rule)
        left = left.filter(~meets(rule))
    return DecisionList(tuple(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """document_statistics of every row of docs with base_failed and kept.

    labels (doc_id, quality): 1 good, 0 bad. kept is false where the base rules
    fail, else what the list learned from the labelled documents that pass them
    says. Null and empty texts fail the base rules. Repeated rows are judged
    alike; null doc_ids have no label; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.write(document_statistics(docs), "statistics")
    marked = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label")).filter("label IS NOT NULL AND labelled_id IS NOT NULL")
    known = stats.filter(f"NOT ({BASE_FAILED})").join(marked, F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")
    rules = learn(known, **settings)
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & F.expr(rules.kept))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
