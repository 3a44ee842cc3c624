"""Mixing sources to target weights.

Each document gets a hash-random key, of its id and text. Within its source the keys are dealt to
ranges of equal width, so a source of any size becomes many sorted ranges of
bounded size; running sums within the ranges and over the ranges' totals give
each document the tokens before it. A source takes whole epochs while its target
allows and then documents in key order up to the exact budget, the last one in
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANGE_ROWS = 4096
_SPACE = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != ""))).cast("long")


def before_in_order(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """rows with the sums of what stands before each in an order, as columns.

    Rows are dealt to sorted ranges; sums run within the ranges and over the
    ranges' totals, one row a range, so no task has all rows. The order must
    tell all rows apart.
    """
    given = rows.columns
    keys = {f"_k{i}": x for i, x in enumerate(order)}
    ranged = rows.withColumns({**keys, **{f"_x_{k}": v for k, v in sums.items()}})
    ranged = scratch.write(ranged.repartitionByRange(*[F.asc_nulls_last(k) for k in keys]).withColumn("_range", F.spark_partition_id()), name)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    totals = totals.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    within = Window.partitionBy("_range").orderBy(*[F.asc_nulls_last(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_x_{k}").over(within), F.lit(0)) for k in sums})
    return inside.join(totals, F.col("_range") == F.col("_r")).select(*given, *[(F.col(f"_b_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, of which there may be any number.

    Sources in code-point order, null last, weigh `weights` in turn. Filling up
    to one common level (tokens a unit of weight) with each source stopped at
    `most` times its size is what resharing the excess comes to. Taken in order
    of the level at which they are full, each stopped source raises the level
    of the others and each that is not would lower it: the highest is the one.
    """
    rows = before_in_order(sizes.select("source", "source_size"), [F.col("source")], {"place": F.lit(1)}, scratch, "ranked")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = rows.select("source", "source_size", pick.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = scratch.write(before_in_order(rows, [F.col("cap") / F.col("w"), F.col("source")], {"cap_before": F.col("cap"), "w_before": F.col("w")}, scratch, "filled"), "caps")
    every = rows.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    left = F.col("all_size") * F.lit(share) - F.col("cap_before")
    level = rows.join(F.broadcast(every)).agg(F.max(left / (F.col("all_w") - F.col("w_before"))).alias("level"))
    return rows.join(F.broadcast(level)).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix_plan(docs: DataFrame, *, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs and part of every row of docs (doc_id, text, source).

    taken = epochs * size + part, where part (at most size) is what the last,
    partial epoch takes of the document. Null and empty texts have size 0 and
    are never taken; null sources are one source, last in order; ties of key and
    repeated rows are ordered by size, and equal rows share what is due to them
    in some order. An empty table gives no rows. Null doc_ids have one key. The
    result depends on the rows only, never on their order or partitioning.
    """
    return _plan(docs, size, weights, share, most, range_rows).drop("key")


def _key() -> Column:
    """The hash-random key of a row, of its id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _plan(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of mix_plan with their keys."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = n_words(F.col("text").cast("string")) if size is None else size
    rows = docs.select("doc_id", "source", size.cast("long").alias("size"), _key().alias("key"))
    rows = scratch.write(rows, "sized")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = scratch.write(totals, "totals")
    targets = source_targets(totals.select("source", "source_size"), scratch, weights=weights, share=share, most=most)
    ranges = F.ceil(F.col("n") / range_rows).cast("long")
    plan = totals.select(F.col("source").alias("s"), "n").withColumn("ranges", ranges).join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s", "n")
    plan = scratch.write(plan, "plan").withColumnRenamed("source", "s")
    # A range number goes with the source from here on: (source, range) is bounded whatever the source's share.
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32))).cast("long")
    rows = rows.join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("range", place)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("s").eqNullSafe(F.col("source")) & (F.col("r") == F.col("range")))
    due = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("rest", due - F.col("epochs") * F.col("source_size") - F.col("base") - F.col("inside"))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least("rest", "size")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", "key")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows that the mix takes: each as often as it has whole epochs, and the last one of a source in part.

    A document taken in part is cut to its first words, joined by blanks, and
    n_chars, if there, follows. Rows of size 0 are not taken. Rows are met with
    the plan by source and key, so rows without doc_id and different texts of
    one doc_id are taken as planned; rows alike in source, doc_id and text are
    each taken as the one of them that the plan takes most of.
    """
    epochs, part, size, copy, key, same, of = (free_name(docs, x) for x in ("epochs", "part", "size", "copy", "key", "same", "of"))
    plan = _plan(docs, **settings).filter("taken > 0").groupBy(F.col("key").alias(same), F.col("source").alias(of)).agg(F.max("epochs").alias(epochs), F.max("part").alias(part), F.max("size").alias(size))
    copies = F.col(epochs) + F.when(F.col(part) > 0, 1).otherwise(0)
    met = docs.withColumn(key, _key()).join(plan, (F.col(key) == F.col(same)) & F.col("source").eqNullSafe(F.col(of)))
    rows = met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col(copy) > F.col(epochs)) & (F.col(part) < F.col(size))
    words = F.filter(F.split("text", f"[{_SPACE}]+"), lambda w: w != "")
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col(part).cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
    WITH sized AS (
        SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
               md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
        FROM documents),
    totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
        FROM totals),
    filled AS (
        SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0.0::DOUBLE) AS rest,
               sum(w) OVER () - coalesce(sum(w) OVER f, 0.0::DOUBLE) AS open_w
        FROM weighed
        WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT max(rest / open_w) AS level FROM filled),
    targets AS (SELECT source, source_size, least(cap, level * w) AS target, CAST(floor(least(cap, level * w)) AS BIGINT) AS due FROM filled, level),
    placed AS (
        SELECT s.doc_id, s.size, t.source_size, t.target, t.due,
               CASE WHEN t.source_size > 0 THEN t.due // t.source_size ELSE 0 END AS epochs,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(due - epochs * source_size - before, size)) AS BIGINT) AS taken
    FROM placed
"""
