"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within a source the keys put the documents in a random order that any rerun
repeats; fixed ranges of the key split a source into buckets of a few thousand documents, so that a source with a third
of all rows is still sorted and summed by many tasks. A bucket's words are summed first (map-side), prefix sums over
buckets give each bucket's offset, and a running sum inside the bucket finishes each document's position. The position
is compared with the source's budget: whole epochs first, then the remainder, cut at the exact word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, text_or_empty, word_count

#: Documents in a bucket, about: what one task sorts.
BUCKET_ROWS = 4096
#: Copies of a row that are made at once.
COPIES = 65_536


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, ...) -> the same with rank and target.

    Sources in code point order, null last, take the weights in turn. They share the words of all sources by weight; no
    target exceeds max_repeat times its source's size, and what is over is shared again by weight among the rest. That
    fixed point is a water level: in order of (cap / weight) sources are capped as long as the level reaches their cap.
    One row per source; a source without words gets target 0.
    """
    everything = Window.partitionBy()
    upward = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size").cast("double") * max_repeat)
        .withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= (F.col("all_words") - F.col("cap_before")) * F.col("weight"))
        .withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("all_words") - F.col("cap_sum")) * F.col("weight") / F.col("free_weight")))
        .drop("weight", "cap", "all_words", "all_weight", "cap_before", "weight_left", "capped", "cap_sum", "free_weight")
    )


def sort_key(seed: str, doc_col: str, text_col: str) -> Column:
    """The hash-random key of a document: by its id, or by its text where it has none."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_col).cast("string"), F.md5(text_or_empty(text_col)))))


def positions(docs: DataFrame, weights: Sequence[float], max_repeat: int, seed: str, doc_col: str, text_col: str, source_col: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Documents with `before`, the words ahead of them in their source's order, and the sources with their budgets.
    Equal rows are one row with their number n, so a document repeated any number of times is no bucket of its own."""
    slim = docs.select(F.col(doc_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), sort_key(seed, doc_col, text_col).alias("key"))
    rows = cut(slim.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count("*").alias("n_rows"))
    sources = cut(
        source_targets(sizes, weights, max_repeat)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_buckets", F.ceil(F.col("n_rows") / bucket_rows))
        .withColumnRenamed("source", "of_source")
    )
    rows = rows.join(small_side(sources), F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n_buckets") / F.lit(1 << 32))
    )
    sums = rows.groupBy("rank", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("bucket_size"))
    ahead = F.sum("bucket_size").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("bucket_size")
    offsets = sums.select("rank", "bucket", ahead.alias("offset"))
    words = F.col("n") * F.col("size")
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(offsets, ["rank", "bucket"]).withColumn("before", F.col("offset") + F.sum(words).over(inside) - words), sources


def mix(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix", doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document, repeats counted).

    Per source the taken words add up to the rounded target. Null or empty texts have size 0 and nothing taken; a null
    source is a source of its own; rows that repeat an id are rows of their own, equal rows interchangeable; an empty
    table gives an empty result; other columns are ignored.
    """
    rows, _ = positions(docs, weights, max_repeat, seed, doc_col, text_col, source_col, bucket_rows)
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    rows = rows.select("*", some.alias("first")).select("*", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, F.col("n")) - 1)).alias("copy"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.col("copy") * F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix", doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it: whole documents with docs' own columns.

    The one document of a source at which its budget ends stays whole if at least half of it is within the budget.
    Texts are not shuffled: a source's place in its order at which the budget ends is one row, and each document
    compares its own key with it. Documents without words are in no mix. Rows that repeat an id and a text count at
    the same place in the order, so at the end of a budget they stay or go together. Columns of any names are carried along.
    """
    rows, sources = positions(docs, weights, max_repeat, seed, doc_col, text_col, source_col, bucket_rows)
    at_end = (F.col("size") > 0) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") * F.col("size") >= F.col("rest"))
    ends = rows.where(at_end).groupBy("rank").agg(
        F.min(F.struct("key", "size", (2 * (F.col("rest") - F.col("before")) >= F.col("n") * F.col("size")).alias("stays"))).alias("end")
    )
    budgets = cut(sources.join(ends, "rank", "left").select("of_source", "epochs", "end"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(row.alias("row"), F.col(source_col).alias("source"), sort_key(seed, doc_col, text_col).alias("key"), word_count(text_or_empty(text_col)).alias("size"))
    place, end = F.struct("key", "size"), F.struct("end.key", "end.size")
    copies = F.col("epochs") + F.when(F.col("end").isNull(), 0).when(place < end, 1).when((place == end) & F.col("end.stays"), 1).otherwise(0)
    placed = own.where("size > 0").join(small_side(budgets), F.col("source").eqNullSafe(F.col("of_source")))
    return placed.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s),
w AS (SELECT *, CAST(1 + (rk - 1) % 3 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
p AS (SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before
      FROM w WINDOW o AS (ORDER BY cap / weight, rk)),
c AS (SELECT *, cap * weight_left <= (total - cap_before) * weight AS capped FROM p),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN cap
                  ELSE (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * weight / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
      FROM c),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, rest - pos)) AS BIGINT) AS taken FROM x
"""
