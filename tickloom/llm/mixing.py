"""Mixing sources to target weights.

Documents get hash-random keys. Within each source the key space is cut into
ranges of about ``ROWS_PER_RANGE`` rows, so that a source with a third of all rows
is sorted by many tasks. Word counts are summed per range, the ranges' sums give
offsets, and a running sum inside each range completes the distributed prefix sum.
A source takes its documents as many whole times as its budget holds, and then, in
key order, exactly the words that are left. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, columns_of, fresh, read, stored, text_of

ROWS_PER_RANGE = 4096
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(col: Column | str) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def hash_key(id_col: Column | str, seed: str = SEED) -> Column:
    """32 hex digits, uniform; a rerun gives the same."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))


def source_key(source: Column | str) -> Column:
    """Sorts by code point, null last; never null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``skey, n_docs, source_size, target`` from rows ``skey, size``.

    Sources in order of ``skey`` weigh ``weights``, repeating. They share the sum
    of all sizes by weight; a target stops at ``max_epochs`` times its source's
    size and the excess is shared again. A source is at its limit if and only if
    all sources with a smaller limit per weight are, so one ordered pass finds
    them. It is a table of one row per source, never of documents.
    """
    per = sizes.groupBy("skey").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    at = (F.row_number().over(W.orderBy("skey")) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (at + 1).cast("int")))
    per = per.withColumn("lim", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("lim").cast("double") / F.col("w"), "skey")
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    exact = "decimal(38,0)"
    per = (
        per.withColumn("t", F.sum("source_size").over(everything) - F.coalesce(F.sum("lim").over(ahead), F.lit(0)))
        .withColumn("wr", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0)))
        .withColumn("full", F.col("w").cast(exact) * F.col("t").cast(exact) > F.col("lim").cast(exact) * F.col("wr").cast(exact))
    )
    left = F.max(F.when(~F.col("full"), F.col("t"))).over(everything)
    weight = F.max(F.when(~F.col("full"), F.col("wr"))).over(everything)
    share = F.col("w").cast("double") * left.cast("double") / weight.cast("double")
    target = F.when(F.col("full"), F.col("lim").cast("double")).otherwise(F.least(share, F.col("lim").cast("double")))
    return per.select("skey", "n_docs", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, skey, key, size, source_size, target,
    epochs, rest``. A document is taken ``epochs`` whole times and then its first
    ``rest`` words; the sum over a source is the whole part of its target.

    A null text has no words. Null is a source of its own, after all others.
    Sources without words have target 0. Rows with the same id share a key and are
    taken one after the other, the shorter first. Other columns are ignored.
    """
    sizes = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source_key(source_col).alias("skey"),
            hash_key(id_col, seed).alias("key"),
            word_count(text_col).alias("size"),
        ),
        "mix-sizes",
    )
    targets = stored(
        source_targets(sizes, weights, max_epochs)
        .withColumn("goal", F.floor("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("goal") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n_docs") / rows_per_range).cast("long")),
        "mix-targets",
    )
    small = broadcast_if_small(targets.select("skey", "ranges"))
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = sizes.join(small, "skey").withColumn("range", F.shiftright(high * F.col("ranges"), 32)).drop("ranges")
    before = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("skey", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .drop("range_size")
        .join(targets.select("skey", "source_size", "target", "epochs", "left"), "skey")
    )
    within = W.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("upto", F.sum("size").over(within))
        .join(ranges, ["skey", "range"])
        .select(
            "doc_id",
            "skey",
            "key",
            "size",
            "source_size",
            "target",
            "epochs",
            F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("offset") - F.col("upto") + F.col("size"))).cast("long").alias("rest"),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``docs`` with all their columns: a document appears once
    for each time it is taken. The one document per source that the budget cuts is
    taken whole if at least half of it is in the budget. The plan is reduced to one
    cut per source, so texts are not shuffled. Nulls, ties and repeated rows count as in
    ``plan_mix``; nothing of ``docs`` is overwritten by names that clash."""
    plan = plan_mix(docs, **options)
    last = F.struct("key", "doc_id", (F.col("rest") * 2 >= F.col("size")).alias("whole"))
    skey, epochs, cut, times, time = fresh(docs, "skey", "epochs", "cut", "times", "time")
    cuts = stored(
        plan.groupBy(F.col("skey").alias(skey)).agg(F.max("epochs").alias(epochs), F.max(F.when(F.col("rest") > 0, last)).alias(cut)),
        "mix-cuts",
    )
    id_col, seed = options.get("id_col", "doc_id"), options.get("seed", SEED)
    here = F.struct(hash_key(id_col, seed).alias("key"), F.col(id_col).alias("doc_id"))
    end = F.struct(F.col(cut)["key"].alias("key"), F.col(cut)["doc_id"].alias("doc_id"))
    once_more = F.col(cut).isNotNull() & ((here < end) | ((here == end) & F.col(cut)["whole"]))
    return (
        docs.withColumn(skey, source_key(options.get("source_col", "source")))
        .join(broadcast_if_small(cuts), skey)
        .withColumn(times, (F.col(epochs) + F.when(once_more, 1).otherwise(0)).cast("int"))
        .where(F.col(times) > 0)
        .withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*columns_of(docs))
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    plan = plan_mix(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


SQL = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS lim,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS BIGINT) AS w
  FROM d GROUP BY skey
), r AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS HUGEINT) AS t,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS HUGEINT) AS wr
  FROM s
  WINDOW o AS (ORDER BY CAST(lim AS DOUBLE) / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, w * t > lim * wr AS capped FROM r
), g AS (
  SELECT skey, source_size,
         CASE WHEN capped THEN CAST(lim AS DOUBLE)
              ELSE least(CAST(w AS DOUBLE) * CAST(max(CASE WHEN NOT capped THEN t END) OVER () AS DOUBLE)
                         / CAST(max(CASE WHEN NOT capped THEN wr END) OVER () AS DOUBLE), CAST(lim AS DOUBLE)) END AS target
  FROM f
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS goal,
         CAST(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.key, d.doc_id, d.size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN g USING (skey)
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (goal // source_size) * size
                 + greatest(0, least(size, goal - (goal // source_size) * source_size - upto + size)) END AS taken
FROM p
"""
}
QUERIES = {"op5_mixing": op5_mixing}
