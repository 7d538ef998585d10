"""Event-time windows over a stream that keep what comes too late, and a join of streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _duration(text: str) -> Column:
    return F.expr(f"INTERVAL '{text}'")


def window_sink(folder: str, keys: Sequence[str], at: str, width: str, delay: str, sums: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: the rows' number and ``sums`` by ``keys`` and by windows
    of ``width`` (as ``5 minutes``) of their time ``at``.

    A micro-batch is held against the watermark that the batches before it left, ``delay`` before the
    latest time seen, and its order does not matter. A row whose window ends at or before that
    goes whole into ``late``, as does one without a time; the others are added up and merged
    into the open windows; those that the new watermark closes go to ``closed`` once and
    for all. Null keys are a group.

    ``folder`` gets ``late``, ``closed``, ``open`` and ``marks``, each with a part for every batch.
    Parts are overwritten if a batch is repeated and only read by the next one, so a restart
    from the stream's checkpoint neither loses nor doubles rows. A batch rewrites the open
    windows alone, whose number the delay bounds, not the rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[at].dataType
        read = lambda what: spark.read.parquet(f"{folder}/{what}/batch={number - 1}")
        seen = read("marks").first()["seen"] if number else None  # one row
        # ``window`` leaves out rows without a time.
        none = batch.where(F.col(at).isNull()).withColumn("__start", F.lit(None).cast(kind))
        rows = batch.withColumn("__start", F.window(F.col(at), width).start).unionByName(none).persist()
        try:
            mark = (F.lit(seen).cast(kind) - _duration(delay)) if seen is not None else F.lit(None).cast(kind)
            late = F.coalesce(F.col("__start") + _duration(width) <= mark, F.col(at).isNull())
            rows.where(late).withColumnRenamed("__start", "start").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
            parts = rows.where(~late).groupBy(*keys, F.col("__start").alias("start")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(s) for s, c in sums.items()])
            if number:
                parts = parts.unionByName(read("open"))
            merged = parts.groupBy(*keys, "start").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
            now = rows.agg(F.greatest(F.max(at), F.lit(seen).cast(kind)).alias("seen"))
            now.write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
            seen = spark.read.parquet(f"{folder}/marks/batch={number}").first()["seen"]
            over = F.coalesce(F.col("start") + _duration(width) <= F.lit(seen).cast(kind) - _duration(delay), F.lit(False))
            merged.where(over).write.mode("overwrite").parquet(f"{folder}/closed/batch={number}")
            merged.where(~over).write.mode("overwrite").parquet(f"{folder}/open/batch={number}")
        finally:
            rows.unpersist()

    return run


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came too late, with their window's ``start`` and their ``batch``."""
    return spark.read.parquet(f"{folder}/late")


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows that are over, with the ``batch`` that closed them."""
    return spark.read.parquet(f"{folder}/closed")


def open_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows that still take rows, after the last batch."""
    last = spark.read.parquet(f"{folder}/marks").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/open/batch={last}")


def followed(first: DataFrame, then: DataFrame, key: str, at: str, within: str, delay: str, ids: tuple[str, str]) -> DataFrame:
    """Pairs ``ids`` of a row of one stream and a row of another with the same ``key`` that is
    at the same time or later, by ``within`` at most. Both sides are kept in the state until
    the watermark shows that no partner can come; a row later than ``delay`` may find none."""
    a = first.withWatermark(at, delay).select(F.col(key).alias("__key"), F.col(at).alias("__first"), F.col(ids[0]).alias("first_id"))
    b = then.withWatermark(at, delay).select(F.col(key).alias(key), F.col(at).alias("__then"), F.col(ids[1]).alias("then_id"))
    near = (F.col("__key") == F.col(key)) & (F.col("__then") >= F.col("__first")) & (F.col("__then") <= F.col("__first") + _duration(within))
    return a.join(b, near).select(key, "first_id", "then_id")
