"""Block programs over streams of readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.program import compile_program, fold, numbered, read_program


def program_sink(workspace: str | dict, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: runs a program on each micro-batch of
    ``device, tick, reads, waits``, and goes on from the state that the batch before
    left.

    ``folder`` gets the actions under ``actions/batch=<n>`` and each batch's states
    under ``states/<n>``. Both are overwritten if a batch is repeated, so a restart
    from the stream's checkpoint neither loses nor doubles actions. A device's
    readings must come in order of batches; inside one, ticks are sorted.
    """
    compiled: list = []

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not compiled:
            compiled.append(compile_program(read_program(workspace)))
        before = spark.read.parquet(f"{folder}/states/{number - 1}") if number else None
        path = f"{folder}/folded/{number}"
        fold(batch, compiled[0], before).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        numbered(done).write.mode("overwrite").parquet(f"{folder}/actions/batch={number}")
        states = done.select("device", "state")
        if before is not None:
            states = states.unionByName(before.join(states, "device", "left_anti"))
        states.write.mode("overwrite").parquet(f"{folder}/states/{number}")

    return run


def actions(spark, folder: str) -> DataFrame:
    """All actions so far."""
    return spark.read.parquet(f"{folder}/actions").drop("batch")


def totals_by_device(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Readings and their sum per device and five minutes, for a stream with ``ts``
    and ``value``; rows later than ``delay`` are not counted."""
    late = readings.withWatermark("ts", delay)
    out = late.groupBy("device", F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("device", F.col("w.start").alias("start"), "n", "total")
