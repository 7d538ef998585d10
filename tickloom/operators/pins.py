"""Pins whose mode decides what a read gives.

A board keeps two things for each pin: the mode asked for by the last ``mode`` row, which
reads use, and the mode in which the pin was last opened. A write opens its pin for output,
and the next read opens it again in the mode asked for. All of this is the last value of
rows before, so it is scanned at two levels (``ticks.scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ticks import scan

# The modes of a pin, and the mode of reads before any is asked for.
OUT, IN, PULLUP = "out", "in", "pullup"
UNASKED = IN


def mode_name(asked: Column) -> Column:
    """``in`` and ``pullup`` are themselves; all else, null included, is ``out``."""
    return F.when(asked.isin(IN, PULLUP), asked).otherwise(F.lit(OUT))


def accesses(df: DataFrame, device: str, pin: str, order: Sequence[str], span: Column, kind: Column, asked: Column, written: Column, signal: Column) -> DataFrame:
    """``df`` with ``mode``, the mode in which the row uses its pin, ``opened``, whether the
    pin is made anew for that, and ``level``, what a read gives (null for other rows).

    ``kind`` is ``mode`` (to ``asked``), ``write`` (of ``written``) or ``read``; other rows
    leave the pin alone and have null in all three. ``signal`` is the level at the pin, null
    if nothing is connected: then a pull-up reads 1 and an input 0. An output reads what was
    written last, 0 before any write (a null ``written`` is 0 too). ``order`` must be total
    by device and pin; ``span`` must grow with it and cuts a busy pin's rows into ranges.
    A null device or pin is one like the others. An empty table stays empty."""
    changes = {
        "__asked": F.when(kind == "mode", F.struct(*order, mode_name(asked).alias("v"))),
        "__put": F.when(kind == "write", F.struct(*order, F.coalesce(written.cast("bigint"), F.lit(0)).alias("v"))),
    }
    df = df.withColumns({"__id": F.struct(device, pin), "__range": span, "__kind": kind, "__signal": signal})
    df = scan(df, "__id", order, F.col("__range"), maxima=changes)
    asked_for = F.coalesce(F.col("__asked.v"), F.lit(UNASKED))
    df = df.withColumn("mode", F.when(F.col("__kind") == "write", OUT).when(F.col("__kind").isin("mode", "read"), asked_for))
    last = F.when(F.col("mode").isNotNull(), F.struct(*order, F.col("mode").alias("v")))
    df = scan(df, "__id", order, F.col("__range"), maxima={"__open": last}, exclusive=True)
    signal_level = F.when(F.col("__signal").isNull(), F.when(F.col("mode") == PULLUP, 1).otherwise(0)).otherwise(F.when(F.col("__signal") != 0, 1).otherwise(0))
    level = F.when(F.col("mode") == OUT, F.coalesce(F.col("__put.v"), F.lit(0))).otherwise(signal_level)
    df = df.withColumns({
        "opened": F.when(F.col("mode").isNotNull(), ~F.col("__open.v").eqNullSafe(F.col("mode"))),
        "level": F.when(F.col("__kind") == "read", level.cast("bigint")),
    })
    return df.drop("__id", "__range", "__kind", "__signal", "__asked", "__put", "__open")


def open_modes(df: DataFrame, device: str, pin: str, order: Sequence[str]) -> DataFrame:
    """The mode in which each pin of each device was used last, and how often it was made
    anew, from rows of ``accesses``. Rows are added up before they are shuffled."""
    used = df.where(F.col("mode").isNotNull())
    return used.groupBy(device, pin).agg(F.max_by("mode", F.struct(*order)).alias("mode"), F.sum(F.col("opened").cast("bigint")).alias("times_opened"))
