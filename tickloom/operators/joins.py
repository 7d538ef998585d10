"""Joins by time. They are no operators of block programs: they are for tables of
readings beside other tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ticks import UPTO


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, span: Column, tie: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` that has the same ``key`` and
    is not after it (``at``); nulls where there is none. Of right rows at the same time
    the last by ``tie`` counts.

    Both tables are merged and each row takes the last right row before it: inside
    ranges of time, and from the last range that has one. ``span`` is of both tables'
    ``at`` and grows with it, so a key with a third of all rows is spread over as many
    tasks as it has ranges. Left rows without key or time stay and find nothing; such
    right rows are never found. Repeated left rows stay each.
    """
    found = F.struct(F.col(at).alias("__at"), *[F.col(c).alias(f"__{c}") for c in tie], *[F.col(c) for c in columns if c not in tie])
    there = F.col(key).isNotNull() & F.col(at).isNotNull()
    rows = right.where(there).select(F.col(key).alias("__key"), F.col(at).alias("__time"), span.alias("__span"), F.lit(0).alias("__side"), found.alias("__found"))
    asks = left.where(there).select(F.col(key).alias("__key"), F.col(at).alias("__time"), span.alias("__span"), F.lit(1).alias("__side"), F.struct("*").alias("__row"))
    both = rows.unionByName(asks, allowMissingColumns=True)
    # Right rows come before left ones of the same time; of those, the largest by tie last.
    local = W.partitionBy("__key", "__span").orderBy("__time", "__side", "__found").rowsBetween(*UPTO)
    both = both.withColumn("__here", F.last("__found", ignorenulls=True).over(local))
    ranges = rows.groupBy("__key", "__span").agg(F.max("__found").alias("__last"))
    # A range that only has left rows needs the last one before it too.
    ranges = both.select("__key", "__span").distinct().join(ranges, ["__key", "__span"], "left")
    ahead = F.last("__last", ignorenulls=True).over(W.partitionBy("__key").orderBy("__span").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumn("__ahead", ahead).select("__key", "__span", "__ahead")
    out = both.where("__side = 1").join(ranges, ["__key", "__span"]).withColumn("__found", F.coalesce("__here", "__ahead"))
    pick = [F.col(f"__found.`__{c}`" if c in tie else f"__found.`{c}`").alias(c) for c in columns]
    out = out.select("__row.*", *pick)
    none = left.where(~there).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    return out.unionByName(none)


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str, end: str, ids: tuple[str, str], width: int) -> DataFrame:
    """Pairs ``ids`` of rows of both tables with the same ``key`` whose intervals, from
    ``start`` to before ``end`` (numbers), share a point. Each pair is there once for each
    pair of rows.

    Intervals are put into all bins of ``width`` that they touch and meet by key and bin,
    in an equi join. A pair belongs to the bin in which the later of both starts, which
    both touch, so that it is found once although it shares more bins. Heavy bins are split by the
    engine's skew join. Null bounds, null keys and empty intervals overlap nothing.
    """

    def binned(df: DataFrame, name: str, mark: str) -> DataFrame:
        low, high = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
        bins = F.explode(F.when(F.col(start) < F.col(end), F.sequence(low, high))).alias("__bin")
        return df.select(F.col(key).alias("__key"), F.col(start).cast("bigint").alias(f"{mark}_start"), F.col(end).cast("bigint").alias(f"{mark}_end"), F.col(name).alias(f"{mark}_id"), bins)

    a, b = binned(left, ids[0], "__a"), binned(right, ids[1], "__b")
    pairs = a.join(b, ["__key", "__bin"]).where((F.col("__a_start") < F.col("__b_end")) & (F.col("__b_start") < F.col("__a_end")))
    owner = F.floor(F.greatest("__a_start", "__b_start") / width)
    return pairs.where(F.col("__bin") == owner).select(F.col("__key").alias(key), F.col("__a_id").alias("left_id"), F.col("__b_id").alias("right_id"))
