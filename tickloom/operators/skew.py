"""Equi joins of which a few keys hold much of a side: only these are split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("inner", "left", "left_semi", "left_anti")
#: A key is heavy from this part of an even task's rows on.
PART = 4


def _known(on: Sequence[str]) -> Column:
    """Whether no key is null."""
    out = F.lit(True)
    for c in on:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def _mark(on: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in on])


def heavy(df: DataFrame, on: Sequence[str], share: float) -> dict[int, float]:
    """Hashes of the keys that hold at least ``share`` of the rows with a key, with about
    what they hold. One scan of the keys with a sketch of frequent items for each task,
    which are merged; the counts are too high by at most ``share / 2`` of all rows and
    never too low, so no such key is missing, every one has at least ``share / 2``, and
    there are at most ``2 / share``, at any size."""
    tracked = math.ceil(7 / share)  # a sketch of m places is off by at most 3.5 / m of the rows
    keys = df.where(_known(on)).select(_mark(on).alias("mark"))
    seen = keys.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(mark, {tracked}, {tracked})").alias("top"))
    row = seen.select("n", F.filter("top", lambda x: x["count"] >= F.col("n") * share).alias("top")).first()
    return {x["item"]: x["count"] / row["n"] for x in row["top"]}


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", share: float | None = None, spread: Column | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for ``how`` of ``KINDS``, with heavy keys in pieces.

    A key of the left side with several times ``share`` of its rows (by default a quarter
    of what an even task gets) is dealt over as many pieces, and the right rows of that
    key go to each of them. In an inner join the right side is dealt in the same way, so
    a key that is heavy in both meets in a grid and each pair once. Semi and anti joins only send each
    right key once. Other keys are joined as they are. Rows are dealt by ``spread``, by
    default a hash of the whole row, so that a repeated task deals alike; equal rows then
    stay together, and where many are, ``spread`` should be an identifier.

    Null keys match nothing; left and anti joins keep their rows, spread over all tasks.
    """
    if how not in KINDS:
        raise ValueError(f"{how} is none of {', '.join(KINDS)}")
    kinds = [(left.schema[c].dataType, right.schema[c].dataType) for c in on]
    if any(a != b for a, b in kinds):
        raise ValueError("the keys of both sides differ in type")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = share or 1 / (PART * tasks)
    if how in ("left_semi", "left_anti"):
        right = right.select(*[F.col(f"`{c}`") for c in on]).distinct()
    a = heavy(left, on, share)
    b = heavy(right, on, share) if how == "inner" else {}
    pieces = [(mark, *(math.ceil(side[mark] / share) if mark in side else 1 for side in (a, b))) for mark in sorted(a.keys() | b.keys())]
    known = left.sparkSession.createDataFrame(pieces, "__mark long, __as int, __bs int")  # at most 4 / share rows

    def dealt(df: DataFrame, mine: str, n: str, other: str, copies: str, lonely: int) -> DataFrame:
        cols = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        by = spread if spread is not None and mine == "__a" else F.xxhash64(*cols)
        df = df.withColumns({"__by": F.xxhash64(by), "__mark": _mark(on)}).join(F.broadcast(known), "__mark", "left")
        many = F.when(_known(on), F.coalesce(n, F.lit(1))).otherwise(lonely)
        df = df.withColumn(mine, F.pmod("__by", many))
        each = F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1)
        return df.withColumn(other, F.explode(each)).drop("__by", "__mark", "__as", "__bs")

    lefts = dealt(left, "__a", "__as", "__b", "__bs", PART * tasks)
    rights = dealt(right, "__b", "__bs", "__a", "__as", 1)
    return lefts.join(rights, [*on, "__a", "__b"], how).drop("__a", "__b")
