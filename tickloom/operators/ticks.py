"""Operators over ordered readings of many devices.

Running values are associative, so they are scanned at two levels: inside ranges of
each device's time, and over the ranges. A device with a third of all rows is thus
spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPTO = (W.unboundedPreceding, W.currentRow)
BEFORE = (W.unboundedPreceding, -1)


def scan(df: DataFrame, key: str, order: Sequence[str], span: Column, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, exclusive: bool = False) -> DataFrame:
    """Running sums and maxima by ``key``, in ``order``. ``span`` grows with the
    order and cuts each key's rows into ranges. ``exclusive`` leaves the row's own
    value out, and 0 or null stands at the start."""
    values = (sums or {}) | (maxima or {})
    df = df.withColumns({"__span": span} | {f"__{n}": c for n, c in values.items()})
    ranges = df.groupBy(key, "__span").agg(*[(F.sum if n in (sums or {}) else F.max)(f"__{n}").alias(f"__{n}_all") for n in values])
    ahead = W.partitionBy(key).orderBy("__span").rowsBetween(*BEFORE)
    ranges = ranges.select(key, "__span", *[(F.sum if n in (sums or {}) else F.max)(f"__{n}_all").over(ahead).alias(f"__{n}_ahead") for n in values])
    local = W.partitionBy(key, "__span").orderBy(*order).rowsBetween(*(BEFORE if exclusive else UPTO))
    for n in values:
        df = df.withColumn(f"__{n}_here", (F.sum if n in (sums or {}) else F.max)(f"__{n}").over(local))
    df = df.join(ranges, [key, "__span"])
    out = {}
    for n in values:
        here, ahead_of = F.col(f"__{n}_here"), F.col(f"__{n}_ahead")
        out[n] = F.coalesce(here, F.lit(0)) + F.coalesce(ahead_of, F.lit(0)) if n in (sums or {}) else F.greatest(here, ahead_of)
    df = df.withColumns(out)
    return df.drop("__span", *[f"__{n}{e}" for n in values for e in ("", "_all", "_ahead", "_here")])


def accumulate(df: DataFrame, key: str, order: Sequence[str], span: Column, delta: Column, name: str = "total") -> DataFrame:
    """``change variable by delta``."""
    return scan(df, key, order, span, sums={name: delta})


def clock(df: DataFrame, key: str, order: Sequence[str], span: Column, sleep_ms: Column, name: str = "t_ms") -> DataFrame:
    """Virtual time at each row: the sleeps of all rows before it."""
    return scan(df, key, order, span, sums={name: sleep_ms}, exclusive=True)


def until_break(df: DataFrame, key: str, order: Sequence[str], span: Column, broken: Column) -> DataFrame:
    """The rows of each device before the first at which ``broken`` holds."""
    return scan(df, key, order, span, maxima={"__broke": broken.cast("int")}).where("__broke = 0").drop("__broke")


def repeat(df: DataFrame, times: Column, name: str = "i") -> DataFrame:
    """Each row ``times`` times; none for 0 or less."""
    return df.withColumn(name, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1))))


def continue_when(rounds: DataFrame, condition: Column) -> DataFrame:
    """The rounds that do not ``continue``; what comes after is for these only. A null
    condition is false."""
    return rounds.where(~F.coalesce(condition, F.lit(False)))


def start_and_loop(df: DataFrame, key: str, order: Sequence[str], loops: str = "loops") -> DataFrame:
    """Each device's first row in ``order``, at which its start runs, and how many rows it
    has, at each of which its loop runs. Rows are added up before they are shuffled."""
    first = F.min(F.struct(*order)).alias("first")
    return df.groupBy(key).agg(first, F.count(F.lit(1)).alias(loops)).select(key, "first.*", loops)


def wait_until(df: DataFrame, key: str, order: Sequence[str], condition: Column, *columns: str) -> DataFrame:
    """Each device's first row at which ``condition`` holds; no row if none does."""
    first = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("first")
    return df.where(condition).groupBy(key).agg(first).select(key, "first.*")


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The value that was written last to each of ``keys``."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("last")).select(*keys, F.col("last")[value].alias(value))


def tail(df: DataFrame, order: Sequence[str], n: int = 4000) -> DataFrame:
    """The newest ``n`` rows, as a monitor shows them: a top-k, by its nature."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def actions(df: DataFrame, *parts: Column) -> DataFrame:
    """One row for each non-null action struct, numbered in order by ``seq``."""
    listed = F.filter(F.array(*parts), lambda a: a.isNotNull())
    return df.select("*", F.posexplode(listed).alias("seq", "action")).select(*df.columns, "seq", "action.*")


def action(kind: str, pin: Column | int, num: Column | None = None, text: Column | None = None, when: Column | None = None) -> Column:
    a = F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(pin) if isinstance(pin, int) else pin).cast("int").alias("pin"),
        (F.lit(None) if num is None else num).cast("double").alias("num_val"),
        (F.lit(None) if text is None else text).cast("string").alias("str_val"),
    )
    return a if when is None else F.when(when, a)
