"""Ranks, cubes and table functions: for tables of readings, not part of block programs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..scratch import kept


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's number, from 1 on, in the order of all rows.

    Rows are dealt by sampled ranges of the order and sorted in them; the counts of the
    ranges (one number for each task) are added up, so no task sees more than a range.
    Rows that are equal in ``order`` are numbered in no certain order among themselves,
    and fall into one range: the order should be total. Nulls come where ``order`` says.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the partition, and below it that of the row.
    held = kept(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("__at", 33)
    ahead, rows = 0, []
    for r in sorted(held.groupBy(part.alias("part")).count().collect()):  # one row a task
        rows.append((r["part"], ahead))
        ahead += r["count"]
    before = df.sparkSession.createDataFrame(rows, "__part long, __ahead long")
    out = held.join(F.broadcast(before), part == F.col("__part"))
    return out.withColumn(name, F.col("__ahead") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__ahead")


def top(df: DataFrame, keys: Sequence[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which should be total. Each task
    keeps ``k`` rows of a key before they are shuffled, so a hot key costs no more than
    others."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


#: Rows of the finest level that a task of ``cube`` holds.
CUBE_ROWS = 100_000


def cube(df: DataFrame, dims: Sequence[str], value: str, sums: dict[str, Column], distinct: str = "n_distinct") -> DataFrame:
    """Sums and the exact number of different ``value``s for every combination of
    ``dims``, with ``level`` (a bit for each of ``dims`` that is summed over, the last
    the lowest). The facts are counted, then read once and added up by all of ``dims`` and ``value``
    first, and dealt by ``value`` into as many parts as their number asks for. No two parts
    share a value, so each counts its own, and only the counts are shuffled. Null values
    count in sums and not as a value; a null of ``dims`` is a group of its own level."""
    finest = df.groupBy(*dims, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // CUBE_ROWS))
    dealt = finest.select(*[F.col(d).alias(f"__d{i}") for i, d in enumerate(dims)], F.col(value).alias("__value"), *[F.col(n).alias(f"__s{i}") for i, n in enumerate(sums)])
    # Null values are no values: they are spread, each group on its own.
    spread = F.when(F.col("__value").isNull(), F.xxhash64(*[f"__d{i}" for i in range(len(dims))])).otherwise(F.xxhash64("__value"))
    dealt = dealt.withColumn("__part", spread).repartition(parts, "__part").withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << len(dims)) - 1).cast("long"))))
    masked = [F.when(F.col("level").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.col(f"__d{i}")).alias(d) for i, d in enumerate(dims)]
    values = dealt.select("__part", "__value", "level", *masked, *[f"__s{i}" for i in range(len(sums))])
    each = values.groupBy("__part", "__value", "level", *dims).agg(*[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(len(sums))])
    return each.groupBy(*dims, "level").agg(*[F.sum(f"__s{i}").alias(n) for i, n in enumerate(sums)], F.count("__value").alias(distinct))


def cube_sketched(df: DataFrame, dims: Sequence[str], value: str, sums: dict[str, Column], distinct: str = "n_distinct", bits: int = 14) -> DataFrame:
    """As ``cube``, with the number of different values estimated from sketches. They are
    made at the finest level in the one scan and merged upward, so their size does not
    depend on the number of values; the relative standard error is about
    ``1.04 / 2 ** (bits / 2)``."""
    finest = df.groupBy(*dims).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.hll_sketch_agg(value, bits).alias("__sketch"))
    return finest.cube(*dims).agg(F.grouping_id().cast("long").alias("level"), *[F.sum(n).alias(n) for n in sums], F.hll_sketch_estimate(F.hll_union_agg("__sketch")).alias(distinct))


class Runs:
    """``runs(TABLE(t), key, order, tie, value)``: stretches of equal values of each key, as
    ``key, run_no, value, rows``. Only the current stretch is held. Nulls are equal to
    each other. ``order`` and ``tie`` should be a total order."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, tie: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        """The types are those of the table; its rows are dealt by key and sorted."""
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        missing = [a.value for a in (key, order, tie, value) if a.value not in kinds]
        if missing:
            raise ValueError(f"the table has no column {missing[0]}")
        schema = T.StructType([T.StructField("key", kinds[key.value]), T.StructField("run_no", T.LongType()), T.StructField("value", kinds[value.value]), T.StructField("rows", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value), OrderingColumn(tie.value)])

    def __init__(self) -> None:
        self.key, self.number, self.value, self.rows = None, 0, None, 0

    def eval(self, row, key: str, order: str, tie: str, value: str) -> Iterator[tuple]:
        if self.rows and row[value] != self.value:
            yield self.key, self.number, self.value, self.rows
            self.number, self.rows = self.number + 1, 0
        self.key, self.value, self.rows = row[key], row[value], self.rows + 1

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield self.key, self.number, self.value, self.rows


def runs(df: DataFrame, key: str, order: str, tie: str, value: str) -> DataFrame:
    """The table function ``Runs`` over ``df``."""
    spark: SparkSession = df.sparkSession
    spark.udtf.register("runs", F.udtf(Runs))
    return spark.sql("SELECT * FROM runs(TABLE(SELECT * FROM {df}), :key, :order, :tie, :value)", args={"key": key, "order": order, "tie": tie, "value": value}, df=df)


def json_field(col: Column | str, path: str, kind: str) -> Column:
    """A field of JSON text, read through VARIANT; null where the text is no JSON, the
    field is absent or is no ``kind``."""
    return F.try_variant_get(F.try_parse_json(col), path, kind)
