"""Helpers that the operators share: scratch tables, size checks, names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

#: White space of the contracts: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table that is broadcast, in bytes of its rows.
BROADCAST_BYTES = 32_000_000


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    A cluster names a folder that driver and executors share. Only where none is
    named, and Spark runs in one process, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tickloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder, and read again: cuts the
    lineage, so that a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more: all that was made
    of them is stored too."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_bytes(df: DataFrame) -> tuple[int, int]:
    """Number of rows, and about how many bytes they are. One job; it reads no column
    where all have fixed widths."""
    fixed, loose = 16, []
    for f in df.schema:
        if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, (StringType, BinaryType)):
            fixed += 8
        else:
            fixed += 16
            loose.append(F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(F.col(f"`{f.name}`")))))
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(loose)]).first()
    return got["n"], got["n"] * fixed + sum(got[f"c{i}"] or 0 for i in range(len(loose)))


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows are at most ``limit`` bytes; as it is
    otherwise, and then the join shuffles. ``df`` should be a stored table."""
    return F.broadcast(df) if row_bytes(df)[1] <= (BROADCAST_BYTES if limit is None else limit) else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, like ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_of(col: Column | str) -> Column:
    """A text, with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Returns freed memory to the system. Spark keeps its Python workers for later
    tasks, whose memory would otherwise add up with the JVM's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
