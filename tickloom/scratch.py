"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast, in bytes of its rows.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; where none is set and Spark
    runs in one process, below a temporary folder that then is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tickloom/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder, and read again."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether the rows of a stored table are few enough to be broadcast."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    size = F.lit(16 + 8 * len(df.columns)) + sum(wide, F.lit(0))
    return (df.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if it is small; else the join shuffles."""
    return F.broadcast(df) if is_small(df) else df
