"""Streams: marker-framed serial text, debounced changes, and stateful totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def framed(chunks: DataFrame, marker: str) -> DataFrame:
    """``port, frame_no, frame`` from a stream ``port string, seq long, chunk`` (binary
    or string): the text before each marker, which is dropped; what follows the last
    marker waits in the state for more. Chunks of a port are taken by ``seq`` within
    a micro-batch, and micro-batches come in order. Bytes are decoded as UTF-8 frame by
    frame, so a character that two chunks share is whole; what is no UTF-8 becomes the
    replacement character."""
    mark = marker.encode()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else (b"", 0)
        rows = pd.concat(parts).sort_values("seq")
        *frames, rest = (bytes(rest) + b"".join(c.encode() if isinstance(c, str) else bytes(c) for c in rows["chunk"])).split(mark)
        state.update((rest, n + len(frames)))
        if frames:
            yield pd.DataFrame({"port": key[0], "frame_no": range(n, n + len(frames)), "frame": [f.decode("utf-8", "replace") for f in frames]})

    return chunks.groupBy("port").applyInPandasWithState(step, "port string, frame_no long, frame string", "rest binary, n long", "append", GroupStateTimeout.NoTimeout)


def totals(changes: DataFrame, key: str, delta: str) -> DataFrame:
    """``change variable by delta`` per key, as a running table."""
    return changes.groupBy(key).agg(F.sum(delta).alias("total"), F.count(F.lit(1)).alias("n"))


def debounced(changes: DataFrame, key: str, at: str, quiet: str = "200 milliseconds") -> DataFrame:
    """One row per burst: changes less than ``quiet`` apart belong together."""
    return changes.groupBy(key, F.session_window(at, quiet).alias("burst")).agg(F.count(F.lit(1)).alias("changes")).select(key, "burst.start", "burst.end", "changes")


def drained(chunks: DataFrame, key: str, at: str, every: str = "100 milliseconds") -> DataFrame:
    """Number of chunks that come in each stretch of time."""
    return chunks.groupBy(key, F.window(at, every).alias("w")).agg(F.count(F.lit(1)).alias("chunks")).select(key, F.col("w.start").alias("start"), "chunks")
