"""Several waiters with time limits on the live text of a port.

Rows of a port are its chunks of text and the waits that are asked for. A wait is for a
marker, and gets the text before it, or for a number of characters. Each new chunk is
offered to all open waits in the order in which they were asked for; what one takes is
gone for the next. A wait ends by itself when its time is over: for a marker with
nothing, for characters with those that have come, and then all text so far is dropped.
A drain drops what is there when it is asked for, and gets all text until its time is
over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``kind``: ``chunk`` (``text``: what has come), ``marker`` (``text``: what to wait for),
#: ``chars`` (``n`` of them), ``drain`` (all for a time) or ``clock`` (nothing but the time).
ROWS = "port string, seq long, at timestamp, kind string, text string, n long, timeout_ms long"
ANSWERS = "port string, waiter long, status string, text string"
#: The state of a bucket of ports: one port's count of waits, open waits, and text, or ``more`` of it.
LOG = "port string, asked long, more boolean, text string, waits array<struct<waiter long, kind string, marker string, n long, deadline_ms long>>"
#: Ports share so many states, and a row of one counts as so many characters beside its text.
BUCKETS, ROW_CHARS = 2048, 64


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, in compact files: much of it is text."""
    store = "spark.sql.streaming.stateStore."
    wanted = {store + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", store + "rocksdb.compression": "zstd"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class Desk:
    """The open waits of a port and its text: a few plain values, without Spark."""

    def __init__(self, chunks: list[str], waits: dict[int, tuple[str, str, int, int]], asked: int):
        self.text, self.waits, self.asked = "".join(chunks), waits, asked
        self.answers: list[tuple[int, str, str | None]] = []

    def offer(self, waiter: int) -> None:
        kind, marker, n, _ = self.waits[waiter]
        if kind == "marker" and (at := self.text.find(marker)) >= 0:
            got, self.text = self.text[:at], self.text[at + len(marker) :]
        elif kind == "chars" and len(self.text) >= n:
            got, self.text = self.text[:n], self.text[n:]
        else:
            return
        del self.waits[waiter]
        self.answers.append((waiter, "ok", got))

    def expire(self, now_ms: int) -> None:
        """Ends the waits whose time was over before ``now_ms``, the earliest first."""
        for waiter in sorted((w for w, x in self.waits.items() if x[3] < now_ms), key=lambda w: (self.waits[w][3], w)):
            kind, _, n, _ = self.waits.pop(waiter)
            got = {"chars": self.text[:n], "drain": self.text}.get(kind)
            self.answers.append((waiter, "ok" if kind == "drain" else "timeout", got))
            if kind != "marker":
                self.text = ""

    def take(self, kind: str, text: str | None, n: int | None, at_ms: int, timeout_ms: int | None) -> None:
        self.expire(at_ms)
        if kind == "chunk":
            self.text += text or ""
            for waiter in sorted(self.waits):
                self.offer(waiter)
        elif kind in ("marker", "chars", "drain"):
            if kind == "drain":
                self.text = ""
            self.waits[self.asked] = (kind, text or "", int(n or 0), at_ms + int(timeout_ms or 0))
            self.offer(self.asked)
            self.asked += 1


class Waiters(StatefulProcessor):
    """The desks of all ports of a bucket. Every call to the state is a message to Spark, so
    there are a few for a bucket and none for a port; frames, since Spark makes single rows cell by cell. What has changed is added to one list,
    in which the last row of a port counts, and the list is written anew when most of it is past."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", LOG)

    def _desks(self) -> tuple[dict[str, Desk], int]:
        """The desks by port, and the size of the list."""
        pieces: dict[str, list[str]] = {}
        last: dict[str, tuple[int, list]] = {}
        size = 0
        for port, asked, more, text, waits in self.log.get():
            size += ROW_CHARS + len(text)
            pieces[port] = pieces[port] if more else []
            pieces[port].append(text)
            last[port] = (asked, waits)
        return {p: Desk(pieces[p], {w[0]: tuple(w[1:]) for w in waits}, asked) for p, (asked, waits) in last.items()}, size

    def _close(self, desks: dict[str, Desk], before: dict[str, tuple], size: int, timer: int | None, fired: bool) -> Iterator[pd.DataFrame]:
        """Keeps what has changed, and a timer for the next wait that may end."""
        fresh = []
        for port, desk in desks.items():
            text, waits, asked = before.get(port, ("", {}, 0))
            if (desk.text, desk.waits, desk.asked) != (text, waits, asked):
                more = port in before and desk.text.startswith(text)
                fresh.append(_logged(port, desk, desk.text[len(text) :] if more else desk.text, more))
        live = sum(ROW_CHARS + len(d.text) for d in desks.values())
        if fresh and size + sum(ROW_CHARS + len(f[3]) for f in fresh) > 2 * live:
            self.log.put([_logged(p, d, d.text, False) for p, d in desks.items()])
        elif fresh:
            self.log.appendList(fresh)
        goal = _timer(desks)
        if timer is not None and not fired and timer != goal:
            self.handle.deleteTimer(timer)
        if goal is not None and (fired or timer != goal):
            self.handle.registerTimer(goal)
        if said := [(port, *answer) for port, desk in desks.items() for answer in desk.answers]:
            yield pd.DataFrame(said, columns=["port", "waiter", "status", "text"])

    def _turn(self, frames: Iterator[pd.DataFrame], now_ms: int, fired: bool) -> Iterator[pd.DataFrame]:
        desks, size = self._desks()
        before, timer = {p: (d.text, dict(d.waits), d.asked) for p, d in desks.items()}, _timer(desks)
        rows = [r for f in frames for r in zip(*(f[c].tolist() for c in ("port", "at_ms", "seq", "kind", "text", "n", "timeout_ms")), strict=True)]
        for port, at_ms, _, kind, text, n, timeout_ms in sorted(rows, key=lambda r: r[:3]):
            if port not in desks:
                desks[port] = Desk([], {}, 0)
            desks[port].take(kind, text, n, at_ms, timeout_ms)
        # All that is over: a timer that is set for a time already past would not fire.
        for desk in desks.values():
            desk.expire(now_ms)
        yield from self._close(desks, before, size, timer, fired)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._turn(rows, timerValues.getCurrentWatermarkInMs(), fired=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._turn(iter(()), timerValues.getCurrentWatermarkInMs(), fired=True)


def _logged(port: str, desk: Desk, text: str, more: bool) -> tuple:
    return port, desk.asked, more, text, [(waiter, *wait) for waiter, wait in desk.waits.items()]


def _timer(desks: dict[str, Desk]) -> int | None:
    """When the next wait may end; text at the end itself is in time."""
    return min((w[3] + 1 for d in desks.values() for w in d.waits.values()), default=None)


def answered(rows: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """``port, waiter, status, text`` for each wait of the stream ``rows`` (``ROWS``), as
    it ends: ``waiter`` counts the waits of a port, ``status`` is ``ok`` or ``timeout``.

    Rows count by ``at``, then ``seq``; text that comes at the very end of a wait is in
    time. A port's rows may come in any order inside a micro-batch, and up to ``late``
    out of order between them: Spark leaves out rows that are not after the stream's
    time, which is the latest ``at`` of the micro-batches before, less ``late``. A wait without further rows ends when the stream's time
    has passed it. Null texts are empty, a null ``seq`` comes first; rows without a port or a time are none. The state of a port is the
    text that no wait has taken and its open waits. Ports are dealt by hash into ``buckets``, whose states
    are read and kept as one; a task holds one bucket's state and its rows of a micro-batch. The number stays
    as it is from start to start of a stream. The stream needs the RocksDB state store.
    """
    rows = rows.where("port is not null and at is not null").withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    # A null among whole numbers would make a frame's column inexact.
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "n": F.coalesce("n", F.lit(0)), "timeout_ms": F.coalesce("timeout_ms", F.lit(0)), "seq": F.coalesce("seq", F.lit(-(2**63)))})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("port"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Waiters(), ANSWERS, "append", "EventTime")
