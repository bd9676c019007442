"""What the stateful streams share: rows taken in order, state that ends by itself.

A stream's rows are numbered from 0 without gaps. Rows that come before their turn wait in state, rows that come again are dropped; so
the cuts into micro-batches, and the order of rows within and between them, change nothing. State goes when the stream's last row has been
taken, or when nothing has come for `idle` milliseconds: the timer then says so and clears it. Spark keeps this state in RocksDB.

State is asked for over a socket, so a key asks as seldom as it can, never once a row: where a stream is, how many of its rows wait and when its
timer ends are one value, and what a new stream cannot have is not asked for. Rows come and go as rows: a frame for each key would cost more than
what is done to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

IDLE_MS = 15 * 60 * 1000
#: Rows of a key that are held and put in order at once.
PART = 10_000
_provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """The session's streams keep state in RocksDB, which timers and several states of one key need; of its versions, those of two batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _provider)
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")


class InOrder(StatefulProcessor):
    """Calls taken() for each row of a key in the order of `seq`; subclasses say what is kept and what comes out.

    fields are the columns that a waiting row must keep, as DDL; columns the names of what comes out.
    """

    fields = ""
    columns: tuple[str, ...] = ()

    def __init__(self, idle: int = IDLE_MS) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long, waiting long, timer long")
        self.early = handle.getMapState("early", "seq long", self.fields)
        self.names = [f.split()[0] for f in self.fields.split(", ")]
        self.row = Row(*self.columns)
        self.opened(handle)

    # What subclasses say.

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Their own states."""

    def begun(self, new: bool) -> None:
        """Their state is read; a new key has none."""

    def taken(self, key: Any, seq: int, row: tuple) -> tuple[list[tuple], bool]:
        """Rows that come out for the key's next row, and whether it was the last."""
        raise NotImplementedError

    def kept(self) -> None:
        """Their state is written."""

    def ended(self) -> None:
        """Their state is cleared."""

    def expired(self, key: Any, seq: int) -> list[tuple]:
        """Rows that come out when a stream has been idle."""
        return []

    # The order of rows.

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at = self.turn.get()
        turn, count, timer = at or (0, 0, None)
        self.begun(at is None)
        waiting = {k[0] for k in self.early.keys()} if count else set()
        gone: list[int] = []
        last = False
        while part := list(islice(rows, PART)):
            part.sort(key=lambda r: r["seq"])
            for r in part:
                seq = r["seq"]
                if last or seq < turn:
                    continue
                if seq > turn:
                    self.early.updateValue((seq,), tuple(r[n] for n in self.names))
                    waiting.add(seq)
                    continue
                got, last = self.taken(key[0], turn, tuple(r[n] for n in self.names))
                yield from map(self._said, got)
                if turn in waiting:  # it came early before another part of the batch brought it again
                    waiting.remove(turn)
                    gone.append(turn)
                turn += 1
                while not last and turn in waiting:
                    got, last = self.taken(key[0], turn, tuple(self.early.getValue((turn,))))
                    yield from map(self._said, got)
                    waiting.remove(turn)
                    gone.append(turn)
                    turn += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        if last:
            self._clear(bool(waiting or gone))
            return
        if gone and not waiting:
            self.early.clear()
        elif gone:
            for seq in gone:
                self.early.removeKey((seq,))
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.turn.update((turn, len(waiting), timer))
        self.kept()
        self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.begun(False)
        turn, count, _ = self.turn.get() or (0, 0, None)
        out = self.expired(key[0], turn)
        self._clear(bool(count))
        yield from map(self._said, out)

    def close(self) -> None:
        pass

    def _said(self, values: tuple) -> Row:
        return self.row(*values)

    def _clear(self, waiting: bool) -> None:
        self.turn.clear()
        if waiting:
            self.early.clear()
        self.ended()


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str | StructType) -> DataFrame:
    """A stream's rows (key, seq and the processor's fields) through the processor, by key."""
    keep_state(rows.sparkSession)
    names = [f.split()[0] for f in processor.fields.split(", ")]
    return rows.select(key, "seq", *names).groupBy(key).transformWithState(processor, schema, "Append", "ProcessingTime")


def drain(out: DataFrame, folder: str) -> DataFrame:
    """Runs a stream until what is there now is read: rows go to folder/out, state and progress to folder/state; what is written is returned.

    Batches without data are left out meanwhile: timers on the clock ask for them without end. They fire with the next batch that has data.
    """
    spark = out.sparkSession
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
