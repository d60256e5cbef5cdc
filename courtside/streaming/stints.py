"""Stints as play-by-play events arrive, in any order.

Events of a period are held in keyed state until the watermark says that no more of them can come, that is ``quiet``
after its last event; then a timer lets the whole period go and drops its state. What comes late, but within the
watermark, is in its place by then. Released events are upserted into a snapshot table and the stints of the periods they
belong to are built anew from all that the table has, by the operator that builds them from a warehouse: so a batch
that is repeated, a period that goes on after a break longer than ``quiet``, and any split into batches all end in the
rows that a batch job over the same events gives. Events behind the watermark are dropped, as Spark drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import lineups
from ..snapshots import SnapshotTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HoldPeriod(StatefulProcessor):
    """Events of one (game, period), as rows of ``schema``, until ``quiet_ms`` after the last by event time ``clock``."""

    def __init__(self, schema: StructType, clock: str, quiet_ms: int) -> None:
        self.schema, self.clock, self.quiet_ms = schema, clock, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.schema)
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        last = self.last.get()[0] if self.last.exists() else None
        came = list(rows)  # of one micro-batch; they are held as they are
        self.events.appendList([tuple(r) for r in came])
        newest = max(int(r[self.clock].timestamp() * 1000) for r in came)
        if last is None or newest > last:  # the timer moves with the last event
            if last is not None:
                self.handle.deleteTimer(last + self.quiet_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        out = [Row(**dict(zip(self.schema.names, r, strict=True))) for r in self.events.get()]
        self.events.clear()
        self.last.clear()
        return iter(out)

    def close(self) -> None:
        pass


def whole_periods(events: DataFrame, clock: str = "ts", delay: str = "10 minutes", quiet_seconds: int = 60) -> DataFrame:
    """The stream's rows, each period's all at once when the watermark (``delay`` behind) has passed it by ``quiet_seconds``.

    Events without a game, a period or a time belong to no period and are left out.
    """
    known = events.filter(F.col("game_id").isNotNull() & F.col("period").isNotNull() & F.col(clock).isNotNull()).withWatermark(clock, delay)
    hold = HoldPeriod(known.schema, clock, quiet_seconds * 1000)
    return known.groupBy("game_id", "period").transformWithState(hold, outputStructType=known.schema, outputMode="Append", timeMode="EventTime")


def store_periods(batch: DataFrame, events: SnapshotTable, stints: SnapshotTable, players: DataFrame | None = None) -> None:
    """Upsert released events by (game_id, event_num) and rebuild the stints of their periods."""
    if batch.isEmpty():
        return
    batch = batch.dropDuplicates(["game_id", "event_num"]).persist()
    try:
        events.upsert(batch, "game_id", "event_num")
        touched = batch.select("game_id", "period").distinct()
        own = events.read().join(touched, ["game_id", "period"], "left_semi")
        stints.upsert(lineups.reconstruct_stints(own, players), "game_id", "period")
    finally:
        batch.unpersist()


def stint_stream(events: DataFrame, event_table: SnapshotTable, stint_table: SnapshotTable, checkpoint: str, players: DataFrame | None = None, until_done: bool = True, **hold) -> StreamingQuery:
    """Start building stints from a stream of events with an event time; ``hold`` goes to ``whole_periods``.

    State is kept by RocksDB, on which timers depend; the session's own choice holds again once the query runs.
    """
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = whole_periods(events, **hold).writeStream.outputMode("append").foreachBatch(lambda batch, _: store_periods(batch, event_table, stint_table, players)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if until_done else writer.trigger(processingTime="10 seconds")).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
