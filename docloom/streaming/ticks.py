"""Ticks of step logs with the loss carried on, over a stream, with state by run.

Spark keeps the state by run (``transformWithState``, RocksDB), so a restart goes on where the checkpoint stands. A step that
comes late changes its tick, and the carried loss of later ticks up to the next one that has a loss of its own: changed
ticks are given again, and the last version of a tick is the one that counts, however late a step is. Only where a caller says how
late steps can be (``keep``), ticks that lie so many behind the newest are folded into one carried loss when there are twice as many, or
when a timer runs out; steps later than that are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TickProcessor(StatefulProcessor):
    """State of a run, one value: its ticks (peak, whether the tick's own step came, last loss and its step), the newest tick
    folded away and the loss carried over it, the number of the last version, and when the timer runs out."""

    def __init__(self, every: int, keep: int | None, idle_ms: int):
        self.every, self.keep, self.idle_ms = every, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "state string")

    def _held(self) -> dict:
        found = json.loads(self.state.get()[0]) if self.state.exists() else {"ticks": {}, "folded": -1, "loss": None, "version": 0, "timer": None}
        return found | {"ticks": {int(k): v for k, v in found["ticks"].items()}}

    def _fold(self, held: dict) -> None:
        for tick in sorted(held["ticks"])[: -self.keep]:
            _, _, own, at = held["ticks"].pop(tick)
            held["loss"], held["folded"] = own if at >= 0 else held["loss"], tick

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, changed = self._held(), set()
        known = held["ticks"]
        for row in rows:
            tick = -(-row.step // self.every)
            if row.step < 0 or tick <= held["folded"]:
                continue
            one = known.setdefault(tick, [None, False, None, -1])
            if row.step > 0 and row.peak is not None and (one[0] is None or row.peak > one[0]):
                one[0] = row.peak
            one[1] = one[1] or row.step == tick * self.every
            if row.loss is not None and row.step >= one[3]:
                one[2], one[3] = row.loss, row.step
            changed.add(tick)
        if not changed:
            return
        held["version"] += 1
        loss, touched = held["loss"], False
        for tick in sorted(known):
            peak, whole, own, at = known[tick]
            loss = own if at >= 0 else loss
            touched = tick in changed or touched and at < 0  # carried on from a changed tick
            if touched and whole and tick > 0:
                yield Row(run=key[0], step=tick * self.every, last_loss=loss, tick_peak=peak, version=held["version"])
        if self.keep is not None:
            if len(known) > 2 * self.keep:
                self._fold(held)
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            held["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(held["timer"])
        self.state.update((json.dumps(held),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if self.keep is not None:  # a timer of a stream that was started with ``keep`` before
            self._fold(held)
        self.state.update((json.dumps(held | {"timer": None}),))
        return iter(())

    def close(self) -> None:
        pass


def ticks(log: DataFrame, every: int = 5, keep: int | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """``run, step, last_loss, tick_peak, version`` of a stream (run, step, loss, peak): ticks whose own step has come, again
    when a late step changes them. Without ``keep`` the state of a run has all its ticks (about 40 bytes each). Needs the RocksDB state store (``prepare``); output mode update.

    Equal steps: the last one's loss counts. A NULL loss or peak says nothing; a NULL run or step is left out.
    """
    kind = log.schema["run"].dataType.simpleString()
    rows = log.where("run is not null and step is not null").select("run", F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"), F.col("peak").cast("double").alias("peak"))
    return rows.groupBy("run").transformWithState(
        statefulProcessor=TickProcessor(every, keep, idle_ms), outputStructType=f"run {kind}, step long, last_loss double, tick_peak double, version long", outputMode="Update", timeMode="ProcessingTime"
    )


def prepare(spark, ends: bool = False) -> None:
    """Settings of the session: the state store, and for a stream that is to end with what is there (``ends``) no batches without
    data, which timers by the clock would go on asking for. Timers then wait for the next data."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if ends:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def latest(versions: DataFrame) -> DataFrame:
    """The version of each tick that counts."""
    return versions.groupBy("run", "step").agg(F.max_by(F.struct("last_loss", "tick_peak"), "version").alias("_v")).select("run", "step", "_v.last_loss", "_v.tick_peak")
