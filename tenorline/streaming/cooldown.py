"""Cool-down of a stream of events: keyed state with timers.

Each series (root, level) has the time of its last kept event and the events that may still be overtaken by earlier ones. Events wait until
the watermark has passed them and are then held against the last kept one in order, so the kept events are those of the batch operator
however the stream is cut and mixed, as long as no event is later than the delay. When the cool-down of the last kept event is over
and none is waiting, it can't suppress anything any more, and its state goes.

Waiting events lie in slots of time as sorted arrays, a part for each HELD events that came, and a series has one timer at a time, for the first
of them. So calls to the state grow with slots and batches, not with events, and a task holds HELD events or those of one slot.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .bars import instant

#: State store that transformWithState needs; write() sets it for the query that it starts, and puts back what was there.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The processor goes to workers as it is, so they needn't find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Events that a task gathers before they go to the state; least microseconds of a slot of time.
HELD, SLOT = 1_000_000, 3600 * 1_000_000


class Cooldown(StatefulProcessor):
    """Keeps an event if it is at least so many seconds after the last kept one of its series.

    in_order: events come in the order of their times, so that all up to the latest one can be judged, although watermarks are cut to milliseconds.
    """

    def __init__(self, seconds: float, in_order: bool) -> None:
        self.microseconds = round(seconds * 1_000_000)
        self.slot = max(self.microseconds, SLOT)
        self.beyond = 999 if in_order else 0  # microseconds behind the watermark's millisecond that are passed, too

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.parts = handle.getValueState("parts", "n long")
        self.waiting = handle.getMapState("waiting", "slot long, part long", "at binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in rows:
            held.append(frame["at"].to_numpy(dtype=np.int64))
            size += len(frame)
            if size >= HELD:
                self._store(np.unique(np.concatenate(held)))
                held, size = [], 0
        if size:
            self._store(np.unique(np.concatenate(held)))
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())

    def _store(self, at: np.ndarray) -> None:
        """Let sorted events wait."""
        state = self.parts.get()
        part = state[0] + 1 if state is not None else 0
        self.parts.update((part,))
        slots = at // self.slot
        for own in np.split(at, np.flatnonzero(np.diff(slots)) + 1):
            self.waiting.updateValue((int(own[0] // self.slot), part), (own.tobytes(),))

    def _judge(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Judge the waiting events that the watermark (in milliseconds) has passed, and set the next timer."""
        passed = watermark * 1000 + self.beyond
        state = self.last.get()
        last = before = state[0] if state is not None else None
        parts: dict[int, list[int]] = defaultdict(list)
        for slot, part in self.waiting.keys():
            parts[slot].append(part)
        kept, following = [], None
        for slot in sorted(parts):
            if slot * self.slot > passed and following is not None:
                break
            at = np.unique(np.concatenate([np.frombuffer(bytes(self.waiting.getValue((slot, part))[0]), dtype=np.int64) for part in parts[slot]]))
            due = at[: np.searchsorted(at, passed, "right")]
            if len(due) < len(at) and following is None:
                following = int(at[len(due)])
            if not len(due):
                continue
            for part in parts[slot]:
                self.waiting.removeKey((slot, part))
            if len(due) < len(at):
                self.waiting.updateValue((slot, parts[slot][0]), (at[len(due) :].tobytes(),))
            i = 0 if last is None else int(np.searchsorted(due, last + self.microseconds))
            while i < len(due):
                last = int(due[i])
                kept.append(last)
                i = int(np.searchsorted(due, last + self.microseconds))
        if last != before:
            self.last.update((last,))
        if following is not None:
            # Spark's timers go off when the watermark is over them, so a millisecond before it is where it must be.
            self.handle.registerTimer(-((self.beyond - following) // 1000) - 1)
        else:
            self.parts.clear()
            if last is not None and passed > last + self.microseconds + self.beyond:
                self.last.clear()  # its cool-down is over, so it says nothing any more
            elif last is not None:
                self.handle.registerTimer((last + self.microseconds) // 1000 + 1)
        if kept:
            yield pd.DataFrame({"root": [key[0]] * len(kept), "level": [key[1]] * len(kept), "at": kept})

    def close(self) -> None:
        pass


def cooldown_time(events: DataFrame, hours: float, delay: str = "0 seconds") -> DataFrame:
    """root, level, ts of the events of a stream (root, level, ts, event) that are kept: at least so many hours after the last kept one of their series.

    delay: how much later than others an event may come and still be judged; none: events come in order, and all up to the latest one are judged.
    Times of a series are distinct; a repeated one counts once.
    """
    if hours <= 0:
        raise ValueError("hours must be over 0")
    rows = events.where("event").withColumn("time", instant("ts")).withWatermark("time", delay)
    rows = rows.select("root", F.col("level").cast("long").alias("level"), F.unix_micros("time").alias("at"), "time")
    kept = rows.groupBy("root", "level").transformWithStateInPandas(Cooldown(hours * 3600, not re.search("[1-9]", delay)), "root string, level long, at long", "append", "eventtime")
    return kept.select("root", "level", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(at div 1000000 as int)) + make_dt_interval(0, 0, 0, cast((at % 1000000) / 1e6 as decimal(18, 6)))").alias("ts"))


def write(kept: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append kept events to a folder until the source has no more for now."""
    conf, name = kept.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)
    try:
        return kept.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)  # a query has its own copy from its start on
