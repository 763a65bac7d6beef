"""Episodes of a stream: who came when, numbered, closed by a gap of silence.

Each key has an open episode (its start, last time, number and sequence) and the
events that still wait for the watermark. A timer on event time takes waiting
events in order once no earlier one can come any more, so the result does not
depend on how the stream was cut into batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnlake.streaming.runs import state_provider

OUT = "key string, id long, at timestamp, episode int, sequence int, started_at timestamp"


class _Episodes(StatefulProcessor):
    """Waiting events are put in order by a timer; an event that follows the last one
    by more than the gap begins an episode."""

    def __init__(self, gap_seconds: int) -> None:
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, last long, episode int, sequence int")
        self.waiting = handle.getListState("waiting", "micros long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            for micros, number in zip(batch["micros"].tolist(), batch["id"].tolist(), strict=True):
                self.waiting.appendValue((int(micros), int(number)))
                first = micros if first is None else min(first, micros)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Whatever is at the watermark or before it is complete: later comers are dropped.
        done = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        ready, rest = [r for r in waiting if r[0] <= done], [r for r in waiting if r[0] > done]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][0] // 1000, done // 1000 + 1))
        else:
            self.waiting.clear()
        if not ready:
            return
        started, last, episode, sequence = self.open.get() if self.open.exists() else (0, None, 0, 0)
        out = []
        for micros, number in ready:
            if last is None or micros - last > self.gap:
                started, episode, sequence = micros, episode + 1, 0
            last, sequence = micros, sequence + 1
            out.append((key[0], number, micros, episode, sequence, started))
        self.open.update((started, last, episode, sequence))
        rows = pd.DataFrame(out, columns=["key", "id", "at", "episode", "sequence", "started_at"])
        for c in ("at", "started_at"):
            rows[c] = pd.to_datetime(rows[c], unit="us")
        yield rows.astype({"episode": "int32", "sequence": "int32"})

    def close(self) -> None:
        pass


def episodes(events: DataFrame, key: str = "user_id", id_col: str = "event_id", ts: str = "ts", gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(key, id, at, episode, sequence, started_at) of a stream of events, each once the
    watermark has passed it: the number of its episode within the key, and its own within
    the episode. Events that come later than ``late`` are dropped; rows without a key, an
    id or a time are left out. The state of a key is what waits and four numbers."""
    state_provider(events.sparkSession)
    # The process that sets up state does not get the application's files, so the
    # processor goes with its code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    some = events.filter(F.col(key).isNotNull() & F.col(id_col).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    keyed = some.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(ts), F.unix_micros(ts).alias("micros"))
    return keyed.groupBy("key").transformWithStateInPandas(_Episodes(gap_seconds), OUT, "append", "eventTime")
