"""The ordered funnel on a stream: open sessions of every user as keyed state, closed by event-time timers."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kindred.operators.activity import FUNNEL, funnel_depth

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = np.iinfo(np.int64).max


def merged(pieces: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Pieces (first, last, events, time of each step or NEVER) that are at most a gap apart become one.

    Counts add and times take their minimum, so it does not matter in which order pieces arrive or how they are cut.
    """
    pieces = pieces.sort_values("first", kind="stable")
    reach = np.maximum.accumulate(pieces["last"].to_numpy())
    fresh = np.ones(len(pieces), bool)
    fresh[1:] = pieces["first"].to_numpy()[1:] > reach[:-1] + gap
    rules = {c: "min" for c in pieces.columns} | {"last": "max", "events": "sum"}
    return pieces.groupby(np.cumsum(fresh)).agg(rules)[list(pieces.columns)]


class OpenSessions(StatefulProcessor):
    """Holds a user's sessions until the watermark has passed their last event by more than the gap.

    The state of a user is a row for each session that is still open, whatever the number of events; what Spark lets through as
    not late can only fall into one of them or open a new one. Times are microseconds.
    """

    def __init__(self, gap: int, steps: Sequence[str]) -> None:
        self.gap, self.steps = gap, list(steps)
        self.columns = ["first", "last", "events", *(f"step{k}" for k in range(len(self.steps)))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ", ".join(f"{c} long" for c in self.columns))

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(row) for row in self.open.get()], columns=self.columns, dtype="int64")

    def _closes(self, last: int) -> int:
        """The first millisecond at which the watermark has passed the session."""
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = held = self._held()
        for batch in rows:
            at = batch["us"].to_numpy("int64")
            new = {"first": at, "last": at, "events": np.ones(len(at), np.int64)}
            new |= {f"step{k}": np.where(batch["action"] == step, at, NEVER) for k, step in enumerate(self.steps)}
            now = merged(pd.concat([now, pd.DataFrame(new)[self.columns]]), self.gap)
        before, after = (set(map(self._closes, frame["last"].tolist())) for frame in (held, now))
        for time in before - after:
            self.handle.deleteTimer(time)
        for time in after - before:
            self.handle.registerTimer(time)
        self.open.put([tuple(row) for row in now.to_numpy().tolist()])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        closed = held["last"].map(self._closes) <= expiredTimerInfo.getExpiryTimeInMs()
        if (~closed).any():
            self.open.put([tuple(row) for row in held[~closed].to_numpy().tolist()])
        else:
            self.open.clear()
        if closed.any():
            out = held[closed].reset_index(drop=True)
            out.insert(0, "user_id", key[0])
            out["last"] += self.gap
            yield out.astype({c: "Int64" for c in self.columns}).mask(out == NEVER)

    def close(self) -> None:
        pass


def funnel_stream(events: DataFrame, gap: str = "30 minutes", steps: Sequence[str] = FUNNEL, lateness: str = "1 day") -> DataFrame:
    """Closed sessions of every user with the first time of each step and how many steps were taken in order.

    What ``session_funnel`` gives for a log without session ids, in append mode: a session comes out once, when the watermark
    has passed its last event by more than the gap. Out-of-order events within the lateness are counted, later ones are not.
    Events without a user or time belong to no session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    microseconds = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap}) - unix_micros(timestamp_seconds(0))").first()[0]
    processor = OpenSessions(int(microseconds), steps)
    kind = events.schema["user_id"].dataType.simpleString()
    known = events.filter("user_id is not null and ts is not null").select("user_id", "ts", "action", F.unix_micros("ts").alias("us"))
    found = known.withWatermark("ts", lateness).groupBy("user_id").transformWithStateInPandas(
        processor, f"user_id {kind}, " + ", ".join(f"{c} long" for c in processor.columns), "Append", "EventTime"
    )
    times = [F.timestamp_micros(f"step{k}").alias(f"first_{step}") for k, step in enumerate(steps)]
    return funnel_depth(found.select(
        "user_id", F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("session_end"), "events", *times
    ), steps)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stopped stream still holds, read from its checkpoint."""
    return spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
