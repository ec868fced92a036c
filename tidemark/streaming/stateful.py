"""The state machines on Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_machine(events: DataFrame, key: str, order: list[str], args: list[str], machine: Callable[[], Any], out: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The streaming twin of state.replay: rows of a micro-batch are taken in
    ``order`` within a key and stepped through the key's machine, which lives in
    the state store between batches. With ``watermark`` (column, delay) a key
    that stays silent past it is forgotten."""
    cols = list(dict.fromkeys([key, *order, *args]))
    names = [x.split()[0] for x in out.split(", ")]
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    source = events.withWatermark(*watermark) if watermark else events

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        m = pickle.loads(state.get[0]) if state.exists else machine()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        got = [m.step(*a) for a in rows[args].itertuples(index=False, name=None)]
        state.update((pickle.dumps(m),))
        if watermark:
            state.setTimeoutTimestamp(int(max(rows[watermark[0]].max().timestamp() * 1000, state.getCurrentWatermarkMs()) + 1))
        head = rows[[key, *order]].reset_index(drop=True)
        yield pd.concat([head, pd.DataFrame(got, columns=names)], axis=1)

    kept = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in [key, *order])
    return source.select(*cols).groupBy(key).applyInPandasWithState(step, f"{kept}, {out}", "machine binary", "append", timeout)


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """Closed sessions of a stream: emitted once the watermark passes their end."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("closes"), "n")
