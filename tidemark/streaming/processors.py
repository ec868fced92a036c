"""The state machines on streams, with their state in typed columns of the store.

Rows of a key wait in a list state, which takes what a micro-batch brings in one
call, until the watermark has passed them and are then
taken in the order of their times, so that what comes out does not depend on how
rows were dealt to micro-batches or in which order they came. A timer at the
earliest waiting row takes care of that; another one ends what has been silent. A
row that comes when the watermark has already passed it is late and is left out.
What waits is what the watermark's delay holds of a key. Needs the RocksDB state
store (``with_store``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.state import CircuitBreaker, ClauseBuffer, History, RateLimiter

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for streams that start inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class InOrder(StatefulProcessor):
    """Rows of a key in the order of ``order``, whose first column is the time.

    ``order`` must be total within a key: of rows equal in it the last to come
    counts. ``silence``: milliseconds of event time without rows after which
    ``ended`` is called once and the key's state is dropped; None for never.
    """

    def __init__(self, key: str, order: list[str], args: list[str], kinds: dict[str, str], out: str, silence: int | None = None) -> None:
        self.key, self.order, self.args, self.names, self.silence = key, order, args, [x.split()[0] for x in out.split(", ")], silence
        self.schema = ", ".join([*(f"o{i} {kinds[c]}" for i, c in enumerate(order)), *(f"a{i} {kinds[c]}" for i, c in enumerate(args))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.timers = handle.getValueState("timers", "due long, quiet long")
        self.open()

    # what a machine adds
    def open(self) -> None: ...

    def step(self, rows: list[tuple[tuple, tuple]]) -> list[tuple]:
        """What comes out for rows (order, args), in order."""
        raise NotImplementedError

    def ended(self) -> list[tuple]:
        return []

    def drop(self) -> None: ...

    def _frame(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=self.names)
            frame.insert(0, self.key, key[0])
            yield frame

    def _ms(self, t: pd.Timestamp) -> int:
        return int(pd.Timestamp(t).value // 1_000_000)

    def _timer(self, which: int, at: int | None) -> None:
        held = list(self.timers.get() or (None, None))
        if held[which] == at:
            return
        other = held[1 - which]
        if held[which] is not None and held[which] != other:
            self.handle.deleteTimer(held[which])
        held[which] = at
        if at is not None and at != other:
            self.handle.registerTimer(at)
        self.timers.update(tuple(held))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first, fresh = None, []
        for frame in rows:
            for order, args in zip(frame[self.order].itertuples(index=False, name=None), frame[self.args].itertuples(index=False, name=None), strict=True):
                at = self._ms(order[0])
                if at > passed or not passed:  # 0: no watermark yet
                    fresh.append((*order, *(None if a is None or a is pd.NaT or a != a else a for a in args)))
                    first = max(1, at if first is None else min(first, at))
        if first is not None:
            self.waiting.appendList(fresh)
            held = self.timers.get()
            due = held[0] if held else None
            if due is None or first < due:
                self._timer(0, first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        n = len(self.order)
        held = {row[:n]: row[n:] for row in self.waiting.get()}
        ready, still, left = [], [], None
        for order, args in held.items():
            at = self._ms(order[0])
            if at <= passed:
                ready.append((order, args))
            else:
                still.append((*order, *args))
                left = at if left is None else min(left, at)
        ready.sort(key=lambda x: x[0])
        if ready:
            self.waiting.put(still) if still else self.waiting.clear()
        due, quiet = self.timers.get() or (None, None)
        out: list[tuple] = []
        at = 0
        # rows up to the end of a silence come before it, those after it start anew
        while at < len(ready):
            n = at
            while n < len(ready) and (quiet is None or self._ms(ready[n][0][0]) <= quiet):
                quiet = None if self.silence is None else self._ms(ready[n][0][0]) + self.silence
                n += 1
            out += self.step(ready[at:n]) if n > at else []
            if n < len(ready):
                out += self.ended()
                self.drop()
                quiet = None
            at = n
        if quiet is not None and quiet <= passed:
            out += self.ended()
            self.drop()
            quiet = None
        fired = expiredTimerInfo.getExpiryTimeInMs()
        self.timers.update(tuple(None if x == fired else x for x in (due, (self.timers.get() or (None, None))[1])))
        self._timer(0, left)
        self._timer(1, quiet)
        if left is None and quiet is None and self.silence is not None:
            self.timers.clear()
        return self._frame(key, out)


class LimiterStream(InOrder):
    """(*order, allowed, remaining), as RateLimiter; admitted times are a list state."""

    def __init__(self, *args, most: int = 10, window: float = 10.0) -> None:
        super().__init__(*args)
        self.most, self.window = most, window

    def open(self) -> None:
        self.ring = self.handle.getListState("ring", "t double, at int")

    def step(self, rows):
        m = RateLimiter(self.most, self.window)
        held = sorted((at, t) for t, at in self.ring.get())
        if held:
            m.ring, m.oldest = [t for _, t in held], min(range(len(held)), key=lambda i: (held[i][1], i))
        out = [(*order, *m.step(*args)) for order, args in rows]
        turned = m.ring[m.oldest :] + m.ring[: m.oldest]
        self.ring.put([(t, i) for i, t in enumerate(turned)])
        return out

    def drop(self) -> None:
        self.ring.clear()


class BreakerStream(InOrder):
    """(*order, state, outcome), as CircuitBreaker."""

    def __init__(self, *args, threshold: int = 3, seconds: float = 30.0) -> None:
        super().__init__(*args)
        self.threshold, self.seconds = threshold, seconds

    def open(self) -> None:
        self.run = self.handle.getValueState("run", "failures int, opened double")

    def step(self, rows):
        m = CircuitBreaker(self.threshold, self.seconds)
        if self.run.exists():
            m.failures, m.opened = self.run.get()
        out = [(*order, *m.step(*args)) for order, args in rows]
        self.run.update((m.failures, m.opened))
        return out

    def drop(self) -> None:
        self.run.clear()


class HistoryStream(InOrder):
    """(*order, held, tokens, folded), as History: turns are a list state, the
    summary a value. A session that is silent for ``silence`` starts anew."""

    def __init__(self, *args, summarise: Callable[[str, list], str], keep: int = 5, limit: int = 2048, share: float = 0.7, silence: int | None = None) -> None:
        super().__init__(*args, silence=silence)
        self.make = lambda: History(summarise, keep, limit, share)

    def open(self) -> None:
        self.turns = self.handle.getListState("turns", "role string, text string")
        self.summary = self.handle.getValueState("summary", "summary string")

    def step(self, rows):
        m = self.make()
        m.turns.extend(tuple(t) for t in self.turns.get())
        m.summary = self.summary.get()[0] if self.summary.exists() else ""
        out = [(*order, *m.step(*args)) for order, args in rows]
        self.turns.put(list(m.turns))
        self.summary.update((m.summary,))
        return out

    def drop(self) -> None:
        self.turns.clear()
        self.summary.clear()


class ClauseStream(InOrder):
    """(seq, sub, event, data), as ``state.clauses``: args are (seq, token). A
    request that is silent for ``silence`` is closed: the rest of its buffer and
    [DONE] are sent."""

    def open(self) -> None:
        self.ready = self.handle.getListState("ready", "part string")
        self.tail = self.handle.getValueState("tail", "tail string, seq long")

    def step(self, rows):
        m, last = ClauseBuffer(), -1
        m.ready.extend(p for (p,) in self.ready.get())
        if self.tail.exists():
            tail, last = self.tail.get()
            m.tail = [tail] if tail else []
        out: list[tuple] = []
        for _, (seq, token) in rows:
            last = seq
            out.append((seq, 0, "token", token))
            clause = m.step(token or "")
            if clause:
                out.append((seq, 1, "clause", clause))
        self.ready.put([(p,) for p in m.ready]) if m.ready else self.ready.clear()
        self.tail.update(("".join(m.tail), last))
        return out

    def ended(self):
        if not self.tail.exists():
            return []
        m = ClauseBuffer()
        m.ready.extend(p for (p,) in self.ready.get())
        tail, last = self.tail.get()
        m.tail = [tail]
        rest = m.flush()
        return ([(last + 1, 0, "clause", rest)] if rest else []) + [(last + 2, 0, None, "[DONE]")]

    def drop(self) -> None:
        self.ready.clear()
        self.tail.clear()


def run_in_order(events: DataFrame, processor: type[InOrder], key: str, order: list[str], args: list[str], out: str, delay: str, silence: int | None = None, **settings) -> DataFrame:
    """``processor`` over a stream of events: (key, *out). The first column of
    ``order`` is a timestamp, which gets a watermark of ``delay``."""
    cols = list(dict.fromkeys([key, *order, *args]))
    kinds = {c: events.schema[c].dataType.simpleString() for c in cols}
    named = [key, order, args, kinds, out]
    made = processor(*named, silence=silence, **settings) if silence is not None else processor(*named, **settings)
    schema = StructType.fromDDL(f"{key} {kinds[key]}, {out}")
    dealt = events.withWatermark(order[0], delay).select(*(F.col(c) for c in cols)).groupBy(key)
    return dealt.transformWithStateInPandas(made, schema, "Append", "EventTime")
