"""Answers that are kept for a time: state with timers of event time, and state that ends by itself."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType

#: A state store that can look up one entry, which `remembered` needs, and holds state on disk: start both with this setting.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _settled(answers: list[tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
    """(answers to hold on, answers that were kept to their end, the first end that is open in ms) of answers (key, id, at, ends, replaced) by the watermark.

    A replaced answer is held until the watermark has passed its own time: none that comes later can be before it.
    """
    by_key: dict[tuple, list[tuple]] = {}
    for x in answers:
        by_key.setdefault(x[0], []).append(x[1:])
    left, kept, first = [], [], None
    for key, own in by_key.items():
        own.sort(key=lambda x: (x[1], x[0]), reverse=True)
        here = after = None  # time and id of the answer at hand, and the time of the next one behind that
        for id, at, ends, over in own:
            if here != (at, id):
                here, after = (at, id), here and here[0]
            over = over or (after is not None and after < ends)
            end = -(-ends // 1000)
            if not over and end <= now:
                kept.append((key, id, ends))
                over = True
            if not over:
                first = end if first is None else min(first, end)
            if not over or -(-at // 1000) > now:
                left.append((key, id, at, ends, over))
    return left, kept, first


def expiries(answers: DataFrame, *, keys: list[str], id: str, time: str, kept: str, late: str = "10 minutes", groups: int = 1024) -> DataFrame:
    """(*keys, id, ended) of the answers that were kept to their end, from a stream of answers; kept is a number of seconds. One without time, id or seconds is not kept.

    An answer replaces that of the same keys before it, by (time, id). Answers of any order are held until the watermark has passed their end, so that one that comes late still replaces an
    earlier one. State is dealt to so many groups of keys, a number that a checkpoint is bound to: a group's open answers are read and written at once, and it has a timer for the first of
    their ends. Keys are passed as strings.
    """
    rows = answers.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull() & F.col(id).isNotNull() & F.col(kept).isNotNull()).withWatermark(time, late)
    kinds = {k: rows.schema[k].dataType for k in keys}
    coded = [(F.base64(k) if isinstance(t, BinaryType) else F.col(k).cast("string")).alias(f"__{i}") for i, (k, t) in enumerate(kinds.items())]
    names = [f"__{i}" for i in range(len(keys))]
    at = F.unix_micros(time)
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("__group")
    rows = rows.select(group, *coded, time, F.col(id).cast("long").alias("id"), at.alias("at"), (at + F.col(kept).cast("long") * 1_000_000).alias("ends"))

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                own = zip(*(frame[n].tolist() for n in names), strict=True)
                held += [(k, *x, False) for k, *x in zip(own, *(frame[n].tolist() for n in ("id", "at", "ends")), strict=True)]
        now = state.getCurrentWatermarkMs()
        left, kept, first = _settled(held, now)
        if left:
            state.update((pickle.dumps(left),))
            if first is not None:  # a timer fires when the watermark is behind it
                state.setTimeoutTimestamp(max(first - 1, now))
        elif state.exists:
            state.remove()
        if kept:
            told = zip(*(k for k, _, _ in kept), strict=True)
            yield pd.DataFrame(dict(zip(names, told, strict=True)) | {"id": [x[1] for x in kept], "ends": [x[2] for x in kept]})

    ended = rows.groupBy("__group").applyInPandasWithState(step, ", ".join(f"{n} string" for n in names) + ", id long, ends long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    decoded = [(F.unbase64(n) if isinstance(t, BinaryType) else F.col(n).cast(t)).alias(k) for n, (k, t) in zip(names, kinds.items(), strict=True)]
    return ended.select(*decoded, "id", F.timestamp_micros("ends").alias("ended"))


class Remembered(StatefulProcessor):
    """Passes on the first request of a key and, after it, the next one that comes when the first one's time is over; the state ends by itself."""

    def __init__(self, keys: list[str], ms: int) -> None:
        self.keys, self.ms = keys, ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "id long", self.ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hit = self.seen.exists()
        first = min(int(i) for frame in rows for i in frame["id"])
        if not hit:
            self.seen.update((first,))
        yield pd.DataFrame({k: [v] for k, v in zip(self.keys, key, strict=True)} | {"id": [first], "hit": [hit]})

    def close(self) -> None:
        pass


def remembered(requests: DataFrame, *, keys: list[str], id: str, ms: int) -> DataFrame:
    """(*keys, id, hit) for each key of each batch of requests: its smallest id and whether an answer of the last `ms` milliseconds of the clock is there."""
    rows = requests.select(*keys, F.col(id).cast("long").alias("id"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(Remembered(keys, ms), f"{kinds}, id long, hit boolean", "append", "processingTime")
