"""Streaming forms of excursions, violations and watch lists."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gridlake.functions.durable import shared_folder
from gridlake.functions.exprs import canonical_tag, select_rating


def stream_excursion(series: DataFrame, high: float = 61.0, low: float = 59.0, hold: float = 0.5, start: float = 0.0, lateness: str | None = None, forget_seconds: float | None = None) -> DataFrame:
    """Sustained excursions of a stream of (machine, t, value[, ts]): (machine, t, value, side).

    The state of a machine is its last value and the times its clocks were started. Samples of a micro-batch are taken in order of
    (t, value); samples older than the last one of their machine are dropped, and with ``lateness`` (a watermark on ts) those beyond it
    before that. Replayed in order it gives what ``sustained_excursion`` gives on the whole. With ``forget_seconds`` (needs ``lateness``) the
    state of a machine that has been silent for so long by the watermark is dropped; it then begins anew.
    """
    if forget_seconds is not None and lateness is None:
        raise ValueError("forget_seconds needs lateness")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, up, down, at = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(frames)).sort_values(["t", "value"])
        out = []
        for t, f in zip(rows["t"].tolist(), rows["value"].tolist(), strict=True):
            if at is not None and t < at:
                continue
            for side, beyond, away in (("up", f > high, before is not None and f > before), ("down", f < low, before is not None and f < before)):
                since = up if side == "up" else down
                if not beyond:
                    since = None
                elif since is None:
                    since = t
                elif not away:
                    since = None
                elif t - since >= hold:
                    out.append((key[0], t, f, side))
                up, down = (since, down) if side == "up" else (up, since)
            before, at = f, t
        state.update((before, up, down, at))
        if forget_seconds is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ms"].max())) + int(1000 * forget_seconds))
        yield pd.DataFrame(out, columns=["machine", "t", "value", "side"])

    rows = series.where((F.col("t") >= start) & F.col("value").isNotNull())
    if lateness is not None:
        rows = rows.withWatermark("ts", lateness)
    kind = series.schema["machine"].dataType.simpleString()
    used = ["machine", "t", "value", *(["ts", F.unix_millis("ts").alias("ms")] if forget_seconds is not None else [])]
    timeout = GroupStateTimeout.NoTimeout if forget_seconds is None else GroupStateTimeout.EventTimeTimeout
    return rows.select(*used).groupBy("machine").applyInPandasWithState(
        step, f"machine {kind}, t double, value double, side string", "before double, up double, down double, at double", "append", timeout
    )


class _InOrder(StatefulProcessor):
    """Holds a machine's samples until the watermark has passed them, then lets them through the rule in order of (t, value)."""

    def __init__(self, high: float, low: float, hold: float, forget_ms: int | None) -> None:
        self.high, self.low, self.hold, self.forget_ms = high, low, hold, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, value double, ms long")
        self.clocks = handle.getValueState("clocks", "before double, up double, down double, ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [x for frame in rows for x in zip(frame["t"].tolist(), frame["value"].tolist(), frame["ms"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(x[2] for x in new))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        past, rest = sorted(x for x in held if x[2] < mark), [x for x in held if x[2] >= mark]
        before, up, down, last = self.clocks.get() if self.clocks.exists() else (None, None, None, None)
        if not past:
            if rest:
                self.handle.registerTimer(min(x[2] for x in rest))
            elif self.forget_ms is not None and last is not None and last + self.forget_ms <= mark:
                self.clocks.clear()
            return
        out = []
        for t, f, ms in past:
            if self.forget_ms is not None and last is not None and ms - last > self.forget_ms:
                before = up = down = None
            up = self._clock(up, t, f > self.high, before is not None and f > before, key, f, "up", out)
            down = self._clock(down, t, f < self.low, before is not None and f < before, key, f, "down", out)
            before, last = f, ms
        self.clocks.update((before, up, down, last))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(x[2] for x in rest))
        else:
            self.waiting.clear()
            if self.forget_ms is not None:
                self.handle.registerTimer(last + self.forget_ms)
        if out:
            yield pd.DataFrame(out, columns=["machine", "t", "value", "side"])

    def _clock(self, since: float | None, t: float, beyond: bool, away: bool, key: tuple, value: float, side: str, out: list) -> float | None:
        if not beyond:
            return None
        if since is None:
            return t
        if not away:
            return None
        if t - since >= self.hold:
            out.append((key[0], t, value, side))
        return since

    def close(self) -> None:
        pass


def stream_excursion_in_order(series: DataFrame, lateness: str, high: float = 61.0, low: float = 59.0, hold: float = 0.5, start: float = 0.0, forget_seconds: float | None = None) -> DataFrame:
    """Sustained excursions of a stream of (machine, t, value, ts) whose samples may arrive in any order: (machine, t, value, side).

    Samples wait in the state until the watermark, the latest ts less ``lateness``, has passed them; an event-time timer then takes them out in order of
    (t, value), t rising with ts. So whatever the order of arrival within the lateness, the result is that of ``sustained_excursion`` on all
    samples before the watermark; older arrivals are dropped, younger ones still wait. The state holds the samples of the lateness and, per
    machine, its clocks; after a silence of over ``forget_seconds`` the clocks start anew, and a timer removes them. Null values, and
    samples before ``start``, are left out. The session needs the RocksDB state store (see ``drained``).
    """
    rows = series.where((F.col("t") >= start) & F.col("value").isNotNull()).withWatermark("ts", lateness)
    kind = series.schema["machine"].dataType.simpleString()
    keyed = rows.select("machine", F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"), F.unix_millis("ts").alias("ms"), "ts").groupBy("machine")
    processor = _InOrder(high, low, hold, None if forget_seconds is None else int(1000 * forget_seconds))
    return keyed.transformWithStateInPandas(processor, f"machine {kind}, t double, value double, side string", "Append", "EventTime")


def stream_violations(rows: DataFrame, ratings: DataFrame, rating: str = "A") -> DataFrame:
    """Arriving (event_idx, from_bus, to_bus, ckt, p, q) rows that exceed their rating; ratings are a static table."""
    rate = select_rating(rating, F.col("rate_a"), F.col("rate_b"), F.col("rate_c"))
    joined = rows.join(ratings.select("from_bus", "to_bus", "ckt", rate.alias("rate")), ["from_bus", "to_bus", "ckt"])
    mva = F.hypot("p", "q")
    return joined.withColumn("mva", mva).where("rate > 0 AND mva > rate")


def stream_watch(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Arriving observations (type, bus_id, tag, ...) that are on the static watch list."""
    clean = lambda f: f.withColumns({"type": F.lower(F.trim("type")), "tag": F.coalesce(canonical_tag(F.col("tag")), F.lit(""))})
    return clean(rows).join(clean(asked).select("type", "bus_id", "tag").distinct(), ["type", "bus_id", "tag"])


_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, store: str | None = None) -> DataFrame:
    """Everything that a stream has available now, written to the shared folder with its checkpoint and read back. ``store`` is the class of
    the state store, if not the session's."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/gridlake-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    before = spark.conf.get(_STORE)
    try:
        if store:
            spark.conf.set(_STORE, store)
        query = writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
