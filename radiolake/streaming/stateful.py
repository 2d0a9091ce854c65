"""Operators with state: attribution of corrupted packets, the stall watchdog, template mining with summaries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from radiolake.functions.drain import DrainTree
from radiolake.functions.text import MASKS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CrcCredit(StatefulProcessor):
    """Per (source, channel) the last sound packet's time and device; a corrupted packet within the tolerance is credited to it."""

    def __init__(self, tolerance: float = 2.0):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double, device long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Arrival order is by ``seq``, over all chunks of the micro-batch; the last sound packet before each comes from a running maximum of places."""
        batch = pd.concat(rows).sort_values("seq", kind="stable")
        ts, device, ok = batch["ts"].to_numpy(dtype=float), batch["device_id"].to_numpy(dtype=float, na_value=np.nan), batch["crc_ok"].to_numpy(dtype=bool)
        held = self.last.get() if self.last.exists() else (0.0, None)
        ts, device = np.append(held[0], ts), np.append(np.nan if held[1] is None else float(held[1]), device)  # the state stands first
        sound = np.append(held[1] is not None, ok) & ~np.isnan(device)
        last = np.maximum.accumulate(np.where(sound, np.arange(len(ts)), -1))
        bad = np.flatnonzero(~ok) + 1
        before = last[bad]
        near = (before >= 0) & (ts[bad] - ts[before] <= self.tolerance)
        if last[-1] >= 0:
            self.last.update((float(ts[last[-1]]), int(device[last[-1]])))
        credited = pd.array(np.where(near, np.nan_to_num(device[before]), 0).astype("int64"), dtype="Int64")
        credited[~near] = pd.NA
        yield pd.DataFrame({"seq": batch["seq"].to_numpy(dtype="int64")[bad - 1], "credited": credited})

    def close(self) -> None:
        pass


def crc_credits(packets: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``seq, credited`` of each corrupted packet of a stream (``source, channel, seq, ts, device_id, crc_ok``); arrival order inside a micro-batch is by ``seq``."""
    return packets.groupBy("source", "channel").transformWithStateInPandas(CrcCredit(tolerance), "seq long, credited long", outputMode="append", timeMode="none")


class Watchdog(StatefulProcessor):
    """Per receiver when it was last heard; a timer tells each stall, retries with a pause, and gives up after some attempts."""

    def __init__(self, stall: float = 60.0, min_gap: float = 30.0, most: int = 3):
        self.stall, self.min_gap, self.most = stall, min_gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last double, attempts int, stuck boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(float(r["ts"].max()) for r in rows)
        if self.state.exists():
            last = max(last, self.state.get()[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update((last, 0, False))
        self.handle.registerTimer(int((last + self.stall) * 1000) + 1)
        yield pd.DataFrame({"sniffer": pd.Series(dtype="string"), "silent_for": pd.Series(dtype="float64"), "attempt": pd.Series(dtype="int32"), "stuck": pd.Series(dtype="bool")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, attempts, stuck = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if stuck:
            return
        attempts += 1
        stuck = attempts > self.most
        self.state.update((last, attempts, stuck))
        if not stuck:
            self.handle.registerTimer(int((now + self.min_gap) * 1000))
        yield pd.DataFrame({"sniffer": [str(key[0])], "silent_for": [now - last], "attempt": pd.Series([attempts], dtype="int32"), "stuck": [stuck]})

    def close(self) -> None:
        pass


def watchdog(packets: DataFrame, at: str = "at", late: str = "5 seconds", **limits) -> DataFrame:
    """Stall alarms of a stream (``sniffer``, ``ts`` in seconds, ``at`` the same as TIMESTAMP): ``sniffer, silent_for, attempt, stuck``, by event time."""
    return packets.withWatermark(at, late).groupBy("sniffer").transformWithStateInPandas(Watchdog(**limits), "sniffer string, silent_for double, attempt int, stuck boolean", outputMode="append", timeMode="eventTime")


def stall_steps(silent: list[tuple[float, float | None]], now: float, stall: float = 60.0) -> list[bool]:
    """Whether each receiver (started, last heard or None) is stalled: by its last packet, or its start if it never had one."""
    return [now - (last if last is not None else started) > stall for started, last in silent]


class TemplateMiner(StatefulProcessor):
    """A parse tree per source: the first line of a template passes verbatim, repeats are counted and told in a summary per micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tree", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import re

        batch = pd.concat(rows).sort_values("ts", kind="stable")
        tree, stats = pickle.loads(self.state.get()[0]) if self.state.exists() else (DrainTree(), {})
        masks = [(re.compile(p), n) for p, n in MASKS]
        lines, repeated = [], {}
        for ts, body in zip(batch["ts"], batch["body"]):
            m = body
            for pattern, name in masks:
                m = pattern.sub(name, m)
            group, new, template = tree.add(m)
            n, first, before, total, squares, gaps = stats.get(group, (0, ts, None, 0.0, 0.0, 0))
            if before is not None and ts > before:
                total, squares, gaps = total + ts - before, squares + (ts - before) ** 2, gaps + 1
            stats[group] = (n + 1, first, ts, total, squares, gaps)
            if new:
                lines.append(("line", body, 1, ts, None, None))
            repeated[group] = (repeated.get(group, (0, ""))[0] + 1, template)
        for group, (n, template) in repeated.items():
            if n >= 2:
                count, _, last, total, squares, gaps = stats[group]
                mean = total / gaps if gaps else None
                lines.append(("summary", template, count, last, mean, max(0.0, squares / gaps - mean * mean) ** 0.5 if gaps else None))
        stats = {g: s for g, s in stats.items() if g in tree.groups}
        self.state.update((pickle.dumps((tree, stats)),))
        out = pd.DataFrame(lines, columns=["kind", "text", "n", "ts", "interval_avg", "interval_jitter"])
        out.insert(0, "source", str(key[0]))
        yield out.astype({"n": "int64", "ts": "float64", "interval_avg": "float64", "interval_jitter": "float64"})

    def close(self) -> None:
        pass


def templates(lines: DataFrame) -> DataFrame:
    """``source, kind, text, n, ts, interval_avg, interval_jitter`` of a stream of lines (``source, ts, body``); the state of a source is its tree, of at most 1024 groups."""
    return lines.groupBy("source").transformWithStateInPandas(
        TemplateMiner(), "source string, kind string, text string, n long, ts double, interval_avg double, interval_jitter double", outputMode="append", timeMode="none"
    )
