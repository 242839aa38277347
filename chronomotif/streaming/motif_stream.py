"""Motifs over a stream of events with event time: completed instances out, state bounded by window and watermark.

An extension: the event log as a Structured Streaming source. Time step t is event time t * ``step_ms``. Events may come out of
order within the watermark's delay: ``transformWithState`` keeps them by time until a timer of that time fires, so they are
matched in order once nothing earlier can come. Later rows are dropped and counted by Spark (numRowsDroppedByWatermark). A
graph's state is a map of its recent adds by node; a timer one step after the window takes out what can't be part of an instance
any more, so a graph without events leaves no state. Without a window all adds stay. The result is that of the batch
operator in monomorphism mode, row by row. The session needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronomotif.plans import catalog

OUT = "graph_id bigint, motif_name string, first_time int, last_time int"


def completed(near: dict[int, list[tuple[int, int]]], new: tuple[int, int, int], edges: list[tuple[int, int]], window: int) -> list[int]:
    """First times of instances whose last event is ``new``, found backwards from it through the adds (other, t) at each node."""
    found: list[int] = []

    def extend(i: int, bound: dict[int, int], later: int) -> None:
        if i < 0:
            found.append(later)
            return
        a, b = edges[i]
        if a in bound:
            ways = [(a, b, bound[a])]
        elif b in bound:
            ways = [(b, a, bound[b])]
        else:
            ways = [(a, b, node) for node in near if node not in bound.values()]
        for x, y, node in ways:
            for other, t in near.get(node, ()):
                if t < later and t >= 0 and (window <= 0 or new[2] - t <= window) and (bound[y] == other if y in bound else other not in bound.values()):
                    extend(i - 1, bound | {x: node, y: other}, t)

    a, b = edges[-1]
    for s, d in ((new[0], new[1]), (new[1], new[0])):
        extend(len(edges) - 2, {a: s, b: d}, new[2])
    return found


class Matcher(StatefulProcessor):
    """State of one graph: adds that wait for the watermark, by time, and recent adds, by node."""

    def __init__(self, motif: str, window: int, step_ms: int):
        self.motif, self.edges, self.window, self.step_ms = motif, catalog.EDGES[motif], window, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t int", "lo array<int>, hi array<int>")
        self.recent = handle.getMapState("recent", "node int", "other array<int>, t array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come: dict[int, set[tuple[int, int]]] = {}
        for frame in rows:
            for u, v, t in frame[["u", "v", "t"]].itertuples(index=False):
                come.setdefault(int(t), set()).add((int(min(u, v)), int(max(u, v))))
        for t, pairs in come.items():
            if self.waiting.containsKey((t,)):
                lo, hi = self.waiting.getValue((t,))
                pairs |= set(zip(lo, hi, strict=True))
            lo, hi = zip(*sorted(pairs), strict=True)
            self.waiting.updateValue((t,), (list(lo), list(hi)))
            self.handle.registerTimer(t * self.step_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = expiredTimerInfo.getExpiryTimeInMs() // self.step_ms
        near = {node[0]: list(zip(*value, strict=True)) for node, value in self.recent.iterator()}
        if self.window > 0:
            for node, adds in list(near.items()):
                fresh = [x for x in adds if x[1] >= t - self.window]
                if not fresh:
                    self.recent.removeKey((node,))
                    del near[node]
                elif len(fresh) < len(adds):
                    near[node] = fresh
                    self._keep(node, fresh)
        if not self.waiting.containsKey((t,)):
            return
        pairs = list(zip(*self.waiting.getValue((t,)), strict=True))
        self.waiting.removeKey((t,))
        firsts = [first for lo, hi in pairs for first in completed(near, (lo, hi, t), self.edges, self.window)]
        for node in {x for pair in pairs for x in pair}:
            self._keep(node, near.get(node, []) + [(hi if lo == node else lo, t) for lo, hi in pairs if node in (lo, hi)])
        if self.window > 0:
            self.handle.registerTimer((t + self.window + 1) * self.step_ms)
        if firsts:
            yield pd.DataFrame({"graph_id": key[0], "motif_name": self.motif, "first_time": pd.Series(firsts, dtype="int32"), "last_time": pd.Series([t] * len(firsts), dtype="int32")})

    def _keep(self, node: int, adds: list[tuple[int, int]]) -> None:
        other, t = zip(*adds, strict=True)
        self.recent.updateValue((node,), ([int(x) for x in other], [int(x) for x in t]))

    def close(self) -> None:
        pass


def motif_stream(events: DataFrame, motif: str, window: int | None = None, delay: str = "0 seconds", step_ms: int = 1000) -> DataFrame:
    """A streaming table of completed monomorphism instances from streaming (graph_id, seq, u, v, t, op).

    ``delay``: how far behind the latest event others may come. An instance comes out when the watermark has passed its end.
    """
    w = window if window is not None else catalog.WINDOWS["default"][motif]
    adds = events.where("op = 'a' AND u <> v AND t >= 0 AND graph_id IS NOT NULL").withColumn("at", F.timestamp_millis(F.col("t").cast("bigint") * step_ms))
    return adds.withWatermark("at", delay).groupBy("graph_id").transformWithStateInPandas(Matcher(motif, w, step_ms), OUT, "Append", "EventTime")
