"""Progress of running workers from a stream of log lines."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxelspark.functions import progress as P

OUTPUT = "run_id long, seq long, phase string, factor double"
STATE = "phase string, factor double, meshes long, arches long, last long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_SECONDS = 6 * 3600         # a run that says nothing for so long is given up
OPENS = {"reading": "read", "computing": "net", "surfaces": "mesh", "separating": "teeth"}
AT_ONCE = {"reading": P.START, "resampled": P.READ, "computing": P.READ, "surfaces": P.NET,
           "separating": P.MESH, "done": 1.0}


class Gauge:
    """Progress of one run; the state is a stage, a share, two counters and the last line's number."""

    def __init__(self, state, n_classes: int, mesh_end: float):
        self.phase, self.factor, self.meshes, self.arches, self.last = state
        self.n_classes, self.mesh_end = max(1, n_classes), mesh_end
        self.done = False

    def feed(self, seq: int, event: str | None, part: float | None) -> tuple[int, str | None, float | None]:
        teeth = P.TEETH - P.MESH
        if event in OPENS:
            self.phase = OPENS[event]
            self.meshes = 0 if event == "surfaces" else self.meshes
            self.arches = 0 if event == "separating" else self.arches
        if event in AT_ONCE:
            self.factor = AT_ONCE[event]
        elif event == "mesh" and self.phase == "mesh":
            self.meshes += 1
            self.factor = P.NET + (self.mesh_end - P.NET) * min(1.0, self.meshes / self.n_classes)
        elif event == "arch" and self.phase == "teeth":
            self.arches += 1
            self.factor = P.MESH + teeth * self.arches / 2
        elif event == "tile" and self.phase in ("net", "teeth") and part is not None:
            self.factor = (P.READ + (P.NET - P.READ) * part if self.phase == "net"
                           else P.MESH + teeth * (self.arches + part) / 2)
        self.last, self.done = seq, event == "done"
        return seq, self.phase, self.factor

    def state(self):
        return self.phase, self.factor, self.meshes, self.arches, self.last


class Progress(StatefulProcessor):
    """Feeds a run's lines to its gauge one by one. State goes when the run is done, or silent for too long."""

    def __init__(self, n_classes: int, mesh_end: float, idle_seconds: float):
        self.n_classes, self.mesh_end, self.idle = n_classes, mesh_end, int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gauge = handle.getValueState("gauge", STATE)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        gauge = Gauge(self.gauge.get() if self.gauge.exists() else (None, None, 0, 0, None), self.n_classes, self.mesh_end)
        early: list = []                                 # lines that came before one they follow
        for r in rows:
            heapq.heappush(early, (r["seq"], r["event"] or "", r["part"]))
            while early and gauge.last is not None and early[0][0] == gauge.last + 1 or early and gauge.last is None and early[0][0] == 0:
                yield Row(run_id=key[0], **self._out(gauge.feed(*heapq.heappop(early))))
        while early:                                     # after a gap: in order of what is there
            yield Row(run_id=key[0], **self._out(gauge.feed(*heapq.heappop(early))))
        self._forget_timers()
        if gauge.done:
            self.gauge.clear()
        else:
            self.gauge.update(gauge.state())
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    @staticmethod
    def _out(fed) -> dict:
        return dict(zip(("seq", "phase", "factor"), fed, strict=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.gauge.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_progress_stream(lines: DataFrame, n_classes: int = P.N_CLASSES, teeth: bool = True,
                        idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """``phase`` and ``factor`` after every line of a streaming (run_id, seq, line).

    State per run is five small values, and ends: it is removed with the run's last line
    (``done in``) or when nothing has come for ``idle_seconds``. Lines of a run must come in
    order from batch to batch; within a batch only those that came too early are held. A line
    that comes after the run's last one starts a run anew. Sets the session's state store to
    one with timers (RocksDB). Timers fire with the query's batches; one that shall stop by
    itself (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = lines.select("run_id", "seq", P.event_of(F.col("line")).alias("event"), P.tile_share(F.col("line")).alias("part"))
    processor = Progress(n_classes, P.MESH if teeth else P.MESH_ALONE, idle_seconds)
    return rows.groupBy("run_id").transformWithState(processor, OUTPUT, "append", "ProcessingTime")
