"""The causal path: smoothing and thinning of observations as they arrive, and progress events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from motionloom.operators.cadence import Grid
from motionloom.operators.smoothing import CausalFilter

SAMPLES = "clip_id long, track_id long, frame long, ts double, px double, py double, vx double, vy double, ax double, ay double"


class TrackFilter(StatefulProcessor):
    """One causal filter for each (clip_id, track_id). Rows are taken in order of frame within a batch; a row whose time doesn't move on is late and is left out."""

    def __init__(self, pos_noise: float, jerk: float):
        self.settings = (pos_noise, jerk)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("filter", "ts double, x array<double>, p array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.last.get() if self.last.exists() else None
        flt = CausalFilter(*self.settings, state=(kept[1], kept[2]) if kept else None)
        ts, out = kept[0] if kept else None, []
        for _, r in pd.concat(list(rows)).sort_values(["frame", "row_id"]).iterrows():
            if ts is not None and r["ts"] <= ts:
                continue
            s = flt.observe(r["cx"], r["cy"], 0.0 if ts is None else r["ts"] - ts)
            ts = float(r["ts"])
            out.append((key[0], key[1], int(r["frame"]), ts, *s[0], *s[1], *s[2]))
        if out:
            x, p = flt.state()
            self.last.update((ts, x, p))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SAMPLES.split(", ")])

    def close(self) -> None:
        pass


def smooth_stream(obs: DataFrame, pos_noise: float = 2.0, jerk: float = 20.0) -> DataFrame:
    """Causal samples of a stream of observations with ``ts``. Needs the RocksDB state store."""
    rows = obs.select("clip_id", "track_id", "row_id", "frame", "ts", "cx", "cy")
    return rows.groupBy("clip_id", "track_id").transformWithStateInPandas(TrackFilter(pos_noise, jerk), outputStructType=SAMPLES, outputMode="Append", timeMode="None")


class CadenceFilter(StatefulProcessor):
    """The cadence grid of a clip over its stream of timesteps."""

    def __init__(self, interval: float, fps: float):
        self.settings = (interval, fps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due double, ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        grid, last = Grid(*self.settings), None
        if self.due.exists():
            grid.due, last = self.due.get()
        steps = pd.concat(list(rows)).drop_duplicates(["frame"]).sort_values(["ts", "frame"])
        if last is not None:
            steps = steps[steps["ts"] > last]
        if len(steps):
            kept = steps[[grid.accepts(t) for t in steps["ts"]]]
            self.due.update((grid.due, float(steps["ts"].iloc[-1])))
            yield kept[["clip_id", "frame", "ts"]]

    def close(self) -> None:
        pass


def thin_stream(steps: DataFrame, interval: float, fps: float) -> DataFrame:
    """The accepted timesteps of a stream of (clip_id, frame, ts)."""
    return steps.select("clip_id", "frame", "ts").groupBy("clip_id").transformWithStateInPandas(CadenceFilter(interval, fps), outputStructType="clip_id long, frame long, ts double", outputMode="Append", timeMode="None")


class Progress(StreamingQueryListener):
    """Turns query events into started, processed, finished and failed events for a receiver."""

    def __init__(self, receive: Callable[[dict], None]):
        self.receive = receive

    def onQueryStarted(self, event) -> None:
        self.receive({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.receive({"event": "processed", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "milliseconds": dict(p.durationMs)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.receive({"event": "failed" if event.exception else "finished", "id": str(event.id), "error": event.exception})


def tee(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, **options):
    """Run a stream into several sinks; a batch is computed once and given to each."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
