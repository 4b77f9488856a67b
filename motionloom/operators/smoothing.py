"""Constant-acceleration Kalman filter with a backward (Rauch-Tung-Striebel) pass, track by track."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Variance of the unknown first velocity and acceleration.
UNKNOWN = 1e6


def transition(dt: float) -> np.ndarray:
    return np.array([[1.0, dt, dt * dt / 2], [0.0, 1.0, dt], [0.0, 0.0, 1.0]])


def process_noise(dt: float, jerk: float) -> np.ndarray:
    d2, d3, d4, d5 = dt**2, dt**3, dt**4, dt**5
    return jerk * np.array([[d5 / 20, d4 / 8, d3 / 6], [d4 / 8, d3 / 3, d2 / 2], [d3 / 6, d2 / 2, dt]])


def _check(pos_noise: float, jerk: float) -> None:
    if pos_noise <= 0 or jerk <= 0:
        raise ValueError("pos_noise and jerk must be positive")


def _transitions(dt: np.ndarray) -> np.ndarray:
    f = np.broadcast_to(np.eye(3), (len(dt), 3, 3)).copy()
    f[:, 0, 1] = f[:, 1, 2] = dt
    f[:, 0, 2] = dt * dt / 2
    return f


def _noises(dt: np.ndarray, jerk: float) -> np.ndarray:
    q = np.empty((len(dt), 3, 3))
    for i, row in enumerate(((20, 8, 6), (8, 3, 2), (6, 2, 1))):
        for j, part in enumerate(row):
            q[:, i, j] = jerk * dt ** (5 - i - j) / part
    return q


def smooth_together(z: np.ndarray, ts: np.ndarray, start: np.ndarray, pos_noise: float, jerk: float, backward: bool = True) -> np.ndarray:
    """States [n, 3, axes] of the rows of many tracks: track i has the rows start[i]:start[i + 1], in time order.

    All tracks go one step at a time, those with the most rows first, so each
    step is a handful of operations on [tracks, 3, 3]. The axes share gains,
    which don't depend on what is measured.
    """
    _check(pos_noise, jerk)
    r, n = pos_noise**2, len(z)
    sizes = np.diff(start)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = np.asarray(start)[:-1][order], sizes[order]
    dt = np.diff(ts, prepend=ts[:1])
    prior, post = np.empty((2, n, 3, z.shape[1]))
    prior_p, post_p = np.empty((2, n, 3, 3))
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 2), side="right")  # tracks with more than k rows
    x = np.zeros((active[0] if steps else 0, 3, z.shape[1]))
    p = np.broadcast_to(np.diag([r, UNKNOWN, UNKNOWN]), (len(x), 3, 3))
    for k in range(steps):
        m = active[k]
        at = begin[:m] + k
        x, p = x[:m], p[:m]
        if k:  # the first measurement updates without a prediction
            f = _transitions(dt[at])
            x, p = f @ x, f @ p @ f.transpose(0, 2, 1) + _noises(dt[at], jerk)
        else:
            x[:, 0] = z[at]
        prior[at], prior_p[at] = x, p
        gain = p[:, :, :1] / (p[:, :1, :1] + r)
        x = x + gain * (z[at] - x[:, 0])[:, None, :]
        p = p - gain @ p[:, :1, :]
        post[at], post_p[at] = x, p
    if backward:
        for k in range(steps - 2, -1, -1):
            at = begin[: active[k + 1]] + k
            c = post_p[at] @ _transitions(dt[at + 1]).transpose(0, 2, 1) @ np.linalg.inv(prior_p[at + 1])
            post[at] += c @ (post[at + 1] - prior[at + 1])
    return post


def filter_and_smooth(z: np.ndarray, ts: np.ndarray, pos_noise: float, jerk: float, backward: bool = True) -> np.ndarray:
    """States [n, 3, axes] of one track's measurements z [n, axes]."""
    z, ts = np.asarray(z, float), np.asarray(ts, float)
    if len(z) != len(ts):
        raise ValueError("measurements and timestamps differ in number")
    if not len(z):
        _check(pos_noise, jerk)
        return np.empty((0, 3, z.shape[1] if z.ndim > 1 else 0))
    return smooth_together(z, ts, np.array([0, len(z)]), pos_noise, jerk, backward)


SAMPLES = "clip_id long, row_id long, frame long, ts double, track_id long, w double, h double, px double, py double, vx double, vy double, ax double, ay double"


def smooth_tracks(obs: DataFrame, pos_noise: float = 2.0, jerk: float = 20.0, backward: bool = True, together: int = 50_000) -> DataFrame:
    """Samples of every track of observations with ``ts``; forward pass only if not ``backward``.

    One shuffle by (clip_id, track_id); only the columns that the filter needs
    travel. A track's rows are ordered by frame, ties by row_id. A task smooths
    about ``together`` rows of whole tracks at once. Rows without a clip or
    track are tracks of their own.
    """
    _check(pos_noise, jerk)
    rows = obs.select("clip_id", "row_id", "frame", "ts", "track_id", "w", "h", "cx", "cy")
    rows = rows.repartition("clip_id", "track_id").sortWithinPartitions("clip_id", "track_id", "frame", "row_id")

    def smoothed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        clip, track = (table.column(k).to_numpy() for k in ("clip_id", "track_id"))
        start = np.concatenate([[0], np.flatnonzero((np.diff(clip) != 0) | (np.diff(track) != 0)) + 1, [len(clip)]])
        z = np.column_stack([table.column(k).to_numpy() for k in ("cx", "cy")])
        s = smooth_together(z, table.column("ts").to_numpy(), start, pos_noise, jerk, backward)
        out = table.drop_columns(["cx", "cy"])
        for i, pair in enumerate((("px", "py"), ("vx", "vy"), ("ax", "ay"))):
            for axis, name in enumerate(pair):
                out = out.append_column(name, pa.array(s[:, i, axis]))
        return out.to_batches()

    def batches(it):
        held, size = [], 0
        for batch in it:
            if not batch.num_rows:
                continue
            if size >= together:
                # Up to the last track that has ended; its last row may be the last one held.
                last = (held[-1].column("clip_id")[-1], held[-1].column("track_id")[-1])
                clip, track = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("clip_id", "track_id"))
                new = np.flatnonzero((clip != last[0].as_py()) | (track != last[1].as_py()))
                if len(new):
                    held.append(batch.slice(0, int(new[0])))
                    yield from smoothed(held)
                    batch, held, size = batch.slice(int(new[0])), [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from smoothed(held)

    return rows.mapInArrow(batches, SAMPLES)


class CausalFilter:
    """The filter one observation at a time, for streams: the first is taken as it is, and time must move on."""

    def __init__(self, pos_noise: float, jerk: float, state: tuple | None = None):
        _check(pos_noise, jerk)
        self.r, self.jerk = pos_noise**2, jerk
        self.x, self.p = (np.array(state[0]).reshape(3, 2), np.array(state[1]).reshape(3, 3)) if state else (None, None)

    def observe(self, x: float, y: float, dt: float) -> np.ndarray:
        if self.x is None:
            self.x = np.zeros((3, 2))
            self.x[0] = x, y
            self.p = np.diag([self.r, UNKNOWN, UNKNOWN])
            return self.x
        if dt <= 0:
            raise ValueError("time must move on")
        f = transition(dt)
        self.x, self.p = f @ self.x, f @ self.p @ f.T + process_noise(dt, self.jerk)
        gain = self.p[:, :1] / (self.p[0, 0] + self.r)
        self.x = self.x + gain @ (np.array([[x, y]]) - self.x[:1])
        self.p = self.p - gain @ self.p[:1, :]
        return self.x

    def state(self) -> tuple[list[float], list[float]]:
        return self.x.ravel().tolist(), self.p.ravel().tolist()
