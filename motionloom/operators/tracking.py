"""Two-stage association of detections with tracks that a motion model carries on."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np

#: Share of a box's height that its centre and size, and their change by frame, are off by (the usual weights of box filters).
POSITION, VELOCITY = 1 / 20, 1 / 160


@dataclass(frozen=True)
class Options:
    """Scores of at least ``high`` are matched first, those over ``low`` after them; the detector is what keeps doubtful boxes out."""

    low: float = 0.1
    high: float = 0.5
    least: float = 0.2
    patience: int = 30


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (centre x, centre y, w, h), [len(a), len(b)]."""
    lo = np.maximum(a[:, None, :2] - a[:, None, 2:] / 2, b[None, :, :2] - b[None, :, 2:] / 2)
    hi = np.minimum(a[:, None, :2] + a[:, None, 2:] / 2, b[None, :, :2] + b[None, :, 2:] / 2)
    both = np.prod(np.maximum(hi - lo, 0), axis=2)
    total = np.prod(a[:, 2:], axis=1)[:, None] + np.prod(b[:, 2:], axis=1)[None] - both
    return np.divide(both, total, out=np.zeros_like(both), where=total > 0)


def _matched(share: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs in falling order of overlap, each row and column once; of equal ones the first."""
    pairs, rows, cols = [], set(), set()
    i, j = np.nonzero(share >= least)
    for k in np.argsort(-share[i, j], kind="stable"):
        if i[k] not in rows and j[k] not in cols:
            pairs.append((int(i[k]), int(j[k])))
            rows.add(i[k])
            cols.add(j[k])
    return pairs


class Tracks:
    """The live tracks of a clip: a constant-velocity filter for each of centre x, centre y, w and h, all tracks at once."""

    def __init__(self, options: Options):
        self.o, self.fresh, self.frame = options, 0, None
        self.ids, self.seen = np.empty(0, np.int64), np.empty(0, np.int64)
        self.at, self.speed = np.empty((0, 4)), np.empty((0, 4))
        self.var = np.empty((3, 0, 4))  # of the place, of both, of the speed

    def _keep(self, which: np.ndarray) -> None:
        self.ids, self.seen, self.at, self.speed, self.var = self.ids[which], self.seen[which], self.at[which], self.speed[which], self.var[:, which]

    def _predict(self, frames: int) -> None:
        for _ in range(min(frames, self.o.patience + 1)):
            q, v = POSITION * self.at[:, 3:], VELOCITY * self.at[:, 3:]
            self.at = np.concatenate([self.at[:, :2] + self.speed[:, :2], np.maximum(self.at[:, 2:] + self.speed[:, 2:], 1e-3)], axis=1)
            p, c, s = self.var
            self.var = np.stack([p + 2 * c + s + q * q, c + s, s + v * v])

    def _observe(self, rows: list[int], boxes: np.ndarray, frame: int) -> None:
        p, c, s = self.var[:, rows]
        noise = (POSITION * boxes[:, 3:]) ** 2
        k, m = p / (p + noise), c / (p + noise)
        off = boxes - self.at[rows]
        self.at[rows] += k * off
        self.speed[rows] += m * off
        self.var[:, rows] = np.stack([(1 - k) * p, (1 - k) * c, s - m * c])
        self.seen[rows] = frame

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Track ids and filtered boxes (centre form) of a frame's detections; -1 for those that no track takes."""
        if self.frame is not None:
            self._predict(frame - self.frame)
        self.frame = frame
        self._keep(frame - self.seen <= self.o.patience)
        got, out = np.full(len(boxes), -1, np.int64), boxes.astype(float).copy()
        free = np.arange(len(self.ids))
        for chosen in (scores >= self.o.high, (scores < self.o.high) & (scores > self.o.low)):
            mine = np.flatnonzero(chosen)
            pairs = _matched(overlaps(boxes[mine], self.at[free]), self.o.least) if len(mine) and len(free) else []
            if pairs:
                d, t = mine[[i for i, _ in pairs]], free[[j for _, j in pairs]]
                self._observe(t.tolist(), boxes[d], frame)
                got[d], out[d] = self.ids[t], self.at[t]
                free = np.setdiff1d(free, t)
        new = np.flatnonzero((got < 0) & (scores > self.o.low))
        if len(new):
            got[new] = np.arange(self.fresh, self.fresh + len(new))
            self.fresh += len(new)
            size = boxes[new][:, 3:]
            var = np.stack([np.repeat((2 * POSITION * size) ** 2, 4, 1), np.zeros((len(new), 4)), np.repeat((10 * VELOCITY * size) ** 2, 4, 1)])
            self.ids, self.seen = np.append(self.ids, got[new]), np.append(self.seen, np.full(len(new), frame))
            self.at, self.speed = np.concatenate([self.at, boxes[new]]), np.concatenate([self.speed, np.zeros((len(new), 4))])
            self.var = np.concatenate([self.var, var], axis=1)
        return got, out


def timed_step(tracks: Tracks, frame: int, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    began = time.perf_counter()
    got, out = tracks.step(frame, boxes, scores)
    return got, out, time.perf_counter() - began
