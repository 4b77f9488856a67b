"""Corners with binary descriptors, for camera motion; numpy only."""

from __future__ import annotations

import functools

import numpy as np

#: Pixels around a corner that its descriptor may reach.
REACH = 16
WORDS = 4
#: No corners, no descriptors.
NONE = np.empty((0, 2), np.int64), np.empty((0, WORDS), np.uint64)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r + 1 pixels; the edge is repeated."""
    n = 2 * r + 1
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        cut = [slice(None)] * 2
        cut[axis] = slice(n, None)
        low = [slice(None)] * 2
        low[axis] = slice(None, -n)
        a = (s[tuple(cut)] - s[tuple(low)]) / n
    return a


def corners(gray: np.ndarray, n: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Up to n corners (x, y): local maxima of the smaller eigenvalue of the structure tensor, strongest first, where the mask is true."""
    height, width = gray.shape
    if min(height, width) <= 2 * REACH + 2:
        return NONE[0]
    gy, gx = np.gradient(gray)
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    inner = strength[REACH:-REACH, REACH:-REACH]
    top = np.full(inner.shape, -np.inf)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            top = np.maximum(top, strength[REACH + dy : height - REACH + dy, REACH + dx : width - REACH + dx])
    good = (inner == top) & (inner > 1.0)
    if mask is not None:
        good &= mask[REACH:-REACH, REACH:-REACH]
    y, x = np.nonzero(good)
    best = np.argsort(-inner[y, x], kind="stable")[:n]
    return np.stack([x[best] + REACH, y[best] + REACH], axis=1)


@functools.lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    """Pairs of points near the centre, drawn once from a fixed seed, turned by 30 steps of 12 degrees: [30, bits, 2, 2] offsets (x, y)."""
    p = np.random.default_rng(7).normal(0, 5, (64 * WORDS, 2, 2))
    p *= np.minimum(1.0, 13 / np.maximum(np.hypot(p[..., 0], p[..., 1]), 1e-9))[..., None]
    turn = np.arange(30) * (2 * np.pi / 30)
    r = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    return np.rint(np.einsum("ijt,bpj->tbpi", r, p)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _disc() -> np.ndarray:
    d = np.arange(-13, 14)
    y, x = np.meshgrid(d, d, indexing="ij")
    inside = x * x + y * y <= 169
    return np.stack([x[inside], y[inside]], axis=1)


def describe(gray: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A descriptor of 256 bits for each corner: which of two smoothed points is brighter, turned with the patch's centre of brightness."""
    if not len(points):
        return NONE[1]
    smooth, disc, pairs = _box(gray, 2), _disc(), _pairs()
    out = []
    for a in range(0, len(points), 512):
        x, y = points[a : a + 512, 0], points[a : a + 512, 1]
        patch = gray[y[:, None] + disc[None, :, 1], x[:, None] + disc[None, :, 0]]
        angle = np.arctan2(patch @ disc[:, 1], patch @ disc[:, 0])
        step = pairs[np.rint(angle / (2 * np.pi) * 30).astype(np.int64) % 30]
        value = smooth[y[:, None, None] + step[..., 1], x[:, None, None] + step[..., 0]]
        out.append(np.packbits(value[..., 0] < value[..., 1], axis=1).view(np.uint64))
    return np.concatenate(out)


def extract(pixels: np.ndarray, n: int, boxes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Corners and descriptors of a blue-green-red or grey frame, outside boxes (x, y, w, h), which are widened to whole pixels."""
    gray = pixels.astype(np.float64) if pixels.ndim == 2 else pixels @ np.array([0.114, 0.587, 0.299])
    mask = None
    if boxes is not None and len(boxes):
        mask = np.ones(gray.shape, bool)
        for x, y, w, h in boxes:
            mask[max(0, int(np.floor(y))) : max(0, int(np.ceil(y + h))), max(0, int(np.floor(x))) : max(0, int(np.ceil(x + w)))] = False
    points = corners(gray, n, mask)
    return points, describe(gray, points)


def match(left: np.ndarray, right: np.ndarray, ratio: float) -> np.ndarray:
    """Pairs (i, j) of descriptors that pass the ratio test, left against right."""
    if not len(left) or len(right) < 2:
        return np.empty((0, 2), np.int64)
    out = []
    for a in range(0, len(left), 256):
        gap = np.bitwise_count(left[a : a + 256, None, :] ^ right[None]).sum(axis=2, dtype=np.int64)
        two = np.argpartition(gap, 1, axis=1)[:, :2]
        d = np.take_along_axis(gap, two, axis=1)
        first = d.argmin(axis=1)
        row = np.arange(len(gap))
        good = d[row, first] < ratio * d[row, 1 - first]
        out.append(np.stack([row[good] + a, two[row, first][good]], axis=1))
    return np.concatenate(out)
