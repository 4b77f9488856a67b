"""Camera motion: a chain of anchors, and the fit of a similarity to matched points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSES = "clip_id long, frame long, a double, b double, c double, d double, tx double, ty double, anchored boolean"


def covered(m: np.ndarray, width: float, height: float) -> float:
    """Share of the canvas that the moved canvas still covers."""
    p = np.array([[0, 0], [width, 0], [width, height], [0, height]], float) @ m[:, :2].T + m[:, 2]
    for axis, limit, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        if not len(p):
            return 0.0
        inside = sign * (p[:, axis] - limit) >= 0
        q = []
        for i in range(len(p)):
            a, b, ia, ib = p[i - 1], p[i], inside[i - 1], inside[i]
            if ia != ib:
                q.append(a + (b - a) * (limit - a[axis]) / (b[axis] - a[axis]))
            if ib:
                q.append(b)
        p = np.array(q).reshape(-1, 2)
    if len(p) < 3:
        return 0.0
    x, y = p.T
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    return min(1.0, area / (width * height))


def compose(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The 2x3 matrix that applies q first, then p."""
    return np.hstack([p[:, :2] @ q[:, :2], (p[:, :2] @ q[:, 2] + p[:, 2])[:, None]])


def chained(motions, width: float, height: float, min_overlap: float):
    """(pose, anchored) for each (usable, motion) of a clip, in frame order.

    A motion maps the frame into the current anchor's; None is a failed fit.
    The first usable frame is the first anchor, at the identity. A frame with
    nothing to match holds the pose and changes nothing. After a failed fit
    the frame takes over as anchor at the old anchor's pose, for there is no
    other. A fitted frame that covers too little of the anchor takes over at
    its own pose.
    """
    anchor = pose = np.hstack([np.eye(2), np.zeros((2, 1))])
    started = False
    for usable, motion in motions:
        if not usable:
            yield pose, False
        elif not started:
            started = True
            yield pose, True
        elif motion is None:
            pose = anchor
            yield pose, True
        else:
            pose = compose(anchor, motion)
            moves_on = covered(motion, width, height) < min_overlap
            if moves_on:
                anchor = pose
            yield pose, moves_on


def chain_poses(motions: DataFrame, width: float, height: float, min_overlap: float) -> DataFrame:
    """Poses of (clip_id, frame, a..ty) motions against the current anchor; a null ``a`` is a failed fit.

    Frames with too few features have ``usable`` false; without that column all
    frames are usable. The chain is a fold in frame order: a few numbers for
    each frame of one clip meet.
    """

    def fold(frame):
        frame = frame.sort_values("frame")
        rows = frame[["usable", "a", "b", "c", "d", "tx", "ty"]].to_numpy(object)
        steps = ((u, None if a is None or np.isnan(a) else np.array([[a, b, tx], [c, d, ty]], float)) for u, a, b, c, d, tx, ty in rows)
        out = [(*p[:, :2].ravel(), *p[:, 2], again) for p, again in chained(steps, width, height, min_overlap)]
        names = ["a", "b", "c", "d", "tx", "ty", "anchored"]
        return frame[["clip_id", "frame"]].assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})

    usable = F.coalesce("usable", F.lit(True)) if "usable" in motions.columns else F.lit(True)
    rows = motions.select("clip_id", "frame", usable.alias("usable"), "a", "b", "c", "d", "tx", "ty")
    return rows.groupBy("clip_id").applyInPandas(fold, POSES)


def anchor_events(poses: DataFrame) -> DataFrame:
    return poses.filter("anchored").drop("anchored")


def _similarity(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Least-squares similarity from p to q, as a 2x3 matrix."""
    mp, mq = p.mean(0), q.mean(0)
    z, w = (p - mp) @ [1, 1j], (q - mq) @ [1, 1j]
    norm = np.vdot(z, z).real
    if norm < 1e-12:
        return None
    k = np.vdot(z, w) / norm
    m = np.array([[k.real, -k.imag], [k.imag, k.real]])
    return np.hstack([m, (mq - m @ mp)[:, None]])


def fit_similarity(p: np.ndarray, q: np.ndarray, threshold: float, min_matches: int, rounds: int = 200, seed: int = 0) -> np.ndarray | None:
    """A similarity that most matches agree with within the threshold (pixels); None with too few matches."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    if len(p) < max(2, min_matches):
        return None
    rng, best = np.random.default_rng(seed), None
    for _ in range(rounds):
        i = rng.choice(len(p), 2, replace=False)
        m = _similarity(p[i], q[i])
        if m is None:
            continue
        good = np.hypot(*(p @ m[:, :2].T + m[:, 2] - q).T) < threshold
        if best is None or good.sum() > best.sum():
            best = good
    return None if best is None or best.sum() < 2 else _similarity(p[best], q[best])


def fit_motions(matches: DataFrame, threshold: float, min_matches: int) -> DataFrame:
    """One motion for each (clip_id, frame) of matches (x0, y0) to (x1, y1); null coefficients where the fit fails."""

    def fit(frame):
        m = fit_similarity(frame[["x0", "y0"]].to_numpy(), frame[["x1", "y1"]].to_numpy(), threshold, min_matches)
        v = [np.nan] * 6 if m is None else [m[0, 0], m[0, 1], m[1, 0], m[1, 1], m[0, 2], m[1, 2]]
        return frame[["clip_id", "frame"]].head(1).assign(**dict(zip(("a", "b", "c", "d", "tx", "ty"), v, strict=True)))

    return matches.select("clip_id", "frame", "x0", "y0", "x1", "y1").groupBy("clip_id", "frame").applyInPandas(fit, "clip_id long, frame long, a double, b double, c double, d double, tx double, ty double")


def outside_vehicles(keypoints: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keypoints (clip_id, frame, kx, ky) that lie in no box of their frame; boxes are widened to whole pixels."""
    b = boxes.select("clip_id", "frame", F.floor("x").alias("x0"), F.floor("y").alias("y0"), F.ceil(F.col("x") + F.col("w")).alias("x1"), F.ceil(F.col("y") + F.col("h")).alias("y1")).alias("b")
    k = keypoints.alias("k")
    hit = (F.col("k.clip_id") == F.col("b.clip_id")) & (F.col("k.frame") == F.col("b.frame")) & (F.col("kx") >= F.col("x0")) & (F.col("kx") < F.col("x1")) & (F.col("ky") >= F.col("y0")) & (F.col("ky") < F.col("y1"))
    return k.join(b, hit, "left_anti")
