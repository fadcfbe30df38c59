"""Smoothing of many tracks at a time: a constant-acceleration filter and its backward pass over lanes.

A lane is one axis of one track. Lanes of similar length stand side by side, and each step
in time is plain arithmetic on all of them: the state (position, speed, acceleration) and
the six distinct entries of its covariance are arrays over lanes. Measurements are taken in
one by one, as scalars. The backward pass carries the adjoint of the state instead of
smoothed covariances, so that no matrix is ever inverted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trailspark.operators.lineage import python_workers

#: Cells (samples of lanes) that are worked on at a time.
CELLS = 1 << 20
#: Rows of whole tracks that reach a kernel at a time, at least, unless a partition has fewer.
ROWS = 20_000


def whole_groups(df: DataFrame, key: str, order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema, rows: int = ROWS) -> DataFrame:
    """``run`` over frames of whole groups, several at a time, each in ``order``: a sort in partitions by key, then one stream through Python.

    Memory holds about ``rows`` rows, or one longer group.
    """
    python_workers(df.sparkSession)

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < rows:
                continue
            every = pd.concat(held, ignore_index=True)
            cut = int(_group_starts(every[key].to_numpy())[-1])  # the last group may go on
            if cut:
                yield run(every.iloc[:cut].reset_index(drop=True))
            held, size = [every.iloc[cut:]], len(every) - cut
        if size:
            yield run(pd.concat(held, ignore_index=True))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(stream, schema)


def _group_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def bounds_of(keys) -> np.ndarray:
    """First rows of the groups of a sorted key, and the end."""
    keys = np.asarray(keys)
    return np.append(_group_starts(keys), len(keys))


def chunks_of(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of similar length, at most about ``CELLS`` cells at a time."""
    size = np.diff(bounds)
    order = np.argsort(size, kind="stable")[::-1]
    at = 0
    while at < len(order):
        n = max(1, CELLS // max(int(size[order[at]]), 1))
        yield order[at : at + n]
        at += n


def smooth_lanes(bounds, t, z, sigma, jerk: float, zv=None, sigma_v=None, gate: float = 3.5) -> tuple[np.ndarray, np.ndarray]:
    """Positions and speeds of lanes that share ``t`` (and groups ``bounds``); z, sigma, zv and sigma_v have a column for each axis.

    White jerk of deviation ``jerk``; a position is always used, a speed where it is finite
    and its innovation within ``gate`` deviations.
    """
    z, sigma = (np.asarray(v, float) for v in (z, sigma))
    p, v = np.empty_like(z), np.empty_like(z)
    for groups in chunks_of(bounds):
        size = np.diff(bounds)[groups]
        n = int(size.max())
        at = bounds[groups][None, :] + np.minimum(np.arange(n)[:, None], size - 1)
        alive = np.arange(n)[:, None] < size
        dt = np.zeros((n, len(groups)))
        dt[1:] = np.where(alive[1:], t[at[1:]] - t[at[:-1]], 0.0)
        for axis in range(z.shape[1]):
            speed = zv[at, axis] if zv is not None else None
            dev = sigma_v[at] if sigma_v is not None else None
            got = _both_passes(dt, z[at, axis], sigma[at], jerk, alive, speed, dev, gate)
            for out, values in zip((p, v), got, strict=True):
                out[at[alive], axis] = values[alive]
    return p, v


def _both_passes(dt, z, sigma, jerk, alive, zv, sigma_v, gate):
    n, lanes = z.shape
    has_v = np.isfinite(zv) & alive if zv is not None else np.zeros_like(alive)
    zv = np.where(has_v, zv, 0.0) if zv is not None else np.zeros_like(z)
    rv = np.where(has_v, sigma_v, 1.0) ** 2 if sigma_v is not None else np.ones_like(z)
    r = sigma**2
    wide = (50 * np.nanmedian(np.where(alive, sigma, np.nan), axis=0)) ** 2
    s0, s1, s2 = z[0].copy(), zv[0].copy(), np.zeros(lanes)
    p00, p11, p22 = r[0].copy(), np.where(has_v[0], rv[0], wide), wide.copy()
    p01, p02, p12 = np.zeros(lanes), np.zeros(lanes), np.zeros(lanes)
    state, cov = np.empty((n, 2, lanes)), np.empty((n, 5, lanes))
    gain_p, gain_v = np.zeros((n, 4, lanes)), np.zeros((n, 4, lanes))
    q = float(jerk) ** 2
    for k in range(n):
        d = dt[k]
        if k:
            h = d * d / 2
            s0, s1 = s0 + d * s1 + h * s2, s1 + d * s2
            a0, a1, a2 = p00 + d * p01 + h * p02, p01 + d * p11 + h * p12, p02 + d * p12 + h * p22
            b1, b2 = p11 + d * p12, p12 + d * p22
            p00, p01, p02 = a0 + d * a1 + h * a2 + q * d**5 / 20, a1 + d * a2 + q * d**4 / 8, a2 + q * d**3 / 6
            p11, p12, p22 = b1 + d * b2 + q * d**3 / 3, b2 + q * d**2 / 2, p22 + q * d
        on = alive[k]
        var = p00 + r[k]
        y = np.where(on, (z[k] - s0) / var, 0.0)
        g0, g1, g2 = (np.where(on, c / var, 0.0) for c in (p00, p01, p02))
        gain_p[k] = g0, g1, g2, y
        s0, s1, s2 = s0 + p00 * y, s1 + p01 * y, s2 + p02 * y
        p00, p01, p02, p11, p12, p22 = p00 - g0 * p00, p01 - g0 * p01, p02 - g0 * p02, p11 - g1 * p01, p12 - g1 * p02, p22 - g2 * p02
        if has_v[k].any():
            var = p11 + rv[k]
            miss = zv[k] - s1
            on = has_v[k] & (miss**2 < gate**2 * var)
            y = np.where(on, miss / var, 0.0)
            g0, g1, g2 = (np.where(on, c / var, 0.0) for c in (p01, p11, p12))
            gain_v[k] = g0, g1, g2, y
            s0, s1, s2 = s0 + p01 * y, s1 + p11 * y, s2 + p12 * y
            p00, p01, p02, p11, p12, p22 = p00 - g0 * p01, p01 - g0 * p11, p02 - g0 * p12, p11 - g1 * p11, p12 - g1 * p12, p22 - g2 * p12
        state[k], cov[k] = (s0, s1), (p00, p01, p02, p11, p12)
    l0, l1, l2 = np.zeros(lanes), np.zeros(lanes), np.zeros(lanes)
    for k in range(n - 1, -1, -1):
        p00, p01, p02, p11, p12 = cov[k]
        state[k, 0] -= p00 * l0 + p01 * l1 + p02 * l2
        state[k, 1] -= p01 * l0 + p11 * l1 + p12 * l2
        g0, g1, g2, y = gain_v[k]
        l1 = l1 - (g0 * l0 + g1 * l1 + g2 * l2 + y)
        g0, g1, g2, y = gain_p[k]
        l0 = l0 - (g0 * l0 + g1 * l1 + g2 * l2 + y)
        d = dt[k]
        l1, l2 = l1 + d * l0, l2 + d * l1 + d * d / 2 * l0
    return state[:, 0], state[:, 1]


def local_medians(bounds, t, values, seconds: float) -> np.ndarray:
    """Median of the values of a sample's group within ``seconds`` before and after it."""
    t, values = np.asarray(t, float), np.asarray(values, float)
    low, high = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        low[a:b] = a + np.searchsorted(t[a:b], t[a:b] - seconds, "left")
        high[a:b] = a + np.searchsorted(t[a:b], t[a:b] + seconds, "right")
    out, width = np.empty(len(t)), high - low
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        widest = int(width[order[min(at + CELLS, len(order)) - 1]])
        who = order[at : at + max(1, CELLS // max(widest, 1))]
        w = int(width[who].max(initial=1))
        place = low[who][:, None] + np.arange(w)
        seen = np.where(place < high[who][:, None], values[np.minimum(place, len(values) - 1)], np.inf)
        seen.sort(axis=1)
        mine = np.arange(len(who))
        out[who] = (seen[mine, (width[who] - 1) // 2] + seen[mine, width[who] // 2]) / 2
        at += len(who)
    return out


def smooth_tracks(bounds, t, x, y, car: float, jacobian=None, zv=None, sigma_v=None, slip=0.0, sigma_meas: float = 0.04, sigma_jerk: float = 0.35, gate: float = 3.5, window_s: float = 0.5) -> pd.DataFrame:
    """x, y, vx, vy and speed of all tracks by two passes.

    The first pass weighs samples by the local scale and slip; the second one by the
    residuals around them too, those of both axes together, for places and, where a track has
    five speeds or more, for speeds.
    """
    t = np.asarray(t, float)
    z = np.column_stack([np.asarray(x, float), np.asarray(y, float)])
    least, jerk = sigma_meas * car, sigma_jerk * car
    sigma = np.hypot(least * np.maximum(1.0 if jacobian is None else np.asarray(jacobian, float), 1.0) * np.ones(len(t)), slip)
    zv = None if zv is None else np.asarray(zv, float)
    sigma_v = None if sigma_v is None else np.asarray(sigma_v, float) * np.ones(len(t))
    p, v = smooth_lanes(bounds, t, z, sigma, jerk, zv, sigma_v, gate)
    sigma = np.maximum(sigma, np.maximum(local_medians(bounds, t, np.hypot(*(z - p).T), window_s), least))
    if zv is not None:
        seen = np.flatnonzero(np.isfinite(zv[:, 0]))
        count = np.searchsorted(seen, bounds)
        enough = np.repeat(np.diff(count) >= 5, np.diff(bounds))
        seen = seen[enough[seen]]
        if len(seen):
            inner = bounds_of(np.searchsorted(bounds, seen, "right"))
            around = local_medians(inner, t[seen], np.hypot(*(zv[seen] - v[seen]).T), window_s)
            floor = np.repeat(np.minimum.reduceat(sigma_v[seen], inner[:-1]), np.diff(inner))
            sigma_v = sigma_v.copy()
            sigma_v[seen] = np.maximum(sigma_v[seen], np.maximum(around, floor))
    p, v = smooth_lanes(bounds, t, z, sigma, jerk, zv, sigma_v, gate)
    return pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "vx": v[:, 0], "vy": v[:, 1], "speed": np.hypot(v[:, 0], v[:, 1])})
