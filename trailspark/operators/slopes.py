"""Medians of the slopes of all pairs of points without all pairs: counted by merging, listed near the median only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

APART = 1e-9  # pairs nearer in time have no slope
LISTED = 100_000  # pairs around the median that are always few enough to list


def _levels(p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Stable partitions of the permutation ``p`` by its bits, the highest first: values, bits, their group's start, ones before them in it, values after it, half a group."""
    at = np.arange(len(p))
    for b in range((len(p) - 1).bit_length() - 1, -1, -1):
        one, start = (p >> b) & 1, (p >> (b + 1)) << (b + 1)
        ones = np.cumsum(one) - one
        before = ones - ones[start]
        after = np.empty_like(p)
        after[np.where(one, start + (1 << b) + before, at - before)] = p
        yield p, one, start, before, after, 1 << b
        p = after


def inversions(p: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[a] w[b] over the pairs of values a > b where a stands before b."""
    total = 0
    for values, one, start, _, _, _ in _levels(p):
        mine = w[values]
        ones = np.cumsum(mine * one)
        total += int(np.dot(mine * (1 - one), ones - ones[start] + (mine * one)[start]))
    return total


def inverted(p: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of values a > b where a stands before b; with ``most``, that many of them."""
    a, b, n = [], [], 0
    for values, one, start, before, after, half in _levels(p):
        zero = np.flatnonzero((one == 0) & (before > 0))
        if most is not None:
            zero = zero[: 1 + np.searchsorted(np.cumsum(before[zero]), most - n)]
        size = before[zero]
        ends = np.cumsum(size)
        n += int(size.sum())
        a.append(after[np.repeat(start[zero] + half - ends + size, size) + np.arange(size.sum())])
        b.append(np.repeat(values[zero], size))
        if most is not None and n >= most:
            break
    return np.concatenate(a)[:most], np.concatenate(b)[:most]


def _together(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted times that differ, but not by more than ``APART``."""
    first = np.searchsorted(t, t, side="right")
    size = np.searchsorted(t - APART, t, side="right") - first
    size = np.maximum(size, 0)
    i = np.repeat(np.arange(len(t)), size)
    j = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    ok = t[j] - t[i] <= APART
    return i[ok], j[ok]


def distinct(t, s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different points in order of time, then place, and the number of the one that each point is."""
    t, s = np.asarray(t, float), np.asarray(s, float)
    if not (np.isfinite(t).all() and np.isfinite(s).all()):
        raise ValueError("points of a robust line must be finite")
    order = np.lexsort((s, t))
    new = np.ones(len(t), bool)
    new[1:] = (np.diff(t[order]) != 0) | (np.diff(s[order]) != 0)
    of = np.empty(len(t), np.int64)
    of[order] = np.cumsum(new) - 1
    return t[order][new], s[order][new], of


def sampled(t: np.ndarray, s: np.ndarray, w: np.ndarray, shares: list[float], size: int = 20_000) -> np.ndarray | None:
    """About where these shares of the slopes are: a first guess of where to count, which no result depends on."""
    upto = np.cumsum(w)
    i, j = np.searchsorted(upto, np.random.default_rng(0).integers(0, upto[-1], (2, size)), side="right")
    dt = t[j] - t[i]
    ok = np.abs(dt) > APART
    return np.quantile((s[j] - s[i])[ok] / dt[ok], shares) if ok.any() else None


def median_slope(t: np.ndarray, s: np.ndarray, w: np.ndarray, near: tuple[float, float] | None = None) -> float | None:
    """Median of the slopes of all pairs of the points (different ones, in order of time, then place), each there ``w`` times; null if none are apart in time.

    Two slopes are found that hold the median between them and few others: a pair's slope is
    less than m where s - m t puts the later point first, so the pairs are counted as
    inversions. Those between are listed and sorted. ``near`` guesses the two. If too many
    pairs are equal but for rounding (1e-13), one of them stands for all.
    """
    i, j = _together(t)
    _, groups = np.unique(t, return_inverse=True)
    sums = np.bincount(groups, w).astype(np.int64).tolist()
    total = (int(w.sum()) ** 2 - sum(g * g for g in sums)) // 2 - int(np.dot(w[i], w[j]))
    if total <= 0:
        return None
    want = (total - 1) // 2, total // 2
    middle = t[len(t) // 2]
    least = 1e-13 * (np.ptp(s) or 1.0) / np.ptp(t)

    def left(m: float) -> np.ndarray:
        return s - m * (t - middle)

    def below(m: float) -> int:
        r = left(m)
        return inversions(np.argsort(r, kind="stable"), w) - int(np.dot(w[i], w[j] * (r[j] < r[i])))

    guess = near if near is not None else sampled(t, s, w, [0.48, 0.52])
    lo, hi = (-least, least) if guess is None else map(float, guess)
    step = max(hi - lo, 4 * least, 4e-13 * max(abs(lo), abs(hi)))
    lo, hi = (lo, hi) if hi > lo else (lo - step / 2, hi + step / 2)
    n_lo, n_hi = below(lo), None
    while n_lo > want[0]:
        lo, hi, n_hi, step = lo - step, lo, n_lo, 4 * step
        n_lo = below(lo)
    n_hi = below(hi) if n_hi is None or n_hi <= want[1] else n_hi
    while n_hi <= want[1]:
        lo, n_lo, hi, step = (hi, n_hi, hi + step, 4 * step) if n_hi <= want[0] else (lo, n_lo, hi + step, 4 * step)
        n_hi = below(hi)
    pairs, most, turn = len(t) * (len(t) - 1) / 2, max(LISTED, 8 * len(t)), 0
    while (share := (n_hi - n_lo) / total * pairs / most) > 1 and hi - lo > max(least, 1e-13 * max(abs(lo), abs(hi))):
        turn += 1
        place = lo + (hi - lo) * (total / 2 - n_lo) / (n_hi - n_lo)
        for x in ((lo + hi) / 2,) if turn % 3 == 0 else (place - (hi - lo) / share / 4, place + (hi - lo) / share / 4):
            if lo < x < hi:
                n = below(x)
                if n <= want[0]:
                    lo, n_lo = x, n
                elif n > want[1]:
                    hi, n_hi = x, n
    by_lo, by_hi = np.argsort(left(lo), kind="stable"), np.argsort(left(hi), kind="stable")
    rank = np.empty_like(by_lo)
    rank[by_lo] = np.arange(len(t))
    a, b = inverted(rank[by_hi], None if share <= 1 else LISTED)
    a, b = by_lo[a], by_lo[b]
    dt = t[a] - t[b]
    a, b, dt = a[np.abs(dt) > APART], b[np.abs(dt) > APART], dt[np.abs(dt) > APART]
    slopes = (s[a] - s[b]) / dt
    if share > 1:
        return float(np.median(slopes))
    order = np.argsort(slopes, kind="stable")
    reached = n_lo + np.cumsum((w[a] * w[b])[order])
    return float(slopes[order][np.searchsorted(reached, want, side="right")].mean())


def counted(t: np.ndarray, s: np.ndarray, many: np.ndarray, m: float) -> np.ndarray:
    """How many slopes of the points are below ``m``, for each row of weights of ``many`` (rows of one sum); the points are put in order once for all rows."""
    i, j = _together(t)
    r = s - m * (t - t[len(t) // 2])
    p = np.argsort(r, kind="stable")
    now, at = np.take(many, p, axis=1), np.arange(len(p))
    kind = np.int32 if many[0].sum(dtype=float) < 2**31 else np.int64
    total = np.array([-float(np.dot(w[i].astype(float), w[j] * (r[j] < r[i]))) for w in many])
    for _, one, start, before, _, half in _levels(p):
        place = np.where(one, start + half + before, at - before)
        turn = np.empty_like(place)
        turn[place] = at
        ones, zeros, wide = one.astype(now.dtype), (1 - one).astype(now.dtype), 2 * half
        for k, w in enumerate(now):
            # whole numbers below 2**53, so doubles are exact
            rest = w * zeros
            upto, left = np.cumsum(w * ones, dtype=kind), np.cumsum(rest, dtype=kind)
            first = left[wide - 1 :: wide]
            mine = np.diff(first if len(left) % wide == 0 else np.append(first, left[-1]))
            total[k] += np.dot(rest.astype(float), upto.astype(float)) - np.dot(mine.astype(float), upto[wide - 1 : -1 : wide].astype(float))
            now[k] = w[turn]
    return total.astype(np.int64)


def degrees(t: np.ndarray, s: np.ndarray, w: np.ndarray, m: float) -> np.ndarray:
    """About how much weight each point's slopes below ``m`` lead to (pairs together in time aren't told apart)."""
    p = np.argsort(s - m * (t - t[len(t) // 2]), kind="stable")
    out = np.zeros(len(p))
    for values, one, start, _, _, half in _levels(p):
        mine = w[values].astype(float)
        upto, zeros = np.cumsum(mine * one), np.cumsum(mine * (1 - one))
        end = np.minimum(start + 2 * half, len(p)) - 1
        first = np.where(start > 0, start - 1, 0)
        out[values] += np.where(one, zeros[end] - zeros, upto - np.where(start > 0, upto[first], 0.0))
    return out


def halves(t: np.ndarray, many: list[np.ndarray]) -> list[tuple[int, int] | None]:
    """For each of some weights the places of the two middle slopes among all of the points; null if none are apart in time."""
    i, j = _together(t)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(t) != 0]))
    out = []
    for w in many:
        sums = np.add.reduceat(w.astype(float), starts) if len(starts) < len(t) else w.astype(float)
        total = int((sums.sum() ** 2 - np.dot(sums, sums)) / 2) - int(np.dot(w[i].astype(float), w[j]))
        out.append(((total - 1) // 2, total // 2) if total > 0 else None)
    return out
