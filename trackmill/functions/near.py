"""Pairs of points that are near, by cells, for kernels in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def near_pairs(ax, ay, bx, by, cx: float, cy: float, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of points a and b whose cells of cx by cy touch or are one, about `step` pairs at a time, all pairs of
    a point of a together. What is left out is farther than cx or than cy apart."""
    if not len(ax) or not len(bx):
        return
    u, v, p, q = (np.floor(x / c).astype(np.int64) for x, c in ((ax, cx), (ay, cy), (bx, cx), (by, cy)))
    low = min(v.min(), q.min()) - 1
    wide = max(v.max(), q.max()) - low + 2
    key = p * wide + (q - low)
    order = np.argsort(key, kind="stable")
    key = key[order]
    lo = np.stack([np.searchsorted(key, (u + d) * wide + (v - low) - 1, "left") for d in (-1, 0, 1)], axis=1)
    hi = np.stack([np.searchsorted(key, (u + d) * wide + (v - low) + 1, "right") for d in (-1, 0, 1)], axis=1)
    n = (hi - lo).sum(axis=1)
    ends = np.cumsum(n)
    at = 0
    while at < len(ax):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        size, begin = (hi - lo)[at:to].ravel(), lo[at:to].ravel()
        total = int(size.sum())
        if total:
            j = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            yield np.repeat(np.arange(at, to), n[at:to]), order[j]
        at = to


def half_up(x: np.ndarray) -> np.ndarray:
    """To six places, as aggregates.half_up has it."""
    return np.floor(x * 1e6 + 0.5) / 1e6
