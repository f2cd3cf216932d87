"""Minima of many small functions at a time: one call evaluates points of all of them.

f takes points (rows) and the number of the function each belongs to, and gives
a value each; a value that is not finite is as bad as can be.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Values = Callable[[np.ndarray, np.ndarray], np.ndarray]
_WORST = 1e300


def _asked(f: Values, points: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Values of a block of points for each function: (functions, points, dimensions)."""
    n, m, k = points.shape
    with np.errstate(all="ignore"):
        got = f(points.reshape(n * m, k), np.repeat(which, m))
    return np.where(np.isfinite(got), got, _WORST).reshape(n, m)


def _slopes(f: Values, x: np.ndarray, value: np.ndarray, which: np.ndarray, width: float) -> np.ndarray:
    got = _asked(f, x[:, None] + np.eye(x.shape[1]) * width, which)
    return (got - value[:, None]) / width


def quasi_newton(f: Values, start: np.ndarray, rounds: int = 60, tol: float = 1e-8, width: float = 1e-6, longest: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Points of least value and these values, by BFGS with forward differences; each line search tries all its steps at once."""
    x, n, k = start.astype("f8").copy(), *start.shape
    best = _asked(f, x[:, None], np.arange(n))[:, 0]
    if not k:
        return x, best
    live, bend = np.arange(n), np.tile(np.eye(k), (n, 1, 1))
    slope = _slopes(f, x, best, live, width)
    steps = np.array([1.0, 0.5, 0.2, 0.08, 0.02, 0.004])
    for _ in range(rounds):
        if not len(live):
            break
        way = -np.einsum("nij,nj->ni", bend[live], slope[live])
        uphill = (way * slope[live]).sum(1) >= 0
        way[uphill], bend[live[uphill]] = -slope[live[uphill]], np.eye(k)
        way *= np.minimum(1, longest / np.maximum(np.abs(way).max(1, keepdims=True), 1e-300))
        tried = _asked(f, x[live][:, None] + steps[:, None] * way[:, None], live)
        at = tried.argmin(1)
        gain = best[live] - tried[np.arange(len(live)), at]
        on = gain > tol * (np.abs(best[live]) + tol)
        live, move, at, tried = live[on], way[on] * steps[at[on]][:, None], at[on], tried[on]
        x[live] += move
        best[live] = tried[np.arange(len(live)), at]
        new = _slopes(f, x[live], best[live], live, width)
        turn = new - slope[live]
        slope[live] = new
        along = (turn * move).sum(1)
        ok = along > 1e-12
        h, s, y, rho = bend[live[ok]], move[ok], turn[ok], 1 / along[ok]
        left = np.eye(k) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
        bend[live[ok]] = left @ h @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
    return x, best


def simplex(f: Values, start: np.ndarray, size: float = 0.5, rounds: int = 500, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Points of least value and these values, by the downhill simplex; the four moves of a round are tried at once."""
    n, k = start.shape
    points = start[:, None] + np.concatenate([np.zeros((1, k)), size * np.eye(k)])
    values = _asked(f, points, np.arange(n))
    moves = np.array([1.0, 2.0, 0.5, -0.5])[:, None]
    live = np.arange(n)
    for _ in range(rounds):
        order = values[live].argsort(1, kind="stable")
        points[live], values[live] = np.take_along_axis(points[live], order[:, :, None], 1), np.take_along_axis(values[live], order, 1)
        live = live[values[live, -1] - values[live, 0] > tol * (np.abs(values[live, 0]) + tol)]
        if not len(live):
            break
        p, v = points[live], values[live]
        centre, worst = p[:, :-1].mean(1), p[:, -1]
        tried = centre[:, None] + moves * (centre - worst)[:, None]
        got = _asked(f, tried, live)
        mirror = got[:, 0]
        pick = np.where(mirror < v[:, 0], np.where(got[:, 1] < mirror, 1, 0), np.where(mirror < v[:, -2], 0, np.where(mirror < v[:, -1], np.where(got[:, 2] <= mirror, 2, -1), np.where(got[:, 3] < v[:, -1], 3, -1))))
        moved, stuck = pick >= 0, pick < 0
        points[live[moved], -1] = tried[moved, pick[moved]]
        values[live[moved], -1] = got[moved, pick[moved]]
        if stuck.any():
            points[live[stuck]] = (p[stuck] + p[stuck][:, :1]) / 2
            values[live[stuck]] = _asked(f, points[live[stuck]], live[stuck])
    at = values.argmin(1)
    return points[np.arange(n), at], values[np.arange(n), at]
