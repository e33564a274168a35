"""Exact Gaussian likelihood of ARMA models by a Kalman filter, for many candidates at a time.

A candidate is a row of parameters (mean, p autoregressive and q moving-average coefficients). The filter
starts from the stationary covariance of its state, so no row of a series is lost and short series have a
likelihood too; moving-average parts need not be invertible. The innovation variance is concentrated out.
All candidates of a batch take each step of the filter, of the gradient and of the search together.
"""

from __future__ import annotations

import numpy as np

BOUND = 3  # largest p and q
STATE = BOUND + 1
WIDTH = 1 + 2 * BOUND  # mean, AR, MA
WARM = 48  # steps of the full filter before settled candidates go on with constant gains


def state_space(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition (n x STATE x STATE) and the load of an innovation on each state (n x STATE)."""
    move = np.zeros((len(ar), STATE, STATE))
    move[:, :BOUND, 0] = ar
    move[:, np.arange(BOUND), np.arange(1, STATE)] = 1.0
    return move, np.hstack([np.ones((len(ma), 1)), ma])


def start_covariance(move: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stationary covariance P = T P T' + R R', and whether there is one."""
    stationary = np.abs(np.linalg.eigvals(move)).max(axis=1) < 1 - 1e-9
    noise = load[:, :, None] * load[:, None, :]
    twice = np.einsum("nij,nkl->nikjl", move, move).reshape(len(move), STATE**2, STATE**2)
    twice[~stationary] = 0.0
    found = np.linalg.solve(np.eye(STATE**2) - twice, noise.reshape(len(move), STATE**2, 1))
    return found.reshape(noise.shape), stationary


def filtered(y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of log F, sum of v v / F, stationary) of series y (n x time, NaN behind its end) under theta (n x WIDTH)."""
    mean, ar, ma = theta[:, :1], theta[:, 1 : 1 + BOUND], theta[:, 1 + BOUND :]
    move, load = state_space(ar, ma)
    cover, stationary = start_covariance(move, load)
    noise = load[:, :, None] * load[:, None, :]
    w = y - mean
    state = np.zeros((len(y), STATE))
    logs, squares = np.zeros(len(y)), np.zeros(len(y))
    live, steady, gain, spread = np.arange(len(y)), np.zeros(len(y), bool), np.zeros((len(y), STATE)), np.ones(len(y))
    last = y.shape[1]
    for t in range(min(WARM, last)):
        v = w[:, t] - state[:, 0]
        inside = ~np.isnan(v)
        spread = np.maximum(cover[:, 0, 0], 1e-12)
        gain = np.einsum("nij,nj->ni", move, cover[:, :, 0]) / spread[:, None]
        logs += np.where(inside, np.log(spread), 0.0)
        v = np.where(inside, v, 0.0)
        squares += v * v / spread
        state = np.einsum("nij,nj->ni", move, state) + gain * v[:, None]
        new = np.einsum("nij,njk,nlk->nil", move, cover, move, optimize=True) + noise
        new -= gain[:, :, None] * gain[:, None, :] * spread[:, None, None]
        steady = np.abs(new - cover).max(axis=(1, 2)) < 1e-11
        cover = new
    if last <= WARM:
        return logs, squares, stationary
    fast, slow = live[steady], live[~steady]
    if len(fast):
        a, k, f = state[fast], gain[fast], spread[fast]
        first, part = ar[fast], w[fast]
        total = np.zeros(len(fast))
        for t in range(WARM, last):
            v = part[:, t] - a[:, 0]
            v = np.where(np.isnan(v), 0.0, v)
            total += v * v
            step = k * v[:, None]
            step[:, :BOUND] += first * a[:, :1] + a[:, 1:]
            a = step
        squares[fast] += total / f
        logs[fast] += np.log(f) * (~np.isnan(part[:, WARM:])).sum(axis=1)
    if len(slow):
        move, cover, state, noise, part = move[slow], cover[slow], state[slow], noise[slow], w[slow]
        for t in range(WARM, last):
            v = part[:, t] - state[:, 0]
            inside = ~np.isnan(v)
            f = np.maximum(cover[:, 0, 0], 1e-12)
            k = np.einsum("nij,nj->ni", move, cover[:, :, 0]) / f[:, None]
            logs[slow] += np.where(inside, np.log(f), 0.0)
            v = np.where(inside, v, 0.0)
            squares[slow] += v * v / f
            state = np.einsum("nij,nj->ni", move, state) + k * v[:, None]
            cover = np.einsum("nij,njk,nlk->nil", move, cover, move, optimize=True) + noise - k[:, :, None] * k[:, None, :] * f[:, None, None]
    return logs, squares, stationary


def deviance(y: np.ndarray, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Minus twice the log-likelihood at the best innovation variance; infinite where there is no stationary start."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        logs, squares, stationary = filtered(y, theta)
        value = n * (np.log(2 * np.pi * squares / n) + 1) + logs
    return np.where(stationary & np.isfinite(value) & (squares > 1e-12 * n), value, np.inf)


def starts(y: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Parameters to begin with: the mean, and a damped lag-one correlation where there is an AR coefficient."""
    theta = np.zeros((len(y), WIDTH))
    theta[:, 0] = np.where(free[:, 0], np.nanmean(y, axis=1), 0.0)
    w = y - theta[:, :1]
    together = np.nansum(w[:, 1:] * w[:, :-1], axis=1) / np.maximum(np.nansum(w * w, axis=1), 1e-300)
    theta[:, 1] = np.where(free[:, 1], np.clip(0.9 * together, -0.9, 0.9), 0.0)
    theta[:, 1 + BOUND] = np.where(free[:, 1 + BOUND], np.where(free[:, 1], 0.05, np.clip(together, -0.6, 0.6)), 0.0)
    return theta


def maximised(y: np.ndarray, free: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(theta, deviance) of each candidate: `free` (n x WIDTH) names the parameters that move, the others stay 0.

    Quasi-Newton rounds with forward differences; four step lengths are tried at once, the best one counts. A
    candidate without a finite deviance keeps it infinite.
    """
    n = (~np.isnan(y)).sum(axis=1)
    theta = starts(y, free)
    value = deviance(y, n, theta)
    curve = np.tile(np.eye(WIDTH), (len(y), 1, 1)) / np.maximum(n, 1)[:, None, None]
    slope, open_ = slopes(y, n, theta, value, free), np.isfinite(value)
    for _ in range(rounds):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        move = -np.einsum("nij,nj->ni", curve[at], slope[at])
        uphill = (move * slope[at]).sum(axis=1) >= 0
        move[uphill] = -slope[at][uphill] / n[at][uphill, None]
        lengths = np.array([1.0, 0.3, 0.05, 0.005])
        tried = theta[at][:, None, :] + lengths[:, None] * move[:, None, :]
        many = len(lengths)
        values = deviance(np.repeat(y[at], many, axis=0), np.repeat(n[at], many), tried.reshape(-1, WIDTH)).reshape(-1, many)
        best = values.argmin(axis=1)
        new, low = tried[np.arange(len(at)), best], values[np.arange(len(at)), best]
        better = low < value[at] - 1e-9
        gained = value[at] - low
        done = ~better | (gained < 1e-7)
        at_better = at[better]
        step = new[better] - theta[at_better]
        theta[at_better], value[at_better] = new[better], low[better]
        before = slope[at_better]
        slope[at_better] = slopes(y[at_better], n[at_better], theta[at_better], value[at_better], free[at_better])
        change = slope[at_better] - before
        product = (step * change).sum(axis=1)
        good = product > 1e-12
        rho = np.where(good, 1.0 / np.where(good, product, 1.0), 0.0)
        left = np.eye(WIDTH) - rho[:, None, None] * step[:, :, None] * change[:, None, :]
        turned = np.einsum("nij,njk,nlk->nil", left, curve[at_better], left) + rho[:, None, None] * step[:, :, None] * step[:, None, :]
        curve[at_better] = np.where(good[:, None, None], turned, curve[at_better])
        # a round that gains nothing from a bent curve starts again straight, once
        bent = done & (np.abs(curve[at] - np.eye(WIDTH) / n[at][:, None, None]).max(axis=(1, 2)) > 1e-12) & ~better
        curve[at[bent]] = np.eye(WIDTH) / n[at[bent]][:, None, None]
        open_[at[done & ~bent]] = False
    return theta, value


def slopes(y, n, theta, value, free, step: float = 1e-6) -> np.ndarray:
    """Forward differences of the deviance in the free parameters."""
    many = free.sum(axis=1)
    row = np.repeat(np.arange(len(y)), many)
    column = np.nonzero(free)[1]
    moved = theta[row].copy()
    moved[np.arange(len(row)), column] += step
    found = np.zeros_like(theta)
    with np.errstate(invalid="ignore"):
        change = (deviance(y[row], n[row], moved) - value[row]) / step
    found[row, column] = np.where(np.isfinite(change), change, 0.0)
    return found


def fits(y: np.ndarray, orders: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(theta, AIC) of series y (n x time) under orders (n x 2: p, q), with a mean where `constant`."""
    free = np.zeros((len(y), WIDTH), bool)
    free[:, 0] = constant
    free[:, 1 : 1 + BOUND] = np.arange(BOUND) < orders[:, :1]
    free[:, 1 + BOUND :] = np.arange(BOUND) < orders[:, 1:]
    theta, value = maximised(y, free)
    return theta, value + 2 * (free.sum(axis=1) + 1)
