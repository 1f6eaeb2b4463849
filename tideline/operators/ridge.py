"""Ridge models of one small panel, on plain arrays: fitting, choice by released targets only, and what each column gives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np

# The grids that are searched.
PENALTIES = (10.0, 25.0, 100.0, 400.0, 1600.0)
HISTORIES = (2, 12, 24)
WINDOWS = (None, 60, 120)  # months of training history; None is all
LOO_PENALTIES = tuple(np.logspace(-3, 3, 25))
STRENGTHS = (5.0, 25.0)  # of the ridge on filled columns
INNER_BLOCKS = 3
LEAST_RELEASED = 4
LEAST_SCALE = 1.0


@dataclass(frozen=True)
class Linear:
    """bias + sum of weight * (value - centre) / scale over the columns in use; a missing value counts as the centre."""

    use: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x[:, self.use] - self.centre) / self.scale) * self.weight

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.parts(x).sum(axis=1) + self.bias


def solve(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise squared errors plus penalty times the squared weights; the bias is free."""
    middle, level = z.mean(axis=0), float(y.mean())
    z, rest = z - middle, y - level
    rows, columns = z.shape
    if columns <= rows:
        weight = np.linalg.solve(z.T @ z + penalty * np.eye(columns), z.T @ rest)
    else:  # as many unknowns as rows
        weight = z.T @ np.linalg.solve(z @ z.T + penalty * np.eye(rows), rest)
    return weight, level - float(middle @ weight)


def learnable(x: np.ndarray, least: int = 1, stable: bool = False) -> np.ndarray:
    """Columns with enough observations in these rows (all of them if stable); an error if there is none."""
    seen = (~np.isnan(x)).sum(axis=0)
    use = np.flatnonzero(seen == len(x) if stable else seen >= least)
    if not len(use):
        raise ValueError("no column has enough observations")
    return use


def fit(x: np.ndarray, y: np.ndarray, penalty: float, least: int = 2, stable: bool = False) -> Linear:
    """Ridge on columns scaled by the mean and population deviation (1 at least) of what was observed."""
    use = learnable(x, least, stable)
    seen = x[:, use]
    centre, scale = np.nanmean(seen, axis=0), np.maximum(np.nanstd(seen, axis=0), LEAST_SCALE)
    weight, bias = solve(np.nan_to_num((seen - centre) / scale), y, penalty)
    return Linear(use, centre, scale, weight, bias)


def expanding(n: int, blocks: int) -> list[tuple[int, int]]:
    """The last `blocks` runs of n // (blocks + 1) rows: (first, end) of each validation block."""
    size = n // (blocks + 1)
    return [(n - k * size, n - (k - 1) * size) for k in range(blocks, 0, -1)] if size else []


def inner_folds(n: int, public, cutoff, blocks: int = INNER_BLOCKS, released: int = LEAST_RELEASED) -> list[tuple[np.ndarray, slice]]:
    """(training rows, validation rows) of each block: earlier months whose target was public before its first cutoff."""
    folds = []
    for first, end in expanding(n, blocks):
        rows = np.flatnonzero((np.arange(n) < first) & (public < cutoff[first]))
        if len(rows) < released:
            raise ValueError("too few released targets before a validation block")
        folds.append((rows, slice(first, end)))
    if not folds:
        raise ValueError("too few months for validation")
    return folds


@dataclass(frozen=True)
class Choice:
    penalty: float
    least: int
    window: int | None
    error: float


def choose(x, y, public, cutoff, stable: bool = False, windows: Sequence[int | None] = (None,), blocks: int = INNER_BLOCKS, released: int = LEAST_RELEASED) -> Choice:
    """The candidate of least mean absolute error on the last blocks.

    A block's model learns only from earlier months whose target was public before the block's first cutoff, and of
    those from the newest `window`. A candidate that cannot be fitted in some block is out, so all are compared on the
    same months. Of equal ones: the larger penalty, all history before a window, the longer history. An error if a
    block has fewer than `released` such months, or no candidate is left.
    """
    folds = inner_folds(len(y), public, cutoff, blocks, released)
    found = []
    for window, penalty, least in product(windows, PENALTIES, (2,) if stable else HISTORIES):
        try:
            losses = np.concatenate([np.abs(fit(x[r], y[r], penalty, least, stable)(x[block]) - y[block]) for rows, block in folds for r in (rows[-window:] if window else rows,)])
        except ValueError:
            continue
        found.append((round(float(losses.mean()), 12), -penalty, window is not None, -least, window))
    if not found:
        raise ValueError("no candidate can be fitted")
    error, penalty, _, least, window = min(found, key=lambda c: c[:4])
    return Choice(-penalty, -least, window, error)


def fit_leave_one_out(x: np.ndarray, y: np.ndarray, penalties: Sequence[float] = LOO_PENALTIES) -> tuple[Linear, float]:
    """Ridge on median-filled, standardised columns and indicators of what was missing; the penalty has the least
    leave-one-out squared error, from one decomposition. Returns the model over columns of with_indicators()."""
    filled = with_indicators(x, x)
    centre, scale = filled.mean(axis=0), filled.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (filled - centre) / scale
    level = y.mean()
    u, s, v = np.linalg.svd(z, full_matrices=False)
    best = None
    for penalty in penalties:
        shrunk = s**2 / (s**2 + penalty)
        fitted = u @ (shrunk * (u.T @ (y - level))) + level
        lever = (u**2 * shrunk).sum(axis=1) + 1 / len(y)
        error = float((((y - fitted) / (1 - lever)) ** 2).mean())
        if best is None or error < best[0]:
            best = error, penalty, v.T @ (s / (s**2 + penalty) * (u.T @ (y - level)))
    return Linear(np.arange(z.shape[1]), centre, scale, best[2], float(level)), float(best[1])


def with_indicators(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """x filled with the training medians (0 for a column never seen), and an indicator for each column with gaps in training."""
    seen = ~np.isnan(train)
    medians = np.array([np.median(c[k]) if k.any() else 0.0 for c, k in zip(train.T, seen.T)])
    gaps = np.flatnonzero(~seen.all(axis=0))
    return np.column_stack([np.where(np.isnan(x), medians, x), np.isnan(x[:, gaps]).astype(float)])


def fit_filled(x: np.ndarray, y: np.ndarray, penalty: float) -> Linear:
    """Ridge on median-filled, standardised columns and indicators of what was missing: a model over with_indicators()."""
    filled = with_indicators(x, x)
    centre, scale = filled.mean(axis=0), filled.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    weight, bias = solve((filled - centre) / scale, y, penalty)
    return Linear(np.arange(filled.shape[1]), centre, scale, weight, bias)


def choose_strength(x: np.ndarray, y: np.ndarray, public, cutoff, penalties: Sequence[float] = STRENGTHS) -> float:
    """The penalty of fit_filled() with the least mean absolute error over the inner blocks; of equal ones the larger."""
    folds = inner_folds(len(y), public, cutoff)
    losses = {p: np.concatenate([np.abs(fit_filled(x[rows], y[rows], p)(with_indicators(x[block], x[rows])) - y[block]) for rows, block in folds]).mean() for p in penalties}
    return min(penalties, key=lambda p: (round(float(losses[p]), 12), -p))
