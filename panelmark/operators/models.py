"""Local statistical models for the forecast cascade: one array of series x weights a batch."""

from __future__ import annotations

import numpy as np

BAND_Z = 1.2816
#: The weights that are tried for level, trend and season.
ALPHAS = (0.02, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.99)
BETAS = (0.01, 0.05, 0.15, 0.3, 0.6)
GAMMAS = (0.01, 0.1, 0.3, 0.6)


def _grid(trend: bool, seasonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, g = np.meshgrid(np.array(ALPHAS), np.array(BETAS if trend else (0.0,)), np.array(GAMMAS if seasonal else (0.0,)), indexing="ij")
    return a.ravel(), b.ravel(), g.ravel() * (1 - a.ravel())


def _fit(y: np.ndarray, n: np.ndarray, m: int, trend: bool) -> np.ndarray:
    """The best weights of each series: rows of (criterion, squared errors, parameters, level, slope, a, b, g, pattern...).

    ``y`` holds series of falling length ``n``, one a row; a step moves all that are still going.
    """
    a, b, g = _grid(trend, m > 1)
    shape = (len(y), a.size)
    start = y[:, :m].mean(axis=1) if m > 1 else y[:, 0]
    first = ((y[:, m : 2 * m].mean(axis=1) - start) / m if m > 1 else y[:, 1] - y[:, 0]) if trend else np.zeros(len(y))
    level, slope, errors = np.tile(start[:, None], a.size), np.tile(first[:, None], a.size), np.zeros(shape)
    pattern = np.tile(((y[:, :m] - start[:, None]) if m > 1 else np.zeros((len(y), 1)))[:, :, None], a.size)
    for t in range(int(n[0])):
        k, at = int(np.searchsorted(-n, -t, "left")), t % m
        error = y[:k, t, None] - (level[:k] + slope[:k] + pattern[:k, at])
        level[:k] = level[:k] + slope[:k] + a * error
        slope[:k] = slope[:k] + a * b * error
        pattern[:k, at] = pattern[:k, at] + g * error
        errors[:k] += error * error
    rows, best = np.arange(len(y)), errors.argmin(axis=1)
    count = 2 + (2 if trend else 0) + (m + 1 if m > 1 else 0)
    square, room = np.maximum(errors[rows, best] / n, 1e-300), n - count - 1
    penalty = np.where(room > 0, 2 * count + 2 * count * (count + 1) / np.maximum(room, 1), np.inf)
    chosen = [n * np.log(square) + penalty, errors[rows, best], np.full(len(y), count), level[rows, best], slope[rows, best], a[best], b[best], g[best]]
    return np.column_stack([*chosen, pattern[rows, :, best]])


def _ahead(fits: np.ndarray, y: np.ndarray, n: np.ndarray, m: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(median, half width of the 80 % band) of the steps after each series."""
    _, total, count, level, slope, a, b, g = (c[:, None] for c in fits[:, :8].T)
    steps = np.arange(1, horizon + 1)
    median = level + slope * steps + np.take_along_axis(fits[:, 8:], (n[:, None] + steps - 1) % m, axis=1)
    spread = total / np.maximum(n[:, None] - count, 1)
    h = steps - 1
    grown = 1 + h * (a * a + a * a * b * (h + 1) + (a * b) ** 2 * (h + 1) * (2 * h + 1) / 6)
    cycles = h // m if m > 1 else np.zeros_like(h)
    grown = grown + g * cycles * (2 * a + g + a * b * m * (cycles + 1))
    width = BAND_Z * np.sqrt(spread * grown)
    flat = ~np.isfinite(width).all(axis=1) | ~width.any(axis=1)
    for row in np.flatnonzero(flat):
        width[row] = BAND_Z * y[row, : n[row]].std()
    return median, width


def smoothing_many(histories: list, horizons: list[int], seasons: list[int]) -> list[tuple[list[float], list[float], list[float]]]:
    """Exponential smoothing of every series, chosen by corrected information criterion, with an 80 % band.

    A season counts only with two full seasons of history. A fit without a usable
    spread falls back to the spread of the history. A series' answer does not depend on
    the others of its batch.
    """
    sizes = np.array([len(h) for h in histories], np.int64)
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    y = np.zeros((len(n), int(n[0]) if len(n) else 0))
    for row, i in enumerate(order.tolist()):
        y[row, : n[row]] = np.asarray(histories[i], dtype="float64")
    cycle = np.array([seasons[i] if seasons[i] > 1 and sizes[i] >= 2 * seasons[i] else 1 for i in order.tolist()], np.int64)
    ahead = np.array([horizons[i] for i in order.tolist()], np.int64)
    out: list = [None] * len(n)
    for m in np.unique(cycle).tolist():
        here = np.flatnonzero(cycle == m)
        tried = [(k, _fit(y[here], n[here], k, trend)) for k in ([1, m] if m > 1 else [1]) for trend in (False, True)]
        winner = np.argmin(np.column_stack([fits[:, 0] for _, fits in tried]), axis=1)
        for number, (k, fits) in enumerate(tried):
            won = np.flatnonzero(winner == number)
            if not len(won):
                continue
            mine = here[won]
            median, width = _ahead(fits[won], y[mine], n[mine], k, int(ahead[mine].max()))
            for row, mid, wide in zip(mine.tolist(), median, width):
                mid, wide = mid[: ahead[row]], wide[: ahead[row]]
                out[order[row]] = (mid.tolist(), (mid - wide).tolist(), (mid + wide).tolist())
    return out


def smoothing(history: list[float], horizon: int, season: int) -> tuple[list[float], list[float], list[float]]:
    """``smoothing_many`` of one series."""
    return smoothing_many([history], [horizon], [season])[0]


smoothing.of_many = smoothing_many
LOCAL_MODELS = [("smoothing", smoothing)]
