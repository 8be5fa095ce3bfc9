"""Stain normalisation of whole tiles by sparse non-negative factors, in NumPy.

A tile's optical densities are factored into two stains and their concentrations; the concentrations
are scaled to reference maxima and put together again with a reference stain matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Stain vectors (red, green, blue by stain) and largest concentrations of the reference. Fixed values.
REFERENCE = ((0.65, 0.07), (0.70, 0.99), (0.29, 0.11))
MAXIMA = (0.8, 0.6)
#: Seed and shifts (left, right, left) of the generator of first factors, and the bits of a draw. Fixed values.
SEED, SHIFTS, BITS = 0x9E3779B97F4A7C15, (13, 7, 17), 24
_MASK = (1 << 64) - 1
_drawn: np.ndarray = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Normaliser:
    """Settings of the factoring; the reference matrix has a row for each channel."""

    reference: tuple[tuple[float, ...], ...] = REFERENCE
    maxima: tuple[float, ...] = MAXIMA
    sparsity: float = 0.01
    eps: float = 1e-8
    rounds: int = 200

    def __post_init__(self):
        m = np.array(self.reference, float)
        if m.ndim != 2 or m.shape[0] != 3 or not m.shape[1] or m.shape[1] != len(self.maxima):
            raise ValueError("the reference has three rows, and a column for each maximum")
        if not np.isfinite(m).all() or not np.isfinite(self.maxima).all():
            raise ValueError("the reference is finite")
        if self.rounds < 1 or not np.isfinite(self.sparsity) or self.sparsity < 0 or not np.isfinite(self.eps) or self.eps <= 0:
            raise ValueError("rounds and eps are positive, sparsity is not negative")


def _step(x: int) -> int:
    a, b, c = SHIFTS
    x ^= (x << a) & _MASK
    x ^= x >> b
    return x ^ ((x << c) & _MASK)


def draws(n: int) -> np.ndarray:
    """The first n numbers of the generator in [0, 1).

    A step is linear over bits, so a known stretch is doubled at once: by where its length of steps
    takes each single bit.
    """
    global _drawn
    if len(_drawn) < n:
        state, out = SEED, []
        for _ in range(64):
            state = _step(state)
            out.append(state)
        found = np.array(out, np.uint64)
        jump = [1 << b for b in range(64)]
        for _ in range(64):
            jump = [_step(x) for x in jump]
        while len(found) < n:
            cols = np.array(jump, np.uint64)

            def moved(x, cols=cols):
                out = np.zeros_like(x)
                for b in range(64):
                    out ^= cols[b] * ((x >> np.uint64(b)) & np.uint64(1))
                return out

            found = np.concatenate([found, moved(found)])
            jump = moved(cols).tolist()
        _drawn = found
    return ((_drawn[:n] >> np.uint64(64 - BITS)).astype(np.float32) / np.float32(1 << BITS)).astype(np.float32)


def _unit_columns(w: np.ndarray, eps: np.float32) -> np.ndarray:
    return w / (np.sqrt((w * w).sum(axis=0, dtype=np.float32)) + eps)


def factors(v: np.ndarray, w: np.ndarray, h: np.ndarray, rounds: int, sparsity: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative updates of v = w h, all of them 32-bit; columns of w have unit length after each."""
    v, w, h = (np.asarray(x, np.float32) for x in (v, w, h))
    if not v.size or not w.size or v.shape != (w.shape[0], h.shape[1]) or w.shape[1] != h.shape[0]:
        raise ValueError("factors do not fit the matrix")
    e, s = np.float32(eps), np.float32(sparsity)

    def grown(x, up, down):
        with np.errstate(over="ignore", invalid="ignore"):
            x = x * (up / np.maximum(down, e))
        return np.where(np.isfinite(x) & (x > e), x, e)

    for _ in range(rounds):
        h = grown(h, w.T @ v, (w.T @ w) @ h + s + e)
        w = _unit_columns(grown(w, v @ h.T, w @ (h @ h.T) + e), e)
    return w, h


def percentile(values: np.ndarray, percent: float) -> np.float32:
    """Linear percentile of the finite values, in 32-bit arithmetic; 0 for none."""
    x = np.sort(values[np.isfinite(values)])
    if not len(x):
        return np.float32(0)
    at = np.float32(percent / 100) * np.float32(len(x) - 1)
    low, high = int(np.floor(at)), min(int(np.ceil(at)), len(x) - 1)
    part = np.float32(at - np.float32(low))
    return x[low] if low == high else x[low] * (np.float32(1) - part) + x[high] * part


def normalise(rgb: np.ndarray, settings: Normaliser = Normaliser()) -> np.ndarray:  # noqa: B008 - frozen
    """The tile in the reference's stains; an (H, W, 3) array of bytes.

    The stain with more blue is the first, and concentrations are scaled by their 99th percentiles.
    """
    if rgb.ndim != 3 or rgb.shape[2] != 3 or not rgb.size:
        raise ValueError("an image has rows, columns and three channels")
    e = np.float32(settings.eps)
    v = -np.log((rgb.reshape(-1, 3).T.astype(np.float32) + e) / np.float32(255))
    k, n = len(settings.maxima), v.shape[1]
    first = draws(3 * k + k * n) + e
    w = _unit_columns(first[: 3 * k].reshape(3, k), e)
    w, h = factors(v, w, first[3 * k :].reshape(k, n), settings.rounds, settings.sparsity, settings.eps)
    if k > 1 and w[2, 0] < w[2, 1]:
        h = h[[1, 0, *range(2, k)]]
    scale = np.array([np.float32(m) / max(percentile(x, 99), e) for m, x in zip(settings.maxima, h, strict=True)], np.float32)
    density = np.array(settings.reference, np.float32) @ np.maximum(h * scale[:, None], e)
    if not np.isfinite(density).all():
        raise ValueError("densities are not finite")
    return np.clip(np.float32(255) * np.exp(-density), 0, 255).astype(np.uint8).T.reshape(rgb.shape)
