"""All features of one nucleus from its padded patch, in NumPy, by family.

A patch has red, green and blue, grey levels and the mask of the nucleus. Families are independent,
so that a caller pays only for those it asks for.
"""

from __future__ import annotations

import math

import numpy as np

from stainloom.operators import chromatin as _chromatin
from stainloom.operators.hull import hull_area
from stainloom.operators.morphology import CODES, hu_from
from stainloom.operators.patch_kernels import DESCRIPTORS, bending, descriptors, ripples
from stainloom.operators.texture import E_WEIGHTS, H_WEIGHTS

#: Names of the columns by family, in order. Fixed values.
MORPHOLOGY = [
    "area", "perimeter", "equivalent_diameter", "major_axis_length", "minor_axis_length", "eccentricity", "solidity", "extent", "convex_area", "euler_number", "orientation",
    "centroid_row", "centroid_col", "circularity", "aspect_ratio", *[f"hu_moment_{i}" for i in range(1, 8)],
]
SHAPE = ["convexity", "fractal_dimension", "roughness", "bending_energy", *[f"fourier_descriptor_{i}" for i in range(1, DESCRIPTORS + 1)]]
RADIAL = ["neis_irregularity_score", "neis_spectral_energy", "neis_spectral_peak_mode"]
INTENSITY = [f"{x}_intensity" for x in ("mean", "median", "std", "min", "max", "range", "iqr", "skewness", "kurtosis", "entropy")]
PAIRS = [f"glcm_{x}" for x in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")]
PATTERNS = ["lbp_mean", "lbp_std", "lbp_entropy"]
STAINS = [*[f"{x}_{s}" for s in ("hematoxylin", "eosin") for x in ("mean", "std", "skew", "kurt", "min", "max")], "he_ratio_H_to_E"]
GRADIENTS = ["hog_mean", "hog_std", "hog_max", "hog_min"]
CHROMATIN = [f"ccsm_{x}" for x in _chromatin.NAMES]
#: Families of the mask, and those of a patch's pixels.
OF_MASK = {"morphology": MORPHOLOGY, "shape": SHAPE, "radial": RADIAL}
OF_PIXELS = {"intensity": INTENSITY, "pairs": PAIRS, "patterns": PATTERNS, "stains": STAINS, "gradients": GRADIENTS, "chromatin": CHROMATIN}
PREFIXES = ("pre_norm_", "post_norm_")
NEAREST = "distance_to_nearest_neighbor"

_SHIFT = [(0, 1), (1, 1), (1, 0), (1, -1)]


def gray_of(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return (r * 19596 + g * 38470 + b * 7470 + 32768) >> 16


def _around(x: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The value beside each pixel, 0 outside."""
    h, w = x.shape
    return np.pad(x, 1)[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]


def perimeter(mask: np.ndarray) -> float:
    cross, corners = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    inner = np.logical_and.reduce([mask, *[_around(mask, *s) for s in cross]]) if min(mask.shape) >= 3 else np.zeros_like(mask)
    edge = (mask & ~inner).astype(int)
    code = edge + 2 * sum(_around(edge, *s) for s in cross) + 10 * sum(_around(edge, *s) for s in corners)
    return float(sum(step * np.isin(code[edge > 0], codes).sum() for step, codes in CODES.items()))


def euler(mask: np.ndarray) -> float:
    """Objects that touch at corners too, less their holes, by counts of 2x2 patterns."""
    m = np.pad(mask, 1).astype(int)
    a, b, c, d = m[:-1, :-1], m[:-1, 1:], m[1:, :-1], m[1:, 1:]
    n = a + b + c + d
    return float(((n == 1).sum() - (n == 3).sum() - 2 * ((n == 2) & (a == d)).sum()) / 4)


def corner_hu(mask: np.ndarray) -> list[float]:
    """The pipeline's seven invariants: the corner of the mask stands for the moments; 0 where undefined."""
    if mask.sum() <= 10 or min(mask.shape) <= 3 or not mask[0, 0]:
        return [0.0] * 7
    out = hu_from({k: float(mask[int(k[0]), int(k[1])]) for k in ("20", "02", "11", "30", "03", "12", "21")})
    return [x if abs(x) < 1e10 else 0.0 for x in out]


def morphology(mask: np.ndarray, origin: tuple[int, int] = (0, 0), convex: int | None = None) -> list[float]:
    r, c = np.nonzero(mask)
    if not len(r):
        raise ValueError("the mask is empty")
    area, p = float(len(r)), perimeter(mask)
    convex = hull_area(r, c) if convex is None else convex
    vr, vc, both = r.var(), c.var(), ((r - r.mean()) * (c - c.mean())).mean()
    root = math.sqrt((vc - vr) ** 2 / 4 + both * both)
    l1, l2 = max((vr + vc) / 2 + root, 0.0), max((vr + vc) / 2 - root, 0.0)
    major, minor = 4 * math.sqrt(l1), 4 * math.sqrt(l2)
    turn = (math.pi / 4 if -both < 0 else -math.pi / 4) if abs(vc - vr) < 1e-12 else 0.5 * math.atan2(2 * both, vr - vc)
    box = (r.max() - r.min() + 1) * (c.max() - c.min() + 1)
    return [
        area, p, 2 * math.sqrt(area / math.pi), major, minor, 0.0 if l1 <= 1e-12 else math.sqrt(max(0.0, 1 - l2 / l1)), area / convex, area / box, float(convex), euler(mask), turn,
        r.mean() + origin[0], c.mean() + origin[1], 4 * math.pi * area / (p * p) if p else 0.0, major / minor if minor else 0.0, *corner_hu(mask),
    ]


def shape(mask: np.ndarray, convex: int | None = None) -> list[float]:
    r, c = np.nonzero(mask)
    area, p = float(len(r)), perimeter(mask)
    convex = hull_area(r, c) if convex is None else convex
    return [convex / area, math.log(p) / math.log(area) if area > 1 and p > 0 else 0.0, p * p / area, bending(mask), *map(float, descriptors(mask))]


def _moments(x: np.ndarray, least: float) -> tuple[float, float, float, float]:
    """Mean, population deviation, skewness and excess kurtosis; the last two are 0 where the variance is not over ``least``."""
    mean, var = x.mean(), x.var()
    if not var > least:
        return float(mean), math.sqrt(var), 0.0, 0.0
    d = x - mean
    return float(mean), math.sqrt(var), float((d**3).mean() / var**1.5), float((d**4).mean() / var**2 - 3)


def intensity(gray: np.ndarray, mask: np.ndarray) -> list[float]:
    x = gray[mask].astype(float)
    if not len(x):
        return [0.0] * len(INTENSITY)
    mean, std, skew, kurt = _moments(x, 1e-8)
    q1, q2, q3 = np.percentile(x, (25, 50, 75))
    d = np.bincount(gray[mask], minlength=1) / (len(x) * 255 / 256)
    d = d[d > 0]
    return [mean, float(q2), std, x.min(), x.max(), x.max() - x.min(), float(q3 - q1), skew, kurt, float(-(d * np.log2(d)).sum())]


def pairs(gray: np.ndarray, mask: np.ndarray) -> list[float]:
    """Means over four directions of the properties of symmetric co-occurrence at distance one, zeros outside included."""
    v = np.where(mask, gray, 0)
    if len(np.unique(v[v > 0])) < 2:
        return [0.0] * len(PAIRS)
    out = []
    for dr, dc in _SHIFT:
        a, b = v[: len(v) - dr], v[dr:]
        a, b = (a[:, : a.shape[1] - dc], b[:, dc:]) if dc >= 0 else (a[:, -dc:], b[:, :dc])
        n = np.bincount(np.concatenate([a * 256 + b, b * 256 + a]).ravel())
        at = np.flatnonzero(n)
        i, j, p = at // 256, at % 256, n[at] / n.sum()
        d, mean = np.abs(i - j), (p * i).sum()
        var, asm = (p * (i - mean) ** 2).sum(), (p * p).sum()
        out.append([(p * d * d).sum(), (p * d).sum(), (p / (1 + d * d)).sum(), math.sqrt(asm), (p * (i - mean) * (j - mean)).sum() / var if var * var > 1e-16 else 0.0, asm])
    return np.mean(out, axis=0).tolist()


def patterns(gray: np.ndarray, mask: np.ndarray) -> list[float]:
    """Mean, deviation and entropy of uniform patterns of eight points at radius one, bilinear at the corners and 0 outside."""
    v = np.where(mask, gray, 0).astype(float)
    if not v.any():
        return [0.0] * 3
    k, on = 0.70711, []
    for dr, dc in [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]:
        x = _around(v, dr, dc)
        if dr and dc:
            x = (1 - k) * ((1 - k) * v + k * _around(v, 0, dc)) + k * ((1 - k) * _around(v, dr, 0) + k * x)
        on.append(np.round(x, 9) >= v)
    on = np.array(on)
    changes = (on[1:] != on[:-1]).sum(axis=0)
    code = np.where(changes <= 2, on.sum(axis=0), 9)[mask]
    f = np.bincount(code) / len(code)
    f = f[f > 0]
    return [float(code.mean()), float(code.std()), float(-(f * np.log2(f)).sum()) + 0.0]


def densities(rgb: np.ndarray) -> np.ndarray:
    """Haematoxylin and eosin of each pixel: 32-bit logarithms by 32-bit stain weights."""
    low = np.float32(1e-6)
    od = (np.log(np.maximum(rgb.astype(np.float32) / np.float32(255), low)) / np.log(low)).astype(np.float32).astype(float)
    return np.maximum(od @ np.array([H_WEIGHTS, E_WEIGHTS], np.float32).astype(float).T, 0.0)


def stains(rgb: np.ndarray, mask: np.ndarray) -> list[float]:
    x = densities(rgb[mask])
    if not len(x):
        return [0.0] * len(STAINS)
    out = []
    for s in x.T:
        mean, std, skew, kurt = _moments(s, 1e-24)
        out += [mean, std, skew, kurt, s.min(), s.max()]
    return [*map(float, out), float(out[0] / out[6]) if out[6] else 0.0]


def gradients(gray: np.ndarray, mask: np.ndarray) -> list[float]:
    """Mean, deviation, largest and smallest value of 8 directions in cells of 8x8, normalised twice with a clip between."""
    v = np.where(mask, gray, 0).astype(float)
    rows, cols = v.shape[0] // 8, v.shape[1] // 8
    if not rows or not cols or not v.any():
        return [0.0] * 4
    gy, gx = np.zeros_like(v), np.zeros_like(v)
    gy[1:-1], gx[:, 1:-1] = v[2:] - v[:-2], v[:, 2:] - v[:, :-2]
    turn = np.degrees(np.arctan2(gy, gx))
    turn = np.where(turn < 0, turn + 180, turn)
    turn = np.where(turn >= 180, turn - 180, turn)
    way = np.floor(np.round(turn, 9) / 22.5).astype(int)
    cell = (np.arange(rows * 8) // 8)[:, None] * cols + (np.arange(cols * 8) // 8)[None, :]
    inner = (slice(0, rows * 8), slice(0, cols * 8))
    h = np.bincount((cell * 8 + way[inner]).ravel(), np.hypot(gx, gy)[inner].ravel(), rows * cols * 8).reshape(-1, 8) / 64
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True) + 1e-10)
    h = unit(np.minimum(unit(h), 0.2))
    return [float(h.mean()), float(h.std()), float(h.max()), float(h.min())]


def of_mask(mask: np.ndarray, origin: tuple[int, int], families) -> list[float]:
    """Values of the families of the mask that are asked for, in the order of OF_MASK."""
    convex = hull_area(*np.nonzero(mask)) if {"morphology", "shape"} & set(families) else None
    made = {"morphology": lambda: morphology(mask, origin, convex), "shape": lambda: shape(mask, convex), "radial": lambda: list(map(float, ripples(mask)))}
    return [x for f in OF_MASK if f in families for x in made[f]()]


def of_pixels(rgb: np.ndarray, mask: np.ndarray, families) -> list[float]:
    """Values of the families of the pixels that are asked for, in the order of OF_PIXELS."""
    gray = gray_of(rgb)
    made = {
        "intensity": lambda: intensity(gray, mask), "pairs": lambda: pairs(gray, mask), "patterns": lambda: patterns(gray, mask), "stains": lambda: stains(rgb, mask),
        "gradients": lambda: gradients(gray, mask), "chromatin": lambda: list(_chromatin.chromatin(gray, mask).values()),
    }
    return [x for f in OF_PIXELS if f in families for x in made[f]()]
