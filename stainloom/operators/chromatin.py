"""Condensed chromatin of one nucleus in its patch, in NumPy: local contrast, two populations, clumps."""

from __future__ import annotations

import math

import numpy as np

from stainloom.operators.hull import hull_area
from stainloom.operators.patch_kernels import distances, objects, opened, without_small

#: Grey levels and bins of the equalisation, side of its squares, share of a square that a bin may hold. Fixed values.
GRAYS, BINS, SQUARE, CLIP = 1 << 14, 256, 16, 0.03
#: Rounds, tolerance and smallest variance of the mixture, rounds of its first centres. Fixed values.
ROUNDS, TOLERANCE, LEAST_VARIANCE, CENTRE_ROUNDS = 100, 1e-3, 1e-6, 20
NAMES = ["condensed_area_ratio", "num_clumps", "mean_clump_area", "mean_clump_eccentricity", "mean_clump_solidity", "mean_dist_to_boundary", "mean_nnd", "contrast", "correlation", "energy", "homogeneity"]


def _clipped(hist: np.ndarray, most: int) -> np.ndarray:
    """The counts, none over ``most``; what is cut off goes to the other bins, evenly as far as whole numbers can."""
    hist = hist.copy()
    left = int(np.maximum(hist - most, 0).sum())
    hist = np.minimum(hist, most)
    if not left:
        return hist
    each = left // len(hist)
    upper = max(most - each, 0)
    low = hist < upper
    if each:
        hist[low] += each
        left -= each * int(low.sum())
    # Bins that the even share would fill are filled, those that it has just filled too.
    near = (hist >= upper) & (hist < most)
    left -= int((most - hist[near]).sum())
    hist[near] = most
    while left > 0:
        before = left
        for i in range(len(hist)):
            under = int((hist < most).sum())
            if left <= 0 or not under:
                break
            part = hist[i :: max(1, under // left)]
            open_ = part < most
            part[open_] += 1
            left -= int(open_.sum())
        if left == before:
            break
    return hist


def equalised(image: np.ndarray, clip: float = CLIP, square: int = SQUARE) -> np.ndarray:
    """Contrast-limited adaptive equalisation of a byte image.

    The image is spread over 14 bits, its histogram taken in squares, clipped and summed to a map
    for each square; a pixel is mapped between the four maps around it, and bytes are spread again.
    """
    if image.ndim != 2 or not image.size or square < 1:
        raise ValueError("an image has rows and columns, a square a side")
    h, w = image.shape
    lo, hi = int(image.min()), int(image.max())
    if lo == hi:
        return np.zeros((h, w), np.uint8)
    wide = np.floor((image.astype(np.float64) - lo) * 257 * ((GRAYS - 1) / ((hi - lo) * 257.0)) + 0.5).astype(np.int64)
    before = square // 2
    after = [(-n) % square + -(-square // 2) for n in (h, w)]
    bins = np.pad(wide, ((before, after[0]), (before, after[1])), mode="reflect") // (1 + GRAYS // BINS)
    rows, cols = bins.shape[0] // square - 1, bins.shape[1] // square - 1
    inner = bins[before : before + rows * square, before : before + cols * square]
    number = (np.arange(rows * square) // square)[:, None] * cols + (np.arange(cols * square) // square)[None, :]
    hists = np.bincount((number * BINS + inner).ravel(), minlength=rows * cols * BINS).reshape(rows * cols, BINS)
    most = int(max(np.float32(clip) * np.float32(square * square), 1)) if clip > 0 else square * square
    maps = np.stack([_clipped(x, most) for x in hists]).cumsum(axis=1) * ((GRAYS - 1) / (square * square))
    maps = np.clip(maps, 0, GRAYS - 1).astype(np.int64).reshape(rows, cols, BINS)
    maps = np.pad(maps, ((1, 1), (1, 1), (0, 0)), mode="edge").astype(float)
    shape = ((rows + 1) * square, (cols + 1) * square)
    y, x = np.arange(shape[0]), np.arange(shape[1])
    b = bins[: shape[0], : shape[1]]
    at = lambda dy, dx: maps[(y // square + dy)[:, None], (x // square + dx)[None, :], b]
    wy, wx = (y % square / square)[:, None], (x % square / square)[None, :]
    out = (1 - wy) * ((1 - wx) * at(0, 0) + wx * at(0, 1)) + wy * ((1 - wx) * at(1, 0) + wx * at(1, 1))
    out = np.clip(out, 0, GRAYS - 1).astype(np.int64)[before : before + h, before : before + w]
    lo, hi = int(out.min()), int(out.max())
    return ((out - lo) * (255.0 / (hi - lo))).astype(np.uint8) if hi > lo else np.zeros((h, w), np.uint8)


def _first_centres(values: np.ndarray, k: int) -> np.ndarray:
    """Centres that are drawn far from each other, each the best of some trials, with the generator of seed 0."""
    rng, n = np.random.RandomState(0), len(values)
    at = lambda: min(int(rng.random_sample() * n), n - 1)
    centres = [values[at()]]
    while len(centres) < k:
        gap = np.min([(values - c) ** 2 for c in centres], axis=0)
        total = np.cumsum(gap)
        if total[-1] <= 1e-12:
            centres.append(values[at()])
            continue
        tries = [values[min(int(np.searchsorted(total, rng.random_sample() * total[-1])), n - 1)] for _ in range(2 + int(math.log(k)))]
        centres.append(min(tries, key=lambda c: float(np.minimum(gap, (values - c) ** 2).sum())))
    return np.array(centres)


def _log_shares(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    v = np.maximum(variances, LEAST_VARIANCE)
    return np.log(weights) - 0.5 * ((x[:, None] - means) ** 2 / v + np.log(2 * np.pi * v))


def mixture(values: np.ndarray, k: int = 2, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a mixture of k normal distributions.

    Grey levels repeat, so all sums go over different values with their counts.
    """
    values = np.asarray(values, float)
    if len(values) < 2 or not 1 <= k <= len(values) or rounds < 1:
        raise ValueError("a mixture needs two values, and a value for each component")
    centres, n = _first_centres(values, k), len(values)
    x, c = np.unique(values, return_counts=True)
    label = None
    for _ in range(CENTRE_ROUNDS):
        now = np.argmin((x[:, None] - centres) ** 2, axis=1)
        own = np.bincount(now, c, k)
        moved = np.where(own > 0, np.bincount(now, c * x, k) / np.maximum(own, 1), centres)
        far, same = np.abs(moved - centres).max(), label is not None and (now == label).all()
        same = same or (label is None and not now.any())
        centres, label = moved, now
        if same or far < 1e-9:
            break
    weights = np.where(own > 0, own / n, 1 / k)
    spread = np.bincount(label, c * (x - centres[label]) ** 2, k)
    whole = max(float((c * (x - (c * x).sum() / n) ** 2).sum()) / n, LEAST_VARIANCE)
    means, variances = centres, np.where(own > 0, spread / np.maximum(own, 1), whole) + LEAST_VARIANCE
    weights, bound = weights / max(weights.sum(), 1e-12), -math.inf
    for _ in range(rounds):
        logs = _log_shares(x, weights, means, variances)
        top = logs.max(axis=1, keepdims=True)
        part = np.exp(logs - top)
        total = np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = part / total * c[:, None]
        size = share.sum(axis=0) + 10 * np.finfo(float).eps
        means = (share * x[:, None]).sum(axis=0) / size
        variances = (share * (x[:, None] - means) ** 2).sum(axis=0) / size + LEAST_VARIANCE
        weights = size / n
        weights = weights / max(weights.sum(), 1e-12)
        now = float(((top + np.log(total))[:, 0] * c).sum() / n)
        if abs(now - bound) < tolerance:
            break
        bound = now
    return weights, means, variances


def component(values: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The most likely component of each value; the first of equal ones."""
    return np.argmax(_log_shares(np.asarray(values, float), *model), axis=1)


def condensed(enhanced: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Pixels of the darker population, without small objects and opened."""
    model = mixture(enhanced[mask])
    out = np.zeros(mask.shape, bool)
    out[mask] = component(enhanced[mask], model) == int(np.argmin(model[1]))
    return opened(without_small(out))


def eccentricity(r: np.ndarray, c: np.ndarray) -> float:
    a, b, d = r.var(), c.var(), ((r - r.mean()) * (c - c.mean())).mean()
    root = math.sqrt((a - b) ** 2 / 4 + d * d)
    l1, l2 = max((a + b) / 2 + root, 0.0), max((a + b) / 2 - root, 0.0)
    return 0.0 if l1 <= 1e-12 else math.sqrt(max(0.0, 1 - l2 / l1))


def mean_nearest(at: np.ndarray) -> float:
    """Mean distance of points to their nearest other; 0 for fewer than two."""
    if len(at) < 2:
        return 0.0
    best = np.full(len(at), math.inf)
    for i in range(0, len(at), 256):
        d = np.hypot(at[i : i + 256, None, 0] - at[None, :, 0], at[i : i + 256, None, 1] - at[None, :, 1])
        d[np.arange(len(d)), np.arange(i, i + len(d))] = math.inf
        best[i : i + 256] = d.min(axis=1)
    return float(best.mean())


def row_pairs(image: np.ndarray, guard: float = 1e-12) -> tuple[float, float, float, float]:
    """Contrast, correlation, energy and homogeneity of the symmetric pairs of neighbours along rows."""
    if image.shape[1] < 2:
        return 0.0, 0.0, 0.0, 0.0
    a, b = image[:, :-1].astype(np.int64).ravel(), image[:, 1:].astype(np.int64).ravel()
    pair, n = np.unique(np.concatenate([a * BINS + b, b * BINS + a]), return_counts=True)
    i, j, p = pair // BINS, pair % BINS, n / n.sum()
    d, mean = i - j, (p * i).sum()
    var = (p * (i - mean) ** 2).sum()
    corr = 0.0 if var <= guard else float((p * (i - mean) * (j - mean)).sum() / var)
    return float((p * d * d).sum()), corr, math.sqrt((p * p).sum()), float((p / (1 + d * d)).sum())


def chromatin(gray: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """The eleven values by name; all 0 for masks of one pixel or none."""
    if gray.shape != mask.shape or not mask.size:
        raise ValueError("grey levels and mask have one shape")
    out = dict.fromkeys(NAMES, 0.0)
    if mask.sum() < 2:
        return out
    enhanced = equalised(np.where(mask, gray, 0).astype(np.uint8))
    dark = condensed(enhanced, mask)
    clumps = [x.T for x in objects(dark)]
    out["condensed_area_ratio"], out["num_clumps"] = float(dark.sum() / mask.sum()), float(len(clumps))
    if clumps:
        out["mean_clump_area"] = float(np.mean([len(r) for r, _ in clumps]))
        out["mean_clump_eccentricity"] = float(np.mean([eccentricity(r, c) for r, c in clumps]))
        out["mean_clump_solidity"] = float(np.mean([len(r) / hull_area(r, c) for r, c in clumps]))
        out["mean_dist_to_boundary"] = float(distances(mask)[dark].mean())
        out["mean_nnd"] = mean_nearest(np.array([(r.mean(), c.mean()) for r, c in clumps]))
        out |= dict(zip(NAMES[-4:], row_pairs(np.where(dark, enhanced, 0)), strict=True))
    return {k: v if math.isfinite(v) else 0.0 for k, v in out.items()}
