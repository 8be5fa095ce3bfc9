"""Operators on the mask of one nucleus in its padded patch, in NumPy: distances, opening, objects, contours.

Tiles and patches are rows; masks reach a kernel in Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

DESCRIPTORS = 5
#: A contour of so many points or fewer has no descriptors.
SHORT = 10
LEAST_OBJECT = 10
#: Neighbours (row, col) in turning order from the west by the south.
RING = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
CROSS = RING[::2]


def distances(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest background pixel of the patch; all 0 where it has none.

    First along columns, then the lower envelope along rows.
    """
    if mask.all():
        return np.zeros(mask.shape)
    h, w = mask.shape
    far = float((h + w) ** 2)
    apart = lambda n: (np.arange(n)[:, None] - np.arange(n)[None, :]).astype(float) ** 2
    down = (apart(h)[:, :, None] + np.where(mask, far, 0.0)[None]).min(axis=1)
    return np.sqrt(np.stack([(apart(w) + row[None, :]).min(axis=1) for row in down]))


def _shifts(mask: np.ndarray, outside: bool) -> np.ndarray:
    framed = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    return np.stack([mask, *[framed[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] for dr, dc in CROSS]])


def opened(mask: np.ndarray) -> np.ndarray:
    """Opening by a cross; what lies outside the patch neither erodes nor dilates."""
    return _shifts(_shifts(mask, True).all(axis=0), False).any(axis=0)


def objects(mask: np.ndarray, around=RING) -> list[np.ndarray]:
    """(row, col) pixels of each connected object, by first pixel in raster order."""
    left, out = {(int(r), int(c)) for r, c in np.argwhere(mask)}, []
    for start in sorted(left):
        if start not in left:
            continue
        left.discard(start)
        found, at = [start], 0
        while at < len(found):
            r, c = found[at]
            near = [p for p in ((r + dr, c + dc) for dr, dc in around) if p in left]
            left.difference_update(near)
            found += near
            at += 1
        out.append(np.array(found))
    return out


def without_small(mask: np.ndarray, least: int = LEAST_OBJECT) -> np.ndarray:
    """The mask without objects, joined by edges, of fewer than ``least`` pixels."""
    out = np.zeros_like(mask)
    for pixels in objects(mask, CROSS):
        if len(pixels) >= least:
            out[tuple(pixels.T)] = True
    return out


def border(pixels: np.ndarray) -> np.ndarray:
    """Outer border of one object from its first pixel in raster order, closed but for the first point."""
    inside = set(map(tuple, pixels.tolist()))
    start = here = min(inside)
    look, out, first = 0, [], None
    while True:
        step = next((k % 8 for k in range(look, look + 8) if (here[0] + RING[k % 8][0], here[1] + RING[k % 8][1]) in inside), None)
        if step is None:
            return np.array([start])
        if (here, step) == first:
            return np.array(out)
        first = first or (here, step)
        out.append(here)
        here = (here[0] + RING[step][0], here[1] + RING[step][1])
        look = step + 5  # the one after the pixel it came from


def descriptors(mask: np.ndarray) -> np.ndarray:
    """Magnitudes of the first Fourier coefficients of the largest outer border by the constant one.

    The point of the border that begins it is left out, and coordinates are those of the patch, so
    the values depend on where the nucleus lies in it.
    """
    best, size, out = None, (-1.0, 0), np.zeros(DESCRIPTORS)
    for pixels in objects(mask):
        b = border(pixels)
        z = b[:, 1] + 1j * b[:, 0]
        area = abs(float((z.conj() * np.roll(z, -1)).imag.sum())) / 2
        if (area, len(b)) > size:
            best, size = z, (area, len(b))
    if best is None or len(best) <= SHORT:
        return out
    z = best[1:] if len(best) > SHORT + 1 else best
    f = np.abs(np.fft.fft(z))
    if f[0] > 1e-10:
        out = f[1 : DESCRIPTORS + 1] / f[0]
    return np.where(out < 1e6, out, 0.0)


def _cell_lines(ul: bool, ur: bool, ll: bool, lr: bool, r: int, c: int):
    """Pieces of the outline in the cell whose upper left pixel is (r, c), between doubled midpoints of its sides."""
    top, low, left, right = (2 * r, 2 * c + 1), (2 * r + 2, 2 * c + 1), (2 * r + 1, 2 * c), (2 * r + 1, 2 * c + 2)
    if ul == lr and ur == ll and ul != ur:  # pixels that meet at a corner only are apart
        return [(top, left), (low, right)] if ul else [(top, right), (low, left)]
    met = [p for p, x, y in ((top, ul, ur), (left, ul, ll), (right, ur, lr), (low, ll, lr)) if x != y]
    return [tuple(met)] if met else []


def outline(mask: np.ndarray) -> np.ndarray:
    """(row, col) of the longest outline halfway between pixels; the first in raster order of several.

    A loop ends with the point it begins with. Where the mask meets the patch's edge the outline is open.
    """
    cells = [mask[:-1, :-1], mask[:-1, 1:], mask[1:, :-1], mask[1:, 1:]]
    near: dict[tuple, list] = {}
    for r, c in np.argwhere(np.any(cells, axis=0) & ~np.all(cells, axis=0)).tolist():
        for a, b in _cell_lines(*(bool(x[r, c]) for x in cells), r, c):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    best: list[tuple] = []
    first = {p: i for i, p in enumerate(near)}
    left = set(near)
    # Open outlines are walked from an end, loops from their first point.
    for start in sorted(near, key=lambda p: (len(near[p]) == 2, first[p])):
        if start not in left:
            continue
        path = [start]
        left.discard(start)
        while (onward := next((p for p in near[path[-1]] if p in left), None)) is not None:
            path.append(onward)
            left.discard(onward)
        if len(near[start]) == 2:
            path.append(start)
        if (len(path), -first[start]) > (len(best), -first[best[0]] if best else 0):
            best = path
    return np.array(best, float).reshape(-1, 2) / 2


def bending(mask: np.ndarray) -> float:
    """Sum of squared curvatures along the longest outline; 0 for one of few points.

    Differences at its two ends are one-sided, so the point where a loop begins has a small part in the value.
    """
    at = outline(mask)
    if len(at) <= SHORT:
        return 0.0
    d = np.gradient(at, axis=0)
    dd = np.gradient(d, axis=0)
    bend = np.abs(dd[:, 1] * d[:, 0] - d[:, 1] * dd[:, 0]) / np.maximum((d**2).sum(axis=1) ** 1.5, 1e-10)
    return float((bend[bend <= 1e6] ** 2).sum())


def ripples(mask: np.ndarray, samples: int = 64) -> tuple[float, float, float]:
    """Irregularity, spectral energy and peak mode of the outline's distance from the centroid as a function of angle."""
    at = outline(mask)
    if samples < 8 or len(at) < 3:
        return 0.0, 0.0, 0.0
    at = at[:-1] if (at[0] == at[-1]).all() else at
    away = at - np.argwhere(mask).mean(axis=0)
    angle, far = np.arctan2(away[:, 0], away[:, 1]), np.hypot(away[:, 0], away[:, 1])
    turn = np.argsort(angle, kind="stable")
    angle, far = np.append(angle[turn], angle[turn[0]] + 2 * np.pi), np.append(far[turn], far[turn[0]])
    power = np.abs(np.fft.fft(np.interp(angle[0] + np.arange(samples) * 2 * np.pi / samples, angle, far)))[: samples // 2] ** 2
    low = power[2:6].sum()
    return (float(power[6:].sum() / low) if low > 0 else 0.0), float(power[1:].sum()), (4.0 + float(np.argmax(power[4:])) if samples > 8 else 4.0)


def _by_nucleus(pixels: DataFrame, side: int, kernel, names: list[str]) -> DataFrame:
    from stainloom.operators.features import by_mask

    return by_mask(pixels, side, kernel, names)


def to_boundary(pixels: DataFrame, side: int) -> DataFrame:
    """Mean and largest distance of a nucleus's pixels to the background of its patch."""
    return _by_nucleus(pixels, side, lambda m: ((d := distances(m)[m]).mean(), d.max()), ["mean_distance", "max_distance"])


def cleaned(pixels: DataFrame, side: int) -> DataFrame:
    """Pixels that opening leaves, those that the removal of small objects leaves, and the number of objects."""
    return _by_nucleus(pixels, side, lambda m: (opened(m).sum(), without_small(m).sum(), len(objects(m))), ["opened_area", "cleaned_area", "n_objects"])


def fourier(pixels: DataFrame, side: int) -> DataFrame:
    """fourier_descriptor_1 to _5."""
    return _by_nucleus(pixels, side, descriptors, [f"fourier_descriptor_{i + 1}" for i in range(DESCRIPTORS)])


def outlines(pixels: DataFrame, side: int) -> DataFrame:
    """bending_energy, and irregularity, spectral energy and peak mode of the outline's radius."""
    return _by_nucleus(pixels, side, lambda m: (bending(m), *ripples(m)), ["bending_energy", "neis_irregularity_score", "neis_spectral_energy", "neis_spectral_peak_mode"])
