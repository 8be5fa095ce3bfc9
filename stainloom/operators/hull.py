"""Convex hulls of nuclei, and matching that must go row by row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = 1e-9


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull in turning order, without points on its edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    half = []
    for run in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for p in run:
            while len(side) > 1 and _cross(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        half += side[:-1]
    return half


def hull_area(rows: np.ndarray, cols: np.ndarray) -> int:
    """Pixels with centres in or on the hull of the pixels' edge midpoints.

    Only the first and last pixel of each row can carry corners, so the others are left out.
    """
    top = rows.min()
    low, high = np.full(rows.max() - top + 1, np.iinfo(np.int64).max), np.full(rows.max() - top + 1, -1)
    np.minimum.at(low, rows - top, cols)
    np.maximum.at(high, rows - top, cols)
    steps = ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))
    ends = [(r + int(top), a, b) for r, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) if b >= 0]
    corners = hull([(float(r + dr), float(c + dc)) for r, *cs in ends for c in cs for dr, dc in steps])
    if len(corners) < 3:
        return len(rows)
    y, x = np.mgrid[rows.min() : rows.max() + 1, cols.min() : cols.max() + 1]
    inside = np.ones(y.shape, bool)
    for (r0, c0), (r1, c1) in zip(corners, corners[1:] + corners[:1], strict=True):
        inside &= (r1 - r0) * (x - c0) - (c1 - c0) * (y - r0) >= -EDGE
    return int(inside.sum())


def convex(pixels: DataFrame, side: int) -> DataFrame:
    """convex_area, solidity (area by it) and convexity (its inverse)."""
    from stainloom.operators.features import by_mask

    def of(mask: np.ndarray):
        area, full = mask.sum(), hull_area(*np.nonzero(mask))
        return full, area / full, full / area

    return by_mask(pixels, side, of, ["convex_area", "solidity", "convexity"])


def match_by_centroid(ours: DataFrame, theirs: DataFrame, group: str, most: float | None = None) -> DataFrame:
    """One-to-one: in order of our ids, each row takes the nearest of theirs that is still free, within ``most``.

    Both have group, id, row, col. A group is the nuclei of one image.
    """
    kind = ours.schema[group].dataType.simpleString()

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, b = [], b.sort_values("id", ignore_index=True)
        free, at, ids = np.ones(len(b), bool), b[["row", "col"]].to_numpy(float), b["id"].to_numpy()
        for r in a.sort_values("id").itertuples():
            d = np.where(free, np.hypot(at[:, 0] - r.row, at[:, 1] - r.col), math.inf)
            j = int(np.argmin(d)) if len(d) else 0
            if len(d) and math.isfinite(d[j]) and (most is None or d[j] <= most):
                free[j] = False
                out.append((key[0], r.id, ids[j], d[j]))
        return pd.DataFrame(out, columns=[group, "id", "their_id", "distance"])

    cols = lambda df: df.select(F.col(group).alias(group), F.col("id").cast("long").alias("id"), F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"))
    return cols(ours).groupBy(group).cogroup(cols(theirs).groupBy(group)).applyInPandas(one, f"{group} {kind}, id long, their_id long, distance double")
