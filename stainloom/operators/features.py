"""The feature row of every nucleus: tiles to patches, patches to columns, in Arrow batches.

A tile is normalised and cut where it is read, so tiles are never shuffled; only patches are, if a
dense tile shall be spread. Every family of features is computed only if it is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainloom.operators import nucleus
from stainloom.operators.nucleus import NEAREST, OF_MASK, OF_PIXELS, PREFIXES
from stainloom.operators.regions import PADDING
from stainloom.operators.stain import Normaliser, normalise

FAMILIES = [*OF_MASK, *OF_PIXELS]
PATCH = "nucleus_id long, r0 int, c0 int, r1 int, c1 int, row int, col int, height int, width int, mask binary, pre binary, post binary, distance_to_nearest_neighbor double, error string"


def columns(families=FAMILIES) -> list[str]:
    """Names of the feature columns, in order."""
    pixels = [x for f in OF_PIXELS if f in families for x in OF_PIXELS[f]]
    return ["nucleus_id", *[x for f in OF_MASK if f in families for x in OF_MASK[f]], *[p + x for p in PREFIXES for x in pixels], NEAREST]


def array_of(data: bytes, kind: str, *shape: int) -> np.ndarray:
    out = np.frombuffer(data, kind)
    if out.size != np.prod(shape, dtype=np.int64) or not out.size:
        raise ValueError(f"{out.size} values for {' x '.join(map(str, shape))}")
    return out.reshape(shape)


def nearest(at: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest other; 0 for a lone one.

    Points are sorted by row, and a point looks at ever more neighbours in that order, both ways,
    until those left are farther by their row alone.
    """
    n = len(at)
    if n < 2:
        return np.zeros(n)
    order = np.argsort(at[:, 0], kind="stable")
    p, best = at[order], np.full(n, np.inf)
    live = np.arange(n)
    for k in range(1, n):
        far = np.full(len(live), np.inf)
        for s in (k, -k):
            ok = (live + s >= 0) & (live + s < n)
            i = live[ok]
            gap = p[i + s] - p[i]
            best[i] = np.minimum(best[i], np.hypot(gap[:, 0], gap[:, 1]))
            far[ok] = np.minimum(far[ok], np.abs(gap[:, 0]))
        live = live[far < best[live]]
        if not len(live):
            break
    out = np.empty(n)
    out[order] = best
    return out


def regions(labels: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(label, first and last row, first and last column, pixels) of each label but 0, in order; one sort."""
    r, c = np.nonzero(labels)
    of = labels[r, c]
    order = np.argsort(of, kind="stable")
    r, c, of = r[order], c[order], of[order]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
    if not len(at):
        return []
    lo = lambda x: np.minimum.reduceat(x, at).tolist()
    hi = lambda x: np.maximum.reduceat(x, at).tolist()
    return list(zip(of[at].tolist(), lo(r), lo(c), hi(r), hi(c), np.diff(np.append(at, len(of))).tolist(), strict=True))


def tile_patches(rgb: np.ndarray, labels: np.ndarray, stain: Normaliser | None, padding: int = PADDING) -> list[tuple]:
    """Rows of PATCH for one tile; post is pre where nothing is normalised."""
    if rgb.shape[:2] != labels.shape:
        raise ValueError(f"image of {rgb.shape[:2]} and labels of {labels.shape}")
    found = regions(labels)
    if not found:
        return []
    try:
        other = normalise(rgb, stain) if stain else rgb
    except ValueError:
        other = rgb
    h, w = labels.shape
    out, middles = [], []
    for label, r0, c0, r1, c1, _ in found:
        a, b, y, x = max(r0 - padding, 0), max(c0 - padding, 0), min(r1 + padding, h - 1) + 1, min(c1 + padding, w - 1) + 1
        mask = labels[a:y, b:x] == label
        r, c = np.nonzero(mask)
        middles.append((r.mean() + a, c.mean() + b))
        cut = lambda of: np.ascontiguousarray(of[a:y, b:x]).tobytes()  # noqa: B023, E731 - used at once
        out.append([label, r0, c0, r1, c1, a, b, y - a, x - b, mask.tobytes(), cut(rgb), cut(other) if other is not rgb else None])
    return [(*row, float(d), None) for row, d in zip(out, nearest(np.array(middles)), strict=True)]


def patches(tiles: DataFrame, key: str, stain: Normaliser | None = None, padding: int = PADDING) -> DataFrame:
    """A row for each nucleus of tiles (key, height, width, rgb, labels): box, padded patch, mask and neighbour distance.

    rgb is 3 bytes a pixel, labels 4 (unsigned, little-endian), both by rows. ``post`` is null where
    it is as ``pre``. A tile that can't be cut gives one row with its error.
    """
    kind = tiles.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in PATCH.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in PATCH.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                of, h, w, rgb, labels = (b.column(i)[at].as_py() for i in range(5))
                try:
                    rows = tile_patches(array_of(rgb, "u1", h, w, 3), array_of(labels, "<u4", h, w), stain, padding)
                except (ValueError, TypeError) as e:
                    rows = [(*[None] * (len(names) - 1), f"{type(e).__name__}: {e}")]
                if rows:
                    keys = pa.array([of] * len(rows), b.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], [key, *names])

    return tiles.select(key, "height", "width", "rgb", "labels").mapInArrow(run, f"{key} {kind}, {PATCH}")


def features(cut: DataFrame, key: str, families=FAMILIES) -> DataFrame:
    """The feature row of each patch: key, nucleus_id, families of the mask, of the pixels before and after, neighbour distance."""
    kind = cut.schema[key].dataType.simpleString()
    names, mask_like, pixel_like = columns(families), set(families) & set(OF_MASK), set(families) & set(OF_PIXELS)
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"no such family: {sorted(unknown)}")

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for of, ident, row, col, h, w, mask, pre, post, near in zip(*[c.to_pylist() for c in b.columns], strict=True):
                mask = np.frombuffer(mask, bool).reshape(h, w)
                out = [float(ident), *nucleus.of_mask(mask, (row, col), mask_like)]
                before = nucleus.of_pixels(np.frombuffer(pre, np.uint8).reshape(h, w, 3), mask, pixel_like) if pixel_like else []
                after = before if post is None or not pixel_like else nucleus.of_pixels(np.frombuffer(post, np.uint8).reshape(h, w, 3), mask, pixel_like)
                rows.append([*out, *before, *after, near])
                keys.append(of)
            table = np.nan_to_num(np.array(rows, float).reshape(-1, len(names)), nan=0.0, posinf=0.0, neginf=0.0)
            cols = [pa.array(table[:, 0].astype(np.int64)), *[pa.array(table[:, i]) for i in range(1, len(names))]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *cols], [key, *names])

    kinds = ", ".join(["nucleus_id long", *[f"{x} double" for x in names[1:]]])
    rows = cut.filter("error is null").select(key, "nucleus_id", "row", "col", "height", "width", "mask", "pre", "post", NEAREST)
    return rows.mapInArrow(run, f"{key} {kind}, {kinds}")


def full_features(tiles: DataFrame, key: str, stain: Normaliser | None = None, families=FAMILIES, spread: int | None = None) -> DataFrame:
    """All features of all nuclei of tiles; ``spread`` deals patches over so many tasks, for dense tiles."""
    cut = patches(tiles, key, stain)
    return features(cut.repartition(spread, key, "nucleus_id") if spread else cut, key, families)


def from_pixels(pixels: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Tiles of a pixel table (key, row, col, r, g, b, label): a row each, in the form that patches() takes."""
    at = F.struct((F.col("row") * width + F.col("col")).alias("at"), "r", "g", "b", "label")
    held = pixels.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("p")).select(key, *[F.col(f"p.{c}").alias(c) for c in ("r", "g", "b", "label")])
    kind = held.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                r, g, blue, label = (b.column(i)[at].values.to_numpy(zero_copy_only=False) for i in range(1, 5))
                rgb = np.stack([r, g, blue], axis=-1).astype(np.uint8).tobytes()
                cols = [b.column(0).slice(at, 1), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([rgb]), pa.array([label.astype("<u4").tobytes()])]
                yield pa.RecordBatch.from_arrays(cols, [key, "height", "width", "rgb", "labels"])

    return held.mapInArrow(run, f"{key} {kind}, height int, width int, rgb binary, labels binary")


def by_mask(pixels: DataFrame, side: int, kernel, names: list[str]) -> DataFrame:
    """tile, label and the named values of a function of each nucleus's mask in its padded patch, many nuclei to a batch."""
    cut = patches(from_pixels(pixels, "tile", side, side), "tile").select("tile", "nucleus_id", "height", "width", "mask")

    def run(batches):
        for b in batches:
            rows = [list(map(float, kernel(np.frombuffer(m, bool).reshape(h, w)))) for h, w, m in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True)]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), *cols], ["tile", "label", *names])

    kind = cut.schema["tile"].dataType.simpleString()
    return cut.mapInArrow(run, ", ".join([f"tile {kind}", "label int", *[f"{n} double" for n in names]]))
