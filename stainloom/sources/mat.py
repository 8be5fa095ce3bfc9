"""Label maps and instance types of MAT files of version 5, as rows; files are read by Spark, so any store will do."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format and of the names that are looked for, in their order.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
MATRIX, COMPRESSED = 14, 15
CELL, CHAR, NUMERIC = 1, 4, range(6, 16)
MAP_NAMES = ["instance_map", "inst_map", "instances", "labels", "segmentation", "mask"]

SCHEMA = "path string, name string, rows int, cols int, values array<double>, texts array<string>, error string"


def _parts(data: bytes, order: str):
    """(type, payload) of each element; compressed ones are opened."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            kind, size, body, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            body, step = at + 8, 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        if body + size > len(data):
            raise ValueError("element beyond the end of the file")
        if kind == COMPRESSED:
            yield from _parts(zlib.decompress(data[body : body + size]), order)
        else:
            yield kind, data[body : body + size]
        at += step


def _array(part: tuple[int, bytes], order: str) -> np.ndarray:
    kind, data = part
    if kind not in ELEMENTS:
        raise ValueError(f"element of type {kind} where numbers are due")
    t = np.dtype(order + ELEMENTS[kind])
    return np.frombuffer(data[: len(data) // t.itemsize * t.itemsize], t)


def _matrix(data: bytes, order: str):
    """(name, rows, cols, numbers or None, texts or None) of a matrix, or None for other kinds; of more dimensions the first two."""
    parts = list(_parts(data, order))
    if len(parts) < 3:
        return None
    kind = int(_array(parts[0], order)[0]) & 0xFF
    dims, name = _array(parts[1], order), parts[2][1].decode("latin-1").strip("\0")
    rows, cols = (int(dims[0]), int(dims[1])) if len(dims) > 1 else (int(dims[0]), 1)
    if kind == CELL:
        found = [_matrix(d, order) for k, d in parts[3:] if k == MATRIX]
        return name, rows, cols, None, [(x[4] or [""])[0].strip() if x and x[4] is not None else None for x in found]
    if len(parts) < 4 or kind not in (CHAR, *NUMERIC):
        return None
    flat = _array(parts[3], order)
    if kind == CHAR:
        grid = flat[: rows * cols].reshape((rows, cols), order="F")
        return name, rows, cols, None, ["".join(map(chr, line)) for line in grid]
    if len(flat) < rows * cols:
        raise ValueError(f"{name} has {len(flat)} of {rows * cols} values")
    return name, rows, cols, flat[: rows * cols].astype(float), None


def parse(data: bytes) -> list[tuple]:
    """The variables of one file, in order."""
    mark = data[126:128]
    if len(data) < 128 or mark not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of version 5")
    order = "<" if mark == b"IM" else ">"
    found = [_matrix(d, order) for k, d in _parts(data[128:], order) if k == MATRIX]
    return [x for x in found if x]


def choose(variables: list[tuple], key: str | None = None) -> tuple[str, np.ndarray]:
    """Name and label map, as in label_maps(), of the variables of one file."""
    fit = [(name, v.reshape((rows, cols), order="F")) for name, rows, cols, v, _ in variables if v is not None and v.size and (key is None or name == key)]
    fit = [(name, np.rint(v)) for name, v in fit if np.isfinite(v).all() and (np.abs(v - np.rint(v)) <= 1e-6).all() and np.rint(v).min() >= 0 and np.rint(v).max() < 2**32]
    if not fit:
        raise ValueError(f"no label map {key!r}" if key else "no label map")
    place = {name: i for i, name in enumerate(MAP_NAMES)}
    name, v = min(fit, key=lambda x: (place.get(x[0], len(place)), 0 if x[0] in place else -len(np.unique(x[1])), x[0]))
    return name, v.astype(np.uint32)


def types_of(variables: list[tuple], key: str) -> dict[int, str] | None:
    """Nucleus types by position from 1; None where the file has no texts under the key."""
    found = [texts for name, _, _, _, texts in variables if name == key and texts is not None]
    return {i: (t or "").strip() for i, t in enumerate(found[0], 1)} if found else None


def read_mat(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """A row for each numeric or text variable: path, name, rows, cols, values (by columns) or texts.

    A file that cannot be read gives one row with an error instead of failing the job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[mM][aA][tT]").load(path)

    def run(batches):
        for pdf in batches:
            out = []
            for at, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(at, *x, None) for x in parse(bytes(data))]
                except Exception as e:  # noqa: BLE001 - whatever a broken file causes is that file's result
                    out.append((at, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "name", "rows", "cols", "values", "texts", "error"]).astype({"rows": "Int32", "cols": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def label_maps(variables: DataFrame, key: str | None = None) -> DataFrame:
    """The label map of each path, as whole numbers: of ``key``, else of the first known name, else the one with most labels.

    A variable is a label map if all its values are finite, whole to 1e-6 and from 0 to 2**32 - 1.
    """
    whole = lambda v: ~F.isnan(v) & (v > -0.5) & (v < 4294967295.5) & (F.abs(v - F.round(v)) <= 1e-6)
    fit = variables.filter("values is not null and size(values) > 0").filter(F.forall("values", whole))
    if key is not None:
        fit = fit.filter(F.col("name") == key)
    place = F.array_position(F.array(*map(F.lit, MAP_NAMES)), F.col("name"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(MAP_NAMES) + 1).alias("place"), F.when(place > 0, 0).otherwise(-F.size(F.array_distinct("values"))).alias("few"), "name")
    best = fit.groupBy("path").agg(F.min_by(F.struct("name", "rows", "cols", "values"), rank).alias("m"))
    return best.select("path", "m.name", "m.rows", "m.cols", F.transform("m.values", lambda v: F.round(v).cast("long")).alias("labels"))


def label_pixels(maps: DataFrame) -> DataFrame:
    """path, row, col, label of every pixel that is not background."""
    p = maps.select("path", "rows", F.posexplode("labels").alias("at", "label")).filter("label > 0")
    return p.select("path", (F.col("at") % F.col("rows")).alias("row"), F.floor(F.col("at") / F.col("rows")).cast("int").alias("col"), "label")


def instance_types(variables: DataFrame, key: str = "inst_type") -> DataFrame:
    """path, pos (from 1), nucleus_type of the texts under ``key``."""
    t = variables.filter((F.col("name") == key) & F.col("texts").isNotNull())
    return t.select("path", F.posexplode("texts").alias("p", "nucleus_type")).select("path", (F.col("p") + 1).alias("pos"), "nucleus_type")
