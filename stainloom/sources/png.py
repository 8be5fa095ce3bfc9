"""PNG files of 8-bit channels as RGB rows, and RGB arrays as PNG bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the file format.
MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

SCHEMA = "path string, height int, width int, rgb binary, error string"


def encode(rgb: np.ndarray) -> bytes:
    """A PNG of an (H, W, 3) array."""
    if rgb.ndim != 3 or rgb.shape[2] != 3 or not rgb.size:
        raise ValueError("an image has rows, columns and three channels")
    h, w, _ = rgb.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, left, corner = bytearray(len(line)), [0] * step, [0] * step
    for i, (v, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        a, c = left[i % step], corner[i % step]
        if kind == 3:
            guess = (a + up) // 2
        elif kind == 4:
            guess = min((abs(up - c), 0, a), (abs(a - c), 1, up), (abs(a + up - 2 * c), 2, c))[2]
        else:
            raise ValueError(f"filter {kind}")
        out[i] = left[i % step] = (v + guess) & 255
        corner[i % step] = up
    return np.frombuffer(bytes(out), np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(H, W, 3): grey is repeated, a palette is looked up and alpha is left out."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, parts = 8, []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("checksum")
        parts.append((kind, body))
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or interlaced or colour not in CHANNELS or not w or not h:
        raise ValueError("only plain images with 8-bit channels")
    n = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    rows, above = [], np.zeros(w * n, np.uint8)
    for line in raw:
        above = _unfilter(int(line[0]), line[1:], above, n)
        rows.append(above)
    px = np.stack(rows).reshape(h, w, n)
    if colour == 3:
        return np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)[px[:, :, 0]]
    return px[:, :, :3] if n > 2 else np.repeat(px[:, :, :1], 3, axis=2)


def read_png(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, height, width, rgb (by rows) of each PNG; a file that cannot be read gives a row with an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[pP][nN][gG]").load(path)

    def run(batches):
        for pdf in batches:
            out = []
            for at, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    px = decode(bytes(data))
                    out.append((at, *px.shape[:2], px.tobytes(), None))
                except Exception as e:  # noqa: BLE001 - whatever a broken file causes is that file's result
                    out.append((at, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "height", "width", "rgb", "error"]).astype({"height": "Int32", "width": "Int32"})

    return found.select("path", "content").mapInPandas(run, SCHEMA)
