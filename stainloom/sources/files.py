"""Listings of image folders, and which of several places has a file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE = r"(?i)\.(png|jpe?g|tiff?|bmp)$"


def scan_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, rel_path and length of the images below a folder, in order of rel_path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length")
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rel = F.expr("substring(path, instr(path, base) + length(base) + 1)")
    return files.filter(F.col("path").rlike(IMAGE)).withColumn("base", base).select("path", rel.alias("rel_path"), "length").orderBy("rel_path")


def first_existing(wanted: DataFrame, existing: DataFrame, dirs: list[str], templates: list[str], stem: str = "stem") -> DataFrame:
    """wanted with ``path``: the first of directory by template (with {stem}) that is in existing.path; null if none is.

    Directories come before templates. A candidate is a row, so both sides are dealt by path.
    """
    n = len(templates)
    ways = [(i * n + j, d.rstrip("/") + "/", *t.split("{stem}", 1)) for i, d in enumerate(dirs) for j, t in enumerate(templates)]
    tries = F.array(*[F.struct(F.lit(k).alias("way"), F.concat(F.lit(d + a), F.col(stem), F.lit(b)).alias("path")) for k, d, a, b in ways])
    hits = wanted.select(stem).distinct().select(stem, F.inline(tries)).join(existing.select("path").distinct(), "path")
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(stem).orderBy("way"))).filter("_n = 1").select(stem, "path")
    return wanted.join(first, stem, "left")


def by_suffix(suffixes) -> str:
    """A file pattern of suffixes, whatever their case."""
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "{" + ",".join(f"*.{either(s.lstrip('.'))}" for s in suffixes) + "}"


def read_images(spark: SparkSession, root: str, suffixes=("png", "jpg", "jpeg", "tif", "tiff", "bmp"), recursive: bool = True) -> DataFrame:
    """path, height, width, rgb (3 bytes a pixel, by rows) of the images below a folder; nulls for one that can't be read.

    The JVM decodes; grey is repeated and alpha left out.
    """
    found = spark.read.format("image").option("recursiveFileLookup", recursive).option("pathGlobFilter", by_suffix(suffixes)).load(root)
    flat = found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import numpy as np

        for b in batches:
            for at in range(b.num_rows):
                path, h, w, n, data = (b.column(i)[at].as_py() for i in range(5))
                rgb = None
                if h and h > 0 and w > 0:
                    px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    rgb = (px[:, :, 2::-1] if n > 2 else np.repeat(px[:, :, :1], 3, axis=2)).tobytes()
                ok = rgb is not None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h if ok else None], pa.int32()), pa.array([w if ok else None], pa.int32()), pa.array([rgb], pa.binary())], ["path", "height", "width", "rgb"])

    return flat.mapInArrow(run, "path string, height int, width int, rgb binary")


def read_metadata(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """key and columns of a CSV file with a header, as trimmed texts; blank keys are left out, and the last row of a key counts.

    A mark of byte order before the header is skipped. Missing columns are an error.
    """
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if not rows.columns:
        raise ValueError(f"no header in {path}")
    if missing := [c for c in [key, *columns] if c not in rows.columns]:
        raise ValueError(f"missing columns in {path}: {', '.join(missing)}")
    quoted = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))
    rows = rows.select(*[quoted(c).alias(c) for c in dict.fromkeys([key, *columns])]).filter(F.col(f"`{key}`") != "")
    rest = [c for c in dict.fromkeys(columns) if c != key]
    last = rows.withColumn("_n", F.monotonically_increasing_id()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]) if rest else F.lit(None), "_n").alias("_m"))
    return last.select(F.col(f"`{key}`"), *[F.col("_m")[c].alias(c) for c in rest])
