"""Batch bookkeeping: image pairs, metadata, nucleus types, label coercion and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainloom.operators.regions import cut

#: Suffixes of image files. Fixed values.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def is_image(path: str) -> Column:
    return F.lower(F.col(path)).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")


def bare(path: str) -> Column:
    """The path without the suffix of its last part."""
    return F.regexp_replace(F.col(path), r"\.[^./]*$", "")


def paths(images: DataFrame, path: str = "path") -> DataFrame:
    """Pair and CSV paths, and the metadata id by first folder, parent folder or stem; the stem where there is no folder."""
    parts = F.split(bare(path), "/")
    stem, depth = F.element_at(parts, -1), F.size(parts)
    return images.select(
        path, F.concat(bare(path), F.lit(".mat")).alias("mat_path"), F.concat(bare(path), F.lit(".csv")).alias("csv_path"), stem.alias("stem"),
        F.when(depth > 1, parts[0]).otherwise(stem).alias("first_dir"), F.when(depth > 1, F.try_element_at(parts, F.lit(-2))).otherwise(stem).alias("parent_dir"),
    )


def pairs(images: DataFrame, mats: DataFrame) -> DataFrame:
    """Each image with the label file of the same path but for the suffix; null where there is none."""
    m = mats.select(F.col("path").alias("mat_path"), bare("path").alias("k"))
    return images.filter(is_image("path")).withColumn("k", bare("path")).join(m, "k", "left").drop("k")


def with_metadata(tasks: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on trimmed keys; blanks where metadata has none, rows with blank keys never match.

    Of rows that repeat a key the last counts, in the order of the metadata's partitions.
    """
    m = metadata.select(F.trim(key).alias(key), *[F.trim(c).alias(c) for c in columns]).filter(F.col(key) != "")
    m = m.withColumn("_n", F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(F.struct(*columns), "_n").alias("_m")).select(key, "_m.*")
    return tasks.join(m, key, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def with_types(nuclei: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    return nuclei.join(types.select(*keys, "nucleus_type"), keys, "left").withColumn("nucleus_type", F.coalesce("nucleus_type", F.lit("Unknown")))


def pending(tasks: DataFrame, done: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Tasks without an output; at most ``most`` of them by key, counted after the others are left out."""
    left = tasks.join(done.select(key), key, "left_anti")
    return left.orderBy(key).limit(most) if most is not None else left


def label_of(value: str) -> Column:
    """A label from a number that is finite, whole within 1e-6 and fits 32 bits; null for any other."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (F.abs(v - F.rint(v)) <= 1e-6) & F.rint(v).between(0, 2**32 - 1)
    return F.when(ok, F.rint(v).cast("long"))


def finite(value: str) -> Column:
    """The value, zero where it is not finite."""
    v = F.col(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def crops(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of each padded box; black outside the nucleus."""
    j = cut(pixels, boxes, ["r", "g", "b"])
    inside = F.col("at") == F.col("label")
    return j.select("tile", "label", (F.col("row") - F.col("pr0")).alias("row"), (F.col("col") - F.col("pc0")).alias("col"), *[F.when(inside, F.col(c)).otherwise(0).alias(c) for c in "rgb"])


def totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("nuclei"))), F.lit(0)).cast("long").alias("nuclei")
    )


def match_by_id(ours: DataFrame, theirs: DataFrame, ident: str, order: str) -> DataFrame:
    """Inner join on the rounded id; of their rows with one id the last in order counts."""
    near = F.rint(ident).cast("long")
    t = theirs.withColumn("_id", near).groupBy("_id").agg(F.max_by(F.struct(*theirs.columns), order).alias("theirs"))
    return ours.withColumn("_id", near).join(t, "_id").drop("_id")


def match_by_order(ours: DataFrame, theirs: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of each group zipped in order, up to the shorter side."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    t = theirs.withColumn("position", n).select(group, "position", F.struct(*theirs.columns).alias("theirs"))
    return ours.withColumn("position", n).join(t, [group, "position"])
