"""Nucleus regions and their padded patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PADDING = 10
#: Pixels of a row that are held together.
STRIP = 64
KEYS, SPAN = ["tile", "label"], ["pr0", "pc0", "pr1", "pc1"]


def boxes(pixels: DataFrame, side: int, padding: int = PADDING) -> DataFrame:
    """Inclusive bounding box of each label but 0, its padded patch and its pixel count; one aggregation."""
    b = pixels.filter("label > 0").groupBy("tile", "label").agg(
        F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"), F.count("*").alias("area")
    )
    low = lambda c: F.greatest(F.col(c) - padding, F.lit(0))
    high = lambda c: F.least(F.col(c) + padding, F.lit(side - 1))
    return b.withColumns({"pr0": low("r0"), "pc0": low("c0"), "pr1": high("r1"), "pc1": high("c1")})


def cut(pixels: DataFrame, boxes: DataFrame, values: list[str]) -> DataFrame:
    """Pixels of each padded box: tile, label, pr0, pc0, pr1, pc1, row, col, at (the pixel's own label) and values.

    Strips of a row's pixels meet the boxes that reach them, so neither all pixels of a tile meet all its nuclei
    nor is each pixel a row of the join. The size that is estimated for pixels made from keys is that of the keys,
    so the join is told to sort; broadcast, the pixels would have to fit into the driver. What comes out lies by nucleus.
    """
    strip = lambda c: F.floor(F.col(c) / STRIP).cast("int")
    held = pixels.groupBy("tile", "row", strip("col").alias("strip")).agg(F.collect_list(F.struct("col", F.col("label").alias("at"), *values)).alias("cells"))
    b = boxes.select(*KEYS, *SPAN, F.explode(F.sequence("pr0", "pr1")).alias("row"))
    b = b.select("*", F.explode(F.sequence(strip("pc0"), strip("pc1"))).alias("strip"))
    met = b.hint("merge").join(held, ["tile", "row", "strip"])
    met = met.select(*KEYS, *SPAN, "row", F.filter("cells", lambda x: x["col"].between(F.col("pc0"), F.col("pc1"))).alias("cells"))
    # Not inline(): the test for empty strips that Spark infers from it would become a condition of the join.
    return met.repartition(*KEYS).select(*KEYS, *SPAN, "row", F.inline_outer("cells")).filter("col is not null")


def patches(pixels: DataFrame, side: int, padding: int = PADDING, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Pixels of each padded patch: tile, label, row, col, inside, v (grey level, 0 outside), values, and the patch's ends.

    Lies by tile and label, so windows and sums of nuclei move nothing. Texture needs no values.
    """
    j = cut(pixels, boxes(pixels, side, padding), ["gray", *values])
    inside = F.col("at") == F.col("label")
    return j.select(*KEYS, "row", "col", inside.alias("inside"), F.when(inside, F.col("gray")).otherwise(0).alias("v"), *values, *SPAN)
