"""Deterministic tissue tiles derived from the keys of the test tables.

Every tile is a formula of its seed, so that Spark and an independent SQL engine build the same
pixels with integer arithmetic alone. ``TILE_SQL`` is the DuckDB twin of :func:`tiles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 48


def tiles(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """One row per pixel: tile, row, col, r, g, b, gray, label.

    Label 1 is a disk near the centre, label 2 a disk that covers the corner pixel (0, 0) and
    label 3 a small square; later shapes win where they overlap. Tiles are dealt over the cluster
    before pixels are made, so the pixel explosion runs in parallel and later steps by tile find
    their rows together.
    """
    s = F.col("tile")
    seeds = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("tile"))
    n = spark.sparkContext.defaultParallelism * 2
    px = (
        seeds.repartition(n, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("row"))
        .select("tile", "row", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("col"))
    )
    r, c = F.col("row"), F.col("col")
    dy, dx = r - (F.lit(side // 2) + s % 3 - 1), c - (F.lit(side // 2) + s % 5 - 2)
    radius = F.floor((F.lit(30) + s % 7) * side / 100).cast("int")
    square = r.between(side - 9, side - 5) & c.between(F.lit(4) + s % 4, F.lit(9) + s % 4)
    label = (
        F.when(square, 3)
        .when(r * r + c * c <= F.lit(20) + s % 9, 2)
        .when(dy * dy + dx * dx <= radius * radius / 2, 1)
        .otherwise(0)
    )
    px = px.select(
        "tile", "row", "col",
        ((r * 3 + c * 5 + s * 7) % 256).alias("r"),
        ((r * 11 + c * 13 + s * 17) % 256).alias("g"),
        ((r * 19 + c * 23 + s * 29) % 256).alias("b"),
        label.alias("label"),
    )
    return px.withColumn("gray", gray())


def gray(r: str = "r", g: str = "g", b: str = "b"):
    """Fixed-point luma of 8-bit channels."""
    return F.shiftright(F.col(r) * 19596 + F.col(g) * 38470 + F.col(b) * 7470 + 32768, 16)


TILE_SQL = f"""px0 AS (
  SELECT CAST(s_suppkey AS INTEGER) AS tile, CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col
  FROM supplier, range({SIDE}) a(i), range({SIDE}) b(i)),
px AS (
  SELECT tile, row, col, (row*3+col*5+tile*7)%256 AS r, (row*11+col*13+tile*17)%256 AS g, (row*19+col*23+tile*29)%256 AS b,
    CASE WHEN row BETWEEN {SIDE - 9} AND {SIDE - 5} AND col BETWEEN 4+tile%4 AND 9+tile%4 THEN 3
      WHEN row*row+col*col <= 20+tile%9 THEN 2
      WHEN (row-({SIDE // 2}+tile%3-1))*(row-({SIDE // 2}+tile%3-1)) + (col-({SIDE // 2}+tile%5-2))*(col-({SIDE // 2}+tile%5-2))
        <= (((30+tile%7)*{SIDE})//100)*(((30+tile%7)*{SIDE})//100)/2.0 THEN 1
      ELSE 0 END AS label
  FROM px0),
pixels AS (SELECT *, (r*19596+g*38470+b*7470+32768)>>16 AS gray FROM px)"""
