"""Shape of nuclei as aggregates over their pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["tile", "label"]
#: Lengths of the border codes of a 3x3 neighbourhood. Fixed values.
CODES = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}


def centroids(pixels: DataFrame) -> DataFrame:
    return pixels.filter("label > 0").groupBy(*KEYS).agg(F.count("*").cast("double").alias("area"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"))


def axes(pixels: DataFrame) -> DataFrame:
    """Axes of the ellipse with the same second moments, eccentricity and orientation (radians).

    Integer power sums are exact, so the central moments need no second pass over the pixels.
    """
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    s = pixels.filter("label > 0").groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.sum(r).alias("sr"), F.sum(c).alias("sc"), F.sum(r * r).alias("srr"), F.sum(c * c).alias("scc"), F.sum(r * c).alias("src")
    )
    mu = lambda xy, x, y: (F.col(xy) * F.col("n") - F.col(x) * F.col(y)) / (F.col("n") * F.col("n"))
    s = s.select(*KEYS, mu("srr", "sr", "sr").alias("vr"), mu("scc", "sc", "sc").alias("vc"), mu("src", "sr", "sc").alias("vrc"))
    # Tensor [[a, b], [b, c]] with a over columns and c over rows.
    a, b, c = F.col("vc"), -F.col("vrc"), F.col("vr")
    root = F.sqrt((a - c) * (a - c) / 4 + b * b)
    s = s.withColumns({"l1": F.greatest((a + c) / 2 + root, F.lit(0.0)), "l2": F.greatest((a + c) / 2 - root, F.lit(0.0))})
    flat = F.abs(F.col("vc") - F.col("vr")) < 1e-12
    turn = F.when(flat, F.when(b < 0, math.pi / 4).otherwise(-math.pi / 4)).otherwise(0.5 * F.atan2(-2 * b, F.col("vr") - F.col("vc")))
    ecc = F.when(F.col("l1") <= 1e-12, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("l2") / F.col("l1"))))
    # The tensor's first axis is that of the rows.
    return s.select(*KEYS, (4 * F.sqrt("l1")).alias("major_axis_length"), (4 * F.sqrt("l2")).alias("minor_axis_length"), ecc.alias("eccentricity"), turn.alias("orientation"))


def perimeters(pixels: DataFrame) -> DataFrame:
    """Border length by codes of border pixels; one window for each of the four directions of neighbours.

    Only pixels of nuclei are sorted; a neighbour that isn't next to a pixel is none.
    """
    p = pixels.filter("label > 0").select("tile", "row", "col", "label")
    across, down = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")
    fall, rise = Window.partitionBy("tile", F.col("row") - F.col("col")).orderBy("row"), Window.partitionBy("tile", F.col("row") + F.col("col")).orderBy("row")
    gap = {across: "col", down: "row", fall: "row", rise: "row"}

    def beside(w, f, of):
        """The value of the neighbour, null if the nearest pixel that way is farther off."""
        return F.when(F.abs(f(gap[w]).over(w) - F.col(gap[w])) == 1, f(of).over(w))

    other = lambda w, f: F.coalesce(beside(w, f, "label"), F.lit(-1)) != F.col("label")
    edge = other(across, F.lag) | other(across, F.lead) | other(down, F.lag) | other(down, F.lead)
    p = p.withColumn("e", F.when(edge & (F.col("label") > 0), F.col("label")).otherwise(0))
    like = lambda w, f: F.coalesce((beside(w, f, "e") == F.col("label")).cast("int"), F.lit(0))
    code = 1 + 2 * (like(across, F.lag) + like(across, F.lead) + like(down, F.lag) + like(down, F.lead))
    code = code + 10 * (like(fall, F.lag) + like(fall, F.lead) + like(rise, F.lag) + like(rise, F.lead))
    p = p.withColumn("code", F.when(F.col("e") > 0, code).otherwise(0)).filter("label > 0")
    length = F.lit(0.0)
    for step, codes in CODES.items():
        length = F.when(F.col("code").isin(*codes), step).otherwise(length)
    return p.groupBy(*KEYS).agg(F.sum(length).alias("perimeter"))


def euler_numbers(pixels: DataFrame) -> DataFrame:
    """8-connected objects less their holes, by counts of 2x2 patterns; each pixel marks the four that hold it."""
    quads = pixels.filter("label > 0").select(*KEYS, "row", "col", F.explode(F.expr("array(0, 1, 2, 3)")).alias("k"))
    at = quads.groupBy(*KEYS, (F.col("row") + F.floor(F.col("k") / 2)).alias("qr"), (F.col("col") + F.col("k") % 2).alias("qc")).agg(
        F.sum(F.expr("shiftleft(1, k)")).alias("bits"), F.count("*").alias("n")
    )
    diagonal = F.col("bits").isin(6, 9)
    score = F.when(F.col("n") == 1, 1).when(F.col("n") == 3, -1).when(diagonal, -2).otherwise(0)
    return at.groupBy(*KEYS).agg((F.sum(score) / 4).alias("euler_number"))


def ratios(pixels: DataFrame, side: int) -> DataFrame:
    """Diameter, extent, circularity, aspect ratio, fractal dimension and roughness."""
    from stainloom.operators.regions import boxes

    b = boxes(pixels, side).join(perimeters(pixels), KEYS).join(axes(pixels), KEYS)
    a, p = F.col("area").cast("double"), F.col("perimeter")
    return b.select(
        *KEYS, F.sqrt(4 * a / math.pi).alias("equivalent_diameter"),
        (a / ((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1))).alias("extent"),
        F.when(p == 0, 0.0).otherwise(4 * math.pi * a / (p * p)).alias("circularity"),
        F.when(F.col("minor_axis_length") == 0, 0.0).otherwise(F.col("major_axis_length") / F.col("minor_axis_length")).alias("aspect_ratio"),
        F.when((a > 1) & (p > 0), F.ln(p) / F.ln(a)).otherwise(0.0).alias("fractal_dimension"), (p * p / a).alias("roughness"),
    )


def hu_from(nu: dict[str, object]) -> list:
    """The seven invariants of normalised central moments, by name of the moment."""
    n20, n02, n11, n30, n03, n12, n21 = (nu[k] for k in ("20", "02", "11", "30", "03", "12", "21"))
    x, y, u, v = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    px, py = x * (x * x - 3 * y * y), y * (3 * x * x - y * y)
    return [n20 + n02, (n20 - n02) ** 2 + 4 * n11 * n11, u * u + v * v, x * x + y * y, u * px + v * py, (n20 - n02) * (x * x - y * y) + 4 * n11 * x * y, v * px - u * py]


def hu_of_mask(pixels: DataFrame, side: int) -> DataFrame:
    """hu_moment_1..7 as the pipeline defines them: the corner of the patch's mask stands for the moments.

    They vanish unless the patch's first pixel is in the nucleus, for areas of ten or less and for
    patches with a side of less than four pixels.
    """
    from stainloom.operators.regions import PADDING

    # A patch that begins at r0 - PADDING has no pixel of the nucleus in its first rows, and any other begins at 0;
    # so pixels near the tile's corner are those near the patch's, and one aggregation does.
    has = lambda k: F.max(((F.col("row") == int(k[0])) & (F.col("col") == int(k[1]))).cast("double")).alias(f"m{k}")
    long = lambda c: F.least(F.max(c) + PADDING, F.lit(side - 1)) - F.greatest(F.min(c) - PADDING, F.lit(0)) >= 3
    m = pixels.filter("label > 0").groupBy(*KEYS).agg(F.count("*").alias("area"), (long("row") & long("col")).alias("large"), *map(has, ("00", "20", "02", "11", "30", "03", "12", "21")))
    hu = hu_from({k: F.col(f"m{k}") for k in ("20", "02", "11", "30", "03", "12", "21")})
    ok = F.col("large") & (F.col("m00") == 1) & (F.col("area") > 10)
    return m.select(*KEYS, *[F.when(ok, h).otherwise(0.0).alias(f"hu_moment_{i}") for i, h in enumerate(hu, 1)])


def hu_moments(pixels: DataFrame) -> DataFrame:
    """True Hu invariants of each nucleus: moments about its centroid, scaled by its area.

    Centroids come from a window over the nucleus, so its pixels are moved once and nothing is joined.
    """
    w = Window.partitionBy(*KEYS)
    c = pixels.filter("label > 0").select(*KEYS, "row", "col", F.count("*").over(w).cast("double").alias("area"), F.avg("row").over(w).alias("centroid_row"), F.avg("col").over(w).alias("centroid_col"))
    y, x = F.col("row") - F.col("centroid_row"), F.col("col") - F.col("centroid_col")
    mu = lambda k: F.sum(F.pow(x, F.lit(int(k[0]))) * F.pow(y, F.lit(int(k[1])))).alias(f"m{k}")
    names = ("20", "02", "11", "30", "03", "12", "21")
    m = c.groupBy(*KEYS, "area").agg(*map(mu, names))
    hu = hu_from({k: F.col(f"m{k}") / F.pow(F.col("area"), F.lit((int(k[0]) + int(k[1])) / 2 + 1)) for k in names})
    return m.select(*KEYS, *[h.alias(f"true_hu_{i}") for i, h in enumerate(hu, 1)])
