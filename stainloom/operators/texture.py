"""Co-occurrence and colour statistics of nuclei, and distances between them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stainloom.operators.morphology import KEYS

OFFSETS = {0: ["row"], 45: ["d"], 90: ["col"], 135: ["s"]}
#: Weights of red, green and blue for the stains, as 32-bit values. Fixed values.
H_WEIGHTS, E_WEIGHTS = (0.65, 0.70, 0.29), (0.07, 0.99, 0.11)


def glcm(patch: DataFrame, angles=tuple(OFFSETS), guard: float = 1e-16) -> DataFrame:
    """Six properties of the symmetric co-occurrence matrices at distance one, averaged over angles.

    Neighbours come from lead() along rows, columns and diagonals rather than joins, and pairs are
    counted before they are made symmetric. Nuclei with fewer than two non-zero levels get zeros.
    """
    p = patch.select(*KEYS, "row", "col", "v", (F.col("row") - F.col("col")).alias("d"), (F.col("row") + F.col("col")).alias("s"))
    by = {a: Window.partitionBy(*KEYS, *OFFSETS[a]).orderBy("col" if a == 0 else "row") for a in angles}
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lead("v").over(by[a]).alias("j")) for a in angles])
    pairs = p.select(*KEYS, F.col("v").alias("i"), near.alias("near")).select(*KEYS, "i", F.explode("near").alias("x")).select(*KEYS, "x.a", "i", "x.j").filter("j is not null")
    pairs = pairs.groupBy(*KEYS, "a", "i", "j").agg(F.count("*").alias("n"))
    both = pairs.select(*KEYS, "a", F.explode(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n"))).alias("x"))
    both = both.groupBy(*KEYS, "a", "x.i", "x.j").agg(F.sum("x.n").alias("n"))
    d, n = F.col("i") - F.col("j"), F.col("n")
    # All sums are of whole numbers but that of homogeneity, which is of decimals; so no value depends on an order.
    t = both.groupBy(*KEYS, "a").agg(
        F.sum("n").alias("t"), F.sum(n * d * d).alias("con"), F.sum(n * F.abs(d)).alias("dis"), F.sum((n / (1 + d * d)).cast("decimal(20,12)")).cast("double").alias("hom"),
        F.sum(n * n).alias("sq"), F.sum(n * F.col("i")).alias("si"), F.sum(n * F.col("i") * F.col("i")).alias("sii"), F.sum(n * F.col("i") * F.col("j")).alias("sij"),
    )
    t = t.withColumn("var", (F.col("sii") * F.col("t") - F.col("si") * F.col("si")) / (F.col("t") * F.col("t")))
    cov = (F.col("sij") * F.col("t") - F.col("si") * F.col("si")) / (F.col("t") * F.col("t"))
    asm = F.col("sq") / (F.col("t") * F.col("t"))
    values = {
        "glcm_contrast": F.col("con") / F.col("t"), "glcm_dissimilarity": F.col("dis") / F.col("t"), "glcm_homogeneity": F.col("hom") / F.col("t"),
        "glcm_ASM": asm, "glcm_energy": F.sqrt(asm), "glcm_correlation": F.when(F.col("var") * F.col("var") <= guard, 0.0).otherwise(cov / F.col("var")),
    }
    # Summed in the order of the angles, four at most, so that a value does not depend on the order in which rows arrive.
    t = t.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("a", *[v.alias(c) for c, v in values.items()]))).alias("by"))
    mean = lambda c: F.aggregate(F.col("by"), F.lit(0.0), lambda total, x: total + x[c]) / F.size("by")
    t = t.select(*KEYS, *[mean(c).alias(c) for c in values])
    levels = patch.filter("v > 0").groupBy(*KEYS).agg(F.count_distinct("v").alias("levels"))
    names = [c for c in t.columns if c not in KEYS]
    t = t.join(levels.hint("merge"), KEYS, "left")
    return t.select(*KEYS, *[F.when(F.col("levels") >= 2, F.col(c)).otherwise(0.0).alias(c) for c in names])


def lbp(patch: DataFrame) -> DataFrame:
    """Mean, deviation and entropy of uniform local binary patterns, 8 points at radius one.

    The points at the corners are bilinear with fixed weights, and zero outside the patch. Patterns
    with more than two changes between neighbours in order count as 9.
    """
    w = lambda *by: Window.partitionBy(*KEYS, *by)
    d, s = F.col("row") - F.col("col"), F.col("row") + F.col("col")
    at = lambda win, order, f: F.coalesce(f("v").over(win.orderBy(order)), F.lit(0)).cast("double")
    p = patch.select(
        *KEYS, "inside", F.col("v").cast("double").alias("v"),
        at(w("row"), "col", F.lead).alias("e"), at(w("row"), "col", F.lag).alias("w"), at(w("col"), "row", F.lag).alias("n"), at(w("col"), "row", F.lead).alias("s"),
        at(w(d), "row", F.lag).alias("nw"), at(w(d), "row", F.lead).alias("se"), at(w(s), "row", F.lag).alias("ne"), at(w(s), "row", F.lead).alias("sw"),
    ).filter("inside")
    k = 0.70711
    # In the order of evaluation: interpolate columns within the two rows, then the rows.
    corner = lambda diag, vert, side: (1 - k) * ((1 - k) * F.col("v") + k * F.col(side)) + k * ((1 - k) * F.col(vert) + k * F.col(diag))
    points = [F.col("e"), corner("ne", "n", "e"), F.col("n"), corner("nw", "n", "w"), F.col("w"), corner("sw", "s", "w"), F.col("s"), corner("se", "s", "e")]
    bits = F.array(*[(F.round(x, 9) >= F.col("v")).cast("int") for x in points])
    p = p.select(*KEYS, "v", bits.alias("b"))
    changes = sum((F.col("b")[i] != F.col("b")[i + 1]).cast("int") for i in range(7))
    ones = sum(F.col("b")[i] for i in range(8))
    p = p.select(*KEYS, "v", F.when(changes <= 2, ones).otherwise(9).alias("code"))
    c = p.groupBy(*KEYS, "code").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    g = Window.partitionBy(*KEYS)
    c = c.withColumn("f", F.col("n") / F.sum("n").over(g))
    out = c.groupBy(*KEYS).agg(F.sum(F.col("f") * F.col("code")).alias("m"), F.sum(F.col("f") * F.col("code") * F.col("code")).alias("m2"), (-F.sum(F.col("f") * F.log2("f"))).alias("h"), F.max("top").alias("top"))
    live = F.col("top") > 0
    zero = lambda x, name: F.when(live, x).otherwise(0.0).alias(name)
    return out.select(*KEYS, zero(F.col("m"), "lbp_mean"), zero(F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0))), "lbp_std"), zero(F.col("h") + 0.0, "lbp_entropy"))


def hog(patch: DataFrame) -> DataFrame:
    """Mean, deviation, largest and smallest value of an oriented-gradient descriptor: 8 bins, 8x8 cells, clipped twice-normalised cells."""
    w = lambda by, order: Window.partitionBy(*KEYS, by).orderBy(order)
    step = lambda win: F.coalesce(F.lead("v").over(win) - F.lag("v").over(win), F.lit(0)).cast("double")
    p = patch.select(*KEYS, "row", "col", "pr0", "pc0", "pr1", "pc1", step(w("row", "col")).alias("gx"), step(w("col", "row")).alias("gy"))
    turn = F.degrees(F.atan2("gy", "gx"))
    turn = F.when(turn < 0, turn + 180).otherwise(turn)
    turn = F.when(turn >= 180, turn - 180).otherwise(turn)
    rows, cols = F.floor((F.col("pr1") - F.col("pr0") + 1) / 8), F.floor((F.col("pc1") - F.col("pc0") + 1) / 8)
    p = p.select(*KEYS, rows.alias("nr"), cols.alias("nc"), F.floor((F.col("row") - F.col("pr0")) / 8).alias("cr"), F.floor((F.col("col") - F.col("pc0")) / 8).alias("cc"), F.floor(F.round(turn, 9) / 22.5).alias("bin"), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"))
    sums = [F.sum(F.when(F.col("bin") == k, F.col("mag")).otherwise(0.0)) / 64 for k in range(8)]
    # Cells that aren't whole have no values, and nuclei of no whole cell zeros.
    whole = (F.col("cr") < F.first("nr")) & (F.col("cc") < F.first("nc"))
    cells = p.groupBy(*KEYS, "cr", "cc").agg(F.when(whole, F.array(*sums)).alias("h"))

    def unit(a):
        total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)
        return F.transform(a, lambda x: x / F.sqrt(total + 1e-10))

    cells = cells.withColumn("h", unit(F.col("h"))).withColumn("h", F.transform("h", lambda x: F.least(x, F.lit(0.2)))).withColumn("h", unit(F.col("h")))
    v = cells.select(*KEYS, F.explode_outer("h").alias("x"))
    v = v.groupBy(*KEYS).agg(F.avg("x").alias("hog_mean"), F.stddev_pop("x").alias("hog_std"), F.max("x").alias("hog_max"), F.min("x").alias("hog_min"))
    return v.fillna(0.0, [c for c in v.columns if c not in KEYS])


def stains(pixels: DataFrame) -> DataFrame:
    """Moments and range of the haematoxylin and eosin densities of each nucleus, and their ratio.

    Densities are logarithms of 32-bit floats, by stain weights that are 32-bit too.
    """
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    low = F.ln(F.lit(1e-6).cast("float"))
    od = lambda c: (F.ln(F.greatest((F.col(c) / 255).cast("float"), F.lit(1e-6).cast("float"))).cast("float") / low.cast("float")).cast("float").cast("double")
    o = pixels.filter("label > 0").select(*KEYS, *[od(c).alias(f"o{c}") for c in "rgb"])
    mixed = lambda ws: F.greatest(sum(F.col(f"o{c}") * single(w) for c, w in zip("rgb", ws, strict=True)), F.lit(0.0))
    o = o.select(*KEYS, mixed(H_WEIGHTS).alias("h"), mixed(E_WEIGHTS).alias("e"))
    aggs = []
    for c in "he":
        flat = F.stddev_pop(c) <= 1e-12
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.coalesce(F.when(~flat, F.skewness(c)), F.lit(0.0)).alias(f"{c}_skewness")]
        aggs += [F.coalesce(F.when(~flat, F.kurtosis(c)), F.lit(0.0)).alias(f"{c}_kurtosis"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = o.groupBy(*KEYS).agg(*aggs)
    return out.withColumn("he_ratio", F.when(F.col("e_mean") == 0, 0.0).otherwise(F.col("h_mean") / F.col("e_mean")))


def nearest(points: DataFrame, group: str, ident: str, row: str, col: str) -> DataFrame:
    """Distance of each point to the nearest other of its group; 0 for a lone one.

    A group is the points of one image. They are shuffled once and swept in order of their rows,
    so a point meets few others, however they lie.
    """
    import numpy as np
    import pyarrow as pa

    p = points.select(group, F.col(ident).alias("i"), F.col(row).cast("double").alias("y"), F.col(col).cast("double").alias("x"))
    kinds = [p.schema[c].dataType.simpleString() for c in (group, "i")]

    def swept(t: pa.Table) -> pa.Table:
        from stainloom.operators.features import nearest as sweep

        far = sweep(np.stack([t.column("y").to_numpy(), t.column("x").to_numpy()], axis=1))
        return pa.table([t.column(group), t.column("i"), pa.array(far)], [group, ident, "distance_to_nearest_neighbor"])

    return p.groupBy(group).applyInArrow(swept, f"{group} {kinds[0]}, {ident} {kinds[1]}, distance_to_nearest_neighbor double")


def nearest_to(points: DataFrame, row: str, col: str, at: tuple[float, float]) -> DataFrame:
    """distance of a place to the nearest of points: one row, 0 where there is none or the place is not finite.

    Points that are not finite are passed over. One aggregate, no join.
    """
    fine = all(math.isfinite(x) for x in at)
    d = F.sqrt((F.col(row) - F.lit(float(at[0]))) ** 2 + (F.col(col) - F.lit(float(at[1]))) ** 2)
    ok = d.isNotNull() & ~F.isnan(d) & (d != float("inf")) & F.lit(fine)
    return points.agg(F.coalesce(F.min(F.when(ok, d)), F.lit(0.0)).alias("distance"))
