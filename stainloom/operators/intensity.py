"""Grey-level statistics of nuclei as DataFrame aggregates over their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistics(pixels: DataFrame, keys: list[str], gray: str = "gray") -> DataFrame:
    """Population moments and linear percentiles of each nucleus; zero where the variance vanishes.

    One aggregation: grey levels are first counted per nucleus, so at most 256 rows of a nucleus
    are shuffled however many pixels it has.
    """
    g = F.col(gray).cast("double")
    flat = F.var_pop(g) <= 1e-8
    q = F.percentile(g, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return (
        pixels.groupBy(*keys)
        .agg(
            F.avg(g).alias("mean_intensity"), q.alias("_q"), F.stddev_pop(g).alias("std_intensity"),
            F.min(g).alias("min_intensity"), F.max(g).alias("max_intensity"),
            F.coalesce(F.when(~flat, F.skewness(g)), F.lit(0.0)).alias("skewness_intensity"),
            F.coalesce(F.when(~flat, F.kurtosis(g)), F.lit(0.0)).alias("kurtosis_intensity"),
        )
        .select(
            *keys, "mean_intensity", F.col("_q")[1].alias("median_intensity"), "std_intensity", "min_intensity", "max_intensity",
            (F.col("max_intensity") - F.col("min_intensity")).alias("range_intensity"),
            (F.col("_q")[2] - F.col("_q")[0]).alias("iqr_intensity"), "skewness_intensity", "kurtosis_intensity",
        )
    )


def entropy(pixels: DataFrame, keys: list[str], gray: str = "gray") -> DataFrame:
    """Entropy in bits of the density over 256 bins of [0, 255]; it may be negative, as bins are narrower than 1."""
    counts = pixels.groupBy(*keys, gray).agg(F.count("*").alias("n"))
    d = F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * 255 / 256)
    return counts.select(*keys, d.alias("d")).groupBy(*keys).agg((-F.sum(F.col("d") * F.log2("d"))).alias("entropy_intensity"))
