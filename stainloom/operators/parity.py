"""Comparison of two feature tables, feature by feature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tolerances: absolute and relative, and those of releases by the beginning of a feature's name. Fixed values.
ABSOLUTE, RELATIVE = 1e-3, 1e-3
RELEASE = {"ccsm_": (1e-2, 2e-2), "neis_": (1e-3, 1e-1), "neis_spectral_peak_mode": (2.0, 0.0)}


def release(spark: SparkSession) -> DataFrame:
    """feature, absolute and relative of the features that a release treats on their own, with their prefixes."""
    from stainloom.operators.nucleus import CHROMATIN, PREFIXES, RADIAL

    names = [*RADIAL, *CHROMATIN, *[p + x for p in PREFIXES for x in CHROMATIN]]
    bare = lambda x: next((x[len(p) :] for p in PREFIXES if x.startswith(p)), x)
    rows = [(x, *RELEASE[max((k for k in RELEASE if bare(x).startswith(k)), key=len)]) for x in names]
    return spark.createDataFrame(rows, "feature string, absolute double, relative double")


def coverage(matched: DataFrame, reference: DataFrame, group: str) -> DataFrame:
    """Rows of the reference and matched ones of each group, and the share of these; 0 where nothing is matched."""
    m = matched.groupBy(group).agg(F.count("*").alias("matched"))
    r = reference.groupBy(group).agg(F.count("*").alias("reference")).join(m, group, "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))
    return r.select(group, "reference", "matched", (F.col("matched") / F.col("reference")).alias("coverage"))


def difference(feature: str, a: str, b: str) -> Column:
    """Size of a - b; orientations are equal at a period of pi."""
    d = F.abs(F.col(a) - F.col(b))
    turn = d - math.pi * F.floor(d / math.pi)
    return F.when(F.col(feature) == "orientation", F.least(turn, math.pi - turn)).otherwise(d)


def details(values: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE, special: DataFrame | None = None) -> DataFrame:
    """feature, a, b with diff and whether it is within absolute + relative * max(|a|, |b|).

    ``special`` has feature, absolute and relative of the features that have tolerances of their own.
    """
    v = values.withColumns({"_a": F.lit(absolute), "_r": F.lit(relative)})
    if special is not None:
        s = F.broadcast(special.select("feature", F.col("absolute").alias("_sa"), F.col("relative").alias("_sr")))
        v = values.join(s, "feature", "left").withColumns({"_a": F.coalesce("_sa", F.lit(absolute)), "_r": F.coalesce("_sr", F.lit(relative))}).drop("_sa", "_sr")
    v = v.withColumn("diff", difference("feature", "a", "b"))
    return v.withColumn("within", F.col("diff") <= F.col("_a") + F.col("_r") * F.greatest(F.abs("a"), F.abs("b"))).drop("_a", "_r")


def summary(detail: DataFrame) -> DataFrame:
    """Count, mean and largest difference, share within tolerance and Pearson correlation (NaN where undefined)."""
    both = F.stddev_pop("a") * F.stddev_pop("b")
    # The quotient only where it is defined; corr() of a constant feature is an error in ANSI mode.
    r = F.when((F.count("*") < 2) | (both * F.count("*") <= 1e-15), float("nan")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop("a", "b") / both)))
    return detail.groupBy("feature").agg(F.count("*").alias("n"), F.avg("diff").alias("mae"), F.max("diff").alias("max_diff"), F.avg(F.col("within").cast("double")).alias("pass_rate"), r.alias("pearson"))


def common(values: DataFrame, row: str) -> DataFrame:
    """Features that every row has."""
    n = values.select(F.count_distinct(row).alias("_n"))
    have = values.groupBy("feature").agg(F.count_distinct(row).alias("n_rows"))
    return have.join(F.broadcast(n), F.col("n_rows") == F.col("_n")).drop("_n")
