"""Parity of our feature tables with those of another program, as tables and a command line."""

from __future__ import annotations

import argparse
import fnmatch
import os
import random
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stainloom.operators import batch, hull, parity
from stainloom.sources.files import by_suffix, first_existing

# Fixed values of the interface: columns that hold an id or a centroid, and templates of file names, in their order.
ID_NAMES = ("instance_id", "nucleus_id", "id", "label")
ROW_NAMES, COL_NAMES = ("centroid_row", "centroid_y"), ("centroid_col", "centroid_x")
REFERENCE_NAMES = ("{stem}_features.csv", "{stem}.csv", "{stem}_feature.csv", "{stem}_nuclei_features.csv")


def read_features(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """image (the stem), row (from 0 in the file), feature, value of CSV files; cells that are no finite number are left out.

    Files may have different columns: each is read by its own header, and a row is unpivoted where it is read.
    """
    out = None
    for path in paths:
        df = spark.read.option("header", True).csv(path)
        names = [c for c in df.columns if c]
        at = F.struct(F.monotonically_increasing_id().alias("row"), F.array(*[F.struct(F.lit(c).alias("feature"), F.expr(f"try_cast(trim(`{c}`) as double)").alias("value")) for c in names]).alias("v"))
        rows = df.select(at.alias("x")).select(F.lit(re.sub(r"\.[^.]*$", "", os.path.basename(path))).alias("image"), "x.row", F.inline("x.v"))
        rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "image string, row long, feature string, value double")


def _wide(values: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """image, row and, by name, the first of several features that the row has."""
    pick = [F.coalesce(*[F.max(F.when(F.col("feature") == c, F.col("value"))) for c in of]).alias(k) for k, of in names.items()]
    return values.groupBy("image", "row").agg(*pick)


def matched(ours: DataFrame, theirs: DataFrame, how: str = "auto", most: float | None = None, id_column: str | None = None) -> DataFrame:
    """image, row, their_row: one-to-one by id, by nearest centroid within ``most``, or by order.

    ``auto`` takes, image by image, ids where every row of both sides has one, else centroids where
    every row has those, else the order.
    """
    names = {"id": (id_column,) if id_column else ID_NAMES, "r": ROW_NAMES, "c": COL_NAMES}
    a, b = _wide(ours, {**names, "id": ID_NAMES}), _wide(theirs, names)
    has = lambda df, p: df.groupBy("image").agg(F.every(F.col("id").isNotNull()).alias(f"{p}i"), F.every(F.col("r").isNotNull() & F.col("c").isNotNull()).alias(f"{p}c"))
    way = F.when(F.col("ai") & F.col("bi"), "id").when(F.col("ac") & F.col("bc"), "centroid").otherwise("order") if how == "auto" else F.lit(how)
    ways = has(a, "a").join(has(b, "b"), "image").select("image", way.alias("how"))
    a, b = a.join(F.broadcast(ways), "image"), b.join(F.broadcast(ways), "image")
    of = lambda df, k: df.filter(F.col("how") == k).drop("how")
    last = of(b, "id").withColumn("id", F.rint("id").cast("long")).groupBy("image", "id").agg(F.max("row").alias("their_row"))
    by_id = of(a, "id").withColumn("id", F.rint("id").cast("long")).join(last, ["image", "id"]).select("image", "row", "their_row")
    place = lambda df: of(df, "centroid").select("image", F.col("row").alias("id"), F.col("r").alias("row"), F.col("c").alias("col"))
    by_place = hull.match_by_centroid(place(a), place(b), "image", most).select("image", F.col("id").alias("row"), F.col("their_id").alias("their_row"))
    order = lambda df: of(df, "order").select("image", F.col("row").alias("id"))
    by_order = batch.match_by_order(order(a), order(b), "image", "id").select("image", F.col("id").alias("row"), F.col("theirs.id").alias("their_row"))
    return by_id.unionByName(by_place).unionByName(by_order)


def compared(ours: DataFrame, theirs: DataFrame, pairs: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """image, row, feature, a, b of the features that all matched rows of both sides have; patterns allow and deny features."""
    like = lambda of: F.col("feature").rlike("|".join(fnmatch.translate(x) for x in of))
    a = ours.withColumnRenamed("value", "a")
    b = theirs.select("image", F.col("row").alias("their_row"), "feature", F.col("value").alias("b"))
    v = pairs.join(a, ["image", "row"]).join(b, ["image", "their_row", "feature"]).filter(~F.col("feature").isin(*ID_NAMES))
    v = v.filter(like(allow)) if allow else v
    v = v.filter(~like(deny)) if deny else v
    n = pairs.groupBy().agg(F.count("*").alias("_n"))
    all_ = v.groupBy("feature").agg(F.count("*").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("feature")
    return v.join(F.broadcast(all_), "feature").select("image", "row", "their_row", "feature", "a", "b")


def _listed(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> list[str]:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(os.path.expanduser(root))
    return sorted(r["path"].removeprefix("file:") for r in found.select("path").collect())


def selected(names: list[str], selectors: Sequence[str] = (), offset: int = 0, most: int | None = None, shuffle: bool = False, seed: int = 42) -> list[str]:
    """Files by name, stem or pattern, in the order of the selectors; then shuffled, without the first ones, at most so many."""
    stem = lambda x: re.sub(r"\.[^.]*$", "", os.path.basename(x))
    if selectors:
        found = [x for s in selectors for x in names if x == os.path.expanduser(s) or any(fnmatch.fnmatch(y, s) for y in (x, os.path.basename(x), stem(x)))]
        names = list(dict.fromkeys(found))
    if shuffle:
        names = names[:]
        random.Random(seed).shuffle(names)
    return names[offset:][:most]


def main(argv: Sequence[str] | None = None) -> int:
    """Compares two folders of feature tables; 0 if there was something to compare and all of it is within tolerance."""
    p = argparse.ArgumentParser(description="Parity of feature tables.")
    p.add_argument("--ours-dir", required=True)
    p.add_argument("--reference-dir", required=True)
    p.add_argument("--reference-template", default=REFERENCE_NAMES[0])
    p.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--image", action="append", default=[], help="name, stem or pattern of tables; may be repeated")
    p.add_argument("--image-list-file")
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--max-images", type=int, default=5)
    p.add_argument("--shuffle", action="store_true")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--match", choices=("auto", "id", "centroid", "order"), default="auto")
    p.add_argument("--max-centroid-distance", type=float)
    p.add_argument("--id-column")
    p.add_argument("--abs-tol", type=float, default=parity.ABSOLUTE)
    p.add_argument("--rel-tol", type=float, default=parity.RELATIVE)
    p.add_argument("--tolerance-profile", choices=("strict", "release"), default="strict")
    p.add_argument("--features", default="")
    p.add_argument("--exclude-features", default="")
    for name in ("summary", "details", "feature-summary"):
        p.add_argument(f"--{name}-csv")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    chosen = list(a.image)
    if a.image_list_file:
        with open(os.path.expanduser(a.image_list_file), encoding="utf-8") as f:
            chosen += [x.strip() for x in f if x.strip()]
    mine = selected(_listed(spark, a.ours_dir, by_suffix([".csv"]), a.recursive), chosen, a.offset, a.max_images, a.shuffle, a.seed)
    there = _listed(spark, a.reference_dir, by_suffix([".csv"]), a.recursive)
    stems = [(re.sub(r"\.[^.]*$", "", os.path.basename(x)), x) for x in mine]
    if not stems:
        print("no tables to compare")
        return 1
    wanted = spark.createDataFrame(stems, "stem string, ours string")
    places = list(dict.fromkeys([os.path.expanduser(a.reference_dir), *map(os.path.dirname, there)]))
    found = first_existing(wanted, spark.createDataFrame([(x,) for x in there], "path string"), places, [a.reference_template, *REFERENCE_NAMES]).orderBy("ours").collect()
    for r in found:
        if r["path"] is None:
            print(f"WARN no reference for {r['stem']}")
    found = [r for r in found if r["path"] is not None]
    if not found:
        print("no reference tables")
        return 1
    ours = read_features(spark, [r["ours"] for r in found])
    theirs = None
    for r in found:
        t = read_features(spark, [r["path"]]).withColumn("image", F.lit(r["stem"]))
        theirs = t if theirs is None else theirs.unionByName(t)
    split = lambda x: [y.strip() for y in x.split(",") if y.strip()]
    pairs = matched(ours, theirs, a.match, a.max_centroid_distance, a.id_column).cache()
    details = parity.details(compared(ours, theirs, pairs, split(a.features), split(a.exclude_features)), a.abs_tol, a.rel_tol, parity.release(spark) if a.tolerance_profile == "release" else None).cache()
    by_feature, cover = parity.summary(details), parity.coverage(pairs, theirs.select("image", "row").distinct(), "image")
    by_image = details.groupBy("image").agg(F.count_distinct("feature").alias("features"), F.avg("diff").alias("mae"), F.max("diff").alias("max_diff"), F.avg(F.col("within").cast("double")).alias("pass_rate"))
    by_image = cover.join(by_image, "image", "left")
    for path, df in ((a.summary_csv, by_image), (a.details_csv, details), (a.feature_summary_csv, by_feature)):
        if path:
            df.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.expanduser(path))
    bad = by_feature.filter("pass_rate < 1").orderBy("feature").collect()
    n = details.count()
    for r in by_image.orderBy("image").collect():
        print(f"{r['image']}: matched {r['matched']} of {r['reference']}, pass rate {r['pass_rate']}")
    for r in bad:
        print(f"FAIL {r['feature']}: {r['pass_rate']:.4f} of {r['n']} within tolerance, largest difference {r['max_diff']:.6g}")
    return 0 if n and not bad else 1


if __name__ == "__main__":
    sys.exit(main())
