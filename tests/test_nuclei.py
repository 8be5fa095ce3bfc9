import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stainloom.operators import intensity, morphology, regions, texture


def pixels(spark, rows, side=16):
    """Pixels of one tile: rows are (row, col, label, gray)."""
    at = {(r, c): (k, g) for r, c, k, g in rows}
    full = [(0, r, c, 0, 0, 0, *at.get((r, c), (0, 0))) for r in range(side) for c in range(side)]
    return spark.createDataFrame(full, "tile int, row int, col int, r int, g int, b int, label int, gray int").repartition(4)


def square(r0, r1, c0, c1, label=1, gray=9):
    return [(r, c, label, gray) for r in range(r0, r1) for c in range(c0, c1)]


def test_square(spark):
    p = pixels(spark, square(5, 8, 5, 8))
    c = morphology.centroids(p).first()
    assert (c["area"], c["centroid_row"], c["centroid_col"]) == (9.0, 6.0, 6.0)
    assert morphology.perimeters(p).first()["perimeter"] == 8.0
    assert morphology.euler_numbers(p).first()["euler_number"] == 1.0
    b = regions.boxes(p, 16).first()
    assert (b["r0"], b["c1"], b["pr0"], b["pr1"]) == (5, 7, 0, 15)


def test_perimeter_of_one_pixel_is_zero(spark):
    assert morphology.perimeters(pixels(spark, square(2, 3, 2, 3), 5)).first()["perimeter"] == 0.0


def test_hole_lowers_euler_number(spark):
    ring = [x for x in square(4, 7, 4, 7) if x[:2] != (5, 5)]
    assert morphology.euler_numbers(pixels(spark, ring)).first()["euler_number"] == 0.0


@pytest.mark.parametrize("levels, expected", [([0, 255, 100, 150], (126.25, 125.0, 255.0)), ([128] * 4, (128.0, 128.0, 0.0))])
def test_intensity(spark, levels, expected):
    p = pixels(spark, [(i // 2, i % 2, 1, g) for i, g in enumerate(levels)], 2)
    r = intensity.statistics(p, ["label"]).first()
    assert (r["mean_intensity"], r["median_intensity"], r["range_intensity"]) == expected
    assert not any(math.isnan(x) for x in r[1:])


def test_entropy_of_one_level_is_negative(spark):
    d = 256 / 255
    got = intensity.entropy(pixels(spark, square(0, 2, 0, 2), 2), ["label"]).first()["entropy_intensity"]
    assert got == pytest.approx(-d * math.log2(d))


def test_glcm_golden(spark):
    rows = [(r, c, 1, 50 * (r + c + 1)) for r in range(3) for c in range(3)]
    r = texture.glcm(regions.patches(pixels(spark, rows, 3), 3)).first()
    assert r["glcm_ASM"] == pytest.approx(0.21006944444444445, abs=1e-12)
    assert r["glcm_energy"] == pytest.approx(0.4476852825219859, abs=1e-12)


def test_glcm_of_one_level_is_zero(spark):
    r = texture.glcm(regions.patches(pixels(spark, square(1, 4, 1, 4), 6), 6)).first()
    assert list(r)[2:] == [0.0] * 6


def test_nearest_against_all_pairs(spark):
    r = np.random.RandomState(4)
    rows = [(0, 1, 10.0, 13.0), (0, 2, 10.0, 10.0), (0, 3, 13.0, 14.0), (0, 4, 200.0, 3.0), (1, 1, 5.0, 5.0)]
    rows += [(2, i, float(y), float(x)) for i, (y, x) in enumerate(np.r_[r.rand(60, 2) * 40, np.c_[np.full(20, 7.0), r.rand(20) * 900], [[7.0, 5.0], [7.0, 5.0]]])]
    df = spark.createDataFrame(rows, "g int, i int, y double, x double")
    got = {(x["g"], x["i"]): x[2] for x in texture.nearest(df, "g", "i", "y", "x").collect()}
    assert got[0, 1] == 3.0 and got[1, 1] == 0.0 and len(got) == len(rows)
    for g, i, y, x in rows:
        far = [np.hypot(y - v, x - w) for h, j, v, w in rows if h == g and j != i]
        assert abs(got[g, i] - min(far, default=0.0)) < 1e-9


def test_nearest_to_a_place(spark):
    df = spark.createDataFrame([(10.0, 10.0), (13.0, 14.0), (2.0, 3.0), (float("nan"), 1.0), (float("inf"), 0.0), (None, 1.0)], "y double, x double")
    one = lambda at, of=df: texture.nearest_to(of, "y", "x", at).first()[0]
    assert one((10, 13)) == 3.0 and one((float("nan"), 0)) == 0.0 and one((1, 1), df.limit(0)) == 0.0


def test_hog_of_blank_patch_is_zero(spark):
    r = texture.hog(regions.patches(pixels(spark, square(0, 16, 0, 16, gray=0)), 16)).first()
    assert list(r)[2:] == [0.0] * 4


def test_queries_match_sql(spark):
    import os

    import duckdb

    from stainloom.plans import registry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{d}/supplier.parquet'")
    for name in ("intensity_stats", "perimeter_lut", "euler_bitquads", "shape_ratios", "glcm_props", "nn_distance"):
        df = registry.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        cur = con.execute(registry.SQL[name])
        at = [[x[0] for x in cur.description].index(c) for c in cols]
        assert sorted(tuple(r[i] for i in at) for r in cur.fetchall()) == sorted(tuple(r[c] for c in cols) for r in df.collect()), name


#: Queries that join pixels, or did.
PIXELS = ["glcm_props", "hog_summary", "hu_true", "hu_pipeline", "glcm_0deg", "lbp_stats", "masked_crop_pixels"]


@pytest.mark.parametrize("name", PIXELS)
def test_pixels_are_not_broadcast(spark, name):
    """Tiles are made from keys, so their table is far smaller than their pixels; the driver never holds those."""
    from stainloom.plans import registry, tables  # noqa: F401

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    assert "Broadcast" not in registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_patches_across_strips(spark):
    """Boxes that begin and end anywhere in a row of several strips get each of their pixels once."""
    side, boxes = 150, {1: (60, 70), 2: (0, 3), 3: (120, 139), 4: (63, 64)}
    rows = [(r, c, k, c) for k, (a, b) in boxes.items() for r in (2 * k, 2 * k + 1) for c in range(a, b)]
    got = regions.patches(pixels(spark, rows, side), side, 5, values=()).select("label", "row", "col", "inside", "v").collect()
    at = {(r, c): (k, v) for r, c, k, v in rows}
    want = set()
    for k, (a, b) in boxes.items():
        for r in range(max(2 * k - 5, 0), 2 * k + 7):
            for c in range(max(a - 5, 0), min(b + 5, side)):
                own = at.get((r, c), (0, 0))
                want.add((k, r, c, own[0] == k, own[1] if own[0] == k else 0))
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_hog_cells(spark):
    """Only whole cells count, and a patch of none has zeros."""
    p = pixels(spark, square(0, 1, 0, 1) + square(6, 8, 6, 8, 2), 16)
    got = {r["label"]: r for r in texture.hog(regions.patches(p, 16, 0, values=())).collect()}
    assert list(got[1])[2:] == [0.0] * 4 and list(got[2])[2:] == [0.0] * 4
    got = texture.hog(regions.patches(p, 16, 7, values=())).orderBy("label").collect()
    assert [r["label"] for r in got] == [1, 2] and all(r["hog_max"] > 0 for r in got)


def test_hu_of_mask_away_from_the_corner(spark):
    """The moments are pixels of the patch; they vanish where the patch does not begin in the nucleus."""
    got = morphology.hu_of_mask(pixels(spark, square(0, 4, 0, 4) + square(11, 16, 0, 5, 2) + square(5, 9, 8, 12, 3)), 16)
    rows = {r["label"]: list(r)[2:] for r in got.collect()}
    want = [float(x) for x in morphology.hu_from(dict.fromkeys(("20", "02", "11", "30", "03", "12", "21"), 1.0))]
    assert rows == {1: want, 2: [0.0] * 7, 3: [0.0] * 7}
