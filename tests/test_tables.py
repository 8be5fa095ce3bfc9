import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stainloom.operators import batch, hull, parity
from stainloom.plans import registry, tables  # noqa: F401

NAMES = [k for k, f in registry.QUERIES.items() if f.__module__.endswith("tables") and k in registry.SQL]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("supplier", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = registry.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    cur = con.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0000001, 2.1, -1.0, float("nan"), float("inf"), 2.0**32, None)], "v double")
    assert [r[0] for r in df.select(batch.label_of("v")).collect()] == [0, 2, None, None, None, None, None, None]


def test_orientation_wraps(spark):
    df = spark.createDataFrame([("orientation", 1.57, -1.57), ("area", 1.0, 1.5)], "feature string, a double, b double")
    assert [r["within"] for r in parity.details(df, 1e-2, 0.0).collect()] == [True, False]
    assert all(r["pearson"] != r["pearson"] for r in parity.summary(parity.details(df)).select("pearson").collect())
    assert batch.pending(spark.range(5).toDF("k"), spark.range(2).toDF("k"), "k", 2).select(F.sum("k")).first()[0] == 5


def test_hull_area():
    at = lambda cells: hull.hull_area(*np.array(cells).T)
    assert at([(2, 3)]) == 1
    assert at([(r, c) for r in range(4) for c in range(5)]) == 20
    # The middle of an L's open side lies on the hull's edge.
    assert at([(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]) == 6
    disk = [(r, c) for r in range(21) for c in range(21) if (r - 10) ** 2 + (c - 10) ** 2 <= 81]
    # Each of its eight half caps lets in two more: from (1.5, 6) to (0.5, 10) the edge has (1, 8) on it and (1, 9) inside.
    assert at(disk) == len(disk) + 16


def test_convex_and_centroids(spark):
    inside = ((0, 0), (1, 0), (2, 0), (2, 1), (2, 2))
    px = spark.createDataFrame([(0, int((r, c) in inside), r, c, 1, 2, 3) for r in range(3) for c in range(3)], "tile int, label int, row int, col int, r int, g int, b int")
    r = hull.convex(px, 3).first()
    assert (r["convex_area"], r["solidity"], r["convexity"]) == (6.0, 5 / 6, 6 / 5)
    a = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.0, 1.0), (1, 1, 0.0, 0.0)], "g int, id int, row double, col double")
    b = spark.createDataFrame([(0, 7, 0.0, 0.9), (0, 8, 0.0, 5.0)], "g int, id int, row double, col double")
    got = hull.match_by_centroid(a, b, "g").collect()
    assert [(x["g"], x["id"], x["their_id"]) for x in got] == [(0, 1, 7), (0, 2, 8)]
    assert hull.match_by_centroid(a, b, "g", 2.0).count() == 1
