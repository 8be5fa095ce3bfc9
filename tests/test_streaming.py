import numpy as np
from pyspark.sql import functions as F

from stainloom import functions
from stainloom.operators import features, regions
from stainloom.streaming import TILES, stream_features


def tile(name, n=3):
    r = np.random.RandomState(n)
    labels = np.zeros((40, 40), np.uint32)
    for i in range(n):
        labels[12 * i : 12 * i + 8, 5:14] = i + 1
    return name, 40, 40, bytearray(r.randint(0, 255, (40, 40, 3)).astype(np.uint8).tobytes()), bytearray(labels.astype("<u4").tobytes())


def test_new_tiles_are_done_once(spark, tmp_path):
    src, sink, seen = (str(tmp_path / x) for x in ("in", "out", "seen"))
    for names in (["a", "b"], ["c"], []):
        if names:
            spark.createDataFrame([tile(x) for x in names], TILES).coalesce(1).write.mode("append").parquet(src)
        stream_features(spark, src, sink, seen, families=["morphology", "intensity"]).awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted((r["image"], r["nucleus_id"]) for r in got.collect()) == [(x, i) for x in "abc" for i in (1, 2, 3)]
    assert got.columns == ["image", *features.columns(["morphology", "intensity"])] and got.filter("area <> 72").isEmpty()


def test_many_nuclei_in_one_tile(spark):
    """Patches meet pixels at their places: as many rows are joined as patches have pixels, not nuclei times pixels."""
    side = 112
    px = spark.range(side * side).select(F.lit(1).alias("tile"), F.floor(F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    label = F.when((F.col("row") % 5 < 3) & (F.col("col") % 5 < 3), F.floor(F.col("row") / 5) * 23 + F.floor(F.col("col") / 5) + 1).otherwise(0).cast("int")
    px = px.select("*", *[F.lit(i).alias(c) for i, c in enumerate("rgb")], label.alias("label")).withColumn("gray", functions.gray())
    cut = regions.patches(px, side)
    assert cut.select("label").distinct().count() == 23 * 23 and cut.filter("inside").groupBy("label").count().filter("count <> 9 and count <> 6 and count <> 4").isEmpty()
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "row" in plan[plan.index("Join") : plan.index("Join") + 200] and "<=" not in plan[plan.index("Join") : plan.index("Join") + 200]
    rows = features.patches(features.from_pixels(px, "tile", side, side), "tile")
    assert rows.count() == 23 * 23


def test_column_functions(spark):
    r = spark.sql("select 10 r, 20 g, 30 b, double('nan') x, 3.0000000001d y, 'A/b.c/d.TIF' p").select(
        functions.gray().alias("gray"), functions.finite("x").alias("x"), functions.label_of("y").alias("y"), functions.is_image("p").alias("i"), functions.bare("p").alias("b")
    ).first()
    assert tuple(r) == (18, 0.0, 3, True, "A/b.c/d")
