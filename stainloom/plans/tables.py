"""Queries of batch bookkeeping and parity reports over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainloom.operators import batch, hull, morphology, parity, patch_kernels, regions, texture
from stainloom.plans.registry import _BOXES, query, rounded
from stainloom.plans.synth import SIDE, TILE_SQL, tiles
from stainloom.sources import files, mat


def _of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_IMAGES = "im AS (SELECT 'n' || c_nationkey || '/' || lower(c_mktsegment) || '/c' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.TIF' ELSE '.txt' END AS path FROM customer)"
_MATS = "mt AS (SELECT 'n' || c_nationkey || '/' || lower(c_mktsegment) || '/c' || c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0)"


def _stem():
    return F.concat(F.lit("n"), F.col("c_nationkey"), F.lit("/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey"))


def _images(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return _of(spark, sf_dir, "customer").select(F.concat(_stem(), F.when(k == 0, ".png").when(k == 1, ".TIF").otherwise(".txt")).alias("path"))


def _pairs(spark, sf_dir):
    mats = _of(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.concat(_stem(), F.lit(".mat")).alias("path"))
    return batch.pairs(_images(spark, sf_dir), mats)


_PAIR = f"WITH {_IMAGES}, {_MATS} SELECT path, k || '.mat' AS mat_path FROM (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS s FROM im WHERE path NOT LIKE '%.txt') LEFT JOIN mt ON k = s"


@query("pairing_inner", f"{_PAIR} WHERE k IS NOT NULL")
def pairing_inner(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("mat_path is not null")


@query("pairing_missing", f"{_PAIR} WHERE k IS NULL".replace(", k || '.mat' AS mat_path", ""))
def pairing_missing(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("mat_path is null").select("path")


@query("path_derivations", f"WITH {_IMAGES}, s AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS s FROM im) SELECT path, s || '.mat' AS mat_path, s || '.csv' AS csv_path, split_part(s, '/', 3) AS stem, split_part(s, '/', 1) AS first_dir, split_part(s, '/', 2) AS parent_dir FROM s")
def path_derivations(spark, sf_dir):
    return batch.paths(_images(spark, sf_dir))


@query("metadata_left_join", "SELECT s_suppkey, coalesce(n_name, '') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 12")
def metadata_left_join(spark, sf_dir):
    tasks = _of(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("id"))
    meta = _of(spark, sf_dir, "nation").filter("n_nationkey < 12").select(F.concat(F.lit(" "), "n_nationkey").alias("id"), F.concat("n_name", F.lit(" ")).alias("n_name"))
    return batch.with_metadata(tasks, meta, "id", ["n_name"]).drop("id")


@query("type_left_join", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN lower(c_mktsegment) END, 'Unknown') AS nucleus_type FROM customer")
def type_left_join(spark, sf_dir):
    c = _of(spark, sf_dir, "customer")
    return batch.with_types(c.select("c_custkey"), c.filter("c_custkey % 4 <> 0").select("c_custkey", F.lower("c_mktsegment").alias("nucleus_type")), ["c_custkey"])


@query("skip_existing_antijoin", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def skip_existing_antijoin(spark, sf_dir):
    c = _of(spark, sf_dir, "customer").select("c_custkey")
    return batch.pending(c, c.filter("c_custkey % 3 = 0"), "c_custkey")


_VALUES = "CASE WHEN s_suppkey % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN s_suppkey % 7 = 1 THEN CAST('inf' AS DOUBLE) WHEN s_suppkey % 7 < 4 THEN s_suppkey + 1e-8 ELSE s_acctbal END"


def _values(spark, sf_dir):
    k = F.col("s_suppkey") % 7
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k < 4, F.col("s_suppkey") + 1e-8).otherwise(F.col("s_acctbal"))
    return _of(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v"))


@query("coerce_labels", f"SELECT s_suppkey, CASE WHEN isfinite(v) THEN CASE WHEN abs(v-round(v)) <= 1e-6 AND v BETWEEN -0.5 AND 4294967295 THEN CAST(round(v) AS BIGINT) END END AS label FROM (SELECT s_suppkey, {_VALUES} AS v FROM supplier)")
def coerce_labels(spark, sf_dir):
    return _values(spark, sf_dir).select("s_suppkey", batch.label_of("v").alias("label"))


@query("csv_coerce", f"SELECT s_suppkey, CASE WHEN isfinite(v) THEN v ELSE 0.0 END AS v FROM (SELECT s_suppkey, {_VALUES} AS v FROM supplier)")
def csv_coerce(spark, sf_dir):
    return _values(spark, sf_dir).select("s_suppkey", batch.finite("v").alias("v"))


@query(
    "masked_crop_pixels",
    f"""WITH {TILE_SQL}, {_BOXES} SELECT b.tile, b.label, row-pr0 AS row, col-pc0 AS col, {", ".join(f"CASE WHEN p.label = b.label THEN {c} ELSE 0 END AS {c}" for c in "rgb")}
FROM pixels p JOIN box b ON p.tile = b.tile AND row BETWEEN pr0 AND pr1 AND col BETWEEN pc0 AND pc1""",
)
def masked_crop_pixels(spark, sf_dir):
    px = tiles(spark, sf_dir)
    return batch.crops(px, regions.boxes(px, SIDE))


@query("batch_totals", "SELECT count(*) FILTER (s_acctbal >= 0) AS ok, count(*) FILTER (s_acctbal < 0) AS failed, CAST(coalesce(sum(s_suppkey) FILTER (s_acctbal >= 0), 0) AS BIGINT) AS nuclei FROM supplier")
def batch_totals(spark, sf_dir):
    return batch.totals(_of(spark, sf_dir, "supplier").select((F.col("s_acctbal") >= 0).alias("ok"), F.col("s_suppkey").alias("nuclei")))


@query("match_by_id", "SELECT n_nationkey, max(s_suppkey) AS their_key, arg_max(s_acctbal, s_suppkey) AS theirs FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def match_by_id(spark, sf_dir):
    ours = _of(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("id"), "n_nationkey")
    theirs = _of(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 0.2).alias("id"), "s_suppkey", "s_acctbal")
    return batch.match_by_id(ours, theirs, "id", "s_suppkey").select("n_nationkey", F.col("theirs.s_suppkey").alias("their_key"), F.col("theirs.s_acctbal").alias("theirs"))


@query(
    "match_by_order",
    """WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier)
SELECT k, CAST(position AS INTEGER) AS position, c_custkey, s_suppkey FROM a JOIN b USING (k, position)""",
)
def match_by_order(spark, sf_dir):
    a = _of(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    b = _of(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return batch.match_by_order(a, b, "k", "id").select("k", "position", F.col("id").alias("c_custkey"), F.col("theirs.id").alias("s_suppkey"))


_FEATURES = """fe AS (SELECT c_custkey AS id, 'area' AS feature, c_acctbal AS a, c_acctbal + (c_custkey % 5) * 0.5 AS b FROM customer
  UNION ALL SELECT c_custkey, 'orientation', (c_custkey % 314) / 100.0e0, (c_custkey % 7) / 10.0e0 FROM customer WHERE c_custkey % 9 <> 0)"""
_DETAILS = f"""{_FEATURES}, df AS (SELECT *, CASE WHEN feature = 'orientation' THEN least(abs(a-b), pi()-abs(a-b)) ELSE abs(a-b) END AS diff FROM fe),
de AS (SELECT *, diff <= 1e-3 + 1e-3*greatest(abs(a), abs(b)) AS within FROM df)"""


def _features(spark, sf_dir):
    c = _of(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    area = c.select(k.alias("id"), F.lit("area").alias("feature"), F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + (k % 5) * 0.5).alias("b"))
    return area.unionByName(c.filter(k % 9 != 0).select(k.alias("id"), F.lit("orientation").alias("feature"), ((k % 314) / 100.0).alias("a"), ((k % 7) / 10.0).alias("b")))


@query("tolerance_details", f"WITH {_DETAILS} SELECT id, feature, round(diff, 6)+0.0 AS diff, within FROM de")
def tolerance_details(spark, sf_dir):
    return rounded(parity.details(_features(spark, sf_dir)).select("id", "feature", "diff", "within"))


@query("feature_summary_pearson", f"WITH {_DETAILS} SELECT feature, count(*) AS n, round(avg(diff),6)+0.0 AS mae, round(max(diff),6)+0.0 AS max_diff, round(avg(within::INTEGER),6)+0.0 AS pass_rate, round(corr(a,b),6)+0.0 AS pearson FROM de GROUP BY ALL")
def feature_summary_pearson(spark, sf_dir):
    return rounded(parity.summary(parity.details(_features(spark, sf_dir))))


@query("common_features", f"WITH {_FEATURES} SELECT feature, count(DISTINCT id) AS n_rows FROM fe GROUP BY ALL HAVING count(DISTINCT id) = (SELECT count(DISTINCT id) FROM fe)")
def common_features(spark, sf_dir):
    return parity.common(_features(spark, sf_dir), "id")


@query("convex_solidity")
def convex_solidity(spark, sf_dir):
    return rounded(hull.convex(tiles(spark, sf_dir), SIDE))


@query("match_by_centroid")
def match_by_centroid(spark, sf_dir):
    """Each tile's nuclei against those of labels above one, so that some are taken and some left."""
    c = morphology.centroids(tiles(spark, sf_dir)).select("tile", F.col("label").alias("id"), F.col("centroid_row").alias("row"), F.col("centroid_col").alias("col"))
    return rounded(hull.match_by_centroid(c, c.filter("id > 1"), "tile"))


_PATCH = f"""{TILE_SQL}, {_BOXES},
fg AS (SELECT tile, label, row, col FROM pixels WHERE label > 0),
bg AS (SELECT p.tile, b.label, p.row, p.col FROM pixels p JOIN box b ON p.tile = b.tile AND p.row BETWEEN pr0 AND pr1 AND p.col BETWEEN pc0 AND pc1 WHERE p.label <> b.label)"""


@query(
    "distance_to_boundary",
    f"""WITH {_PATCH}, d AS (SELECT f.tile, f.label, f.row, f.col, sqrt(min((f.row-b.row)*(f.row-b.row)+(f.col-b.col)*(f.col-b.col))) AS d
  FROM fg f JOIN bg b USING (tile, label) GROUP BY ALL)
SELECT tile, label, round(avg(d), 6)+0.0 AS mean_distance, round(max(d), 6)+0.0 AS max_distance FROM d GROUP BY ALL""",
)
def distance_to_boundary(spark, sf_dir):
    return rounded(patch_kernels.to_boundary(tiles(spark, sf_dir), SIDE))


@query(
    "opened_area",
    f"""WITH {_PATCH}, steps AS (SELECT * FROM (VALUES (0,0),(0,1),(1,0),(0,-1),(-1,0)) s(dr, dc)),
er AS (SELECT * FROM fg f WHERE NOT EXISTS (SELECT 1 FROM bg b WHERE b.tile = f.tile AND b.label = f.label AND abs(b.row-f.row)+abs(b.col-f.col) = 1)),
op AS (SELECT DISTINCT tile, label, row+dr AS row, col+dc AS col FROM er, steps)
SELECT f.tile, f.label, CAST(count(o.tile) AS DOUBLE) AS opened_area FROM fg f LEFT JOIN op o USING (tile, label, row, col) GROUP BY ALL""",
)
def opened_area(spark, sf_dir):
    return patch_kernels.cleaned(tiles(spark, sf_dir), SIDE).select("tile", "label", "opened_area")


@query("fourier_descriptors")
def fourier_descriptors(spark, sf_dir):
    return rounded(patch_kernels.fourier(tiles(spark, sf_dir), SIDE))


@query("outline_features")
def outline_features(spark, sf_dir):
    return rounded(patch_kernels.outlines(tiles(spark, sf_dir), SIDE))


@query("cleaned_objects")
def cleaned_objects(spark, sf_dir):
    """Pixels of objects that are not small, and objects, of each nucleus."""
    return patch_kernels.cleaned(tiles(spark, sf_dir), SIDE).select("tile", "label", "cleaned_area", "n_objects")


@query(
    "nn_point_api",
    "SELECT round(coalesce(min(sqrt((s_acctbal-100.0e0)*(s_acctbal-100.0e0) + (s_suppkey-7.0e0)*(s_suppkey-7.0e0))), 0), 6)+0.0 AS distance FROM supplier WHERE s_suppkey % 10 <> 0",
)
def nn_point_api(spark, sf_dir):
    """A place against points, some of which are not finite."""
    s = _of(spark, sf_dir, "supplier")
    row = F.when(F.col("s_suppkey") % 10 == 0, float("nan")).otherwise(F.col("s_acctbal"))
    return rounded(texture.nearest_to(s.select(row.alias("r"), F.col("s_suppkey").cast("double").alias("c")), "r", "c", (100.0, 7.0)))


_VARS = """va AS (SELECT 'n' || s_nationkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'mask' WHEN 1 THEN 'labels' ELSE 'x' || s_suppkey END AS name,
  [s_suppkey * 1.0, s_suppkey % 3, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 ELSE 1.0 END] AS v FROM supplier WHERE s_suppkey % 7 <> 0)"""


@query(
    "mat_key_choice",
    f"""WITH {_VARS}, ok AS (SELECT * FROM va WHERE list_min(v) >= 0 AND list_last(v) = 1.0),
rk AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE name WHEN 'labels' THEN 4 WHEN 'mask' THEN 6 ELSE 7 END, CASE WHEN name LIKE 'x%' THEN -len(list_distinct(v)) ELSE 0 END, name, v) AS k FROM ok)
SELECT path, name FROM rk WHERE k = 1""",
)
def mat_key_choice(spark, sf_dir):
    """Which variable of a file is its label map."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "mask").when(k % 4 == 1, "labels").otherwise(F.concat(F.lit("x"), k))
    values = F.array(k.cast("double"), (k % 3).cast("double"), F.col("s_nationkey").cast("double"), F.when(k % 5 == 0, 0.5).otherwise(1.0))
    s = _of(spark, sf_dir, "supplier").filter(k % 7 != 0)
    v = s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("path"), name.alias("name"), F.lit(2).alias("rows"), F.lit(2).alias("cols"), values.alias("values"))
    return mat.label_maps(v).select("path", "name")


@query(
    "file_lookup",
    """WITH ex AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a/' ELSE 'b/' END || 'c' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_seg' ELSE '' END || '.mat' AS path FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT 'b/c' || c_custkey || '.mat' FROM customer WHERE c_custkey % 4 = 0),
ca AS (SELECT 'c' || c_custkey AS stem, d.i * 2 + t.i AS way, d.x || 'c' || c_custkey || t.x AS path FROM customer, (VALUES (0, 'a/'), (1, 'b/')) d(i, x), (VALUES (0, '.mat'), (1, '_seg.mat')) t(i, x))
SELECT s.stem, f.path FROM (SELECT DISTINCT stem FROM ca) s LEFT JOIN (SELECT stem, arg_min(path, way) AS path FROM ca WHERE path IN (SELECT path FROM ex) GROUP BY 1) f USING (stem)""",
)
def file_lookup(spark, sf_dir):
    """The first of two folders by two names that has a file."""
    c, k = _of(spark, sf_dir, "customer"), F.col("c_custkey")
    one = c.filter(k % 5 != 0).select(F.concat(F.when(k % 2 == 0, "a/").otherwise("b/"), F.lit("c"), k, F.when(k % 3 == 0, "_seg").otherwise(""), F.lit(".mat")).alias("path"))
    two = c.filter(k % 4 == 0).select(F.concat(F.lit("b/c"), k, F.lit(".mat")).alias("path"))
    return files.first_existing(c.select(F.concat(F.lit("c"), k).alias("stem")), one.unionByName(two), ["a", "b"], ["{stem}.mat", "{stem}_seg.mat"])


@query(
    "match_coverage",
    """SELECT n_nationkey, count(s_suppkey) AS reference, count(s_suppkey) FILTER (s_suppkey % 3 <> 0) AS matched, round(count(s_suppkey) FILTER (s_suppkey % 3 <> 0) / count(s_suppkey), 6)+0.0 AS coverage
FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL""",
)
def match_coverage(spark, sf_dir):
    s = _of(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return rounded(parity.coverage(s.filter("s_suppkey % 3 <> 0"), s, "n_nationkey"))


@query("metadata_last_wins", "SELECT c_custkey, coalesce(CAST(m AS VARCHAR), '') AS key FROM customer LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS m FROM supplier WHERE s_nationkey < 15 GROUP BY 1) ON c_nationkey = s_nationkey")
def metadata_last_wins(spark, sf_dir):
    """Of metadata rows with one key the last counts."""
    meta = _of(spark, sf_dir, "supplier").filter("s_nationkey < 15").coalesce(1).sortWithinPartitions("s_suppkey")
    meta = meta.select(F.col("s_nationkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("key"))
    tasks = _of(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("id"))
    return batch.with_metadata(tasks, meta, "id", ["key"]).drop("id")
