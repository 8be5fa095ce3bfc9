"""Queries by name, each with its twin in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stainloom.operators import features, intensity, morphology, regions, texture
from stainloom.plans.synth import SIDE, TILE_SQL, tiles

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df, *cols, digits: int = 6):
    """Doubles to so many places, so that the last bits of different summation orders do not count."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols or [n for n, t in df.dtypes if t == "double"]})


@query(
    "intensity_stats",
    f"""WITH {TILE_SQL}, m AS (
  SELECT tile, label, count(*) AS n, avg(gray) AS mu, median(gray) AS med, min(gray) AS mn, max(gray) AS mx,
    quantile_cont(gray, 0.75) - quantile_cont(gray, 0.25) AS iqr FROM pixels WHERE label > 0 GROUP BY ALL),
c AS (SELECT p.tile, p.label, avg(power(gray-mu,2)) AS m2, avg(power(gray-mu,3)) AS m3, avg(power(gray-mu,4)) AS m4
  FROM pixels p JOIN m USING (tile, label) GROUP BY ALL)
SELECT tile, label, round(mu,6)+0.0 AS mean_intensity, round(CAST(med AS DOUBLE),6)+0.0 AS median_intensity, round(sqrt(m2),6)+0.0 AS std_intensity,
  CAST(mn AS DOUBLE) AS min_intensity, CAST(mx AS DOUBLE) AS max_intensity, CAST(mx-mn AS DOUBLE) AS range_intensity, round(iqr,6)+0.0 AS iqr_intensity,
  CASE WHEN m2 <= 1e-8 THEN 0.0 ELSE round(m3/power(m2,1.5),6)+0.0 END AS skewness_intensity,
  CASE WHEN m2 <= 1e-8 THEN 0.0 ELSE round(m4/(m2*m2)-3,6)+0.0 END AS kurtosis_intensity
FROM m JOIN c USING (tile, label)""",
)
def intensity_stats(spark, sf_dir):
    return rounded(intensity.statistics(tiles(spark, sf_dir).filter("label > 0"), ["tile", "label"]))


def nuclei(spark, sf_dir):
    """Pixels in labels."""
    return tiles(spark, sf_dir).filter("label > 0")


@query("tile_gray_hist", f"WITH {TILE_SQL} SELECT tile, gray, count(*) AS n FROM pixels GROUP BY ALL")
def tile_gray_hist(spark, sf_dir):
    return tiles(spark, sf_dir).groupBy("tile", "gray").agg(F.count("*").alias("n"))


_BOXES = f"""box AS (SELECT *, greatest(r0-10,0) AS pr0, greatest(c0-10,0) AS pc0, least(r1+10,{SIDE - 1}) AS pr1, least(c1+10,{SIDE - 1}) AS pc1 FROM (
  SELECT tile, label, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1, count(*) AS area FROM pixels WHERE label > 0 GROUP BY ALL))"""


@query("region_bbox_padded", f"WITH {TILE_SQL}, {_BOXES} SELECT * FROM box")
def region_bbox_padded(spark, sf_dir):
    return regions.boxes(tiles(spark, sf_dir), SIDE)


@query("area_centroid", f"WITH {TILE_SQL} SELECT tile, label, CAST(count(*) AS DOUBLE) AS area, round(avg(row),6)+0.0 AS centroid_row, round(avg(col),6)+0.0 AS centroid_col FROM pixels WHERE label > 0 GROUP BY ALL")
def area_centroid(spark, sf_dir):
    return rounded(morphology.centroids(tiles(spark, sf_dir)))


_AXES = """ms AS (SELECT tile, label, count(*) AS n, sum(row) AS sr, sum(col) AS sc, sum(row*row) AS srr, sum(col*col) AS scc, sum(row*col) AS src FROM pixels WHERE label > 0 GROUP BY ALL),
mo AS (SELECT tile, label, CAST(srr*n - sr*sr AS DOUBLE)/(n*n) AS vr, CAST(scc*n - sc*sc AS DOUBLE)/(n*n) AS vc, CAST(src*n - sr*sc AS DOUBLE)/(n*n) AS vrc FROM ms),
ei AS (SELECT *, (vr+vc)/2 + sqrt((vc-vr)*(vc-vr)/4 + vrc*vrc) AS l1, greatest((vr+vc)/2 - sqrt((vc-vr)*(vc-vr)/4 + vrc*vrc), 0) AS l2 FROM mo)"""


@query(
    "axes_ecc_orient",
    f"""WITH {TILE_SQL}, {_AXES} SELECT tile, label, round(4*sqrt(l1),6)+0.0 AS major_axis_length, round(4*sqrt(l2),6)+0.0 AS minor_axis_length,
  CASE WHEN l1 <= 1e-12 THEN 0.0 ELSE round(sqrt(greatest(0, 1-l2/l1)),5)+0.0 END AS eccentricity,
  round(CASE WHEN abs(vc-vr) < 1e-12 THEN CASE WHEN vrc > 0 THEN pi()/4 ELSE -pi()/4 END ELSE 0.5*atan2(2*vrc, vr-vc) END, 6)+0.0 AS orientation FROM ei""",
)
def axes_ecc_orient(spark, sf_dir):
    return rounded(morphology.axes(tiles(spark, sf_dir)).withColumn("eccentricity", F.round("eccentricity", 5)))


_PERIMETER = """bo AS (SELECT p.* FROM pixels p WHERE label > 0 AND (tile, row, col) NOT IN (
  SELECT (a.tile, a.row, a.col) FROM pixels a JOIN pixels b ON a.tile = b.tile AND a.label = b.label AND a.row = b.row AND a.col = b.col + 1
    JOIN pixels c ON a.tile = c.tile AND a.label = c.label AND a.row = c.row AND a.col = c.col - 1
    JOIN pixels d ON a.tile = d.tile AND a.label = d.label AND a.col = d.col AND a.row = d.row + 1
    JOIN pixels e ON a.tile = e.tile AND a.label = e.label AND a.col = e.col AND a.row = e.row - 1 WHERE a.label > 0)),
cd AS (SELECT a.tile, a.label, a.row, a.col, 1 + coalesce(sum(CASE WHEN b.row = a.row OR b.col = a.col THEN 2 ELSE 10 END), 0) AS code
  FROM bo a LEFT JOIN bo b ON a.tile = b.tile AND a.label = b.label AND abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY ALL),
pe AS (SELECT tile, label, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1.0 WHEN code IN (21,33) THEN sqrt(2.0) WHEN code IN (13,23) THEN (1+sqrt(2.0))/2 ELSE 0.0 END) AS perimeter FROM cd GROUP BY ALL)"""


@query("perimeter_lut", f"WITH {TILE_SQL}, {_PERIMETER} SELECT tile, label, round(perimeter,6)+0.0 AS perimeter FROM pe")
def perimeter_lut(spark, sf_dir):
    return rounded(morphology.perimeters(tiles(spark, sf_dir)))


@query(
    "euler_bitquads",
    f"""WITH {TILE_SQL}, q AS (SELECT tile, label, row + d // 2 AS qr, col + d % 2 AS qc, sum(1 << d) AS bits, count(*) AS n FROM pixels, range(4) k(d) WHERE label > 0 GROUP BY ALL)
SELECT tile, label, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN bits IN (6, 9) THEN -2 ELSE 0 END) / 4.0 AS euler_number FROM q GROUP BY ALL""",
)
def euler_bitquads(spark, sf_dir):
    return morphology.euler_numbers(tiles(spark, sf_dir))


@query(
    "shape_ratios",
    f"""WITH {TILE_SQL}, {_BOXES}, {_AXES}, {_PERIMETER} SELECT tile, label, round(sqrt(4*area/pi()),6)+0.0 AS equivalent_diameter, round(area/((r1-r0+1)*(c1-c0+1)),6)+0.0 AS extent,
  CASE WHEN perimeter = 0 THEN 0.0 ELSE round(4*pi()*area/(perimeter*perimeter),6)+0.0 END AS circularity, CASE WHEN l2 <= 1e-12 THEN 0.0 ELSE round(sqrt(l1)/sqrt(l2),5)+0.0 END AS aspect_ratio,
  CASE WHEN area > 1 AND perimeter > 0 THEN round(ln(perimeter)/ln(area),6)+0.0 ELSE 0.0 END AS fractal_dimension, round(perimeter*perimeter/area,6)+0.0 AS roughness
FROM box JOIN ei USING (tile, label) JOIN pe USING (tile, label)""",
)
def shape_ratios(spark, sf_dir):
    return rounded(morphology.ratios(tiles(spark, sf_dir), SIDE).withColumn("aspect_ratio", F.round("aspect_ratio", 5)))


def _hu_sql(n: dict[str, str]) -> list[str]:
    x, y, u, v = f"({n['30']}+{n['12']})", f"({n['21']}+{n['03']})", f"({n['30']}-3*{n['12']})", f"(3*{n['21']}-{n['03']})"
    px, py, d = f"({x}*({x}*{x}-3*{y}*{y}))", f"({y}*(3*{x}*{x}-{y}*{y}))", f"({n['20']}-{n['02']})"
    return [f"{n['20']}+{n['02']}", f"{d}*{d}+4*{n['11']}*{n['11']}", f"{u}*{u}+{v}*{v}", f"{x}*{x}+{y}*{y}", f"{u}*{px}+{v}*{py}", f"{d}*({x}*{x}-{y}*{y})+4*{n['11']}*{x}*{y}", f"{v}*{px}-{u}*{py}"]


_HU = ("20", "02", "11", "30", "03", "12", "21")


@query(
    "hu_pipeline",
    f"""WITH {TILE_SQL}, {_BOXES}, m AS (SELECT tile, label, any_value(area) AS area, any_value(pr1-pr0 >= 3 AND pc1-pc0 >= 3) AS large, {", ".join(f"CAST(max(CASE WHEN row-pr0 = {k[0]} AND col-pc0 = {k[1]} THEN 1 ELSE 0 END) AS DOUBLE) AS m{k}" for k in ("00", *_HU))}
  FROM pixels JOIN box USING (tile, label) GROUP BY ALL)
SELECT tile, label, {", ".join(f"CASE WHEN large AND m00 = 1 AND area > 10 THEN {h} ELSE 0.0 END AS hu_moment_{i}" for i, h in enumerate(_hu_sql({k: f"m{k}" for k in _HU}), 1))} FROM m""",
)
def hu_pipeline(spark, sf_dir):
    return morphology.hu_of_mask(tiles(spark, sf_dir), SIDE)


@query(
    "hu_true",
    f"""WITH {TILE_SQL}, c AS (SELECT tile, label, avg(row) AS cr, avg(col) AS cc FROM pixels WHERE label > 0 GROUP BY ALL),
m AS (SELECT tile, label, {", ".join(f"sum(power(col-cc,{k[0]})*power(row-cr,{k[1]}))/power(count(*),{(int(k[0]) + int(k[1])) / 2 + 1}) AS m{k}" for k in _HU)} FROM pixels JOIN c USING (tile, label) GROUP BY ALL)
SELECT tile, label, {", ".join(f"round({h},8)+0.0 AS true_hu_{i}" for i, h in enumerate(_hu_sql({k: f"m{k}" for k in _HU}), 1))} FROM m""",
)
def hu_true(spark, sf_dir):
    return rounded(morphology.hu_moments(tiles(spark, sf_dir)), digits=8)


@query(
    "intensity_entropy",
    f"""WITH {TILE_SQL}, c AS (SELECT tile, label, gray, count(*) AS n FROM pixels WHERE label > 0 GROUP BY ALL),
d AS (SELECT tile, label, n / ((sum(n) OVER (PARTITION BY tile, label)) * 255.0 / 256) AS d FROM c)
SELECT tile, label, round(-sum(d*log2(d)),6)+0.0 AS entropy_intensity FROM d GROUP BY ALL""",
)
def intensity_entropy(spark, sf_dir):
    return rounded(intensity.entropy(nuclei(spark, sf_dir), ["tile", "label"]))


_PATCH = f"""{_BOXES}, pa AS (SELECT p.tile, b.label, p.row, p.col, p.label = b.label AS inside, CASE WHEN p.label = b.label THEN gray ELSE 0 END AS v, pr0, pc0, pr1, pc1
  FROM pixels p JOIN box b ON p.tile = b.tile AND p.row BETWEEN pr0 AND pr1 AND p.col BETWEEN pc0 AND pc1)"""


def _glcm_sql(offsets) -> str:
    return f"""{_PATCH}, o(a, dr, dc) AS (VALUES {", ".join(map(str, offsets))}),
pr AS (SELECT x.tile, x.label, a, x.v AS i, y.v AS j, count(*) AS n FROM pa x, o JOIN pa y ON y.tile = x.tile AND y.label = x.label AND y.row = x.row + dr AND y.col = x.col + dc GROUP BY ALL),
sy AS (SELECT tile, label, a, i, j, sum(n) AS n FROM (SELECT * FROM pr UNION ALL SELECT tile, label, a, j, i, n FROM pr) GROUP BY ALL),
su AS (SELECT tile, label, a, CAST(sum(n) AS DOUBLE) AS t, sum(n*(i-j)*(i-j)) AS con, sum(n*abs(i-j)) AS dis, CAST(sum(CAST(CAST(n AS DOUBLE)/(1+(i-j)*(i-j)) AS DECIMAL(20,12))) AS DOUBLE) AS hom,
  sum(n*n) AS sq, sum(n*i) AS si, sum(n*i*i) AS sii, sum(n*i*j) AS sij FROM sy GROUP BY ALL),
mu AS (SELECT tile, label, a, CAST(con AS DOUBLE)/t AS con, CAST(dis AS DOUBLE)/t AS dis, hom/t AS hom, CAST(sq AS DOUBLE)/(t*t) AS asm, (CAST(sii AS DOUBLE)*t - CAST(si AS DOUBLE)*si)/(t*t) AS va, (CAST(sij AS DOUBLE)*t - CAST(si AS DOUBLE)*si)/(t*t) AS cv FROM su),
lv AS (SELECT tile, label, count(DISTINCT v) AS k FROM pa WHERE v > 0 GROUP BY ALL)"""


@query(
    "glcm_props",
    f"""WITH {TILE_SQL}, {_glcm_sql([(0, 0, 1), (45, 1, 1), (90, 1, 0), (135, 1, -1)])}
SELECT tile, label, {", ".join(f"CASE WHEN any_value(k) >= 2 THEN round(({' + '.join(f'max(CASE WHEN a = {a} THEN {e} END)' for a in (0, 45, 90, 135))})/4, 9)+0.0 ELSE 0.0 END AS glcm_{n}" for n, e in (("contrast", "con"), ("dissimilarity", "dis"), ("homogeneity", "hom"), ("ASM", "asm"), ("energy", "sqrt(asm)"), ("correlation", "CASE WHEN va*va <= 1e-16 THEN 0 ELSE cv/va END")))}
FROM mu LEFT JOIN lv USING (tile, label) GROUP BY ALL""",
)
def glcm_props(spark, sf_dir):
    return rounded(texture.glcm(regions.patches(tiles(spark, sf_dir), SIDE, values=())), digits=9)


@query(
    "glcm_0deg",
    f"""WITH {TILE_SQL}, {_glcm_sql([(0, 0, 1)])} SELECT tile, label, CASE WHEN k >= 2 THEN round(con,9)+0.0 ELSE 0.0 END AS contrast,
  CASE WHEN k >= 2 AND va > 1e-12 THEN round(cv/va,9)+0.0 ELSE 0.0 END AS correlation, CASE WHEN k >= 2 THEN round(sqrt(asm),9)+0.0 ELSE 0.0 END AS energy, CASE WHEN k >= 2 THEN round(hom,9)+0.0 ELSE 0.0 END AS homogeneity
FROM mu LEFT JOIN lv USING (tile, label)""",
)
def glcm_0deg(spark, sf_dir):
    g = texture.glcm(regions.patches(tiles(spark, sf_dir), SIDE, values=()), angles=(0,), guard=1e-24)
    return rounded(g.select("tile", "label", *[F.col(f"glcm_{c}").alias(c) for c in ("contrast", "correlation", "energy", "homogeneity")]), digits=9)


@query(
    "nn_distance",
    f"""WITH {TILE_SQL}, c AS (SELECT tile, label, avg(row) AS y, avg(col) AS x FROM pixels WHERE label > 0 GROUP BY ALL)
SELECT a.tile, a.label, coalesce(round(min(sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))),6)+0.0, 0.0) AS distance_to_nearest_neighbor FROM c a LEFT JOIN c b ON a.tile = b.tile AND a.label <> b.label GROUP BY ALL""",
)
def nn_distance(spark, sf_dir):
    c = morphology.centroids(tiles(spark, sf_dir))
    return rounded(texture.nearest(c, "tile", "label", "centroid_row", "centroid_col"))


def _moments(c: str, name: str) -> str:
    over = lambda k: f"round(CASE WHEN sqrt(max(m2{c})) <= 1e-12 THEN 0 ELSE avg(power({c}-m{c}, {k}))/power(max(m2{c}), {k / 2}) - {k - 3}*3 END, 4)+0.0"
    return f"""round(avg({c}),4)+0.0 AS {name}_mean, round(stddev_pop({c}),4)+0.0 AS {name}_std, {over(3)} AS {name}_skewness, {over(4)} AS {name}_kurtosis, round(min({c}),4)+0.0 AS {name}_min, round(max({c}),4)+0.0 AS {name}_max"""


@query(
    "he_color_stats",
    f"""WITH {TILE_SQL}, o AS (SELECT tile, label, {", ".join(f"CAST(CAST(ln(greatest(CAST({c}/255.0 AS FLOAT), CAST(1e-6 AS FLOAT))) AS FLOAT) / CAST(ln(CAST(1e-6 AS FLOAT)) AS FLOAT) AS DOUBLE) AS o{c}" for c in "rgb")} FROM pixels WHERE label > 0),
s AS (SELECT tile, label, greatest(CAST(CAST(0.65 AS FLOAT) AS DOUBLE)*orr+CAST(CAST(0.70 AS FLOAT) AS DOUBLE)*og+CAST(CAST(0.29 AS FLOAT) AS DOUBLE)*ob, 0) AS h, greatest(CAST(CAST(0.07 AS FLOAT) AS DOUBLE)*orr+CAST(CAST(0.99 AS FLOAT) AS DOUBLE)*og+CAST(CAST(0.11 AS FLOAT) AS DOUBLE)*ob, 0) AS e FROM (SELECT tile, label, "or" AS orr, og, ob FROM o)),
c AS (SELECT *, avg(h) OVER (PARTITION BY tile, label) AS mh, avg(e) OVER (PARTITION BY tile, label) AS me FROM s),
w AS (SELECT *, avg((h-mh)*(h-mh)) OVER (PARTITION BY tile, label) AS m2h, avg((e-me)*(e-me)) OVER (PARTITION BY tile, label) AS m2e FROM c)
SELECT tile, label, {_moments("h", "h")}, {_moments("e", "e")}, CASE WHEN avg(e) = 0 THEN 0.0 ELSE round(avg(h)/avg(e),4)+0.0 END AS he_ratio FROM w GROUP BY ALL""",
)
def he_color_stats(spark, sf_dir):
    return rounded(texture.stains(tiles(spark, sf_dir)), digits=4)


_K = 0.70711


def _corner(diag: str, vert: str, side: str) -> str:
    return f"({1 - _K!r}*({1 - _K!r}*v + {_K}*{side}) + {_K}*({1 - _K!r}*{vert} + {_K}*{diag}))"


_POINTS = ["e", _corner("ne", "n", "e"), "n", _corner("nw", "n", "w"), "w", _corner("sw", "s", "w"), "s", _corner("se", "s", "e")]
_NEAR = {"e": (0, 1), "w": (0, -1), "n": (-1, 0), "s": (1, 0), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}


@query(
    "lbp_stats",
    f"""WITH {TILE_SQL}, {_PATCH},
nb AS (SELECT x.tile, x.label, x.row, x.col, CAST(x.v AS DOUBLE) AS v, {", ".join(f"CAST(coalesce(max(CASE WHEN y.row-x.row = {dr} AND y.col-x.col = {dc} THEN y.v END), 0) AS DOUBLE) AS {k}" for k, (dr, dc) in _NEAR.items())}
  FROM pa x JOIN pa y ON y.tile = x.tile AND y.label = x.label AND abs(y.row-x.row) <= 1 AND abs(y.col-x.col) <= 1 WHERE x.inside GROUP BY x.tile, x.label, x.row, x.col, x.v),
bi AS (SELECT tile, label, v, {", ".join(f"CAST(round({p}, 9) >= v AS INTEGER) AS b{i}" for i, p in enumerate(_POINTS))} FROM nb),
co AS (SELECT tile, label, v, CASE WHEN {" + ".join(f"abs(b{i}-b{i + 1})" for i in range(7))} <= 2 THEN {" + ".join(f"b{i}" for i in range(8))} ELSE 9 END AS code FROM bi),
ct AS (SELECT tile, label, code, count(*) AS n, max(v) AS top FROM co GROUP BY ALL),
fr AS (SELECT *, n / sum(n) OVER (PARTITION BY tile, label) AS f FROM ct)
SELECT tile, label, CASE WHEN max(top) > 0 THEN round(sum(f*code),6)+0.0 ELSE 0.0 END AS lbp_mean, CASE WHEN max(top) > 0 THEN round(sqrt(greatest(sum(f*code*code)-sum(f*code)*sum(f*code), 0)),6)+0.0 ELSE 0.0 END AS lbp_std,
  CASE WHEN max(top) > 0 THEN round(-sum(f*log2(f)),6)+0.0 ELSE 0.0 END AS lbp_entropy FROM fr GROUP BY ALL""",
)
def lbp_stats(spark, sf_dir):
    return rounded(texture.lbp(regions.patches(tiles(spark, sf_dir), SIDE, values=())))


@query(
    "hog_summary",
    f"""WITH {TILE_SQL}, {_PATCH},
gr AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY tile, label, row ORDER BY col) - lag(v) OVER (PARTITION BY tile, label, row ORDER BY col), 0) AS gx,
  coalesce(lead(v) OVER (PARTITION BY tile, label, col ORDER BY row) - lag(v) OVER (PARTITION BY tile, label, col ORDER BY row), 0) AS gy FROM pa),
an AS (SELECT *, degrees(atan2(gy, gx)) AS d, sqrt(gx*gx + gy*gy) AS mag FROM gr),
bn AS (SELECT tile, label, (row-pr0)//8 AS cr, (col-pc0)//8 AS cc, floor(round(CASE WHEN d < 0 THEN CASE WHEN d+180 >= 180 THEN d ELSE d+180 END WHEN d >= 180 THEN d-180 ELSE d END, 9)/22.5) AS b, mag FROM an
  WHERE (row-pr0)//8 < (pr1-pr0+1)//8 AND (col-pc0)//8 < (pc1-pc0+1)//8),
hi AS (SELECT tile, label, cr, cc, k, sum(CASE WHEN b = k THEN mag ELSE 0 END)/64 AS h FROM bn, range(8) r(k) GROUP BY ALL),
h1 AS (SELECT *, least(h/sqrt(sum(h*h) OVER (PARTITION BY tile, label, cr, cc) + 1e-10), 0.2) AS g FROM hi),
h2 AS (SELECT *, g/sqrt(sum(g*g) OVER (PARTITION BY tile, label, cr, cc) + 1e-10) AS x FROM h1)
SELECT b.tile, b.label, {", ".join(f"coalesce(round({f}(x),6)+0.0, 0.0) AS hog_{n}" for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min")))} FROM box b LEFT JOIN h2 USING (tile, label) GROUP BY ALL""",
)
def hog_summary(spark, sf_dir):
    return rounded(texture.hog(regions.patches(tiles(spark, sf_dir), SIDE, values=())))


def tile_rows(spark, sf_dir):
    """Synthetic tiles as rows of bytes."""
    return features.from_pixels(tiles(spark, sf_dir), "tile", SIDE, SIDE)


@query("full_features_130")
def full_features_130(spark, sf_dir):
    """The whole row of every nucleus, before and after stain normalisation."""
    return rounded(features.full_features(tile_rows(spark, sf_dir), "tile", features.Normaliser()))


@query("chromatin_features")
def chromatin_features(spark, sf_dir):
    return rounded(features.full_features(tile_rows(spark, sf_dir), "tile", families=["chromatin"]))


@query("stain_normalised")
def stain_normalised(spark, sf_dir):
    """Mean red, green and blue of each nucleus's patch before and after normalisation of its tile."""
    cut = features.patches(tile_rows(spark, sf_dir), "tile", features.Normaliser())
    mean = lambda of, k: F.expr(f"aggregate(sequence({k}, length({of}) - 1, 3), 0L, (s, i) -> s + conv(hex(substring({of}, i + 1, 1)), 16, 10)) / (length({of}) / 3)")
    return rounded(cut.select("tile", "nucleus_id", *[mean(of, k).alias(f"{of}_{c}") for of in ("pre", "post") for k, c in enumerate("rgb")]))


_FROM_MASK = ["area", "perimeter", "equivalent_diameter", "extent", "euler_number", "centroid_row", "centroid_col", "circularity", "fractal_dimension", "roughness"]


@query(
    "mask_features",
    f"""WITH {TILE_SQL}, {_BOXES}, {_PERIMETER}, q AS (SELECT tile, label, row + d // 2 AS qr, col + d % 2 AS qc, sum(1 << d) AS bits, count(*) AS n FROM pixels, range(4) k(d) WHERE label > 0 GROUP BY ALL),
eu AS (SELECT tile, label, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN bits IN (6, 9) THEN -2 ELSE 0 END) / 4.0 AS euler_number FROM q GROUP BY ALL),
ce AS (SELECT tile, label, avg(row) AS cr, avg(col) AS cc FROM pixels WHERE label > 0 GROUP BY ALL)
SELECT tile, CAST(label AS BIGINT) AS nucleus_id, CAST(area AS DOUBLE) AS area, round(perimeter,6)+0.0 AS perimeter, round(sqrt(4*area/pi()),6)+0.0 AS equivalent_diameter, round(area/((r1-r0+1)*(c1-c0+1)),6)+0.0 AS extent, euler_number,
  round(cr,6)+0.0 AS centroid_row, round(cc,6)+0.0 AS centroid_col, CASE WHEN perimeter = 0 THEN 0.0 ELSE round(4*pi()*area/(perimeter*perimeter),6)+0.0 END AS circularity,
  CASE WHEN area > 1 AND perimeter > 0 THEN round(ln(perimeter)/ln(area),6)+0.0 ELSE 0.0 END AS fractal_dimension, round(perimeter*perimeter/area,6)+0.0 AS roughness
FROM box JOIN eu USING (tile, label) JOIN ce USING (tile, label) JOIN pe USING (tile, label)""",
)
def mask_features(spark, sf_dir):
    """Columns of the whole row that come from the mask alone, by the kernels."""
    return rounded(features.full_features(tile_rows(spark, sf_dir), "tile", families=["morphology", "shape"]).select("tile", "nucleus_id", *_FROM_MASK))
