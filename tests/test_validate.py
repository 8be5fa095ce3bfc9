import csv

import pytest

from stainloom import validate
from stainloom.operators import parity


def table(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)


def nuclei(step=0.0, ident="nucleus_id"):
    return [{ident: i, "centroid_row": 10.0 * i, "centroid_col": 5.0, "area": 100.0 + i + step, "orientation": 1.5 if step else -1.6415926, "note": "x", "empty": "", "bad": "nan"} for i in range(1, 5)]


@pytest.fixture
def folder(tmp_path):
    table(tmp_path / "ours/a.csv", nuclei())
    table(tmp_path / "ref/a_features.csv", nuclei(0.01, "instance_id")[:3])
    table(tmp_path / "ours/sub/b.csv", nuclei())
    table(tmp_path / "ref/b.csv", [{k: v for k, v in r.items() if k != "nucleus_id"} for r in nuclei()[::-1]])
    table(tmp_path / "ours/lonely.csv", nuclei())
    return tmp_path


def test_command_line(spark, folder, capsys):
    args = ["--ours-dir", str(folder / "ours"), "--reference-dir", str(folder / "ref")]
    out = ["--summary-csv", str(folder / "s"), "--details-csv", str(folder / "d"), "--feature-summary-csv", str(folder / "f")]
    assert validate.main([*args, *out]) == 0
    said = capsys.readouterr().out
    assert "WARN no reference for lonely" in said and "a: matched 3 of 3" in said and "b: matched 4 of 4" in said
    s = {r["feature"]: r for r in spark.read.option("header", True).csv(str(folder / "f")).collect()}
    assert set(s) == {"centroid_row", "centroid_col", "area", "orientation"} and float(s["area"]["max_diff"]) == pytest.approx(0.01)
    assert validate.main([*args, "--abs-tol", "0.0001", "--rel-tol", "0"]) == 1 and "FAIL area" in capsys.readouterr().out
    assert validate.main([*args, "--abs-tol", "0.0001", "--rel-tol", "0", "--exclude-features", "area,orient*"]) == 0
    assert validate.main([*args, "--image", "none*"]) == 1 and validate.main([*args, "--image", "lonely"]) == 1


def test_matching(spark, folder):
    mine, other = validate.read_features(spark, [str(folder / "ours/sub/b.csv")]), validate.read_features(spark, [str(folder / "ref/b.csv")])
    assert mine.filter("feature in ('note', 'empty', 'bad')").isEmpty()
    got = {(r["row"], r["their_row"]) for r in validate.matched(mine, other).collect()}
    assert got == {(0, 3), (1, 2), (2, 1), (3, 0)}
    assert {(r["row"], r["their_row"]) for r in validate.matched(mine, other, "order").collect()} == {(i, i) for i in range(4)}
    assert validate.matched(mine, mine, "id").count() == 4 and validate.matched(mine, other, "centroid", 0.0).count() == 4


def test_selection():
    names = ["/x/a.csv", "/x/b.csv", "/y/ab.csv"]
    assert validate.selected(names, ["b", "a*"]) == ["/x/b.csv", "/x/a.csv", "/y/ab.csv"]
    assert validate.selected(names, offset=1, most=1) == ["/x/b.csv"] and validate.selected(names, ["/y/*"]) == ["/y/ab.csv"]
    assert sorted(validate.selected(names, shuffle=True)) == sorted(names) and validate.selected(names, shuffle=True) == validate.selected(names, shuffle=True)


def test_release_tolerances(spark):
    t = {r["feature"]: (r["absolute"], r["relative"]) for r in parity.release(spark).collect()}
    assert t["neis_spectral_peak_mode"] == (2.0, 0.0) and t["neis_spectral_energy"] == (1e-3, 1e-1) and t["pre_norm_ccsm_energy"] == (1e-2, 2e-2) and "area" not in t
