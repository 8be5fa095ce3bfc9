"""Whole rows of features, crops, folders of images and the command line."""

import csv
import struct
import zlib

import numpy as np
import pytest

from stainloom import extract
from stainloom.operators import features as feats
from stainloom.operators import nucleus
from stainloom.sources import files, mat, png


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_file(labels, types=None, name=b"inst_map"):
    """A MAT file of a label map and, if given, texts of types."""
    head = element(6, struct.pack("<II", 12, 0)) + element(5, struct.pack("<ii", *labels.shape)) + element(1, name)
    parts = element(14, head + element(5, labels.astype("<i4").tobytes(order="F")))
    if types is not None:
        text = lambda s: element(14, element(6, struct.pack("<II", 4, 0)) + element(5, struct.pack("<ii", 1, len(s))) + element(1, b"") + element(4, s.encode("utf-16-le")))
        parts += element(14, element(6, struct.pack("<II", 1, 0)) + element(5, struct.pack("<ii", len(types), 1)) + element(1, b"inst_type") + b"".join(map(text, types)))
    z = zlib.compress(parts[: len(parts)])
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x100) + b"IM" + (parts if types is not None else struct.pack("<II", 15, len(z)) + z)


def flat_tile():
    rgb = np.full((16, 16, 3), (40, 90, 140), np.uint8)
    labels = np.zeros((16, 16), np.uint32)
    labels[2:6, 2:6], labels[9:13, 9:13] = 1, 2
    return rgb, labels


def textured():
    y, x = np.mgrid[:96, :96]
    rgb = np.stack([(3 * x + 5 * y) % 256, (7 * x + 11 * y + 37) % 256, (13 * x + 17 * y + 71) % 256], -1).astype(np.uint8)
    labels = np.zeros((96, 96), np.uint32)
    labels[(y - 8) ** 2 + (x - 8) ** 2 <= 144], labels[(y - 70) ** 2 + (x - 70) ** 2 <= 121] = 1, 2
    return rgb, labels


def test_whole_rows():
    rgb, labels = textured()
    rows = extract.extract_features(rgb, labels)
    assert [r["nucleus_id"] for r in rows] == [1, 2] and all(list(r) == feats.columns() and len(r) == 130 for r in rows)
    assert all(np.isfinite(list(r.values())).all() and r[nucleus.NEAREST] > 0 for r in rows)
    assert all(r["pre_norm_" + k] == r["post_norm_" + k] for r in rows for of in nucleus.OF_PIXELS.values() for k in of)
    other = extract.extract_features(rgb, labels, normalize=True)
    assert other[0]["post_norm_mean_intensity"] != rows[0]["post_norm_mean_intensity"] and other[0]["pre_norm_glcm_ASM"] == rows[0]["pre_norm_glcm_ASM"]
    # The list of masks has the same rows, and masks may overlap.
    listed = extract.extract_features(rgb, [labels == 1, labels == 2])
    assert all(abs(a[k] - b[k]) < 1e-9 for a, b in zip(rows, listed, strict=True) for k in a)
    assert len(extract.extract_features(rgb, [labels > 0, labels == 2])) == 2
    some = extract.extract_features(rgb, labels, families=["morphology", "pairs"])
    assert list(some[0]) == feats.columns(["morphology", "pairs"]) and some[1]["area"] == rows[1]["area"]


def test_errors():
    rgb, labels = flat_tile()
    for bad, error in (
        ((rgb[:, :, :2], labels), ValueError), ((rgb[:8], labels), ValueError), ((rgb, labels.astype(float)), TypeError), ((rgb, labels > 0), TypeError),
        ((rgb, [labels]), TypeError), ((rgb, [labels > 5]), RuntimeError), ((rgb, labels, True), RuntimeError),
    ):
        with pytest.raises(error):
            extract.extract_features(*bad)
    with pytest.raises(ValueError):
        extract.extract_features(rgb, labels, save_crops=True)
    assert extract.extract_features(rgb, labels * 0) == [] and not extract.check_gpu() and extract.get_gpu_device_count() == 0


def test_crops(tmp_path):
    y, x = np.mgrid[:6, :6]
    rgb = np.stack([10 * y + x, 7 * y + 2 * x, 200 - (5 * y + x)], -1).astype(np.uint8)
    labels = np.zeros((6, 6), np.uint32)
    labels[4, 4:], labels[0, :2], labels[1, 0] = 2, 1, 1
    (tmp_path / "a.png").write_bytes(png.encode(rgb))
    (tmp_path / "a.mat").write_bytes(mat_file(labels))
    got = extract.save_cropped_nuclei_from_files(tmp_path / "a.png", tmp_path / "a.mat", tmp_path / "out", padding=1, save_post_normalized=False)
    assert [(r["nucleus_id"], r["bbox"], r["post_path"]) for r in got] == [(1, (0, 0, 1, 1), None), (2, (4, 4, 4, 5), None)]
    first = png.decode((tmp_path / "out/pre_normalized_nuclei/nucleus_0001.png").read_bytes())
    assert first.shape == (3, 3, 3) and (first[labels[:3, :3] != 1] == 0).all() and (first[labels[:3, :3] == 1] == rgb[:3, :3][labels[:3, :3] == 1]).all()
    rows = extract.extract_features_from_files(tmp_path / "a.png", tmp_path / "a.mat", save_crops=True, crop_output_dir=tmp_path / "two")
    assert len(rows) == 2 and len(list((tmp_path / "two").rglob("*.png"))) == 4


@pytest.fixture
def folder(tmp_path):
    rgb, labels = flat_tile()
    (tmp_path / "im/PATIENT_A").mkdir(parents=True)
    (tmp_path / "mat/PATIENT_A").mkdir(parents=True)
    for name, types in (("tile_a", ["Tumor", "Stroma"]), ("PATIENT_A/tile_b", None)):
        (tmp_path / f"im/{name}.png").write_bytes(png.encode(rgb))
        (tmp_path / f"mat/{name}.mat").write_bytes(mat_file(labels, types))
    (tmp_path / "im/alone.PNG").write_bytes(png.encode(rgb))
    (tmp_path / "im/broken.png").write_bytes(b"no image")
    (tmp_path / "mat/broken.mat").write_bytes(mat_file(labels))
    (tmp_path / "meta.csv").write_text("﻿Tissue Sample ID,Tissue,Sex\n PATIENT_A ,Liver,M\n,x,y\nPATIENT_A, Brain ,F\n", encoding="utf-8")
    return tmp_path


def test_folders(spark, folder):
    args = [folder / x for x in ("im", "mat", "csv", "nuclei")]
    r = extract.batch_extract_and_crop(*args, spark=spark, stain_normalization_features=False, metadata_csv=folder / "meta.csv", metadata_cols=("Tissue", "Sex"))
    assert (r.tasks_discovered, r.completed_images, r.failed_images, r.total_nuclei) == (3, 2, 1, 4)
    assert "Missing MAT pair for alone.PNG" in r.warnings and any("Unknown nucleus_type" in w and "tile_b" in w for w in r.warnings)
    assert any("No metadata match for tile_a.png using key 'tile_a'" in w for w in r.warnings)
    assert [x.error for x in r.results if not x.ok][0].startswith("cannot read") and {x.mat_key for x in r.results if x.ok} == {"inst_map"}
    with open(folder / "csv/PATIENT_A/tile_b.csv", newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == ["nucleus_id", "Tissue", "Sex", "nucleus_type", *feats.columns()[1:]] and len(rows) == 2
    assert [(x["nucleus_id"], x["Tissue"], x["Sex"], x["nucleus_type"], x["area"]) for x in rows] == [("1", "Brain", "F", "Unknown", "16.0"), ("2", "Brain", "F", "Unknown", "16.0")]
    with open(folder / "csv/tile_a.csv", newline="") as f:
        assert [(x["nucleus_type"], x["Tissue"]) for x in csv.DictReader(f)] == [("Tumor", ""), ("Stroma", "")]
    assert len(list((folder / "nuclei/tile_a").rglob("nucleus_000?.png"))) == 4 and not list(folder.rglob(".*.png.*"))
    again = extract.BatchExtractor(*args, spark=spark, skip_existing=True, stain_normalization_features=False)
    assert [t["rel"] for t in again.tasks()[0].collect()] == ["broken.png"]
    few = extract.batch_extract_features(*args[:2], folder / "csv2", folder / "n2", spark=spark, max_images=1, recursive=False, stain_normalization_features=False, image_exts=(".png",))
    assert few.tasks_discovered == 1 and not (folder / "n2").exists()


def test_command_line(spark, folder, capsys):
    args = ["--image-root", str(folder / "im"), "--mat-root", str(folder / "mat"), "--output-csv-root", str(folder / "c"), "--output-nuclei-root", str(folder / "n"), "--no-save-crops", "--no-stain-normalization-features"]
    assert extract.main(args) == 1 and "Completed images: 2" in capsys.readouterr().out
    (folder / "im/broken.png").unlink()
    assert extract.main([*args, "--metadata-csv", str(folder / "none.csv")]) == 1 and "Failed to prepare" in capsys.readouterr().out
    assert extract.main(args) == 0
    assert extract.main([*args, "--image-exts", " .tif , "]) == 1


def test_image_formats(spark, tmp_path):
    """What the JVM writes in other formats comes back as RGB rows; a broken file is a row without pixels."""
    jvm = spark._jvm
    rgb = textured()[0][:8, :9]
    buffered = jvm.java.awt.image.BufferedImage(9, 8, 1)
    for r in range(8):
        for c in range(9):
            buffered.setRGB(c, r, int(rgb[r, c, 0]) << 16 | int(rgb[r, c, 1]) << 8 | int(rgb[r, c, 2]))
    for kind in ("bmp", "tiff", "jpg"):
        jvm.javax.imageio.ImageIO.write(buffered, kind, jvm.java.io.File(str(tmp_path / f"x.{kind}")))
    (tmp_path / "y.BMP").write_bytes(b"broken")
    (tmp_path / "z.txt").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"x.bmp", "x.tiff", "x.jpg", "y.BMP"} and got["y.BMP"]["rgb"] is None
    for name in ("x.bmp", "x.tiff"):
        assert (got[name]["height"], got[name]["width"], bytes(got[name]["rgb"])) == (8, 9, rgb.tobytes())


def test_metadata(spark, folder):
    m = files.read_metadata(spark, str(folder / "meta.csv"), "Tissue Sample ID", ["Tissue", "Sex"])
    assert [tuple(r) for r in m.collect()] == [("PATIENT_A", "Brain", "F")]
    with pytest.raises(ValueError):
        files.read_metadata(spark, str(folder / "meta.csv"), "Tissue Sample ID", ["Age"])


def test_map_choice():
    v = lambda name, x: (name, *np.array(x).shape, np.array(x, float).flatten(order="F"), None)
    assert mat.choose([v("x", [[1, 1]]), v("y", [[1, 2]]), v("neg", [[-1, 5, 6]])])[0] == "y"
    assert mat.choose([v("mask", [[1]]), v("labels", [[0, 1]])])[0] == "labels"
    assert mat.choose([v("mask", [[1, 2], [3, 4]])], "mask")[1].tolist() == [[1, 2], [3, 4]]
    for bad in ([], [v("x", [[0.5]])]):
        with pytest.raises(ValueError):
            mat.choose(bad)


def test_spark_rows_like_local_ones(spark):
    """The distributed form on several tiles, one of them broken, against the local one; and spread patches."""
    tiles = [("flat", *flat_tile()), ("textured", *textured())]
    rows = [(n, *lab.shape, bytearray(rgb.tobytes()), bytearray(lab.astype("<u4").tobytes())) for n, rgb, lab in tiles] + [("short", 4, 4, bytearray(b"abc"), bytearray(b""))]
    df = spark.createDataFrame(rows, "image string, height int, width int, rgb binary, labels binary")
    want = {(n, r["nucleus_id"]): r for n, rgb, lab in tiles for r in extract.extract_features(rgb, lab, normalize=True)}
    for spread in (None, 4):
        got = {(r["image"], r["nucleus_id"]): r.asDict() for r in feats.full_features(df, "image", feats.Normaliser(), spread=spread).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][c] - want[k][c]) < 1e-6 for k in want for c in feats.columns())
    assert feats.patches(df, "image").filter("error is not null").count() == 1
    assert "pre_norm_mean_intensity" in feats.full_features(df, "image", families=["intensity"]).columns
