import math
import struct
import zlib

import numpy as np
import pytest

from stainloom.operators import patch_kernels as k
from stainloom.sources import files, mat, png


def element(kind, data, order="<"):
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, rows, cols, values, order="<", kind=12):
    body = element(6, struct.pack(order + "II", kind, 0), order) + element(5, struct.pack(order + "ii", rows, cols), order)
    return element(14, body + element(1, name.encode(), order) + element(5, struct.pack(f"{order}{len(values)}i", *values), order), order)


def text(s, name=b""):
    return element(14, element(6, struct.pack("<II", 4, 0)) + element(5, struct.pack("<ii", 1, len(s))) + element(1, name) + element(4, struct.pack(f"<{len(s)}H", *map(ord, s))))


def cells(name, texts):
    return element(14, element(6, struct.pack("<II", 1, 0)) + element(5, struct.pack("<ii", len(texts), 1)) + element(1, name) + b"".join(map(text, texts)))


def file(*parts, order="<"):
    return b"MATLAB 5.0".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI") + b"".join(parts)


def test_mat_forms():
    for order in "<>":
        name, rows, cols, values, _ = mat.parse(file(matrix("inst_map", 2, 2, [1, 2, 3, 4], order), order=order))[0]
        assert (name, rows, cols, values.tolist()) == ("inst_map", 2, 2, [1.0, 2.0, 3.0, 4.0])
    z = zlib.compress(matrix("m", 1, 3, [5, 6, 7]))
    packed = file(struct.pack("<II", 15, len(z)) + z, matrix("n", 1, 1, [8]))
    assert [(x[0], x[3].tolist()) for x in mat.parse(packed)] == [("m", [5.0, 6.0, 7.0]), ("n", [8.0])]
    for bad in (b"", b"x" * 200, file(matrix("m", 2, 2, [1, 2])), file(matrix("m", 2, 2, [1, 2, 3, 4])[:-8])):
        with pytest.raises(ValueError):
            mat.parse(bad)


def test_mat_source(spark, tmp_path):
    (tmp_path / "a.mat").write_bytes(file(matrix("foo", 2, 2, [9, 8, 7, 6]), matrix("inst_map", 2, 2, [1, 0, 3, 4]), cells(b"inst_type", ["Tumor", "Stroma"])))
    (tmp_path / "b.MAT").write_bytes(file(matrix("x", 1, 2, [1, 1]), matrix("y", 1, 2, [1, 2]), matrix("neg", 1, 3, [-1, 2, 3])))
    (tmp_path / "c.mat").write_bytes(b"no")
    v = mat.read_mat(spark, str(tmp_path)).cache()
    assert v.filter("error is not null").count() == 1
    maps = mat.label_maps(v)
    assert {r["path"][-5:]: r["name"] for r in maps.collect()} == {"a.mat": "inst_map", "b.MAT": "y"}
    px = mat.label_pixels(maps.filter("name = 'inst_map'"))
    assert sorted((r["row"], r["col"], r["label"]) for r in px.collect()) == [(0, 0, 1), (0, 1, 3), (1, 1, 4)]
    assert mat.label_maps(v, "foo").first()["labels"] == [9, 8, 7, 6]
    assert [(r["pos"], r["nucleus_type"]) for r in mat.instance_types(v).orderBy("pos").collect()] == [(1, "Tumor"), (2, "Stroma")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.PNG", "a.tiff", "c.txt", "in/d.jpg"):
        (tmp_path / n).write_bytes(b"12")
    assert [r["rel_path"] for r in files.scan_images(spark, str(tmp_path)).collect()] == ["a.tiff", "b.PNG", "in/d.jpg"]
    have = spark.createDataFrame([("/y/a.mat",), ("/x/a_map.mat",), ("/y/b.mat",)], "path string")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    got = files.first_existing(want, have, ["/x", "/y"], ["{stem}.mat", "{stem}_map.mat"])
    assert {r["stem"]: r["path"] for r in got.collect()} == {"a": "/x/a_map.mat", "b": "/y/b.mat", "c": None}


def square(n, r0, r1, c0, c1):
    m = np.zeros((n, n), bool)
    m[r0:r1, c0:c1] = True
    return m


def test_distances():
    assert k.distances(square(7, 3, 4, 3, 4))[3, 3] == 1.0
    rng = np.random.default_rng(3)
    for _ in range(20):
        m = rng.random((9, 7)) < 0.8
        m[4, 2] = False
        out = np.argwhere(~m)
        want = [[min(math.hypot(r - a, c - b) for a, b in out) for c in range(7)] for r in range(9)]
        assert np.allclose(k.distances(m), want)
    assert not k.distances(np.ones((3, 3), bool)).any()


def test_opening_and_objects():
    m = square(12, 4, 8, 4, 8)
    m[0, 10] = True
    assert k.opened(m).sum() == 12 and not k.opened(m)[0, 10]
    assert k.without_small(m).sum() == 16
    m[8, 8] = True
    assert len(k.objects(m)) == 2 and len(k.objects(m, k.CROSS)) == 3


def test_border_and_descriptors():
    b = k.border(np.argwhere(square(6, 1, 4, 1, 4)))
    assert b.tolist() == [[1, 1], [2, 1], [3, 1], [3, 2], [3, 3], [2, 3], [1, 3], [1, 2]]
    assert k.border(np.array([[2, 2]])).tolist() == [[2, 2]]
    assert k.border(np.array([[0, 0], [0, 1], [0, 2]])).tolist() == [[0, 0], [0, 1], [0, 2], [0, 1]]
    assert not k.descriptors(square(6, 1, 4, 1, 4)).any()
    m = square(20, 5, 15, 5, 15)
    z = np.array([x + 1j * y for y, x in k.border(np.argwhere(m))][1:])
    n = np.arange(len(z))
    want = [abs((z * np.exp(-2j * np.pi * q * n / len(z))).sum()) / abs(z.sum()) for q in range(1, 6)]
    assert np.allclose(k.descriptors(m), want)
    # Of two objects the larger counts; an empty mask has none.
    m[0, 0:3] = True
    assert np.allclose(k.descriptors(m), want)
    assert not k.descriptors(np.zeros((4, 4), bool)).any()


def test_outline():
    got = k.outline(square(5, 2, 3, 2, 3))
    assert got[0].tolist() == got[-1].tolist()
    assert {tuple(p) for p in got.tolist()} == {(1.5, 2.0), (2.0, 1.5), (2.0, 2.5), (2.5, 2.0)} and len(got) == 5
    # Two pixels that meet at a corner have an outline each; the first counts.
    two = square(6, 1, 2, 1, 2) | square(6, 2, 3, 2, 3)
    assert len(k.outline(two)) == 5 and k.outline(two)[:, 0].max() == 1.5
    # At the patch's edge the outline is open.
    edge = k.outline(square(4, 0, 2, 0, 2))
    assert len(edge) == 4 and edge[0].tolist() != edge[-1].tolist()
    assert len(k.outline(np.ones((3, 3), bool))) == len(k.outline(np.zeros((3, 3), bool))) == 0
    assert len(k.outline(np.ones((1, 1), bool))) == 0


def test_bending_and_ripples():
    assert k.bending(square(5, 2, 3, 2, 3)) == 0.0
    disk = np.hypot(*np.mgrid[-15:16, -15:16]) <= 10
    assert k.bending(disk) > 0
    assert k.ripples(np.zeros((4, 4), bool)) == (0.0, 0.0, 0.0)
    r = k.ripples(square(32, 8, 24, 8, 24))
    assert all(map(math.isfinite, r)) and r[2] == 4.0
    # A square is less round than a disk.
    assert k.ripples(disk)[1] < r[1]


def test_png(spark, tmp_path):
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (7, 9, 3), dtype=np.uint8)
    assert (png.decode(png.encode(px)) == px).all()

    def form(colour, lines, w, extra=b""):
        part = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
        return png.MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, len(lines), 8, colour, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")

    # Every filter, made from the pixels by its definition.
    lines, flat = [], px.reshape(7, 27).astype(int)
    for r, kind in enumerate((0, 1, 2, 3, 4, 4, 3)):
        up = flat[r - 1] if r else np.zeros(27, int)
        a, c = np.r_[0, 0, 0, flat[r][:-3]], np.r_[0, 0, 0, up[:-3]]
        p = a + up - c
        near = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
        lines.append(bytes([kind]) + ((flat[r] - [0 * a, a, up, (a + up) // 2, near][kind]) % 256).astype(np.uint8).tobytes())
    assert (png.decode(form(2, lines, 9)) == px).all()
    assert png.decode(form(4, [b"\0\x05\xff\x09\x00"], 2)).tolist() == [[[5] * 3, [9] * 3]]
    plte = struct.pack(">I", 6) + b"PLTE" + bytes(range(6)) + struct.pack(">I", zlib.crc32(b"PLTE" + bytes(range(6))))
    assert png.decode(form(3, [b"\0\1\0"], 2, plte)).tolist() == [[[3, 4, 5], [0, 1, 2]]]
    (tmp_path / "a.png").write_bytes(png.encode(px))
    (tmp_path / "b.PNG").write_bytes(png.encode(px)[:-20])
    got = {r["path"][-5:]: r for r in png.read_png(spark, str(tmp_path)).collect()}
    assert bytes(got["a.png"]["rgb"]) == px.tobytes() and (got["a.png"]["height"], got["a.png"]["width"]) == (7, 9)
    assert got["b.PNG"]["error"] and got["b.PNG"]["rgb"] is None
