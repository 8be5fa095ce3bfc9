"""Contrast, mixtures, clumps and stain normalisation on shapes worked out by hand or written out plainly."""

import math

import numpy as np
import pytest

from stainloom.operators import chromatin as ch
from stainloom.operators import stain


def test_clipping_keeps_the_count():
    r = np.random.RandomState(0)
    for _ in range(40):
        h = np.bincount(r.choice(256, 256, p=r.dirichlet(np.full(256, 0.02 + r.rand()))), minlength=256)
        out = ch._clipped(h, 7)
        assert out.max() <= 7 and out.sum() >= h.sum() - 0 and (out >= np.minimum(h, 7)).all()


def plain_equalised(image, k=16):
    """Pixel by pixel."""
    h, w = image.shape
    lo, hi = int(image.min()), int(image.max())
    wide = [[math.floor((int(v) - lo) * 16383 / (hi - lo) + 0.5) for v in row] for row in image.tolist()]

    def folded(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * n - i - 2
        return i

    at = lambda y, x: wide[folded(y - 8, h)][folded(x - 8, w)] // 65
    ny, nx = -(-h // k), -(-w // k)
    maps = {}
    for ty in range(ny):
        for tx in range(nx):
            hist = np.bincount([at(8 + ty * k + i, 8 + tx * k + j) for i in range(k) for j in range(k)], minlength=256)
            maps[ty, tx] = [min(int(c * 16383 / 256), 16383) for c in np.cumsum(ch._clipped(hist, 7))]
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            py, px = y + 8, x + 8
            by, bx, fy, fx = py // k, px // k, py % k / k, px % k / k
            v = 0.0
            for dy, wy in ((0, 1 - fy), (1, fy)):
                for dx, wx in ((0, 1 - fx), (1, fx)):
                    m = maps[min(max(by + dy - 1, 0), ny - 1), min(max(bx + dx - 1, 0), nx - 1)]
                    v += wy * wx * m[at(py, px)]
            out[y, x] = int(v + 1e-9)
    return ((out - out.min()) * (255.0 / (out.max() - out.min()))).astype(np.uint8)


@pytest.mark.parametrize("shape", [(16, 16), (20, 37), (33, 48), (5, 9)])
def test_equalised_like_pixel_by_pixel(shape):
    image = np.random.RandomState(sum(shape)).randint(0, 256, shape).astype(np.uint8)
    assert np.abs(ch.equalised(image).astype(int) - plain_equalised(image)).max() <= 1


def test_equalised_edges():
    assert (ch.equalised(np.full((20, 20), 80, np.uint8)) == 0).all()
    block = np.full((32, 32), 120, np.uint8)
    block[8:24, 8:24] = 124
    out = ch.equalised(block)
    assert out[16, 16] != out[1, 1]
    with pytest.raises(ValueError):
        ch.equalised(np.zeros((0, 3), np.uint8))


def test_mixtures():
    v = np.array([40 + i % 5 for i in range(200)] + [180 + i % 5 for i in range(200)], float)
    weights, means, variances = ch.mixture(v)
    assert sorted(means)[0] < 80 and sorted(means)[1] > 140 and abs(weights.sum() - 1) < 1e-12
    assert np.allclose(sorted(means), [42, 182], atol=1e-6) and np.allclose(variances, 2, atol=1e-4)
    dark = int(np.argmin(means))
    assert ((ch.component(v, (weights, means, variances)) == dark) == (v < 100)).all()
    assert all(np.isfinite(x).all() for x in ch.mixture(np.full(50, 7.0)))
    for bad in (dict(values=[1.0]), dict(values=[1.0, 2.0], k=3), dict(values=[1.0, 2.0], rounds=0)):
        with pytest.raises(ValueError):
            ch.mixture(**bad)


def test_two_populations():
    gray = np.full((32, 32), 30)
    mask = np.zeros((32, 32), bool)
    mask[6:26, 6:26] = True
    gray[6:26, 6:16], gray[6:26, 16:26] = 65, 190
    out = ch.chromatin(gray, mask)
    assert list(out) == ch.NAMES and all(map(math.isfinite, out.values())) and 0 <= out["condensed_area_ratio"] <= 1
    enhanced = ch.equalised(np.where(mask, gray, 0).astype(np.uint8))
    dark = ch.condensed(enhanced, mask)
    assert out["num_clumps"] >= 1 and dark[15, 10] != dark[15, 21]
    assert ch.chromatin(gray, np.zeros((32, 32), bool)) == dict.fromkeys(ch.NAMES, 0.0)
    one = np.zeros((32, 32), bool)
    one[3, 3] = True
    assert set(ch.chromatin(gray, one).values()) == {0.0}
    with pytest.raises(ValueError):
        ch.chromatin(gray, mask[:5])


def test_clumps():
    assert ch.mean_nearest(np.array([[0, 0], [0, 3], [0, 10.0]])) == pytest.approx((3 + 3 + 7) / 3)
    assert ch.mean_nearest(np.zeros((1, 2))) == 0
    assert ch.row_pairs(np.array([[0, 255], [255, 0]])) == pytest.approx((255.0**2, -1.0, math.sqrt(0.5), 1 / (1 + 255.0**2)))
    assert ch.row_pairs(np.zeros((3, 1), int)) == (0, 0, 0, 0)


def test_first_factors_follow_the_recurrence():
    x, want = stain.SEED, []
    for _ in range(500):
        x ^= x << 13 & (1 << 64) - 1
        x ^= x >> 7
        x ^= x << 17 & (1 << 64) - 1
        want.append(np.float32((x >> 40) / 2**24))
    stain._drawn = np.zeros(0, np.uint64)
    assert np.array_equal(stain.draws(100), np.array(want[:100], np.float32)) and np.array_equal(stain.draws(500), np.array(want, np.float32))


def test_factors_approach_the_matrix():
    r = np.random.RandomState(1)
    v = np.array(stain.REFERENCE) @ r.rand(2, 8)
    w0, h0 = r.rand(3, 2), r.rand(2, 8)
    w, h = stain.factors(v, w0, h0, 60, 0.01, 1e-8)
    assert w.shape == (3, 2) and h.shape == (2, 8) and (w >= 0).all() and (h >= 0).all()
    assert np.allclose(np.linalg.norm(w, axis=0), 1, atol=1e-3)
    assert np.linalg.norm(v - w @ h) <= 1.05 * np.linalg.norm(v - w0 @ h0)
    with pytest.raises(ValueError):
        stain.factors(v, w0[:2], h0, 1, 0.01, 1e-8)


def plain_normalise(rgb, rounds):
    """The whole way with loops over pixels, in 64-bit arithmetic."""
    px = rgb.reshape(-1, 3).astype(float)
    v = -np.log((px + 1e-8) / 255).T
    d = stain.draws(6 + 2 * v.shape[1]).astype(float) + 1e-8
    w, h = d[:6].reshape(3, 2), d[6:].reshape(2, -1)
    w = w / (np.sqrt((w**2).sum(0)) + 1e-8)
    for _ in range(rounds):
        for j in range(h.shape[1]):
            h[:, j] = np.maximum(h[:, j] * (w.T @ v[:, j]) / (w.T @ w @ h[:, j] + 0.01 + 1e-8), 1e-8)
        w = np.maximum(w * (v @ h.T) / (w @ h @ h.T + 1e-8), 1e-8)
        w = w / (np.sqrt((w**2).sum(0)) + 1e-8)
    if w[2, 0] < w[2, 1]:
        h = h[::-1]
    h = h * (np.array(stain.MAXIMA) / np.percentile(h, 99, axis=1))[:, None]
    return np.clip(255 * np.exp(-(np.array(stain.REFERENCE) @ np.maximum(h, 1e-8))), 0, 255).astype(np.uint8).T.reshape(rgb.shape)


def test_normalise_like_loops():
    rgb = np.random.RandomState(3).randint(20, 250, (9, 11, 3)).astype(np.uint8)
    got = stain.normalise(rgb, stain.Normaliser(rounds=25))
    assert np.abs(got.astype(int) - plain_normalise(rgb, 25)).max() <= 1
    assert np.array_equal(got, stain.normalise(rgb, stain.Normaliser(rounds=25)))
    assert stain.percentile(np.array([1, 2, 3, 4, 5, np.nan], np.float32), 50) == 3 and 4.9 <= stain.percentile(np.arange(1, 6, dtype=np.float32), 99) <= 5


def test_settings():
    for bad in (dict(rounds=0), dict(eps=0), dict(sparsity=-1), dict(maxima=(1.0,)), dict(reference=((1, 2),)), dict(maxima=(1.0, math.inf))):
        with pytest.raises(ValueError):
            stain.Normaliser(**bad)
    with pytest.raises(ValueError):
        stain.normalise(np.zeros((0, 3, 3), np.uint8))
