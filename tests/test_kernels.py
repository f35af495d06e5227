from __future__ import annotations

import numpy as np
import pytest

from lectern.operators import kernels as K


def page():
    image = np.full((200, 300), 230, np.uint8)
    image[80:90, 50:250] = 20
    image[110:120, 60:240] = 20
    return image


def test_alpha_is_flattened_over_white():
    colour = np.zeros((1, 2, 4), np.uint8)
    colour[0, 1] = (0, 0, 0, 255)
    assert K.flatten_alpha(colour).tolist() == [[255, 0]]
    assert K.flatten_alpha(np.array([[[10, 255]]], np.uint8)).tolist() == [[10]]


def test_standardize_enlarges_only():
    image = np.tile(np.arange(50, dtype=np.uint8) * 4, (20, 1))
    assert K.standardize(image, None, K.Settings()).shape == (40, 100)
    assert K.standardize(np.zeros((20, 400), np.uint8), 150, K.Settings()).shape == (40, 800)
    assert K.standardize(np.zeros((20, 400), np.uint8), 600, K.Settings()).shape == (20, 400)
    flat = K.resize(np.full((5, 7), 77, np.uint8), 20, 15)
    assert (flat == 77).all()


def test_contrast_and_otsu():
    assert K.enhance(np.array([[100, 200]], np.uint8), 2.0).tolist() == [[50, 250]]
    two = np.array([[10, 10, 200, 200, 200]], np.uint8)
    assert K.otsu_threshold(two) == 10
    assert K.binarize(two).tolist() == [[0, 0, 255, 255, 255]]
    assert K.otsu_threshold(np.full((3, 3), 9, np.uint8)) == 9


def test_components_table():
    mask = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    assert sorted(map(tuple, K.component_table(K.label_components(mask))[:, 1:].tolist())) == [(0, 0, 3, 2, 3), (0, 3, 1, 1, 1), (3, 3, 1, 1, 1)]


def test_crop():
    box = K.crop_box(page(), K.Settings(padding=20))
    assert box == (26, 56, 274, 144)
    assert K.crop_box(np.full((50, 50), 255, np.uint8), K.Settings()) is None
    edge = page()
    edge[:, 0:3] = 0
    assert K.crop_box(edge, K.Settings()) == box
    with pytest.raises(ValueError):
        K.crop(np.full((30, 40), 255, np.uint8), K.Settings(), 15)


def test_denoising():
    noisy = np.clip(page().astype(int) + np.random.default_rng(0).integers(-8, 9, (200, 300)), 0, 255).astype(np.uint8)
    calm = K.non_local_means(noisy[60:130, 40:120], 10.0)
    assert calm[:15].std() < noisy[60:75, 40:120].std() / 2
    specks = page()
    specks[10:13, 10:13] = 0
    assert K.despeckle(specks, 128, 70)[11, 11] == 255 and K.despeckle(specks, 128, 70)[85, 100] == 20
    flat = K.flatten_background(np.full((20, 20), 100, np.uint8), 5.0)
    assert (flat == 255).all()


def test_gaussian_against_the_sum():
    image = np.random.default_rng(1).integers(0, 255, (9, 7)).astype(np.uint8)
    sigma, reach = 1.0, 4
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    padded = np.pad(image.astype(float), reach, mode="reflect")
    want = sum(w[i] * w[j] * padded[i : i + 9, j : j + 7] for i in range(9) for j in range(9))
    assert np.allclose(K.gaussian(image, sigma), want)


@pytest.mark.parametrize("angle", [-7.0, 4.0, 10.0])
def test_skew(angle):
    turned = K.rotate(page(), angle)
    assert abs(K.skew_angle(turned) + angle) <= 0.5
    assert K.skew_angle(np.full((10, 10), 255, np.uint8)) == 0.0
    assert K.deskew(page()).shape == page().shape


def test_all_stages_and_isolation(spark):
    good, bad = page(), np.full((20, 120), 255, np.uint8)
    frame = spark.createDataFrame([(1, 300, 200, bytearray(good.tobytes())), (2, 120, 20, bytearray(bad.tobytes()))], K.IMAGES)
    got = {r["id"]: r for r in K.prepare_images(frame).collect()}
    assert got[1]["status"] == "ok" and set(got[1]["pixels"]) <= {0, 255} and got[1]["width"] * got[1]["height"] == len(got[1]["pixels"])
    assert got[2]["status"] == "error" and "too small" in got[2]["error"]


def test_whole_image_block():
    assert K.whole_image_block(4, 2)["bbox"] == [0.0, 0.0, 4.0, 2.0]


def plain_non_local_means(image, strength, patch=3, search=10):
    search = min(search, min(image.shape) - 1)
    wide = np.pad(image.astype(np.float64), search + patch, mode="symmetric")
    (height, width), side = image.shape, 2 * patch + 1
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    centre = wide[search : search + height + 2 * patch, search : search + width + 2 * patch]
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            moved = wide[search + dy : search + dy + height + 2 * patch, search + dx : search + dx + width + 2 * patch]
            sums = np.cumsum(np.cumsum(np.pad((centre - moved) ** 2, ((1, 0), (1, 0))), axis=0), axis=1)
            w = np.exp(-(sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]) / side**2 / strength**2)
            total += w * moved[patch : patch + height, patch : patch + width]
            weight += w
    return K.to_bytes(total / weight)


def test_denoising_compares_each_pair_of_patches_once():
    import time

    rng = np.random.default_rng(2)
    for shape in ((1, 1), (1, 6), (9, 4), (25, 40)):
        for image in (rng.integers(0, 256, shape), 120 + rng.integers(-9, 9, shape), np.where(rng.random(shape) < 0.5, 0, 255)):
            assert (K.non_local_means(image.astype(np.uint8), 10.0) == plain_non_local_means(image.astype(np.uint8), 10.0)).all()
    image = rng.integers(0, 256, (90, 90)).astype(np.uint8)

    def seconds(of):
        began = time.process_time()
        of(image, 10.0)
        return time.process_time() - began

    assert min(seconds(K.non_local_means) for _ in range(3)) < 0.7 * min(seconds(plain_non_local_means) for _ in range(3))
