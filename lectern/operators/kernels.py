"""Raster kernels in numpy, and the Arrow functions that run them over images.

An image is a row of (id, width, height, pixels), its grey bytes row by row.  Whole
images are handled one at a time inside a map, without shuffles; a broken image gives a
row with status ``error`` and its message, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.edges import long_thin_at_edge

IMAGES = "id bigint, width int, height int, pixels binary"
PREPARED = IMAGES + ", status string, error string"
COMPONENTS = "id bigint, label int, x int, y int, w int, h int, area int"


@dataclass(frozen=True)
class Settings:
    dpi: int = 300
    min_width: int = 100
    padding: int = 20
    dark_delta: int = 45
    crop_area: int = 250
    dilate: int = 4
    min_crop_ratio: float = 0.01
    border: int = 15
    drop_edges: bool = True
    factor: float = 2.0
    strength: float = 10.0
    speck_area: int = 70
    sigma: float = 75.0
    dark: int = 128
    max_skew: float = 15.0


def to_bytes(image: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(image.astype(np.float64) + 0.5), 0, 255).astype(np.uint8)


def flatten_alpha(image: np.ndarray) -> np.ndarray:
    """Colours over white by their alpha, then grey; two channels are grey and alpha."""
    if image.ndim == 2:
        return image
    channels = image.astype(np.float64)
    if image.shape[2] in (2, 4):
        alpha = channels[..., -1:] / 255
        channels = channels[..., :-1] * alpha + 255 * (1 - alpha)
    return to_bytes(channels @ (np.array([0.299, 0.587, 0.114]) if channels.shape[2] == 3 else np.ones(1)))


def _taps(n_in: int, n_out: int, lobes: int = 3) -> np.ndarray:
    """Lanczos weights (n_out, n_in) for enlarging."""
    centre = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    away = centre[:, None] - np.arange(n_in)
    weights = np.where(np.abs(away) < lobes, np.sinc(away) * np.sinc(away / lobes), 0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return to_bytes(_taps(image.shape[0], height) @ image.astype(np.float64) @ _taps(image.shape[1], width).T)


def scale_of(width: int, dpi: float | None, settings: Settings) -> float:
    by_dpi = settings.dpi / dpi if dpi and 0 < dpi < settings.dpi else 1.0
    return max(1.0, by_dpi, settings.min_width / width)


def standardize(image: np.ndarray, dpi: float | None, settings: Settings) -> np.ndarray:
    scale = scale_of(image.shape[1], dpi, settings)
    return image if scale == 1 else resize(image, round(image.shape[1] * scale), round(image.shape[0] * scale))


def enhance(image: np.ndarray, factor: float) -> np.ndarray:
    middle = np.floor(image.mean() + 0.5)
    return to_bytes(middle + factor * (image - middle))


def otsu_threshold(image: np.ndarray) -> int:
    """As :func:`lectern.operators.raster.otsu`."""
    counts = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    n0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    n, s = n0[-1], s0[-1]
    inner = (counts > 0) & (n0 < n)
    between = np.where(inner, (s0 * n - s * n0) ** 2 / np.where(inner, n0 * (n - n0), 1), 0)
    return int(between.argmax()) if between.any() else int(image.max())


def binarize(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu_threshold(image), 255, 0).astype(np.uint8)


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected components, from 1 in reading order; 0 is background.

    Runs of each row are joined to the runs they touch in the row before.
    """
    height, width = mask.shape
    step = width + 1  # a blank column ends each row's last run
    flat = np.zeros(height * step + 1, np.int8)
    flat[1:].reshape(height, step)[:, :width] = mask
    change = np.diff(flat)
    starts, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    first, last = np.searchsorted(ends, starts - step), np.searchsorted(starts, ends - step, "right")
    parent = list(range(len(starts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    touching = np.flatnonzero(last > first)
    for k, lo, hi in zip(touching.tolist(), first[touching].tolist(), last[touching].tolist(), strict=True):
        for touched in range(lo, hi):
            one, two = root(k), root(touched)
            parent[max(one, two)] = min(one, two)
    _, small = np.unique(np.array([root(k) for k in range(len(parent))], np.int64), return_inverse=True)
    labels = np.zeros(mask.shape, np.int64)
    labels[mask.astype(bool)] = np.repeat(small + 1, ends - starts)
    return labels


def component_table(labels: np.ndarray) -> np.ndarray:
    """Rows of label, x, y, w, h, area."""
    y, x = np.nonzero(labels)
    label = labels[y, x]
    n = int(label.max(initial=0))
    out = np.zeros((n, 6), np.int64)
    out[:, 0] = np.arange(1, n + 1)
    low, high = np.full((n + 1, 2), 1 << 40), np.zeros((n + 1, 2), np.int64)
    for k, values in enumerate((x, y)):
        np.minimum.at(low[:, k], label, values)
        np.maximum.at(high[:, k], label, values)
    out[:, 1:3] = low[1:]
    out[:, 3:5] = high[1:] - low[1:] + 1
    out[:, 5] = np.bincount(label, minlength=n + 1)[1:]
    return out


def _at_edge(table: np.ndarray, width: int, height: int) -> np.ndarray:
    """Long thin components that touch the edge."""
    _, x, y, w, h, _ = table.T
    return long_thin_at_edge(x, y, w, h, width, height)


def _without(labels: np.ndarray, table: np.ndarray, drop: np.ndarray) -> np.ndarray:
    keep = np.r_[False, ~drop]
    return keep[labels]


def dilate(mask: np.ndarray, by: int) -> np.ndarray:
    """Widened by a square; along rows, then along columns."""
    for axis in (0, 1):
        grown = mask.copy()
        for shift in range(1, by + 1):
            ahead = [slice(None)] * 2
            behind = [slice(None)] * 2
            ahead[axis], behind[axis] = slice(shift, None), slice(None, -shift)
            grown[tuple(ahead)] |= mask[tuple(behind)]
            grown[tuple(behind)] |= mask[tuple(ahead)]
        mask = grown
    return mask


def crop_box(image: np.ndarray, s: Settings) -> tuple[int, int, int, int] | None:
    """left, top, right, bottom around the writing, or None."""
    level = max(0, min(250, int(np.percentile(image, 95)) - s.dark_delta))
    mask = dilate(image < level, s.dilate)
    height, width = mask.shape
    labels = label_components(mask)
    table = component_table(labels)
    drop = table[:, 5] < s.crop_area
    if s.drop_edges:
        drop |= _at_edge(table, width, height)
    mask = _without(labels, table, drop)
    y, x = np.nonzero(mask)
    if not len(x):
        return None
    box = max(0, x.min() - s.padding), max(0, y.min() - s.padding), min(width, x.max() + s.padding + 1), min(height, y.max() + s.padding + 1)
    return tuple(map(int, box)) if (box[2] - box[0]) * (box[3] - box[1]) >= s.min_crop_ratio * width * height else None


def crop(image: np.ndarray, s: Settings, border: int) -> np.ndarray:
    """The image inside its box; unchanged without one; an error if the border leaves nothing."""
    box = crop_box(image, s)
    if box is not None:
        image = image[box[1] : box[3], box[0] : box[2]]
    if border:
        if min(image.shape) <= 2 * border:
            raise ValueError(f"{image.shape[1]} x {image.shape[0]} is too small for a border of {border}")
        image = image[border:-border, border:-border]
    return image


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur; the border is mirrored without its edge."""
    reach = max(1, round(4 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        period = max(1, 2 * (n - 1))
        at = np.abs((np.arange(-reach, n + reach) + period * (reach // period + 1)) % period)
        at = np.where(at >= n, period - at, at) if n > 1 else np.zeros_like(at)
        padded = np.take(out, at, axis=axis)
        out = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), axis, padded)
    return out


def flatten_background(image: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return image
    behind = to_bytes(gaussian(image, sigma)).astype(np.float64)
    return to_bytes(np.where(behind > 0, image * 255.0 / np.where(behind > 0, behind, 1), 0))


def window_sums(values: np.ndarray, size: int) -> np.ndarray:
    """Sums of so many neighbouring rows, from sums of 1, 2, 4, .. rows."""
    n = len(values) - size + 1
    out, done, part, rows = None, 0, values, 1
    while True:
        if size & rows:
            piece = part[done : done + n]
            out = piece if out is None else out + piece
            done += rows
        rows *= 2
        if rows > size:
            return out
        part = part[: -rows // 2] + part[rows // 2 :]


@lru_cache(4)
def _weights(strength: float, side: int) -> np.ndarray:
    """The weight by a patch's sum of squares, a whole number; beyond 2e-22 no sum of doubles has room for it."""
    scale = side**2 * strength**2
    most = min(int(50 * scale) + 1, 255**2 * side**2)
    return np.append(np.exp(-np.arange(most + 1) / scale), 0.0)


def non_local_means(image: np.ndarray, strength: float, patch: int = 3, search: int = 10) -> np.ndarray:
    """Each pixel as a mean of those near it whose surroundings look alike."""
    if strength <= 0:
        return image
    search = min(search, min(image.shape) - 1)
    edge, side = search + patch, 2 * patch + 1
    # sums of squares over a patch are whole numbers, so they are exact however they are added
    kind = np.int32 if 255**2 * side**2 < 2**31 else np.int64
    wide = np.pad(image.astype(kind), edge, mode="symmetric")
    height, width = image.shape
    weights = _weights(strength, side)
    total, weight, real = image.astype(np.float64), np.ones(image.shape), wide.astype(np.float64)  # a pixel's own

    for dy in range(search + 1):
        for dx in range(-search if dy else 1, search + 1):
            # patches around q and q + (dy, dx), for every q that is in the image or that lands there
            left, right = min(0, -dx), width + max(0, -dx)
            rows, columns = slice(edge - dy - patch, edge + height + patch), slice(edge + left - patch, edge + right + patch)
            square = wide[rows, columns] - wide[rows.start + dy : rows.stop + dy, columns.start + dx : columns.stop + dx]
            square *= square
            sums = window_sums(window_sums(square, side).T, side).T
            w = weights.take(sums, mode="clip")
            # both ways round: q looks at q + (dy, dx), and that one looks at q
            here, there = w[dy:, -left : width - left], w[:height, -left - dx : width - left - dx]
            weight += here
            total += here * real[edge + dy : edge + dy + height, edge + dx : edge + dx + width]
            weight += there
            total += there * real[edge - dy : edge - dy + height, edge - dx : edge - dx + width]
    return to_bytes(total / weight)


def despeckle(image: np.ndarray, dark: int, least_area: int) -> np.ndarray:
    """Dark components smaller than ``least_area`` become white."""
    if least_area <= 0:
        return image
    labels = label_components(image < dark)
    small = np.r_[False, component_table(labels)[:, 5] < least_area]
    return np.where(small[labels], 255, image).astype(np.uint8)


def denoise(image: np.ndarray, s: Settings) -> np.ndarray:
    return despeckle(flatten_background(non_local_means(image, s.strength), s.sigma), s.dark, s.speck_area)


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Rotated about its centre in a frame that holds all of it; bilinear."""
    height, width = image.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    new_w, new_h = int(np.ceil(abs(width * c) + abs(height * s) - 1e-9)), int(np.ceil(abs(height * c) + abs(width * s) - 1e-9))
    y, x = np.mgrid[0:new_h, 0:new_w].astype(np.float64)
    x, y = x - (new_w - 1) / 2, y - (new_h - 1) / 2
    from_x, from_y = c * x - s * y + (width - 1) / 2, s * x + c * y + (height - 1) / 2
    padded = np.pad(image.astype(np.float64), 1, constant_values=fill)
    px, py = np.clip(from_x + 1, 0, width + 1), np.clip(from_y + 1, 0, height + 1)
    x0, y0 = np.minimum(px.astype(int), width), np.minimum(py.astype(int), height)
    fx, fy = px - x0, py - y0
    top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
    low = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
    return to_bytes(top * (1 - fy) + low * fy)


def skew_angle(image: np.ndarray, most: float = 15.0, step: float = 0.5) -> float:
    """The angle whose row sums of dark pixels vary most; 0 for a blank image.

    A projection profile stands in for a line-transform estimator.
    """
    y, x = np.nonzero(image <= otsu_threshold(image))
    if len(y) in (0, image.size):
        return 0.0
    y, x = y - y.mean(), x - x.mean()
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=abs):
        rows = np.floor(y * np.cos(np.radians(angle)) - x * np.sin(np.radians(angle))).astype(int)
        sharp = float((np.bincount(rows - rows.min()).astype(np.float64) ** 2).sum())
        if sharp > best * (1 + 1e-9):
            best, found = sharp, float(angle)
    return found


def deskew(image: np.ndarray, most: float = 15.0) -> np.ndarray:
    angle = skew_angle(image, most)
    return image if not angle else rotate(image, angle)


def prepare(image: np.ndarray, s: Settings = Settings(), dpi: float | None = None) -> np.ndarray:
    """All stages: standardize, crop, contrast, denoise, deskew, crop with its border, binarize."""
    image = crop(standardize(image, dpi, s), s, 0)
    image = deskew(denoise(enhance(image, s.factor), s), s.max_skew)
    return binarize(crop(image, s, s.border))


def whole_image_block(width: int, height: int) -> dict:
    """The layout that makes a whole image one text block."""
    box = [0.0, 0.0, float(width), float(height)]
    polygon = [[0.0, 0.0], [float(width), 0.0], [float(width), float(height)], [0.0, float(height)]]
    return {"polygon": polygon, "bbox": box, "label": "Text", "raw_label": "Text", "reading_order": 0, "confidence": 1.0, "skipped": False, "error": False}


def _image(row: dict) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])


def prepare_images(images: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Prepared images with status and error, one row per image."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    out = prepare(_image(row), settings)
                    rows.append((row["id"], out.shape[1], out.shape[0], out.tobytes(), "ok", None))
                except Exception as problem:  # noqa: BLE001  one bad image is one row
                    rows.append((row["id"], None, None, None, "error", str(problem)))
            frame = pd.DataFrame(rows, columns=["id", "width", "height", "pixels", "status", "error"])
            yield frame.astype({"width": "Int32", "height": "Int32"})

    return images.select("id", "width", "height", "pixels").mapInPandas(work, PREPARED)


def components(images: DataFrame, below: int) -> DataFrame:
    """The 8-connected components of pixels darker than ``below``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [np.c_[np.full(len(t), row["id"]), t] for row in frame.to_dict("records") if len(t := component_table(label_components(_image(row) < below)))]
            rows = np.concatenate(parts) if parts else np.zeros((0, 7), np.int64)
            yield pd.DataFrame(rows, columns=["id", "label", "x", "y", "w", "h", "area"])

    return images.select("id", "width", "height", "pixels").mapInPandas(work, COMPONENTS)
