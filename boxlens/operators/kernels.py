"""Dense kernels over one image or level: numpy, run by mapInPandas and grouped functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CELL, DIMS, EPSILON, CLIP, TEXTURE = 8, 32, 1e-4, 0.2, 0.2357


def as_colour(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image, np.float64)
    return np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image


def hog(image: np.ndarray, cell: int = CELL) -> np.ndarray:
    """(rows, cols, 32) of gradient histograms without the border cells: 18 signed and 9 unsigned orientations, 4 texture energies, and a truncation flag."""
    im = as_colour(image)
    blocks = [int(math.floor(n / cell + 0.5)) for n in im.shape[:2]]
    out_shape = [max(b - 2, 0) for b in blocks]
    if not all(out_shape):
        return np.zeros((*out_shape, DIMS))
    ys, xs = np.arange(1, blocks[0] * cell - 1), np.arange(1, blocks[1] * cell - 1)
    cy, cx = np.minimum(ys, im.shape[0] - 2), np.minimum(xs, im.shape[1] - 2)
    dy = im[np.ix_(cy + 1, cx)] - im[np.ix_(cy - 1, cx)]
    dx = im[np.ix_(cy, cx + 1)] - im[np.ix_(cy, cx - 1)]
    power = dx**2 + dy**2
    channel = power.argmax(axis=2)[:, :, None]
    dx, dy, power = (np.take_along_axis(a, channel, 2)[:, :, 0] for a in (dx, dy, power))
    angles = np.arange(9) * math.pi / 9
    dots = dx[:, :, None] * np.cos(angles) + dy[:, :, None] * np.sin(angles)
    both = np.concatenate([dots, -dots], axis=2)
    best = both.argmax(axis=2)
    size = np.sqrt(power)
    # each pixel votes for the four cells around it
    hist = np.zeros((blocks[0], blocks[1], 18))
    py, px = (ys + 0.5) / cell - 0.5, (xs + 0.5) / cell - 0.5
    iy, ix = np.floor(py).astype(int), np.floor(px).astype(int)
    fy, fx = py - iy, px - ix
    for oy, wy in ((0, 1 - fy), (1, fy)):
        for ox, wx in ((0, 1 - fx), (1, fx)):
            gy, gx = iy + oy, ix + ox
            ok = ((gy >= 0) & (gy < blocks[0]))[:, None] & ((gx >= 0) & (gx < blocks[1]))[None, :]
            yy, xx = np.broadcast_to(gy[:, None], ok.shape)[ok], np.broadcast_to(gx[None, :], ok.shape)[ok]
            np.add.at(hist, (yy, xx, best[ok]), (wy[:, None] * wx[None, :] * size)[ok])
    folded = hist[:, :, :9] + hist[:, :, 9:]
    energy = (folded**2).sum(axis=2)
    four = energy[:-1, :-1] + energy[1:, :-1] + energy[:-1, 1:] + energy[1:, 1:]
    norm = 1 / np.sqrt(four + EPSILON)
    around = np.stack([norm[1:, 1:], norm[:-1, 1:], norm[1:, :-1], norm[:-1, :-1]], axis=2)
    inner, inner_folded = hist[1:-1, 1:-1], folded[1:-1, 1:-1]
    signed = np.minimum(inner[:, :, :, None] * around[:, :, None, :], CLIP)
    unsigned = np.minimum(inner_folded[:, :, :, None] * around[:, :, None, :], CLIP)
    return np.concatenate([signed.sum(axis=3) / 2, unsigned.sum(axis=3) / 2, signed.sum(axis=2) * TEXTURE, np.zeros((*out_shape, 1))], axis=2)


def mirror_order() -> np.ndarray:
    """Where each feature of a mirrored image comes from: orientation k of 18 goes to 9 - k, of 9 to -k, and the texture energies swap left and right."""
    signed = [(9 - k) % 18 for k in range(18)]
    unsigned = [18 + (9 - k) % 9 for k in range(9)]
    return np.array([*signed, *unsigned, 27 + 2, 27 + 3, 27 + 0, 27 + 1, 31])


def flip_filter(f: np.ndarray) -> np.ndarray:
    return f[:, ::-1, mirror_order()]


def shrink(image: np.ndarray, scale: float) -> np.ndarray:
    """Area resampling by a scale of at most 1, rows then columns. Sizes round half up."""
    if not 0 < scale <= 1:
        raise ValueError("scale must be in (0, 1]")

    def weights(n: int) -> np.ndarray:
        m = int(math.floor(n * scale + 0.5))
        edge = np.arange(m + 1) * (n / m)
        at = np.arange(n)
        w = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, 1)
        return w / w.sum(axis=1, keepdims=True)

    im = np.asarray(image, np.float64)
    rows, cols = weights(im.shape[0]), weights(im.shape[1])
    return np.einsum("ab,bc...->ac...", rows, np.einsum("cd,bd...->bc...", cols, im))


def pyramid(image: np.ndarray, interval: int = 10, cell: int = CELL, pad: tuple[int, int] = (0, 0), extra_octave: bool = False) -> list[tuple[float, np.ndarray]]:
    """(scale, features) of each level: an octave of `interval` levels at half cells (with extra_octave one at quarter cells first), then whole cells down to 5 cells, an octave at least. The first octave is resized from the image, each later one is half of the one before. Padding is zeros with the truncation flag set."""
    im = as_colour(image)
    step = 2 ** (1 / interval)
    levels = max(interval, 1 + int(math.floor(math.log(min(im.shape[:2]) / (5 * cell)) / math.log(step))))
    small: list[np.ndarray] = []
    for i in range(levels):
        small.append(shrink(im, 1 / step**i) if i < interval else shrink(small[i - interval], 0.5))
    sizes = ([(4, cell // 4)] if extra_octave else []) + [(2, cell // 2)]
    out = [(factor / step**i, hog(small[i], size)) for factor, size in sizes for i in range(interval)]
    coarse = [(1 / step**i, hog(small[i], cell)) for i in range(levels)]
    return [(s, padded(f, pad)) for s, f in out + coarse]


def padded(f: np.ndarray, pad: tuple[int, int]) -> np.ndarray:
    py, px = pad[0] + 1, pad[1] + 1
    out = np.pad(f, ((py, py), (px, px), (0, 0)))
    out[:py, :, -1] = out[-py:, :, -1] = 1
    out[:, :px, -1] = out[:, -px:, -1] = 1
    return out


def correlate(a: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Valid correlation over all feature dimensions."""
    windows = np.lib.stride_tricks.sliding_window_view(a, f.shape[:2], axis=(0, 1))
    return np.einsum("yxdij,ijd->yx", windows, f, optimize=True)


def post_pad(a: np.ndarray, rows: int, cols: int, value: float) -> np.ndarray:
    return np.pad(a, ((0, rows), (0, cols)), constant_values=value)


def distance_transform(values: np.ndarray, ax: float, bx: float, ay: float, by: float, reach: int | None = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best of f(j) - a (i - j)^2 - b (i - j) within reach (None: anywhere), down then across: score and the row and column it came from, the first of equals."""

    def one(v: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(v)
        best, arg = np.full(v.shape, -np.inf), np.zeros(v.shape, np.int64)
        far = n - 1 if reach is None else reach
        for d in range(far, -far - 1, -1):  # j = i - d, ascending
            lo, hi = max(0, d), min(n, n + d)
            if lo >= hi:
                continue
            cand = v[lo - d : hi - d] - a * d * d - b * d
            better = cand > best[lo:hi]
            best[lo:hi][better] = cand[better]
            arg[lo:hi][better] = np.broadcast_to((np.arange(lo, hi) - d).reshape(-1, *[1] * (v.ndim - 1)), cand.shape)[better]
        return best, arg

    down, row = one(np.asarray(values, np.float64), ay, by)
    across, col = one(down.T, ax, bx)
    col = col.T
    return across.T, np.take_along_axis(row, col, 1), col


def brute_transform(values: np.ndarray, ax: float, bx: float, ay: float, by: float, reach: int = 4) -> np.ndarray:
    h, w = values.shape
    out = np.full((h, w), -np.inf)
    for y in range(h):
        for x in range(w):
            for j in range(max(0, y - reach), min(h, y + reach + 1)):
                for i in range(max(0, x - reach), min(w, x + reach + 1)):
                    dy, dx = y - j, x - i
                    out[y, x] = max(out[y, x], values[j, i] - ay * dy * dy - by * dy - ax * dx * dx - bx * dx)
    return out


def subarray(a: np.ndarray, y1: int, y2: int, x1: int, x2: int, replicate: bool) -> np.ndarray:
    """Rows y1..y2 and columns x1..x2, from 1, which may lie outside: edge values there, or zeros."""
    ys, xs = np.arange(y1, y2 + 1) - 1, np.arange(x1, x2 + 1) - 1
    got = a[np.ix_(np.clip(ys, 0, a.shape[0] - 1), np.clip(xs, 0, a.shape[1] - 1))].copy()
    if not replicate:
        got[(ys < 0) | (ys >= a.shape[0])] = 0
        got[:, (xs < 0) | (xs >= a.shape[1])] = 0
    return got


def warp(image: np.ndarray, box: tuple[float, float, float, float], size: tuple[int, int], cell: int = CELL) -> np.ndarray:
    """The box, with a border of one cell at the filter's scale, brought to (rows + 2, cols + 2) cells."""
    im = as_colour(image)
    pad_y, pad_x = cell * (box[3] - box[1] + 1) / (size[0] * cell), cell * (box[2] - box[0] + 1) / (size[1] * cell)
    cut = subarray(im, round(box[1] - pad_y), round(box[3] + pad_y), round(box[0] - pad_x), round(box[2] + pad_x), True)
    rows, cols = (size[0] + 2) * cell, (size[1] + 2) * cell
    at_y = np.clip((np.arange(rows) + 0.5) * cut.shape[0] / rows - 0.5, 0, cut.shape[0] - 1)
    at_x = np.clip((np.arange(cols) + 0.5) * cut.shape[1] / cols - 0.5, 0, cut.shape[1] - 1)
    y0, x0 = np.floor(at_y).astype(int), np.floor(at_x).astype(int)
    y1, x1 = np.minimum(y0 + 1, cut.shape[0] - 1), np.minimum(x0 + 1, cut.shape[1] - 1)
    fy, fx = (at_y - y0)[:, None, None], (at_x - x0)[None, :, None]
    return (cut[y0][:, x0] * (1 - fx) + cut[y0][:, x1] * fx) * (1 - fy) + (cut[y1][:, x0] * (1 - fx) + cut[y1][:, x1] * fx) * fy


def project(features: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return features @ basis


def overlap_field(shape: tuple[int, int], window: tuple[int, int], scale: float, pad: tuple[int, int], box: tuple[float, float, float, float], image: tuple[int, int], cell: int = CELL) -> np.ndarray:
    """IoU of a window at every cell with a box. The window is cut to the image unless the box takes 70% of it or more."""
    y, x = np.arange(shape[0])[:, None], np.arange(shape[1])[None, :]
    x1, y1 = (x - pad[1]) * cell * scale + 1, (y - pad[0]) * cell * scale + 1
    x2, y2 = x1 + window[1] * cell * scale - 1, y1 + window[0] * cell * scale - 1
    size = (box[2] - box[0] + 1) * (box[3] - box[1] + 1)
    if size < 0.7 * image[0] * image[1]:
        x1, y1, x2, y2 = np.maximum(x1, 1), np.maximum(y1, 1), np.minimum(x2, image[1]), np.minimum(y2, image[0])
    w = np.minimum(x2, box[2]) - np.maximum(x1, box[0]) + 1
    h = np.minimum(y2, box[3]) - np.maximum(y1, box[1]) + 1
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    return inter / (np.maximum(x2 - x1 + 1, 0) * np.maximum(y2 - y1 + 1, 0) + size - inter)


# --- over tables ----------------------------------------------------------------------------------------


def image_of(row) -> np.ndarray:
    """The image of a row with h, w and pixels: grey or, with three times as many values, colour, channels last."""
    pixels = np.asarray(row.pixels, np.float64)
    return pixels.reshape((row.h, row.w) if pixels.size == row.h * row.w else (row.h, row.w, 3))


def image_levels(images: DataFrame, interval: int = 10, cell: int = CELL, pad: tuple[int, int] = (0, 0)) -> DataFrame:
    """images (image_id, h, w, pixels): a row for each level, with its features flattened."""

    def run(batches):
        for d in batches:
            for r in d.itertuples(index=False):
                im = image_of(r)
                yield pd.DataFrame([(r.image_id, k + 1, s, *f.shape, f.astype(np.float32).ravel().tolist()) for k, (s, f) in enumerate(pyramid(im, interval, cell, pad))], columns=["image_id", "level", "scale", "h", "w", "dims", "feat"])

    return images.select("image_id", "h", "w", "pixels").mapInPandas(run, "image_id long, level long, scale double, h long, w long, dims long, feat array<float>")


def responses(levels: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """Scores of each filter at each cell of each level, as tables of cells."""

    def run(batches):
        for d in batches:
            for r in d.itertuples(index=False):
                a = np.array(r.feat, np.float64).reshape(r.h, r.w, r.dims)
                for k, f in enumerate(filters):
                    if a.shape[0] < f.shape[0] or a.shape[1] < f.shape[1]:
                        continue
                    out = correlate(a, f)
                    y, x = np.indices(out.shape)
                    yield pd.DataFrame({"symbol": k, "image_id": r.image_id, "level": r.level, "y": y.ravel(), "x": x.ravel(), "score": out.ravel()})

    return levels.mapInPandas(run, "symbol long, image_id long, level long, y long, x long, score double")


def warped_rows(boxes: DataFrame, size: tuple[int, int], cell: int = CELL) -> DataFrame:
    """Features of each box of an image, brought to a filter's size: boxes has dataid, h, w, pixels and the sides. (dataid, feat), a row a box."""

    def run(batches):
        for d in batches:
            rows = [(r.dataid, hog(warp(image_of(r), (r.x1, r.y1, r.x2, r.y2), size, cell), cell).astype(np.float32).ravel().tolist()) for r in d.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["dataid", "feat"])

    return boxes.select("dataid", "h", "w", "pixels", "x1", "y1", "x2", "y2").mapInPandas(run, "dataid long, feat array<float>")
