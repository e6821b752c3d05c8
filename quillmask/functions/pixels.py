"""Pixel work on RGBA images, as Pandas functions over binary columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def resize(img: np.ndarray, x: float, y: float, w: float, h: float, out_w: int, out_h: int) -> np.ndarray:
    """Bilinear resize of a crop, as bytes (halves to even)."""

    def places(start: float, size: float, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(start + (np.arange(n) + 0.5) * (size / n) - 0.5, 0, most - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(most - 1, low + 1), at - low

    y0, y1, wy = places(y, h, out_h, img.shape[0])
    x0, x1, wx = places(x, w, out_w, img.shape[1])
    wx, wy = wx[None, :, None], wy[:, None, None]
    f = img.astype(float)
    top = f[y0][:, x0] * (1 - wx) + f[y0][:, x1] * wx
    low = f[y1][:, x0] * (1 - wx) + f[y1][:, x1] * wx
    return np.clip(np.rint(top * (1 - wy) + low * wy), 0, 255).astype(np.uint8)


def difference_hash(img: np.ndarray, x: float, y: float, w: float, h: float) -> int:
    """64 bits, most significant first: whether a pixel of the 9 x 8 grey image is brighter than the next; signed."""
    small = resize(img, x, y, w, h, 9, 8).astype(float)
    grey = small[..., 0] * 0.299 + small[..., 1] * 0.587 + small[..., 2] * 0.114
    return int(np.packbits(grey[:, :-1] > grey[:, 1:]).view(">i8")[0])


def tile_hashes(img: np.ndarray, grid: int = 8) -> list[int]:
    h, w = img.shape[0] / grid, img.shape[1] / grid
    return [difference_hash(img, i * w, j * h, w, h) for j in range(grid) for i in range(grid)]


def _cut(b: tuple, by: int, width: int, height: int) -> tuple[int, int, int, int]:
    x0, y0 = max(0, int(np.floor(b[0] - by))), max(0, int(np.floor(b[1] - by)))
    return x0, y0, min(width, int(np.ceil(b[0] + b[2] + by))), min(height, int(np.ceil(b[1] + b[3] + by)))


def black_fill(img: np.ndarray, boxes: list[tuple], by: int = 4) -> np.ndarray:
    out = img.copy()
    for b in boxes:
        x0, y0, x1, y1 = _cut(b, by, img.shape[1], img.shape[0])
        if x1 > x0 and y1 > y0:
            out[y0:y1, x0:x1] = (0, 0, 0, 255)
    return out


def pixelate(img: np.ndarray, boxes: list[tuple], cell: int = 16, by: int = 4) -> np.ndarray:
    """Boxes in cells of at least ``cell`` pixels and a sixth of the longer side, each of its mean colour."""
    out = img.copy()
    for b in boxes:
        x0, y0, x1, y1 = _cut(b, by, img.shape[1], img.shape[0])
        c = max(cell, int(np.ceil(max(x1 - x0, y1 - y0) / 6)))
        for y in range(y0, y1, c):
            for x in range(x0, x1, c):
                part = out[y : min(y1, y + c), x : min(x1, x + c), :3]
                part[:] = np.rint(part.reshape(-1, 3).mean(axis=0)).astype(np.uint8)
    return out


def only_inside(img: np.ndarray, boxes: list[tuple]) -> np.ndarray:
    """Black but for the boxes."""
    out = np.zeros_like(img)
    out[..., 3] = 255
    for b in boxes:
        x0, y0, x1, y1 = _cut(b, 0, img.shape[1], img.shape[0])
        out[y0:y1, x0:x1] = img[y0:y1, x0:x1]
    return out


def pixel_key(img: np.ndarray) -> str:
    """An exact key over size and colours: two multiplicative hashes, over all pixels at once."""
    flat = img.reshape(-1, 4).astype(np.uint64)
    v = flat[:, 0] | flat[:, 1] << np.uint64(8) | flat[:, 2] << np.uint64(16)
    h1, h2 = 0x811C9DC5, 0x01000193 ^ img.shape[1]
    for i, x in enumerate(v.tolist()):
        h1 = ((h1 ^ x) * 0x01000193) & 0xFFFFFFFF
        h2 = ((h2 ^ (x + 4 * i)) * 0x5BD1E995) & 0xFFFFFFFF
    return f"{img.shape[1]}x{img.shape[0]}:{h1:x}{h2:x}"


def normalized_planes(img: np.ndarray, mean: tuple, std: tuple, scale: float = 1 / 255, bgr: bool = False) -> np.ndarray:
    """Channels first, scaled, centred and divided."""
    rgb = img[..., :3][..., ::-1] if bgr else img[..., :3]
    return ((rgb.astype(np.float32) * scale - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def components(mask: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Boxes of 4-connected areas of at least ``least`` pixels, by their first pixel: runs of rows are joined by union-find."""
    runs, parent, before = [], [], []
    for y, row in enumerate(mask.astype(bool)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            for j in before:
                if runs[j][1] < b and a < runs[j][2]:
                    r, s = _root(parent, j), _root(parent, k)
                    parent[max(r, s)] = min(r, s)
            now.append(k)
        before = now
    areas: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        v = areas.setdefault(_root(parent, k), [a, y, b, y + 1, 0])
        v[0], v[2], v[3], v[4] = min(v[0], a), max(v[2], b), y + 1, v[4] + b - a
    return [(v[0], v[1], v[2] - v[0], v[3] - v[1]) for _, v in sorted(areas.items()) if v[4] >= least]


def _root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = k = parent[parent[k]]
    return k


def tiles(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([tile_hashes(image(d, w, h)) for d, w, h in zip(data, width, height, strict=True)])


def whole_hash(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([difference_hash(image(d, w, h), 0, 0, w, h) for d, w, h in zip(data, width, height, strict=True)])


def keys(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([pixel_key(image(d, w, h)) for d, w, h in zip(data, width, height, strict=True)])


def redacted(data: pd.Series, width: pd.Series, height: pd.Series, texts: pd.Series, faces: pd.Series) -> pd.Series:
    """Texts filled black, then faces pixelated; boxes as arrays of x, y, w, h."""
    return pd.Series([pixelate(black_fill(image(d, w, h), list(t)), list(f)).tobytes() for d, w, h, t, f in zip(data, width, height, texts, faces, strict=True)])


def column(name: str) -> Callable[..., Column]:
    """One of these as a function of columns: tiles, hash, key or redact."""
    function, kind = {"tiles": (tiles, "array<bigint>"), "hash": (whole_hash, "bigint"), "key": (keys, "string"), "redact": (redacted, "binary")}[name]
    return F.pandas_udf(function, kind)
