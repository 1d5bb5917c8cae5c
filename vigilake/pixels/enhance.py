"""Contrast-limited adaptive histogram equalisation on lightness (Zuiderveld, 1994)."""

from __future__ import annotations

import numpy as np


def equalise(grey: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """CLAHE of an 8-bit image; the border is mirrored up to whole tiles."""
    h, w = grey.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    whole = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric")
    cut = whole.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, th * tw)
    counts = np.zeros((tiles * tiles, 256), np.int64)
    np.add.at(counts, (np.arange(tiles * tiles)[:, None], cut), 1)
    limit = max(1, int(clip * th * tw / 256))
    excess = np.maximum(counts - limit, 0).sum(1)
    counts = np.minimum(counts, limit) + (excess // 256)[:, None]
    rest = excess % 256
    for t in np.flatnonzero(rest):
        step = max(1, 256 // rest[t])
        counts[t, np.arange(0, 256, step)[: rest[t]]] += 1
    maps = np.clip(np.round(np.cumsum(counts, 1) * (255.0 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    near = lambda v: np.clip(v, 0, tiles - 1)
    at = lambda a, b: maps[near(a)[:, None], near(b)[None, :], grey]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    bottom = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.clip(np.round(top * (1 - fy) + bottom * fy), 0, 255).astype(np.uint8)


_TO_XYZ = np.array([[0.180423, 0.357580, 0.412453], [0.072169, 0.715160, 0.212671], [0.950227, 0.119193, 0.019334]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def bgr_to_lab(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (L 0 to 100) of 8-bit sRGB in BGR order."""
    c = bgr.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ _TO_XYZ.T / _WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def lab_to_bgr(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], -1)
    xyz = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(xyz @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.round(c * 255), 0, 255).astype(np.uint8)


def enhance(bgr: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """A night frame with its lightness equalised, colours kept."""
    lab = bgr_to_lab(bgr)
    light = np.clip(np.round(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalise(light, clip, tiles) / 2.55
    return lab_to_bgr(lab)
