"""Quality of frames: PSNR, SSIM, and resizing before them."""

from __future__ import annotations

import numpy as np


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape != b.shape:
        raise ValueError("frames differ in size")
    mse = float(((a.astype(np.float64) - b) ** 2).mean())
    return float("inf") if mse == 0 else 10 * np.log10(65025.0 / mse)


def grey(bgr: np.ndarray) -> np.ndarray:
    return bgr if bgr.ndim == 2 else bgr @ np.array([0.114, 0.587, 0.299])


def _window_means(x: np.ndarray, size: int) -> np.ndarray:
    sums = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / (size * size)


def ssim(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean structural similarity of grey values over all windows (Wang et al., 2004), sample covariances."""
    if a.shape != b.shape:
        raise ValueError("frames differ in size")
    x, y = grey(a).astype(np.float64), grey(b).astype(np.float64)
    size = min(size, *x.shape)
    n = size * size
    unbiased = n / max(1, n - 1)
    mx, my = _window_means(x, size), _window_means(y, size)
    vx = unbiased * (_window_means(x * x, size) - mx * mx)
    vy = unbiased * (_window_means(y * y, size) - my * my)
    vxy = unbiased * (_window_means(x * y, size) - mx * my)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def resize(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = frame.shape[:2]
    if (h, w) == (height, width):
        return frame
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if frame.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    f = frame.astype(np.float64)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    bottom = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.clip(np.round(top * (1 - fy) + bottom * fy), 0, 255).astype(np.uint8)
