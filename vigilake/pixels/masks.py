"""Mask cleanup, packing and shares."""

from __future__ import annotations

import numpy as np

SHADOW, FOREGROUND = 127, 255
#: Values above this are foreground; shadows are not.
THRESHOLD = 200


def ellipse(size: int = 5) -> np.ndarray:
    """Filled ellipse in a size by size square, as booleans."""
    r = size // 2
    rows = np.arange(size) - r
    half = np.round(r * np.sqrt(np.maximum(0.0, 1 - (rows / max(r, 1)) ** 2))).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= half[:, None]


def _add_shifted(out: np.ndarray, mask: np.ndarray, dy: int, dx: int) -> None:
    """out |= mask moved by (dy, dx); what leaves the picture is lost.  Pictures may be stacked over the first axes."""
    h, w = mask.shape[-2:]
    if abs(dy) < h and abs(dx) < w:
        out[..., max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)] |= mask[..., max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Union over the kernel, whose rows are centred runs; nothing beyond the border.

    The mask is widened step by step, and each row of the kernel takes the width it needs.
    """
    r = kernel.shape[0] // 2
    half = kernel.sum(1) // 2
    out, wide = np.zeros_like(mask), mask.copy()
    for reach in range(int(half.max()) + 1):
        if reach:
            _add_shifted(wide, mask, 0, reach)
            _add_shifted(wide, mask, 0, -reach)
        for dy in np.flatnonzero((half == reach) & kernel[:, r]) - r:
            _add_shifted(out, wide, int(dy), 0)
    return out


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Intersection over the kernel; the border counts as set."""
    return ~dilate(~mask, kernel)


def clean(raw: np.ndarray, kernel_size: int = 5) -> np.ndarray:
    """Foreground without shadows, holes closed, then specks opened away; boolean."""
    return clean_foreground(raw > THRESHOLD, kernel_size)


def clean_foreground(mask: np.ndarray, kernel_size: int = 5) -> np.ndarray:
    """Holes closed, then specks opened away; of one mask or of a stack of them."""
    kernel = ellipse(kernel_size)
    mask = erode(dilate(mask, kernel), kernel)
    return dilate(erode(mask, kernel), kernel)


def coverage(mask: np.ndarray) -> float:
    return float(np.count_nonzero(mask)) / mask.size if mask.size else 0.0


def pack(mask: np.ndarray) -> bytes:
    """One bit a pixel, row-major."""
    return np.packbits(mask.astype(bool).ravel()).tobytes()


def unpack(data: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=height * width).reshape(height, width).astype(bool)


def packed_coverage(data: bytes, height: int, width: int) -> float:
    n = height * width
    return float(np.bitwise_count(np.frombuffer(data, np.uint8)).sum()) / n if n else 0.0
