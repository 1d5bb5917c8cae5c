"""Packing a segment's frames: quantise by tier, difference to the frame before, zlib.

Not a video codec; its sizes compare with each other only.
"""

from __future__ import annotations

import zlib

import numpy as np


def step_of(tier: int) -> int:
    """Quantiser step of a tier: 1 at 18 and below, doubling every 6 above."""
    return max(1, round(2 ** ((tier - 18) / 6)))


class Packer:
    """Packs frames of one segment one after another."""

    def __init__(self, tier: int):
        self.step = step_of(tier)
        self.last: np.ndarray | None = None

    def pack(self, frame: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the frame, and the frame as it comes back."""
        level = (frame // self.step).astype(np.uint8)
        delta = level if self.last is None else level - self.last
        self.last = level
        back = np.minimum(level.astype(np.int32) * self.step + self.step // 2, 255).astype(np.uint8)
        return zlib.compress(delta.tobytes(), 6), back


def unpack(parts: list[bytes], shape: tuple[int, ...], tier: int) -> list[np.ndarray]:
    step, last, out = step_of(tier), None, []
    for part in parts:
        delta = np.frombuffer(zlib.decompress(part), np.uint8).reshape(shape)
        last = delta if last is None else delta + last
        out.append(np.minimum(last.astype(np.int32) * step + step // 2, 255).astype(np.uint8))
    return out
