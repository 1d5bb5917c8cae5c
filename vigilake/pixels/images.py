"""Pictures from their files: PNG and BMP, as BGR.

PNG's filters predict a byte from those to the left and above.  Rows that use the left or
the upper one alone are sums; where averages or Paeth's predictor occur, the picture is
worked off by diagonals, all of whose bytes know their neighbours by then.
"""

from __future__ import annotations

import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type: grey, colour, palette, grey and alpha, colour and alpha.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """Height by width by BGR; alpha is dropped, grey repeated.  ValueError for what cannot be read."""
    if data[:8] == _PNG:
        return _png(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither PNG nor BMP")


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or not packed:
        raise ValueError("no picture in the PNG file")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    if depth not in (8, 16) or colour not in _CHANNELS or interlaced:
        raise ValueError("PNG of this depth or order is not read")
    step = _CHANNELS[colour] * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    except (zlib.error, ValueError) as error:
        raise ValueError("broken PNG data") from error
    pixels = unfilter(raw[:, 1:].reshape(height, width, step), raw[:, 0])[:, :, :: depth // 8]
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ValueError("PNG palette is missing")
        pixels = palette[pixels[:, :, 0]]
    if pixels.shape[2] < 3:
        return np.repeat(pixels[:, :, :1], 3, 2)
    return np.ascontiguousarray(pixels[:, :, 2::-1])


def unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bytes (height, width, step) of filtered rows: 0 none, 1 left, 2 above, 3 their mean, 4 Paeth."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    if kinds.max(initial=0) > 2:
        return _by_diagonals(rows, kinds)
    out = rows.copy()
    for y, kind in enumerate(kinds.tolist()):
        if kind == 1:
            np.cumsum(rows[y], 0, dtype=np.uint8, out=out[y])
        elif kind == 2 and y:
            out[y] += out[y - 1]
    return out


def _by_diagonals(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Diagonal d holds the bytes of row y at d - y; left and above are on d - 1, the corner is on d - 2."""
    height, width, step = rows.shape
    total = height + width - 1
    # Two empty diagonals and an empty row in front are what lies outside.
    skewed = np.zeros((total + 2, height + 1, step), np.int16)
    y, x = np.indices((height, width))
    given = np.zeros((total, height, step), np.int16)
    given[y + x, y] = rows
    inside = np.zeros((total, height, 1), bool)
    inside[y + x, y] = True
    one, two, three, four = ((kinds == k)[:, None] for k in (1, 2, 3, 4))
    for d in range(total):
        left, up, corner = skewed[d + 1, 1:], skewed[d + 1, :-1], skewed[d, :-1]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = left * one + up * two + ((left + up) >> 1) * three + paeth * four
        skewed[d + 2, 1:] = ((given[d] + guess) & 255) * inside[d]
    return skewed[y + x + 2, y + 1].astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    word = lambda at, n=4: int.from_bytes(data[at : at + n], "little", signed=True)
    begin, width, height, bits, packing = word(10), word(18), word(22), word(28, 2), word(30)
    if bits not in (24, 32) or packing not in (0, 3) or width <= 0:
        raise ValueError("BMP of this kind is not read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), begin).reshape(abs(height), stride)
    pixels = rows[:: -1 if height > 0 else 1, : width * bits // 8].reshape(abs(height), width, bits // 8)
    return np.ascontiguousarray(pixels[:, :, :3])
