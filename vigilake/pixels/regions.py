"""Bounding regions of a mask: 8-connected blobs with holes filled.

A picture with a border of background is cut into runs, foreground and background alike;
runs that touch in neighbouring rows are joined by pointer jumping over all pairs at once.
Every component but the outermost lies inside the one to the left of its first run, so
that a blob's holes, and all in them, are found by following that up.
"""

from __future__ import annotations

import numpy as np


def _components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bordered mask: flat starts of runs, their lengths, their foreground flags and the first run of their component.

    Foreground touches at corners if ``diagonal``, background otherwise.
    """
    bordered = np.pad(mask.astype(bool), 1)
    width = bordered.shape[1]
    flat = bordered.ravel()
    change = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    starts = np.union1d(change, np.arange(0, len(flat), width))
    lengths = np.diff(np.append(starts, len(flat)))
    full = flat[starts]
    inside = starts < len(flat) - width
    # At the picture's edge a corner leads into another row, whose run there is border like this one.
    reach = (full == diagonal)[inside]
    low = np.searchsorted(starts, starts[inside] + width - reach, "right") - 1
    high = np.searchsorted(starts, starts[inside] + lengths[inside] + width - 1 + reach, "right")
    many = high - low
    above = np.repeat(np.flatnonzero(inside), many)
    below = np.arange(len(above)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    alike = full[above] == full[below]
    return starts, lengths, full, _joined(len(starts), above[alike], below[alike])


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's set, given pairs of members."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def label_runs(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1.. of connected pixels in the order of their first pixels, 0 elsewhere; and how many."""
    _, lengths, full, first = _components(mask, diagonal)
    labels, names = _painted(mask.shape, lengths, np.where(full, first, 0))
    return labels[1:-1, 1:-1], len(names)


def _painted(shape: tuple[int, int], lengths: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bordered picture of the runs' names, numbered from 1; and the names.  Name 0 is the background."""
    names = np.unique(name[name > 0])
    number = np.where(name > 0, np.searchsorted(names, name) + 1, 0).astype(np.int32)
    return np.repeat(number, lengths).reshape(shape[0] + 2, shape[1] + 2), names


def filled_blobs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels from 1 of the blobs that no other one encloses, with all inside them; their contour areas; (x0, y0, x1, y1).

    The area is that of the polygon through the centres of the outline's pixels; a w by h
    block has (w-1)(h-1).  It is counted over squares of four pixels: whole ones and halves.
    """
    starts, lengths, full, first = _components(mask)
    around = np.arange(len(first))
    roots = np.unique(first)[1:]
    outside = first[roots - 1]
    around[roots] = np.where(outside == 0, roots, outside)
    while True:
        up = around[around]
        if (up == around).all():
            break
        around = up
    name = around[first]
    labels, names = _painted(mask.shape, lengths, name)
    some = labels > 0
    squares = some[:-1, :-1].astype(np.int8) + some[1:, :-1] + some[:-1, 1:] + some[1:, 1:]
    y, x = np.nonzero(squares >= 3)
    # Two blobs never meet in a square, and three of its pixels leave no diagonal empty.
    owner = np.maximum(labels[y, x], labels[y + 1, x + 1])
    areas = np.bincount(owner, np.where(squares[y, x] == 4, 1.0, 0.5), len(names) + 1)[1:]
    width = mask.shape[1] + 2
    own = full & (name > 0)
    who, x0, y0 = np.searchsorted(names, name[own]), starts[own] % width - 1, starts[own] // width - 1
    boxes = np.repeat([[mask.shape[1], mask.shape[0], 0, 0]], len(names), 0)
    for column, value, take in ((0, x0, np.minimum), (1, y0, np.minimum), (2, x0 + lengths[own], np.maximum), (3, y0 + 1, np.maximum)):
        take.at(boxes[:, column], who, value)
    return labels[1:-1, 1:-1], areas, boxes


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with everything that the outside cannot reach sideways."""
    return filled_blobs(mask)[0] > 0


def contour_area(mask: np.ndarray) -> float:
    """Contour areas of all blobs together."""
    return float(filled_blobs(mask)[1].sum())


def regions(mask: np.ndarray, min_area: float = 500, pad: int = 20) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of padded boxes, largest first (then left, then up).

    Blobs whose contour area is below ``min_area`` are dropped; the area given is the padded
    box's.  Blobs inside the hole of another are part of it.
    """
    return regions_each(mask[None], min_area, pad)[0]


def regions_each(stack: np.ndarray, min_area: float = 500, pad: int = 20) -> list[list[tuple[int, int, int, int, int]]]:
    """The regions of every mask of a stack: one tall picture, with an empty row below each mask so that no blob goes on."""
    n, h, w = stack.shape
    tall = np.zeros((n, h + 1, w), bool)
    tall[:, :h] = stack
    _, areas, boxes = filled_blobs(tall.reshape(n * (h + 1), w))
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(n)]
    for x0, y0, x1, y1 in boxes[areas >= min_area].tolist():
        number, y0 = divmod(y0, h + 1)
        y1 -= number * (h + 1)
        left, top, right, bottom = max(0, x0 - pad), max(0, y0 - pad), min(w, x1 + pad), min(h, y1 + pad)
        out[number].append((left, top, right - left, bottom - top, (right - left) * (bottom - top)))
    return [sorted(found, key=lambda r: (-r[4], r[0], r[1])) for found in out]
