"""Background models: an adaptive mixture of Gaussians, nearest stored samples, and colour histograms.

All keep a state of arrays for every pixel and give 0 (background), 127 (shadow) or 255.
They follow Zivkovic (2004), Zivkovic & van der Heijden (2006) and Godbehere et al. (2012).
Arrays go mode by mode, or sample by sample, over pixels in row order, and frames are
worked off in blocks of pixels whose state fits the processor's cache; only pixels that
their first mode or samples do not settle are looked at further.
"""

from __future__ import annotations

import numpy as np

from vigilake.pixels.masks import FOREGROUND, SHADOW

METHODS = ("MOG2", "KNN")
#: All that can be asked for; METHODS are run by default.
ALL_METHODS = (*METHODS, "GMG")
DAY_THRESHOLD, NIGHT_THRESHOLD = 16.0, 30.0


def _shadow(x: np.ndarray, mean: np.ndarray, spread: np.ndarray | float, tau: float = 0.5) -> np.ndarray:
    """Is x a darker version of the mean: between tau and 1 of its brightness and of like colour?  Channels come first."""
    dot, square = x[0] * mean[0] + x[1] * mean[1] + x[2] * mean[2], mean[0] * mean[0] + mean[1] * mean[1] + mean[2] * mean[2]
    out = (square > 0) & (dot <= square) & (dot >= tau * square)
    at = np.flatnonzero(out)
    if len(at):
        share, x, mean = dot[at] / square[at], x[:, at], mean[:, at]
        off = share * mean - x
        off *= off
        spread = spread[at] if isinstance(spread, np.ndarray) else spread
        out[at] = off[0] + off[1] + off[2] < spread * share * share
    return out


class _Model:
    """A model over frames of one size; its whole state is in the attributes that STATE names."""

    STATE: tuple[str, ...] = ()
    #: Pixels of a block.
    BLOCK = 8192

    def __init__(self, height: int, width: int, history: int, threshold: float, learning_rate: float):
        self.height, self.width, self.history, self.threshold, self.learning_rate, self.seen = height, width, history, threshold, learning_rate, 0

    def state(self) -> dict[str, np.ndarray]:
        """Numbers of one element and arrays; the latter are the model's own."""
        return {n: np.asarray(getattr(self, n)) for n in ("seen", *self.STATE)}

    def restore(self, state: dict[str, np.ndarray]) -> None:
        for name in ("seen", *self.STATE):
            value = np.asarray(state[name])
            setattr(self, name, int(value) if value.ndim == 0 else value.copy())

    def _rate(self) -> float:
        return self.learning_rate if self.learning_rate >= 0 and self.seen > 1 else 1 / min(2 * self.seen, self.history)

    def apply(self, frame: np.ndarray) -> np.ndarray:
        self.seen += 1
        planes = np.ascontiguousarray(frame.reshape(-1, 3).T)
        out = np.empty(planes.shape[1], np.uint8)
        self._begin()
        for number, begin in enumerate(range(0, planes.shape[1], self.BLOCK)):
            at = slice(begin, begin + self.BLOCK)
            self._block(number, planes[:, at], at, out[at])
        return out.reshape(self.height, self.width)

    def apply_each(self, frames: np.ndarray) -> np.ndarray:
        """Masks of frames that follow each other."""
        return np.stack([self.apply(frame) for frame in frames])

    def _begin(self) -> None:
        pass

    def _block(self, number: int, planes: np.ndarray, at: slice, out: np.ndarray) -> None:
        raise NotImplementedError


class Mixture(_Model):
    """Up to five Gaussians by pixel, kept in order of weight."""

    MODES, RATIO, FIT, START_VAR, LEAST_VAR, MOST_VAR, COMPLEXITY = 5, 0.9, 9.0, 15.0, 4.0, 75.0, 0.05
    STATE = ("weight", "variance", "mean", "used")

    def __init__(self, height: int, width: int, history: int = 500, threshold: float = DAY_THRESHOLD, learning_rate: float = -1):
        super().__init__(height, width, history, threshold, learning_rate)
        n = height * width
        self.weight = np.zeros((self.MODES, n), np.float32)
        self.variance = np.full((self.MODES, n), self.START_VAR, np.float32)
        self.mean = np.zeros((self.MODES, 3, n), np.float32)
        #: Modes with any weight, by block; all others are skipped.
        self.used = np.zeros(-(-n // self.BLOCK), np.int64)

    def _block(self, number: int, planes: np.ndarray, at: slice, out: np.ndarray) -> None:
        x, used = planes.astype(np.float32), int(self.used[number])
        weight, variance, mean = self.weight[:, at], self.variance[:, at], self.mean[:, :, at]
        off = x - mean[0]
        square = off * off
        away = square[0] + square[1] + square[2]
        alive = weight[0] > 0
        background = alive & (away < self.threshold * variance[0])
        fits = alive & (away < self.FIT * variance[0])
        # Pixels for which the first mode does not say all.
        rest = np.flatnonzero(~(background & fits))
        mode = np.zeros(0, np.int64)
        if len(rest):
            xr, wr, vr, mr = x[:, rest], weight[:used, rest], variance[:used, rest], mean[:used, :, rest]
            far = xr - mr
            far *= far
            far = far[:, 0] + far[:, 1] + far[:, 2]
            living = wr > 0
            common = living & (np.cumsum(wr, 0) - wr < self.RATIO)
            known = (common & (far < self.threshold * vr)).any(0)
            background[rest] = known
            near = living & (far < self.FIT * vr)
            mode = np.where(near.any(0), near.argmax(0), -1) if used else np.full(len(rest), -1)
        out[:] = np.where(background, 0, FOREGROUND)
        if len(rest) and used:
            strange = np.flatnonzero(~known)
            # Every pair of such a pixel and a mode that counts, in a row.
            k, pixel = np.nonzero(common[:, strange])
            pixel = strange[pixel]
            dark = _shadow(xr[:, pixel], mr[k, :, pixel].T, self.threshold * vr[k, pixel])
            out[rest[pixel[dark]]] = SHADOW
        rate = self._rate()
        if rate > 0:
            rate = np.float32(rate)
            least = rate * self.COMPLEXITY
            moved = weight[:used] * (1 - rate) - least
            moved *= weight[:used] > 0
            later = np.flatnonzero(mode > 0)
            if used:
                moved[0] += rate * fits
                moved[mode[later], rest[later]] += rate
                moved *= moved >= least
                pace = np.where(fits, rate / np.maximum(moved[0], 1e-6), 0).astype(np.float32)
                mean[0] += pace * off
                variance[0] = self._bounded(variance[0] + pace * (away - variance[0]))
            if len(later):
                k, i = mode[later], rest[later]
                pace = rate / np.maximum(moved[k, i], 1e-6)
                mean[k, :, i] += pace[:, None] * (x[:, i].T - mean[k, :, i])
                variance[k, i] = self._bounded(variance[k, i] + pace * (far[k, later] - variance[k, i]))
            new = rest[mode < 0]
            if len(new):
                if used < self.MODES:
                    used += 1
                    moved = np.concatenate([moved, np.zeros((1, moved.shape[1]), np.float32)])
                own = moved[:, new]
                slot, each = own.argmin(0), np.arange(len(new))
                own[slot, each] = 0
                left = _summed(own)
                own *= np.where(left > 0, (1 - rate) / np.maximum(left, 1e-6), 0)
                own[slot, each] = np.where(left > 0, rate, 1)
                moved[:, new] = own
                mean[slot, :, new] = x[:, new].T
                variance[slot, new] = self.START_VAR
            moved /= np.maximum(_summed(moved), 1e-6)
            # Only a mode that has just fitted or come can rise.
            risen = np.concatenate([rest[later], new])
            if len(risen):
                own = moved[:, risen]
                order = np.argsort(-own, 0, kind="stable")
                moved[:, risen] = own[order, np.arange(len(risen))]
                variance[:used, risen] = variance[order, risen]
                mean[:used, :, risen] = mean[order[:, None], np.arange(3)[:, None], risen]
            weight[:used] = moved
            if used > 1 and not moved[-1].any():
                used -= 1
            self.used[number] = used

    def _bounded(self, variance: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(variance, self.LEAST_VAR), self.MOST_VAR)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Sum over the first axis, in its order."""
    total = rows[0].copy()
    for row in rows[1:]:
        total += row
    return total


class Samples(_Model):
    """Stored samples by pixel; a pixel near two of them that count as background is background.

    Samples are replaced in turn, at a pace by the history, from a sequence of hashes of the
    frame's number, so that the same frames give the same masks.
    """

    STORED, NEAR, REACH = 21, 2, 20
    BLOCK = 16_384
    #: Pixels of a picture up to which calls cost more than what they do.
    SMALL = 512
    STATE = ("value", "counts", "filled")
    #: Before these samples it is asked again which pixels are still open.
    LOOKS = (0, 2, 3, 4, 6, 8, 11, 16)

    def __init__(self, height: int, width: int, history: int = 500, threshold: float = DAY_THRESHOLD, learning_rate: float = -1):
        super().__init__(height, width, history, threshold, learning_rate)
        self.value = np.zeros((self.STORED, 3, height * width), np.uint8)
        self.counts = np.zeros((self.STORED, height * width), bool)
        self.filled = 0

    def _begin(self) -> None:
        """Which sample this frame replaces, if any; what is stored before the frame decides about it."""
        self.known, self.slot = self.filled, None
        rate = self._rate()
        if rate <= 0:
            return
        if self.filled < self.STORED:
            self.slot, self.filled = self.filled, self.filled + 1
            return
        turn = (self.seen * 2654435761) & 0xFFFFFFFF
        if turn / 2**32 < min(1.0, rate * self.STORED):
            self.slot = (turn >> 7) % self.STORED

    def _close(self, x: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Is the distance below REACH?  Differences are cut off at REACH, so that squares fit into 16 bits."""
        apart = np.maximum(x, value) - np.minimum(x, value)
        np.minimum(apart, self.REACH, out=apart)
        square = np.multiply(apart, apart, dtype=np.uint16)
        return square[..., 0, :] + square[..., 1, :] + square[..., 2, :] < self.REACH * self.REACH

    def _block(self, number: int, planes: np.ndarray, at: slice, out: np.ndarray) -> None:
        value, counts, known = self.value[:, :, at], self.counts[:, at], self.known
        near, settled = np.zeros(planes.shape[1], np.uint8), np.zeros(planes.shape[1], np.uint8)
        need = min(self.NEAR, max(1, known))
        open_: np.ndarray | slice = slice(None)
        for k in range(known):
            # The pixels still open are gathered anew while that saves work.
            if k in self.LOOKS:
                open_ = np.flatnonzero((near < self.NEAR) | (settled < need))
                if not len(open_):
                    break
                if 6 * len(open_) > len(near):
                    open_ = slice(None)
                x = planes[:, open_]
            close = self._close(x, value[k][:, open_])
            near[open_] += close
            settled[open_] += close & counts[k, open_]
        background = settled >= need if known else np.zeros(len(near), bool)
        out[:] = np.where(background, 0, FOREGROUND)
        strange = np.flatnonzero(~background)
        if len(strange) and known:
            # Every pair of an open pixel and a stored sample that counts, in a row.
            sample, pixel = np.nonzero(counts[:known, strange])
            x = planes[:, strange].astype(np.float32)[:, pixel]
            dark = _shadow(x, value[sample, :, strange[pixel]].T.astype(np.float32), float(self.REACH * self.REACH))
            out[strange[pixel[dark]]] = SHADOW
        if self.slot is not None:
            value[self.slot] = planes
            counts[self.slot] = (near >= self.NEAR) | (self.filled <= self.NEAR)

    def apply_each(self, frames: np.ndarray) -> np.ndarray:
        """Small pictures are compared many frames at once: which frame a sample is does not depend on what the frames show."""
        pixels = self.height * self.width
        if not 0 < pixels <= self.SMALL:
            return super().apply_each(frames)
        step = max(1, (1 << 20) // (self.STORED * pixels))
        return np.concatenate([self._small(frames[i : i + step]) for i in range(0, len(frames), step)])

    def _small(self, frames: np.ndarray) -> np.ndarray:
        n, pixels = len(frames), self.height * self.width
        planes = np.ascontiguousarray(frames.reshape(n, pixels, 3).transpose(0, 2, 1))
        known, filled, written = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64), np.full((n + 1, self.STORED), -1)
        for i in range(n):
            self.seen += 1
            self._begin()
            known[i], filled[i] = self.known, self.filled
            if self.slot is not None:
                written[i + 1, self.slot] = i
        # Samples from before these frames, then the frames; which of them each slot has when a frame comes, and at the end.
        value = np.concatenate([self.value, planes])
        written = np.maximum.accumulate(written, 0)
        source = np.where(written < 0, np.arange(self.STORED), written + self.STORED)
        there = np.arange(self.STORED) < known
        close = np.empty((self.STORED, n, pixels), bool)
        for k in range(self.STORED):
            close[k] = self._close(planes, value[source[:n, k]]) & there[:, k, None]
        counts = np.concatenate([self.counts, (close.sum(0) >= self.NEAR) | (filled <= self.NEAR)])
        settled = np.zeros((n, pixels), np.uint8)
        for k in range(self.STORED):
            settled += close[k] & counts[source[:n, k]]
        background = (settled >= np.minimum(self.NEAR, np.maximum(1, known))) & (known > 0)
        out = np.where(background, 0, FOREGROUND).astype(np.uint8)
        for k in range(self.STORED):
            frame, pixel = np.nonzero(~background & counts[source[:n, k]] & there[:, k, None])
            x, mean = planes[frame, :, pixel].T.astype(np.float32), value[source[frame, k], :, pixel].T.astype(np.float32)
            dark = _shadow(x, mean, float(self.REACH * self.REACH))
            out[frame[dark], pixel[dark]] = SHADOW
        self.value[:], self.counts[:] = value[source[n]], counts[source[n]]
        return out.reshape(n, self.height, self.width)


class Histograms(_Model):
    """Weighted colours by pixel; Bayes' rule on the share of the pixel's colour tells background.

    The first START frames only teach the model.  Afterwards colours lose weight at RATE,
    the pixel's own gains it, and a pixel is foreground if the posterior of it, from a prior
    of PRIOR for background, is above DECISION.  The lightest of MOST colours makes room.
    """

    MOST, LEVELS, START, RATE, PRIOR, DECISION = 64, 16, 120, 0.025, 0.8, 0.8
    BLOCK = 4096
    STATE = ("colour", "share", "number")

    def __init__(self, height: int, width: int, history: int = 500, threshold: float = DAY_THRESHOLD, learning_rate: float = -1, start: int | None = None):
        super().__init__(height, width, history, threshold, learning_rate)
        self.start = self.START if start is None else start
        #: Colours in the order of their first use; the first ``number`` of a pixel are in use.
        self.colour = np.full((self.MOST, height * width), -1, np.int16)
        self.share = np.zeros((self.MOST, height * width), np.float32)
        self.number = np.zeros(height * width, np.int16)

    def _block(self, number: int, planes: np.ndarray, at: slice, out: np.ndarray) -> None:
        colour, share, held = self.colour[:, at], self.share[:, at], self.number[at]
        step = np.uint8(256 // self.LEVELS)
        own = ((planes[0] // step).astype(np.int16) * self.LEVELS + planes[1] // step) * self.LEVELS + planes[2] // step
        most = int(held.max(initial=0))
        same = colour[:most] == own
        found = same.any(0)
        place = np.where(found, same.argmax(0) if most else 0, 0)
        each = np.arange(len(own))
        learning = self.seen <= self.start
        if learning:
            out[:] = 0
        else:
            p = np.where(found, share[place, each], 0).astype(np.float32)
            behind = p * np.float32(self.PRIOR)
            posterior = 1 - behind / (behind + (1 - p) * np.float32(1 - self.PRIOR))
            out[:] = np.where(posterior > self.DECISION, FOREGROUND, 0)
        rate = np.float32(self.learning_rate if self.learning_rate >= 0 else self.RATE)
        if learning:
            gain = np.float32(1)
        elif rate > 0:
            share[:most] *= 1 - rate
            gain = rate
        else:
            return
        share[place[found], each[found]] += gain
        new = np.flatnonzero(~found)
        if len(new):
            slot = held[new].astype(np.int64)
            full = slot >= self.MOST
            slot[full] = share[:, new[full]].argmin(0)
            colour[slot, new], share[slot, new] = own[new], gain
            held[new] += ~full
        if not learning or self.seen == self.start:
            most = int(held.max(initial=0))
            share[:most] /= np.maximum(share[:most].sum(0), np.float32(1e-6))


def part_of_state(state: dict[str, np.ndarray], size: tuple[int, int], y: int, x: int, h: int, w: int) -> dict[str, np.ndarray]:
    """The state of a part of a picture, h by w from (y, x) on, out of that of the whole of ``size``."""
    out = {}
    for name, value in state.items():
        if name == "used":
            value = np.full(-(-h * w // Mixture.BLOCK), value.max(initial=0), value.dtype)
        elif value.ndim:
            value = value.reshape(*value.shape[:-1], *size)[..., y : y + h, x : x + w].reshape(*value.shape[:-1], h * w)
        out[name] = value
    return out


def background_model(method: str, height: int, width: int, night: bool = False, var_threshold: float | None = None, **options):
    """A fresh model; an explicit ``var_threshold`` goes before the day and night ones."""
    if method not in ALL_METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(ALL_METHODS)}")
    threshold = var_threshold if var_threshold is not None else NIGHT_THRESHOLD if night else DAY_THRESHOLD
    return {"MOG2": Mixture, "KNN": Samples, "GMG": Histograms}[method](height, width, threshold=threshold, **options)
