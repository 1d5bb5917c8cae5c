import numpy as np
import pytest

from vigilake.pixels import enhance, masks, metrics, models, packing, regions


def blank(h=120, w=160):
    return np.zeros((h, w, 3), np.uint8)


def with_block(x, y, w, h, value=200, size=(120, 160)):
    frame = blank(*size)
    frame[y : y + h, x : x + w] = value
    return frame


def trained(method, n=30, **options):
    model = models.background_model(method, 120, 160, history=50, **options)
    for _ in range(n):
        model.apply(blank())
    return model


@pytest.mark.parametrize("method", models.METHODS)
def test_static_scene_has_no_foreground_and_objects_have(method):
    model = trained(method)
    assert not masks.clean(model.apply(blank())).any()
    mask = masks.clean(model.apply(with_block(50, 40, 40, 50)))
    assert mask[50:80, 60:80].all() and not mask[:30].any()
    assert masks.coverage(masks.clean(trained(method).apply(np.full((120, 160, 3), 255, np.uint8)))) > 0.9


@pytest.mark.parametrize("method", models.METHODS)
def test_shadows_are_marked_and_then_removed(method):
    model = models.background_model(method, 40, 40, history=50)
    bright = np.full((40, 40, 3), 150, np.uint8)
    for _ in range(40):
        model.apply(bright)
    dim = bright.copy()
    dim[10:30, 10:30] = 100
    raw = model.apply(dim)
    assert set(np.unique(raw)) <= {0, 127, 255} and (raw == 127).any()
    assert not masks.clean(raw).any()


def test_frozen_model_does_not_absorb_and_a_fast_one_does():
    frozen, fast = trained("MOG2"), trained("MOG2")
    frozen.learning_rate, fast.learning_rate = 0, 1
    block = with_block(50, 40, 40, 50)
    for _ in range(3):
        still, gone = frozen.apply(block), fast.apply(block)
    assert still[60, 60] == 255 and gone[60, 60] == 0


def test_unknown_method_is_an_error():
    with pytest.raises(ValueError):
        models.background_model("MOG", 4, 4)


def moving_clip(h, w, n, seed=1, noise=9):
    rng = np.random.default_rng(seed)
    base = rng.integers(30, 220, (h, w, 3))
    for i in range(n):
        frame = base + rng.normal(0, noise, (h, w, 3))
        frame[h // 4 : h // 2, (3 * i) % w :][:, :6] = 210 if i % 5 else rng.integers(0, 255, 3)
        frame[h // 2 :, :4] *= 0.7
        yield np.clip(frame, 0, 255).astype(np.uint8)


def plain_mixture(frames, history, threshold):
    """Zivkovic's mixture, pixel by pixel and mode by mode."""
    one = np.float32
    modes = {}
    for t, frame in enumerate(frames, 1):
        rate = one(1 / min(2 * t, history))
        out = np.zeros(frame.shape[:2], np.uint8)
        for place in np.ndindex(*frame.shape[:2]):
            x = frame[place].astype(np.float32)
            held = modes.setdefault(place, [])
            background, dark, total, fit = False, False, one(0), None
            for mode in held:
                w, v, m = mode
                off = x - m
                far = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
                total += w
                if total - w < one(0.9):
                    background |= bool(far < threshold * v)
                    dot, square = x[0] * m[0] + x[1] * m[1] + x[2] * m[2], m[0] * m[0] + m[1] * m[1] + m[2] * m[2]
                    if square > 0 and 0.5 * square <= dot <= square:
                        share = dot / square
                        d = share * m - x
                        dark |= bool(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < one(threshold) * v * share * share)
                if fit is None and far < one(9) * v:
                    fit = mode
            out[place] = 0 if background else 127 if dark else 255
            for mode in held:
                mode[0] = mode[0] * (1 - rate) - rate * 0.05 + (rate if mode is fit else one(0))
            held[:] = [m for m in held if m[0] >= rate * 0.05]
            if fit is not None:
                off = x - fit[2]
                far, pace = off[0] * off[0] + off[1] * off[1] + off[2] * off[2], rate / fit[0]
                fit[1] = np.clip(fit[1] + pace * (far - fit[1]), one(4), one(75))
                fit[2] = fit[2] + pace * off
            else:
                if len(held) == 5:
                    held.pop(min(range(5), key=lambda i: held[i][0]))
                left = sum((m[0] for m in held), one(0))
                for mode in held:
                    mode[0] = mode[0] * ((1 - rate) / left)
                held.append([rate if held else one(1), one(15), x])
            total = sum((m[0] for m in held), one(0))
            for mode in held:
                mode[0] = mode[0] / total
            held.sort(key=lambda m: -m[0])
        yield out


@pytest.mark.parametrize("threshold", [5.0, 16.0])
def test_mixture_equals_a_plain_loop(threshold):
    clip = list(moving_clip(9, 11, 50))
    model = models.Mixture(9, 11, history=30, threshold=threshold)
    assert all((model.apply(f) == m).all() for f, m in zip(clip, plain_mixture(clip, 30, threshold), strict=True))


def test_samples_equal_a_plain_loop():
    clip = list(moving_clip(9, 11, 60, noise=6))
    model, stored, seen = models.Samples(9, 11, history=40), [], 0
    for frame in clip:
        seen += 1
        x = frame.astype(np.int64)
        near = [((x - s) ** 2).sum(-1) < 400 for s, _ in stored]
        counted = sum((n & c).astype(int) for n, (_, c) in zip(near, stored, strict=True)) if stored else np.zeros((9, 11))
        background = (counted >= min(2, max(1, len(stored)))) & bool(stored)
        dark = np.zeros((9, 11), bool)
        for s, c in stored:
            dot, square = (x * s).sum(-1), (s * s).sum(-1)
            share = np.divide(dot, square, out=np.zeros((9, 11)), where=square > 0)
            dark |= c & (square > 0) & (dot <= square) & (2 * dot >= square) & (((share[..., None] * s - x) ** 2).sum(-1) < 400 * share * share)
        want = np.where(background, 0, np.where(dark, 127, 255))
        assert (model.apply(frame) == want).mean() > 0.995  # a shadow at the very edge may round otherwise
        familiar = sum(n.astype(int) for n in near) >= 2 if near else np.zeros((9, 11), bool)
        turn = (seen * 2654435761) & 0xFFFFFFFF
        if len(stored) < 21:
            stored.append((x, familiar | (len(stored) < 2)))
        elif turn / 2**32 < min(1.0, 21 / min(2 * seen, 40)):
            stored[(turn >> 7) % 21] = (x, familiar)


def test_histograms_equal_a_plain_loop():
    clip = list(moving_clip(7, 9, 80, noise=20))
    model = models.Histograms(7, 9, start=12)
    held = {place: {} for place in np.ndindex(7, 9)}
    for t, frame in enumerate(clip, 1):
        got = model.apply(frame)
        for place, shares in held.items():
            colour = tuple(int(c) // 16 for c in frame[place])
            if t <= 12:
                assert got[place] == 0
                shares[colour] = shares.get(colour, 0) + 1
            else:
                p = shares.get(colour, 0.0)
                posterior = 1 - p * 0.8 / (p * 0.8 + (1 - p) * 0.2)
                assert abs(posterior - 0.8) < 1e-4 or (got[place] == 255) == (posterior > 0.8)
                for c in shares:
                    shares[c] *= 1 - 0.025
                if colour not in shares and len(shares) == 64:
                    del shares[min(shares, key=shares.get)]
                shares[colour] = shares.get(colour, 0) + 0.025
            if t >= 12:
                total = sum(shares.values())
                for c in shares:
                    shares[c] /= total


@pytest.mark.parametrize("method", models.ALL_METHODS)
def test_a_restored_model_goes_on_alike(method):
    clip = list(moving_clip(20, 30, 150))
    model = models.background_model(method, 20, 30, history=50)
    for frame in clip[:130]:
        model.apply(frame)
    other = models.background_model(method, 20, 30, history=50)
    other.restore({k: v.copy() for k, v in model.state().items()})
    assert all((model.apply(f) == other.apply(f)).all() for f in clip[130:])


def test_night_threshold_and_explicit_one():
    assert models.background_model("MOG2", 2, 2).threshold == 16
    assert models.background_model("MOG2", 2, 2, night=True).threshold == 30
    assert models.background_model("MOG2", 2, 2, night=True, var_threshold=5).threshold == 5


def naive(mask, kernel, erode):
    r = kernel.shape[0] // 2
    out = np.zeros_like(mask)
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            near = [
                mask[y + i - r, x + j - r]
                for i in range(kernel.shape[0])
                for j in range(kernel.shape[1])
                if kernel[i, j] and 0 <= y + i - r < mask.shape[0] and 0 <= x + j - r < mask.shape[1]
            ]
            out[y, x] = all(near) if erode else any(near)
    return out


def test_morphology_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    kernel = masks.ellipse(5)
    assert kernel.sum() == 17
    for p in (0.3, 0.7, 0.95):
        mask = rng.random((17, 23)) < p
        assert (masks.dilate(mask, kernel) == naive(mask, kernel, False)).all()
        assert (masks.erode(mask, kernel) == naive(mask, kernel, True)).all()


def test_packing_masks():
    mask = np.random.default_rng(0).random((13, 7)) < 0.4
    assert (masks.unpack(masks.pack(mask), 13, 7) == mask).all()
    assert masks.packed_coverage(masks.pack(mask), 13, 7) == masks.coverage(mask)
    assert masks.coverage(np.zeros((0, 0), bool)) == 0.0 == masks.packed_coverage(b"", 0, 0)


def flood(mask):
    seen, blobs = np.zeros_like(mask), []
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            stack, blob = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                blob.append((a, b))
                for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            stack.append((i, j))
            blobs.append(frozenset(blob))
    return set(blobs)


def test_connected_blobs_match_a_flood_fill():
    rng = np.random.default_rng(5)
    for p in (0.1, 0.4, 0.6):
        mask = rng.random((20, 31)) < p
        labels, n = regions.label_runs(mask)
        assert {frozenset(map(tuple, np.argwhere(labels == k))) for k in range(1, n + 1)} == {frozenset(map(tuple, b)) for b in flood(mask)}


def test_regions_area_holes_order_and_padding():
    mask = np.zeros((480, 640), bool)
    mask[100:200, 50:250] = True
    mask[120:180, 80:200] = False
    mask[140:150, 100:110] = True
    mask[300:330, 300:330] = True
    mask[400:410, 10:20] = True
    assert regions.contour_area(mask[100:200, 50:250]) == 199 * 99
    found = regions.regions(mask, min_area=500, pad=20)
    assert [r[:4] for r in found] == [(30, 80, 240, 140), (280, 280, 70, 70)]
    assert found[0][4] == 240 * 140
    assert regions.regions(np.zeros((10, 10), bool)) == []
    corner = np.zeros((480, 640), bool)
    corner[460:480, 600:640] = True
    (x, y, w, h, _), *_ = regions.regions(corner, 100, 20)
    assert x + w == 640 and y + h == 480
    assert regions.regions(corner, min_area=5000) == []


def test_psnr_and_ssim():
    a, b = np.zeros((100, 100, 3), np.uint8), np.full((100, 100, 3), 255, np.uint8)
    assert metrics.psnr(a, a) == float("inf") and metrics.ssim(a, a) == pytest.approx(1.0)
    assert metrics.psnr(a, b) < 10 and metrics.ssim(a, b) < 0.1
    with pytest.raises(ValueError):
        metrics.psnr(a, a[:50])
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (12, 15)).astype(np.uint8), rng.integers(0, 256, (12, 15)).astype(np.uint8)
    c1, c2, scores = 6.5025, 58.5225, []
    for i in range(6):
        for j in range(9):
            p, q = x[i : i + 7, j : j + 7].astype(float), y[i : i + 7, j : j + 7].astype(float)
            cov = ((p - p.mean()) * (q - q.mean())).sum() / 48
            scores.append((2 * p.mean() * q.mean() + c1) * (2 * cov + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var(ddof=1) + q.var(ddof=1) + c2)))
    assert metrics.ssim(x, y) == pytest.approx(np.mean(scores))


def test_resize_keeps_flat_pictures_and_sizes():
    assert (metrics.resize(np.full((10, 14, 3), 77, np.uint8), 5, 9) == 77).all()
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    half = metrics.resize(ramp, 4, 10)
    assert half.shape == (4, 10) and (np.diff(half[0].astype(int)) > 0).all()


def test_equalise_spreads_contrast_and_keeps_shape():
    rng = np.random.default_rng(2)
    dark = rng.integers(10, 40, (61, 83)).astype(np.uint8)
    out = enhance.equalise(dark)
    assert out.shape == dark.shape and out.std() > dark.std()
    night = np.repeat(dark[..., None], 3, 2)
    assert enhance.enhance(night).shape == night.shape
    colours = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert np.abs(enhance.lab_to_bgr(enhance.bgr_to_lab(colours)).astype(int) - colours).max() <= 1


@pytest.mark.parametrize("tier", [18, 30, 40])
def test_packing_gives_back_within_a_step(tier):
    rng = np.random.default_rng(4)
    frames = [rng.integers(0, 256, (16, 16, 3)).astype(np.uint8) for _ in range(4)]
    packer = packing.Packer(tier)
    parts, backs = zip(*[packer.pack(f) for f in frames])
    for frame, back, again in zip(frames, backs, packing.unpack(list(parts), (16, 16, 3), tier)):
        assert (back == again).all() and np.abs(back.astype(int) - frame).max() <= packing.step_of(tier)
    assert tier > 18 or all((f == b).all() for f, b in zip(frames, backs))


def small_frames(n=120, h=6, w=5, seed=4):
    rng = np.random.default_rng(seed)
    frames = np.clip(rng.normal(120, 35, (n, h, w, 3)), 0, 255)
    frames[n // 2 :] *= 0.6
    return frames.astype(np.uint8)


@pytest.mark.parametrize("method", models.ALL_METHODS)
@pytest.mark.parametrize("rate", [-1, 0, 0.3])
def test_frames_together_give_what_they_give_one_by_one(method, rate):
    frames = small_frames()
    one, many = (models.background_model(method, 6, 5, history=20, learning_rate=rate) for _ in range(2))
    want = np.stack([one.apply(f) for f in frames])
    cuts = [0, 1, 4, 30, 31, len(frames)]
    assert np.array_equal(np.concatenate([many.apply_each(frames[a:b]) for a, b in zip(cuts, cuts[1:])]), want)
    assert all(np.array_equal(v, many.state()[k]) for k, v in one.state().items())
    assert method == "GMG" or rate == 0 or len(np.unique(want)) == 3


def test_small_pictures_are_not_compared_frame_by_frame(monkeypatch):
    calls = []
    close = models.Samples._close
    monkeypatch.setattr(models.Samples, "_close", lambda *a: calls.append(1) or close(*a))
    models.Samples(6, 5, history=20).apply_each(small_frames(400))
    assert len(calls) == models.Samples.STORED
    # Pictures too large for that go one by one.
    large = small_frames(3, 30, 30)
    one, many = models.Samples(30, 30), models.Samples(30, 30)
    assert np.array_equal(many.apply_each(large), np.stack([one.apply(f) for f in large]))


@pytest.mark.parametrize("method", models.ALL_METHODS)
def test_a_part_goes_on_from_the_state_of_the_whole(method):
    frames = small_frames()
    whole, part, want = (models.background_model(method, *size, history=20) for size in ((6, 5), (3, 2), (6, 5)))
    whole.apply_each(frames[:60])
    part.restore(models.part_of_state(whole.state(), (6, 5), 2, 3, 3, 2))
    want.restore(whole.state())
    assert np.array_equal(part.apply_each(frames[60:, 2:5, 3:5]), want.apply_each(frames[60:])[:, 2:5, 3:5])


def test_masks_in_a_stack_do_not_touch():
    rng = np.random.default_rng(5)
    stack = rng.random((40, 7, 9)) < 0.6
    stack[0], stack[1], stack[2] = True, False, True
    for least, pad in ((1, 1), (0, 2), (6, 0)):
        assert regions.regions_each(stack, least, pad) == [regions.regions(m, least, pad) for m in stack]
    assert regions.regions_each(stack, 1, 0)[:3] == [[(0, 0, 9, 7, 63)], [], [(0, 0, 9, 7, 63)]]
    assert np.array_equal(masks.clean_foreground(stack), np.stack([masks.clean(m * np.uint8(255)) for m in stack]))
