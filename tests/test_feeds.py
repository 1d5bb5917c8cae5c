"""Pictures as they land, and known objects in a stream."""

import datetime as dt
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streaming import drained

from vigilake.operators import objects
from vigilake.pixels import images
from vigilake.sources import frames as sources
from vigilake.streaming import objects as streaming


def paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def png_bytes(samples, colour, kinds, depth=8, palette=None):
    """A PNG file of (height, width, bytes a pixel), rows filtered byte by byte."""
    h, w, step = samples.shape
    flat, packed = samples.reshape(h, -1).astype(int), b""
    for y in range(h):
        row = []
        for i in range(w * step):
            left = flat[y, i - step] if i >= step else 0
            up = flat[y - 1, i] if y else 0
            corner = flat[y - 1, i - step] if y and i >= step else 0
            guess = (0, left, up, (left + up) // 2, paeth(left, up, corner))[kinds[y]]
            row.append((flat[y, i] - guess) % 256)
        packed += bytes([kinds[y], *row])
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))
    colours = part(b"PLTE", palette.tobytes()) if palette is not None else b""
    data = zlib.compress(packed)
    return b"\x89PNG\r\n\x1a\n" + head + colours + part(b"IDAT", data[:7]) + part(b"IDAT", data[7:]) + part(b"IEND", b"")


def bmp_bytes(bgr):
    h, w, _ = bgr.shape
    rows = b"".join(bgr[y].tobytes() + bytes(-3 * w % 4) for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


@pytest.mark.parametrize("some", [(0,), (1, 2), (0, 1, 2, 3, 4), (4,), (3,)])
def test_pictures_of_every_filter(some):
    rng = np.random.default_rng(5)
    for colour, channels in ((2, 3), (6, 4), (0, 1), (4, 2)):
        for h, w in ((1, 1), (5, 9), (12, 3)):
            kinds = rng.choice(some, h).tolist()
            samples = rng.integers(0, 256, (h, w, channels)).astype(np.uint8)
            want = samples[:, :, 2::-1] if channels > 2 else np.repeat(samples[:, :, :1], 3, 2)
            assert (images.decode(png_bytes(samples, colour, kinds)) == want).all()
            wide = np.stack([samples, np.zeros_like(samples)], -1).reshape(h, w, -1)
            assert (images.decode(png_bytes(wide, colour, kinds, 16)) == want).all()
    palette = rng.integers(0, 256, (7, 3)).astype(np.uint8)
    picked = rng.integers(0, 7, (4, 6, 1)).astype(np.uint8)
    assert (images.decode(png_bytes(picked, 3, rng.choice(some, 4).tolist(), 8, palette)) == palette[picked[:, :, 0]][:, :, ::-1]).all()


def test_bitmaps_and_broken_pictures():
    bgr = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (images.decode(bmp_bytes(bgr)) == bgr).all()
    good = png_bytes(bgr, 2, [0] * 5)
    for bad in (b"", b"broken", good[:40], good[:-30], good.replace(b"IDAT", b"IDOT"), bmp_bytes(bgr)[:60]):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_stream_of_pictures_equals_reading_them(spark, tmp_path):
    rng = np.random.default_rng(3)
    for scene, n in (("one", 5), ("two", 3)):
        folder = tmp_path / "in" / "cat" / scene / "input"
        folder.mkdir(parents=True)
        for i in range(n):
            pixels = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
            data = bmp_bytes(pixels) if i == 2 else png_bytes(pixels, 2, rng.integers(0, 5, 9).tolist())
            (folder / f"in{i + 1:06d}.{'bmp' if i == 2 else 'png'}").write_bytes(data)
    root = str(tmp_path / "in")
    want = {tuple(r) for r in sources.read_frames(spark, root).collect()}
    (tmp_path / "in" / "cat" / "one" / "input" / "in000009.png").write_bytes(b"broken")
    stream = sources.stream_images(spark, root, max_files=2)
    drained(stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")), "pictures")
    got = {tuple(r) for r in spark.table("pictures").collect()}
    assert got == want | {("cat", "one", 8, None, None, None)} and len(want) == 8


def seen(n, seed=4):
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(6)]
    start = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        code = rng.choice(base)
        for bit in rng.sample(range(63), rng.choice([0, 0, 3, 9])):
            code ^= 1 << bit
        rows.append((i, f"cam_{rng.randrange(3)}", start + dt.timedelta(hours=i), code))
    return rows


def plain_decisions(batches, ids, bits=10, keep=None):
    """The rule of the batch operator, batch by batch, over plain lists."""
    known, told = {}, []
    for rows in batches:
        if keep is not None:
            floor = max(r[2] for r in rows) - keep
            known = {h: o for h, o in known.items() if o["last"] >= floor}
        new = {}
        for d, camera, ts, code in rows:
            near = min(((bin(code ^ h).count("1"), ids[h], h) for h, o in known.items()), default=(99, 0, 0))
            if near[0] <= bits:
                home = known[near[2]]
                told.append((d, home["hash"], near[0], "log" if camera == home["camera"] else "flag"))
                home["last"] = max(home["last"], ts)
            else:
                new.setdefault(code, []).append((ts, camera, d))
        for code, hits in new.items():
            hits.sort()
            for ts, camera, d in hits:
                told.append((d, code, 0, "register" if d == hits[0][2] else "log" if camera == hits[0][1] else "flag"))
            known[code] = {"hash": code, "camera": hits[0][1], "last": hits[-1][0]}
    return told


@pytest.mark.parametrize("keep_days", [None, 1])
def test_objects_are_decided_as_they_come(spark, tmp_path, keep_days):
    rows = seen(60)
    batches = [rows[i : i + 15] for i in range(0, 60, 15)]
    schema = "detection_id long, camera_id string, ts timestamp, hash long"
    ids = {r["hash"]: r["id"] for r in spark.createDataFrame(rows, schema).select("hash", F.xxhash64("hash").alias("id")).collect()}
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "objects")
    for number, part in enumerate(batches):
        for _ in range(2 if number == 2 else 1):  # One micro-batch is tried twice.
            streaming.decide_batch(spark.createDataFrame(part, schema), folder, number, keep_days=keep_days)
    got = {r.detection_id: r for r in streaming.decisions(spark, folder).collect()}
    assert len(got) == 60 == streaming.decisions(spark, folder).count()
    keep = None if keep_days is None else dt.timedelta(days=keep_days)
    for d, code, distance, action in plain_decisions(batches, ids, keep=keep):
        assert got[d].action == action and got[d].distance == distance
        if distance == 0 and action != "register":
            assert got[d].object_id == ids[code]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.stream_objects(stream, str(tmp_path / "streamed"), str(tmp_path / "check"), keep_days=keep_days)
    query.awaitTermination(200)
    assert query.exception() is None and streaming.decisions(spark, str(tmp_path / "streamed")).count() == 60
    if keep_days is None:
        registry = streaming.known_objects(spark, folder)
        whole = objects.decide(objects.match_objects(spark.createDataFrame(batches[-1], schema), registry.filter("batch < 3")), registry.filter("batch < 3"))
        assert {(r.detection_id, r.action) for r in whole.filter("action <> 'register'").collect()} <= {(d, r.action) for d, r in got.items()}
