import datetime as dt
import os
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.functions import columns as C
from vigilake.operators import background, compaction, coverage, objects, resume, scenes, scorecard, segments
from vigilake.pixels import masks, models, regions
from vigilake.schemas import FRAMES, SEGMENTS
from vigilake.sources import frames as sources
from vigilake.sources import manifest, sinks

SEED = [
    (1, "20260101T000000Z", "cam_a", 1, 2, 100000, 60.0, "cam_a_seg1.mp4"),
    (2, "20260101T010000Z", "cam_a", 1, 5, 200000, 60.0, "cam_a_seg2.mp4"),
    (3, "20260101T000000Z", "cam_b", 0, 0, 50000, 60.0, "cam_b_seg1.mp4"),
]


@pytest.fixture
def index(spark):
    return spark.createDataFrame(SEED, SEGMENTS)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_index_questions(spark, index):
    now = "2026-01-01 02:00:00"
    assert [r.id for r in segments.recent_targets(index, "cam_a", 24, now).collect()] == [2, 1]
    assert [r.id for r in segments.recent_targets(index, "cam_a", 1, now).collect()] == [2]
    assert segments.recent_targets(index, "cam_b", 24, now).count() == 0
    assert [r.roi_count for r in segments.busiest_segments(index, 1).collect()] == [5]
    days = segments.daily_storage(index).collect()
    assert [(r.camera_id, r.total_bytes) for r in days] == [("cam_a", 300000), ("cam_b", 50000)]
    report = segments.storage_report(index).first()
    assert (report.total_segments, report.segments_with_targets, report.total_roi_count, report.total_duration_hours) == (3, 2, 7, 0.05)


def test_empty_index(spark):
    empty = spark.createDataFrame([], SEGMENTS)
    assert tuple(segments.storage_report(empty).first()) == (0, 0, 0.0, 0, 0, 0.0)
    assert segments.daily_storage(empty).count() == segments.busiest_segments(empty).count() == 0


def test_text_times_without_t_and_old_rows(spark):
    rows = [(i, f"2026010100000{i}Z", "c", 1, i, 1, 1.0, "p") for i in range(3)] + [(9, "20200101T000000Z", "c", 1, 1, 1, 1.0, "p")]
    found = segments.recent_targets(spark.createDataFrame(rows, SEGMENTS), "c", 24, "2026-01-01 12:00:00")
    assert [r.id for r in found.collect()] == [2, 1, 0]
    assert segments.retained(spark.createDataFrame(rows, SEGMENTS), 7, "2026-01-05 00:00:00").count() == 3


def test_index_on_disk(spark, index, tmp_path):
    path = str(tmp_path / "index")
    assert sources.open_index(spark, path).count() == 0
    sinks.append_segments(index, path)
    sinks.append_segments(index, path)
    back = sources.open_index(spark, path)
    assert back.count() == 6 and back.schema.names == [*SEGMENTS.names, "date", "batch"]
    assert not sinks.save_csv(index.filter("id > 99"), str(tmp_path / "none"))
    assert sinks.save_csv(index, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_scalar_columns(spark):
    roi = lambda s: C.temporal_roi(F.lit(s))
    row = one(
        spark,
        name=C.camera_name(F.lit("../../etc/passwd")),
        w1=C.warmup_frames(roi("5 10")),
        w2=C.warmup_frames(roi("7")),
        w3=C.warmup_frames(roi("0 3")),
        n=C.frames_per_segment(0.01, 60.0),
        r1=C.compression_ratio(F.lit(6000), F.lit(1000)),
        r2=C.compression_ratio(F.lit(6000), F.lit(0)),
        s=C.savings(F.lit(10_000_000), F.lit(2_000_000)),
        e=C.savings(F.lit(5), F.lit(5)),
        c1=C.coverage(F.array(*[F.lit(x) for x in (255, 0, 255, 0)])),
        c2=C.coverage(F.array().cast("array<int>")),
        p1=C.psnr(F.array(F.lit(1)), F.array(F.lit(1))),
        p2=C.psnr(F.array(F.lit(0), F.lit(0)), F.array(F.lit(255), F.lit(255))),
        t=C.segment_time(F.lit("nonsense")),
        f=C.sample_name(F.lit("s"), F.lit("KNN"), F.lit(7)),
        v=C.scene_name(F.lit("/a/clip.mp4"), sequence=False),
    )
    assert row["name"] == "______etc_passwd" and (row.w1, row.w2, row.w3, row.n) == (4, 120, 0, 1)
    assert row.r1 == 6.0 and row.r2 == float("inf") and tuple(row.s) == (10.0, 2.0, 8.0, 5.0, 80.0) and row.e.compression_ratio == 1.0
    assert (row.c1, row.c2, row.p1, row.p2) == (0.5, 0.0, float("inf"), 0.0) and row.t is None
    assert row.f == "s_KNN_frame00007.jpg" and row.v == "clip"
    with pytest.raises(Exception, match="negative"):
        one(spark, r=C.compression_ratio(F.lit(-1), F.lit(1)))
    with pytest.raises(Exception, match="differ"):
        one(spark, r=C.psnr(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))))


@pytest.mark.parametrize("box, pad, want", [((5, 5, 10, 10, 100), 20, (0, 0, 35, 35)), ((620, 460, 15, 15, 225), 20, (600, 440, 40, 40)), ((100, 100, 50, 50, 2500), 10, (90, 90, 70, 70))])
def test_padded_boxes(spark, box, pad, want):
    b = F.struct(*[F.lit(v).alias(n) for v, n in zip(box, ("x", "y", "w", "h", "area"))])
    row = one(spark, b=C.padded_box(b, pad, 640, 480), a=C.box_corners(b)).asDict()
    assert tuple(row["b"])[:4] == want and row["b"].area == want[2] * want[3] and row["a"] == list(box[:4])


def counted(spark, rows):
    return spark.createDataFrame([("c", "s", "m", "MOG2", i, float(c), n) for i, (c, n) in enumerate(rows)], "category string, scene string, camera_id string, method string, frame_idx long, coverage double, n_regions int")


def test_segments_drop_the_partial_one_and_flush_on_request(spark):
    frames = counted(spark, [(0, 0)] * 4 + [(0, 0)] * 5 + [(0, 2)] + [(0, 0)] * 3)
    full = segments.build_segments(frames, fps=5, segment_seconds=1, warmup=4, regions=F.col("n_regions")).collect()
    assert [(r.segment_no, r.n_frames, r.target_detected, r.crf, r.duration) for r in full] == [(1, 5, 0, 40, 1.0)]
    both = segments.build_segments(frames, fps=5, segment_seconds=1, warmup=4, regions=F.col("n_regions"), flush_partial=True).orderBy("segment_no").collect()
    assert [(r.segment_no, r.n_frames, r.roi_count, r.crf) for r in both] == [(1, 5, 0, 40), (2, 4, 2, 18)]
    rows = segments.index_rows(segments.build_segments(frames, fps=5, segment_seconds=1, warmup=4, regions=F.col("n_regions")), F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit(None).cast("long"))
    assert rows.first().file_path == "m_20260101T000000Z_1.mp4" and rows.first().file_size == 0


def test_clips_that_are_all_warmup_have_zeros(spark):
    stats = coverage.clip_coverage(counted(spark, [(0.5, 1)] * 3), warmup=120).first()
    assert (stats.total_frames, stats.analyzed_frames, stats.avg_coverage_pct, stats.activity_rate_pct) == (3, 0, 0.0, 0.0)
    edge = coverage.clip_coverage(counted(spark, [(0.001, 1), (0.0011, 1)]), warmup=0).first()
    assert edge.frames_with_activity == 1 and edge.activity_rate_pct == 50.0


def test_objects_meet_few_detections_and_large_keys_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(5)
    spread = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 3000)], "hash long")
    asked, known = (objects._keyed(spread.filter(f"hash % 3 {side} 0"), 10, around) for side, around in (("<>", False), ("=", True)))
    n = spread.filter("hash % 3 = 0").count()
    assert asked.count() == 4 * (3000 - n)
    assert asked.join(known, ["choice", "value"]).count() < 0.01 * n * (3000 - n)
    monkeypatch.setattr(objects, "TOGETHER", 20)
    monkeypatch.setattr(objects, "PAIRS", 50)
    bases = [int(b) for b in rng.integers(-(2**63), 2**63, 4)]
    changed = lambda b: b ^ objects._signed(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 12), replace=False)))
    codes, own = [changed(b) for b in bases for _ in range(60)], [changed(b) for b in bases for _ in range(8)]
    t = dt.datetime(2026, 1, 1)
    seen = spark.createDataFrame([(i, c) for i, c in enumerate(codes)] + [(-1, None)], "detection_id long, hash long")
    registry = spark.createDataFrame([(100 - i, c, "cam_a", t) for i, c in enumerate(own * 2)], "object_id long, hash long, camera_id string, first_seen timestamp")
    for bits in (1, 10):
        best = {i: min((((c ^ o) & (2**64 - 1)).bit_count(), 100 - j) for j, o in enumerate(own * 2)) for i, c in enumerate(codes)}
        want = {i: b if b[0] <= bits else (None, None) for i, b in best.items()} | {-1: (None, None)}
        assert {r.detection_id: (r.distance, r.object_id) for r in objects.match_objects(seen, registry, bits).collect()} == want


def test_averages_that_lie_halfway_do_not_hang_on_the_order_of_rows(spark):
    shares = [2, 1, 7, 2, 10, 3, 2, 1, 6, 6, 8, 4, 8, 4, 7, 5, 1, 3, 10, 5]
    for given, want in ((shares, 0.48), ([3, 3, 4, 7, 8, 9, 6, 3, 7, 4, 5, 7, 9, 1, 3, 1, 0, 0, 0, 7], 0.44)):
        for rows in (given, given[::-1]):
            frames = counted(spark, [(x / 100 / 10, 1) for x in rows]).coalesce(1)
            assert coverage.clip_coverage(frames, warmup=0).first().avg_coverage_pct == want
            assert scorecard.tier_plan(frames, warmup=0).first().avg_coverage_pct == want


def test_bad_frames_end_a_clip(spark):
    rows = spark.createDataFrame([("c", "a", i, i == 2) for i in range(5)] + [("c", "b", i, False) for i in range(3)], "category string, scene string, frame_idx long, bad boolean")
    assert scenes.truncate_at_bad(rows, F.col("bad")).count() == 5
    assert scenes.truncate_at_bad(rows, F.col("bad"), "drop").count() == 7
    with pytest.raises(ValueError):
        scenes.truncate_at_bad(rows, F.col("bad"), "keep")


def test_even_samples_of_short_and_empty_clips(spark):
    clips = spark.createDataFrame([("a", 3), ("b", 0), ("c", 100)], "scene string, total_frames long")
    found = scorecard.even_samples(clips, k=30).groupBy("scene").count().collect()
    assert {r.scene: r["count"] for r in found} == {"a": 3, "c": 30}
    assert scorecard.even_samples(clips, k=1).count() == 2


def test_objects(spark):
    t = dt.datetime(2026, 1, 1)
    registry = spark.createDataFrame([(1, 0, "cam_a", t)], "object_id long, hash long, camera_id string, first_seen timestamp")
    seen = spark.createDataFrame([(1, 0b111, "cam_a", t), (2, -1, "cam_b", t), (3, 1 << 63 - 1, "cam_b", t), (4, (1 << 11) - 1, "cam_a", t)], "detection_id long, hash long, camera_id string, ts timestamp")
    decided = objects.decide(objects.match_objects(seen, registry), registry)
    assert {r.detection_id: (r.action, r.distance) for r in decided.collect()} == {1: ("log", 3), 2: ("register", None), 3: ("flag", 1), 4: ("register", None)}
    assert objects.register_new(decided).count() == 2 and objects.sightings(decided).filter("flagged").count() == 1
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 2**63, 20)
    codes = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 16), replace=False)) for b in bases for _ in range(6)]
    known = spark.createDataFrame([(i, int(b), "cam_a", t) for i, b in enumerate(bases)], registry.schema)
    found = objects.match_objects(spark.createDataFrame([(i, c, "cam_a", t) for i, c in enumerate(codes)], seen.schema), known)
    for r in found.collect():
        best = min(((codes[r.detection_id] ^ int(b)).bit_count(), i) for i, b in enumerate(bases))
        assert (r.distance, r.object_id) == (best if best[0] <= 10 else (None, None))


def test_scenes_of_one_name_in_two_categories(spark):
    clips = spark.createDataFrame([("a", "park", 3), ("b", "park", 4)], "category string, scene string, n int")
    rois = spark.createDataFrame([("a", "park", [5, 10]), ("b", "park", [7, 9])], "category string, scene string, temporal_roi array<int>")
    assert {(r.category, r.temporal_roi[0]) for r in scenes.attach_roi(clips, rois).collect()} == {("a", 5), ("b", 7)}
    sizes = spark.createDataFrame([("a", "park", 600, 100, 50), ("b", "park", 800, 100, 50)], "category string, scene string, original_bytes long, baseline_bytes long, selective_bytes long")
    tiers = spark.createDataFrame([(c, "park", "KNN", 1.0, True, 20) for c in "ab"], "category string, scene string, method string, avg_coverage_pct double, has_targets boolean, crf_used int")
    assert {(r.category, r.selective_ratio) for r in scorecard.scorecard(sizes, tiers).collect()} == {("a", 12.0), ("b", 16.0)}


def test_pictures_with_alpha(spark, tmp_path):
    folder = tmp_path / "baseline" / "park" / "input"
    folder.mkdir(parents=True)
    bgr = np.random.default_rng(1).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    rows = b"".join(b"\0" + np.dstack([row[None, :, ::-1], np.full((1, 5, 1), 200, np.uint8)]).tobytes() for row in bgr)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", 5, 4, 8, 6, 0, 0, 0)
    (folder / "in000001.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))
    assert [bytes(r.px) for r in sources.read_frames(spark, str(tmp_path)).collect()] == [bgr.tobytes()]


def clip(n=12, h=40, w=56, seed=0, step=3):
    rng = np.random.default_rng(seed)
    ground = rng.integers(60, 90, (h, w, 3)).astype(np.uint8)
    for i in range(n):
        frame = ground.copy()
        if i >= 5:
            x = 4 + step * (i - 5)
            frame[8:24, x : x + 14] = 240
        yield frame


def frame_table(spark, clips):
    rows = [("cat", name, i, f.shape[1], f.shape[0], bytearray(f.tobytes())) for name, c in clips.items() for i, f in enumerate(c)]
    return spark.createDataFrame(rows, FRAMES)


def as_set(df):
    return {(r.scene, r.method, r.frame_idx, round(r.coverage, 9), tuple(map(tuple, r.regions))) for r in df.collect()}


def test_background_jobs_equal_a_plain_loop_however_they_are_cut(spark):
    clips = {"one": list(clip()), "two": list(clip(9, seed=1))}
    want = set()
    for name, frames in clips.items():
        for method in models.METHODS:
            model = models.background_model(method, *frames[0].shape[:2], history=50)
            for i, f in enumerate(frames):
                mask = masks.clean(model.apply(f))
                want.add((name, method, i, round(masks.coverage(mask), 9), tuple(regions.regions(mask, 20, 4))))
    table = frame_table(spark, clips)
    options = {"min_area": 20, "pad": 4, "history": 50}
    assert as_set(background.subtract_background(table, **options)) == want
    assert as_set(background.subtract_background(table, tile=16, **options)) == want
    assert as_set(background.subtract_background(table.repartition(5), partitions=1, **options)) == want
    assert any(r[3] > 0 for r in want) and background.explode_regions(background.subtract_background(table, **options)).count() > 0
    night = as_set(background.subtract_background(table, night_mode=True, **options))
    assert night == as_set(background.subtract_background(table, night_mode=True, tile=20, **options))
    with pytest.raises(ValueError):
        background.subtract_background(table, methods=("MOG",))


def test_packing_and_quality(spark):
    table = frame_table(spark, {"one": list(clip())}).withColumn("segment_no", F.lit(1).cast("long"))
    fine, coarse = (compaction.pack_frames(table.withColumn("crf", F.lit(t))) for t in (18, 40))
    sizes = [compaction.segment_sizes(p).first().file_size for p in (fine, coarse)]
    assert sizes[0] > sizes[1] > 0
    best, worse = (compaction.sampled_quality(table, p).first() for p in (fine, coarse))
    assert best.psnr == float("inf") and best.ssim == 1.0 and best.samples_used == 12
    assert 20 < worse.psnr < 60 and worse.ssim < 1


def png(path, pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row[:, ::-1].tobytes() for row in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_reading_image_sequences(spark, tmp_path):
    rng = np.random.default_rng(42)
    kept = {}
    for scene, n in (("highway", 4), ("office", 3)):
        folder = tmp_path / "baseline" / scene / "input"
        folder.mkdir(parents=True)
        for i in range(n):
            pixels = rng.integers(0, 256, (16, 16, 3)).astype(np.uint8)
            kept[scene, i] = pixels.tobytes()
            png(folder / f"in{i + 1:06d}.png", pixels)
        (folder / "notes.txt").write_text("x")
    (tmp_path / "baseline" / "highway" / "temporalROI.txt").write_text("5 10\n")
    (tmp_path / "baseline" / "office" / "input" / "in000002.png").write_bytes(b"broken")
    root = str(tmp_path)
    frames = sources.read_frames(spark, root)
    assert {(r.scene, r.frame_idx): bytes(r.px) for r in frames.collect()} == {k: v for k, v in kept.items() if k[0] == "highway" or k[1] == 0}
    assert sources.read_frames(spark, root, on_bad="drop").count() == 6
    assert {(r.category, r.scene) for r in sources.find_scenes(spark, root).collect()} == {("baseline", "highway"), ("baseline", "office")}
    facts = {r.scene: r for r in sources.clips(frames, sources.read_temporal_roi(spark, root)).collect()}
    assert (facts["highway"].warmup, facts["office"].warmup, facts["highway"].fps, facts["highway"].total_frames) == (4, 120, 30.0, 4)
    sources.compact_frames(frames, str(tmp_path / "frames"), 2)
    assert sources.read_frame_table(spark, str(tmp_path / "frames")).count() == 5
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        sources.read_frames(spark, str(tmp_path / "empty"))


def test_standard_manifest_and_plans(spark):
    known = manifest.standard_manifest(spark)
    rows = known.collect()
    assert len(rows) == 46 and [r.ord for r in rows] == list(range(46)) and sum(r.night for r in rows) == 6
    assert {r.scene for r in rows if r.sample_rate_override == 5} == {"port_0_17fps", "tramCrossroad_1fps", "tunnelExit_0_35fps", "turnpike_0_5fps"}
    found = known.filter("category IN ('thermal', 'turbulence') AND scene <> 'park'")
    planned = scenes.plan_scenes(found, known, skip=("turbulence",)).collect()
    assert [r.scene for r in planned] == ["corridor", "diningRoom", "lakeSide", "library"] and {r.sample_rate for r in planned} == {20}
    assert scenes.missing_scenes(known, found).count() == 46 - 8
    summary = scenes.run_summary(known, found, known.filter("scene = 'library' OR scene = 'highway'")).first()
    assert tuple(summary) == (46, 38, 1, 7)
    place = known.filter("scene = 'park'").first().category
    rois = spark.createDataFrame([(place, "park", (3, 9)), ("other", "park", (1, 2))], "category string, scene string, temporal_roi struct<start:int,end:int>")
    assert scenes.attach_roi(known, rois).filter("temporal_roi.end = 9").count() == 1


def test_manifest_from_csv(spark, tmp_path):
    manifest.standard_manifest(spark).coalesce(1).write.option("header", True).csv(str(tmp_path / "m"))
    assert manifest.read_manifest(spark, str(tmp_path / "m")).exceptAll(manifest.standard_manifest(spark)).count() == 0


def test_ratios_of_files(spark, tmp_path):
    for name, size in (("a", 6000), ("b", 1000), ("c", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    listing = sources.list_files(spark, str(tmp_path))
    at = {r.path[-1]: r.path for r in listing.collect()}
    pairs = spark.createDataFrame([(at["a"], at["b"]), (at["a"], at["c"])], "original string, compressed string")
    assert sorted(r.compression_ratio for r in scenes.file_ratios(pairs, listing).collect()) == [6.0, 6000.0]
    with pytest.raises(Exception, match="no such file"):
        scenes.file_ratios(spark.createDataFrame([("x", "y")], "original string, compressed string"), listing).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many_days(spark, days=12):
    rows = [(d, f"202601{d + 1:02d}T120000Z", f"cam_{d % 2}", 1, 1, 100, 60.0, f"f{d}") for d in range(days)]
    return spark.createDataFrame(rows, SEGMENTS)


def test_look_backs_open_only_their_days(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = many_days(spark)
    sinks.append_segments(rows, path)
    index = sources.open_index(spark, path)
    for ask in (lambda x: segments.recent_targets(x, "cam_1", 48, "2026-01-12 13:00:00"), lambda x: segments.retained(x, 3, "2026-01-12 13:00:00")):
        plan = plan_of(ask(index))
        assert re.search(r"PartitionFilters: \[.*date#\d+ >= 202601(09|10)", plan)
        assert sorted(r.id for r in ask(index).collect()) == sorted(r.id for r in ask(rows).collect())
    assert "camera_id,cam_1" in plan_of(segments.recent_targets(index, "cam_1", 48, "2026-01-12 13:00:00"))
    days = segments.daily_storage(index)
    assert "timestamp" not in re.search("ReadSchema.*", plan_of(days))[0] and days.count() == 12


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "index")
    for _ in range(2):
        sinks.append_segments(many_days(spark), path, "feed-1")
        sinks.append_segments(many_days(spark, 3), path, "feed-2")
    found = sources.open_index(spark, path)
    assert found.count() == 15 and {r.batch for r in found.select("batch").distinct().collect()} == {"feed-1", "feed-2"}


def test_retention_hides_days_and_then_removes_them(spark, tmp_path):
    path = str(tmp_path / "index")
    sinks.append_segments(many_days(spark), path)
    before = sources.open_index(spark, path)
    now = dt.datetime(2026, 1, 12, 13)
    assert sinks.expire_segments(spark, path, 5, now) == []
    assert sources.open_index(spark, path).agg(F.min("date")).first()[0] == "20260107" and before.count() == 12
    assert sinks.expire_segments(spark, path, 3, now + dt.timedelta(hours=12)) == []
    assert sinks.expire_segments(spark, path, 3, now + dt.timedelta(hours=25)) == [f"202601{d:02d}" for d in range(1, 7)]
    assert not (tmp_path / "index" / "date=20260106").exists() and (tmp_path / "index" / "date=20260107").exists()
    assert sources.open_index(spark, path).agg(F.min("date")).first()[0] == "20260110"


def noisy_scene(n, seed=0, h=36, w=44):
    rng = np.random.default_rng(seed)
    base = rng.integers(40, 200, (h, w, 3))
    for i in range(n):
        frame = base + rng.normal(0, 3, base.shape)
        frame[8:24, (3 * i) % (w - 12) :][:, :12] = 230
        yield np.clip(frame, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("tile", [None, 16])
def test_steps_give_what_one_run_gives(spark, tmp_path, tile):
    table = frame_table(spark, {"one": list(noisy_scene(23)), "two": list(noisy_scene(9, 1))})
    options = {"methods": models.ALL_METHODS, "min_area": 10, "pad": 2, "history": 30, "tile": tile}
    want = as_set(background.subtract_background(table, **options))
    folder = str(tmp_path / "steps")
    # A day's frames, then the rest; the last step is lost after its files were begun.
    first = resume.run(table.filter("frame_idx < 10"), folder, every=7, **options)
    assert first.count() == 3 * 19
    os.remove(tmp_path / "steps" / f"step={resume.finished_steps(spark, folder)[-1]}" / "_SUCCESS")
    whole = resume.run(table, folder, every=7, **options)
    assert as_set(whole) == want
    assert len(resume.finished_steps(spark, folder)) >= 4
    assert sum(n.startswith("kind=state") for s in (tmp_path / "steps").iterdir() for n in os.listdir(s)) <= 2
    assert not resume.advance(table, folder, 7, background.Options(**options))


def test_a_broken_scene_does_not_end_the_job(spark, tmp_path):
    table = frame_table(spark, {"good": list(noisy_scene(6)), "bad": list(noisy_scene(6, 1))})
    broken = table.withColumn("px", F.when((F.col("scene") == "bad") & (F.col("frame_idx") == 3), F.lit(b"xx")).otherwise(F.col("px")))
    for tile in (None, 16):
        folder = str(tmp_path / f"t{tile}")
        found = resume.run(broken, folder, every=4, methods=("MOG2",), min_area=10, tile=tile)
        assert {(r.scene, r["count"]) for r in found.groupBy("scene").count().collect()} >= {("good", 6)}
        (bad,) = resume.stored_rejects(spark, folder).collect()
        assert (bad.scene, bad.frame_idx) == ("bad", 3) and "reshape" in bad.reason
    with pytest.raises(Exception, match="reshape"):
        background.subtract_background(broken, methods=("MOG2",)).count()


def test_tiles_work_on_every_pixel_once(spark):
    options = background.Options(tile=4)
    assert sum(w * h for *_, w, h in options.tiles(8, 10)) == 80
    sizes = {"large": [f[:20, :30] for f in noisy_scene(7)], "small": [f[:8, :8] for f in noisy_scene(30, 1)]}
    table = frame_table(spark, sizes).withColumn("night", F.col("frame_idx") >= 0)
    cut = background.cut_tiles(table, options).groupBy("scene", "frame_idx").agg(F.sum(F.length("px")).alias("n"))
    assert {(r.scene, r.n) for r in cut.collect()} == {("large", 1800), ("small", 192)}
    given = {"methods": models.ALL_METHODS, "min_area": 1, "pad": 1, "history": 20}
    assert as_set(background.subtract_background(table, tile=4, **given)) == as_set(background.subtract_background(table, **given))
