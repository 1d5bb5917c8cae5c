from pyspark.sql import functions as F
from test_operators import clip, frame_table

from vigilake.functions import columns as C
from vigilake.operators import background, scenes, segments
from vigilake.plans import jobs
from vigilake.sources import frames as sources
from vigilake.sources import manifest


def test_study_index_and_questions(spark, tmp_path, capsys):
    frames = frame_table(spark, {"one": list(clip(14)), "two": list(clip(9, seed=1))})
    sources.compact_frames(frames, str(tmp_path / "frames"), 2)
    table = sources.read_frame_table(spark, str(tmp_path / "frames"))
    jobs.coverage_study(table, str(tmp_path / "study"), warmup=2, min_area=20, pad=4)
    clips = spark.read.parquet(str(tmp_path / "study" / "clips")).collect()
    assert {(r.scene, r.analyzed_frames) for r in clips} == {("one", 12), ("two", 7)}
    assert spark.read.parquet(str(tmp_path / "study" / "methods")).count() == 2
    index = str(tmp_path / "index")
    jobs.index_feed(table, index, "2026-01-01 00:00:00", fps=2, seconds=2, warmup=2, min_area=20, pad=4)
    rows = sources.open_index(spark, index).orderBy("file_path").collect()
    assert [r.file_path for r in rows] == ["one_20260101T000001Z_1.mp4", "one_20260101T000003Z_2.mp4", "one_20260101T000005Z_3.mp4", "two_20260101T000001Z_1.mp4"]
    assert all(r.file_size > 0 and r.duration == 2.0 for r in rows) and rows[1].target_detected == 1
    jobs.main(["recent", index, "one", "--hours", "24", "--now", "2026-01-01 12:00:00"])
    jobs.main(["daily", index])
    assert "one_20260101T000003Z_2.mp4" in capsys.readouterr().out
    assert segments.storage_report(sources.open_index(spark, index)).first().total_segments == 4


def test_a_study_by_manifest_survives_a_failing_scene(spark, tmp_path):
    frames = frame_table(spark, {n: list(clip(9, seed=i)) for i, n in enumerate(("day", "dark", "broken", "unlisted"))})
    frames = frames.withColumn("px", F.when((F.col("scene") == "broken") & (F.col("frame_idx") == 4), F.lit(b"?")).otherwise(F.col("px")))
    rows = [("cat", "day", False, None, 0), ("cat", "dark", True, 2, 1), ("cat", "broken", False, None, 2), ("cat", "absent", False, None, 3)]
    plan = spark.createDataFrame(rows, manifest.SCHEMA)
    rois = spark.createDataFrame([("cat", "dark", (4, 9))], "category string, scene string, temporal_roi struct<start:int,end:int>")
    out = str(tmp_path / "study")
    jobs.coverage_study(frames, out, warmup=2, rois=rois, manifest=plan, sample_rate=3, every=4, min_area=20, pad=4)
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    assert tuple(read("summary").first()) == (4, 1, 1, 2)
    assert [(r.scene, r.frame_idx) for r in read("rejects").collect()] == [("broken", 4)]
    clips = {(r.scene, r.method): r for r in read("clips").collect()}
    assert {k[0] for k in clips} == {"day", "dark"} and clips["dark", "MOG2"].total_frames == 9
    begin = C.warmup_frames("temporal_roi", 2)
    want = scenes.attach_roi(spark.createDataFrame([("cat", "dark")], "category string, scene string"), rois).select(begin).first()[0]
    assert clips["dark", "KNN"].analyzed_frames == 9 - want and clips["dark", "KNN"].sample_images_saved == -(-(9 - want) // 2)
    assert clips["day", "KNN"].analyzed_frames == 7 and clips["day", "KNN"].sample_images_saved == 3
    night = background.subtract_background(frames.filter("scene = 'dark'"), night_mode=True, min_area=20, pad=4)
    key = ("method", "frame_idx", "coverage")
    assert {tuple(r) for r in night.select(*key).collect()} == {tuple(r) for r in read("activity").filter("scene = 'dark'").select(*key).collect()}


def test_an_index_job_run_again_adds_nothing(spark, tmp_path):
    frames = frame_table(spark, {"one": list(clip(14)), "two": list(clip(9, seed=1))})
    both = frames.unionByName(frames.filter("scene = 'two'").withColumn("category", F.lit("other")))
    index = str(tmp_path / "index")
    ask = {"fps": 2, "seconds": 2, "warmup": 2, "min_area": 20, "pad": 4, "tile": 16}
    first, again = (jobs.index_feed(both, index, "2026-01-01 00:00:00", **ask) for _ in range(2))
    rows = sources.open_index(spark, index).collect()
    assert first == again and sorted({r.camera_id for r in rows}) == ["cat_two", "one", "other_two"] and len(rows) == 5
    jobs.index_feed(both, index, "2026-01-02 00:00:00", **ask)
    assert sources.open_index(spark, index).count() == 10
    jobs.main(["expire", index, "--days", "1", "--now", "2026-01-03T00:00:00"])
    assert sources.open_index(spark, index).count() == 5


def test_compression_study(spark, tmp_path):
    frames = frame_table(spark, {"moving": list(clip(14)), "still": list(clip(5))})
    jobs.compression_study(frames, str(tmp_path), warmup=2, fps=2, seconds=2, min_area=20, pad=4)
    card = {r.scene: r for r in spark.read.parquet(str(tmp_path / "scorecard")).collect()}
    assert (card["moving"].has_targets, card["moving"].crf_used, card["still"].has_targets, card["still"].crf_used) == (True, 20, False, 40)
    assert card["still"].selective_ratio > card["still"].baseline_ratio > 1
    assert spark.read.option("header", True).csv(str(tmp_path / "scorecard_csv")).count() == 2
