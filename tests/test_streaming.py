import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F
from test_operators import SEED, clip, frame_table

from vigilake.operators import background, segments
from vigilake.schemas import SEGMENTS
from vigilake.sources import frames as sources
from vigilake.streaming import segments as streaming


def drained(query_writer, name):
    query = query_writer.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_of_frames_equals_the_batch_job(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table = frame_table(spark, {"one": list(clip(13)), "two": list(clip(9, seed=1))})
    for part in (0, 1):
        low, high = part * 6, 6 if part == 0 else 99
        table.filter((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = sources.stream_frames(spark, str(tmp_path / "frames"), max_files=1)
    made = streaming.stream_segments(stream, fps=4, segment_seconds=1, warmup=2, min_area=20, pad=4)
    drained(made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")), "made")
    columns = ["scene", "segment_no", "n_frames", "frames_with_targets", "roi_count", "target_detected", "duration", "crf"]
    activity = background.subtract_background(table, methods=("MOG2",), min_area=20, pad=4)
    batch = segments.build_segments(activity, fps=4, segment_seconds=1, warmup=2, camera="scene").select(*columns)
    got = {tuple(r) for r in spark.table("made").select(*columns).collect()}
    assert got == {tuple(r) for r in batch.collect()} and len(got) == 3


def segment_set(df, *more):
    names = ["scene", *more, "segment_no", "n_frames", "frames_with_targets", "roi_count", "target_detected", "duration", "crf"]
    return {tuple(r) for r in df.select(*names).collect()}


def camera_clip(n, seed, h=240, w=320):
    rng = np.random.default_rng(seed)
    base = rng.integers(40, 200, (h // 8, w // 8, 3)).repeat(8, 0).repeat(8, 1)
    for i in range(n):
        frame = base + rng.normal(0, 3, base.shape)
        frame[60:160, (25 * i) % 240 :][:, :70] = 240 if i % 4 < 3 else base[0, 0]
        yield np.clip(frame, 0, 255).astype(np.uint8)


def test_tiles_methods_and_settings_in_a_stream_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table = frame_table(spark, {"one": list(camera_clip(14, 0)), "two": list(camera_clip(11, 1))})
    for low, high in ((0, 5), (5, 9), (9, 99)):
        table.filter((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    settings = spark.createDataFrame([("cat", "two", True, 4)], "category string, scene string, night boolean, warmup int")
    options = {"methods": ("MOG2", "KNN"), "min_area": 300, "pad": 4, "history": 20}
    stream = sources.stream_frames(spark, str(tmp_path / "frames"), max_files=1)
    made = streaming.stream_segments(stream, fps=4, segment_seconds=1, warmup=2, settings=settings, tile=160, **options)
    drained(made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")), "tiled")
    left = streaming.partial_segments(spark, str(tmp_path / "check"), fps=4)
    with_night = table.join(settings.drop("warmup"), ["category", "scene"], "left")
    activity = background.subtract_background(with_night, **options)
    warmup = F.when(F.col("scene") == "two", 4).otherwise(2)
    keyed = activity.withColumn("scene_method", F.concat_ws("/", "scene", "method"))
    built = [segments.build_segments(keyed, fps=4, segment_seconds=1, warmup=warmup, camera="scene_method", flush_partial=f) for f in (False, True)]
    full, all_ = ({(*r[0].split("/"), *r[1:]) for r in segment_set(b.withColumnRenamed("scene_method", "scene"))} for b in built)
    got, rest = segment_set(spark.table("tiled"), "method"), segment_set(left, "method")
    assert got == full and got | rest == all_ and not got & rest
    assert len(got) == 8 and {r[0] for r in rest} == {"two"} and any(r[4] for r in got)


def test_time_segments_and_running_report(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("cam", start + dt.timedelta(seconds=10 * i), int(i % 7 == 0)) for i in range(30)]
    frames = spark.createDataFrame(rows, "camera_id string, ts timestamp, n_regions int")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    made = streaming.stream_time_segments(stream, "60 seconds", "0 seconds")
    drained(made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")), "timed")
    found = spark.table("timed").orderBy("start").collect()
    assert [r.n_frames for r in found] == [6] * len(found) and len(found) >= 4 and found[0].duration == 60.0
    assert [(r.roi_count, r.crf) for r in found[:2]] == [(1, 18), (1, 18)]


def test_stream_to_index(spark, tmp_path):
    spark.createDataFrame(SEED, SEGMENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SEGMENTS).parquet(str(tmp_path / "in"))
    query = streaming.write_segments(stream, str(tmp_path / "index"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert segments.storage_report(sources.open_index(spark, str(tmp_path / "index"))).first().total_segments == 3
    drained(streaming.running_report(stream).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "check2")), "report")
    assert spark.table("report").first().total_bytes == 350000
    assert np.isclose(spark.table("report").first().total_gb, 0.0)


def test_silent_cameras_give_up_their_partial_segment(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame_table(spark, {"one": list(clip(9))}).coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = sources.stream_frames(spark, str(tmp_path / "frames"))
    made = streaming.stream_segments(stream, fps=4, segment_seconds=1, warmup=2, min_area=20, pad=4, flush_idle_seconds=1)
    writer = made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
    query = writer.format("memory").queryName("flushed").trigger(processingTime="1 second").start()
    until = time.time() + 90
    while time.time() < until and spark.table("flushed").count() < 2:
        time.sleep(1)
    query.stop()
    assert sorted((r.segment_no, r.n_frames, r.duration) for r in spark.table("flushed").collect()) == [(1, 4, 1.0), (2, 3, 0.75)]
