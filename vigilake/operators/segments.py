"""Segments of camera feeds: building them, and the questions asked of their index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import columns as C
from vigilake.schemas import SEGMENTS


def number_segments(frames: DataFrame, per_segment: Column | int, warmup: Column | int = 120) -> DataFrame:
    """Frames after the warm-up with ``post_idx`` and ``segment_no`` (from 1)."""
    warmup, per_segment = (x if isinstance(x, Column) else F.lit(x) for x in (warmup, per_segment))
    rows = frames.withColumn("post_idx", F.col("frame_idx") - warmup).filter("post_idx >= 0")
    return rows.withColumn("segment_no", (F.floor(F.col("post_idx") / per_segment) + 1).cast("long"))


def build_segments(
    frames: DataFrame,
    fps: float = 30.0,
    segment_seconds: float = 60,
    warmup: int = 120,
    flush_partial: bool = False,
    nominal_duration: float | None = None,
    camera: str = "camera_id",
    regions: Column | None = None,
    foreground: int = 18,
    background: int = 40,
) -> DataFrame:
    """Count-based segments: n_frames, frames_with_targets, roi_count, target_detected, duration, crf.

    ``regions`` is the number of boxes of a frame (by default the size of ``regions``).  The
    last segment of a camera is dropped unless it is full or ``flush_partial`` is set.  The
    duration is frames over fps, or the nominal one where given.
    """
    per_segment = max(1, int(fps * segment_seconds))
    boxes = F.size("regions") if regions is None else regions
    numbered = number_segments(frames, per_segment, warmup).withColumn("_boxes", F.greatest(boxes, F.lit(0)).cast("long"))
    built = numbered.groupBy(camera, "segment_no").agg(
        F.count("*").alias("n_frames"),
        F.count_if(F.col("_boxes") > 0).alias("frames_with_targets"),
        F.sum("_boxes").alias("roi_count"),
        F.max((F.col("_boxes") > 0).cast("int")).alias("target_detected"),
    )
    if not flush_partial:
        built = built.filter(F.col("n_frames") == per_segment)
    duration = F.col("n_frames") / fps if nominal_duration is None else F.lit(float(nominal_duration))
    return built.withColumn("duration", duration).withColumn("crf", C.quality_tier(F.col("target_detected") == 1, foreground, background))


def check_segments(frames: DataFrame, keys: tuple[str, ...] = ("camera_id", "segment_no")) -> DataFrame:
    """Segments that cannot be encoded, with a reason: no frame, frames of several sizes, or box lists missing."""
    found = frames.groupBy(*keys).agg(
        F.count("frame_idx").alias("n_frames"),
        F.count("regions").alias("n_lists"),
        F.countDistinct("width", "height").alias("n_sizes"),
    )
    reason = F.when(F.col("n_frames") == 0, "empty").when(F.col("n_sizes") > 1, "sizes differ").when(F.col("n_lists") != F.col("n_frames"), "box lists missing")
    return found.withColumn("reason", reason).filter("reason IS NOT NULL")


def index_rows(segments: DataFrame, start: Column, sizes: Column, camera: str = "camera_id") -> DataFrame:
    """Rows of the segment index: stable ids, time texts and paths from the segment's own start."""
    stamp = C.segment_time_text(start)
    return segments.select(
        F.xxhash64(camera, "segment_no").alias("id"),
        stamp.alias("timestamp"),
        C.camera_name(camera).alias("camera_id"),
        F.col("target_detected").cast("int").alias("target_detected"),
        F.col("roi_count").cast("long").alias("roi_count"),
        F.coalesce(sizes, F.lit(0)).cast("long").alias("file_size"),
        F.col("duration").cast("double").alias("duration"),
        C.segment_path(C.camera_name(camera), stamp, "segment_no").alias("file_path"),
    )


def _on_days_since(segments: DataFrame, since: Column) -> DataFrame:
    """Rows whose text of time is not before ``since``; of an index by days, only those days are opened.

    The time comes as ``_ts``.
    """
    if "date" in segments.columns:
        segments = segments.filter(F.col("date") >= F.date_format(since, "yyyyMMdd"))
    return segments.withColumn("_ts", C.segment_time("timestamp")).filter(F.col("_ts") >= since)


def recent_targets(segments: DataFrame, camera_id: str, hours: float = 24, now: datetime | str | None = None) -> DataFrame:
    """Segments of a camera with targets in the hours before ``now`` and after it, newest first."""
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    since = moment - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours * 60) % 60))
    rows = segments.filter((F.col("camera_id") == camera_id) & (F.col("target_detected") == 1))
    return _on_days_since(rows, since).orderBy(F.desc("_ts"), F.desc("id")).select(*[f.name for f in SEGMENTS])


def busiest_segments(segments: DataFrame, limit: int = 50) -> DataFrame:
    """Segments with targets by number of regions."""
    return segments.filter("target_detected = 1").orderBy(F.desc("roi_count"), "id").limit(limit).select(*[f.name for f in SEGMENTS])


def daily_storage(segments: DataFrame) -> DataFrame:
    """Bytes and hours by day and camera, latest day first."""
    return (
        segments.groupBy((F.col("date") if "date" in segments.columns else C.day_key("timestamp")).alias("date"), "camera_id")
        .agg(F.sum("file_size").alias("total_bytes"), C.hours(F.sum("duration")).alias("total_hours"))
        .orderBy(F.desc("date"), "camera_id")
    )


def storage_report(segments: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty index."""
    return segments.agg(
        F.count("*").alias("total_segments"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(C.gigabytes(F.sum("file_size")), F.lit(0.0)).alias("total_gb"),
        F.count_if(F.col("target_detected") == 1).alias("segments_with_targets"),
        F.coalesce(F.sum("roi_count"), F.lit(0)).alias("total_roi_count"),
        F.coalesce(C.hours(F.sum("duration"), 2), F.lit(0.0)).alias("total_duration_hours"),
    )


def retained(segments: DataFrame, days: int, now: datetime | str) -> DataFrame:
    """Segments not older than the retention time."""
    return _on_days_since(segments, F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))).drop("_ts")


def weekly_storage(segments: DataFrame) -> DataFrame:
    """Bytes that a week would take at each camera's rate so far."""
    return segments.groupBy("camera_id").agg(
        F.sum("file_size").alias("bytes"),
        (F.sum("duration") / 3600.0).alias("hours"),
        F.when(F.sum("duration") > 0, F.sum("file_size") / (F.sum("duration") / 3600.0) * 168).alias("week_bytes"),
    )
