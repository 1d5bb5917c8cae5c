"""Scene manifests against what is there: plans, missing scenes, inputs, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import columns as C

SCENE = ["category", "scene"]


def attach_manifest(frames: DataFrame, manifest: DataFrame, how: str = "inner") -> DataFrame:
    """Adds night, sample_rate_override and ord; Spark broadcasts the manifest while it is small."""
    return frames.join(manifest.select(*SCENE, "night", "sample_rate_override", "ord"), SCENE, how)


def attach_roi(frames: DataFrame, rois: DataFrame) -> DataFrame:
    """Adds each clip's region of time where it has one; a clip is a scene of its category."""
    return frames.join(rois.select(*SCENE, "temporal_roi"), SCENE, "left")


def skip_categories(rows: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    return rows.filter(~F.col("category").isin(*skip)) if skip else rows


def kept_categories(manifest: DataFrame, skip: DataFrame) -> DataFrame:
    """Categories minus the skipped ones, each once."""
    return manifest.select("category").subtract(skip.select("category"))


def missing_scenes(manifest: DataFrame, found: DataFrame) -> DataFrame:
    return manifest.join(found.select(*SCENE), SCENE, "left_anti")


def plan_scenes(found: DataFrame, manifest: DataFrame, skip: tuple[str, ...] = (), sample_rate: int = 20) -> DataFrame:
    """Scenes to run with night flag and sample rate, in the manifest's order."""
    rows = skip_categories(manifest, skip).join(found.select(*SCENE).distinct(), SCENE, "left_semi")
    return rows.select(*SCENE, "night", F.coalesce("sample_rate_override", F.lit(sample_rate)).alias("sample_rate"), "ord").orderBy("ord")


def run_summary(manifest: DataFrame, found: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: scenes planned, not found, failed, completed."""
    marks = (
        manifest.select(*SCENE)
        .join(found.select(*SCENE).distinct().withColumn("_found", F.lit(1)), SCENE, "left")
        .join(rejected.select(*SCENE).distinct().withColumn("_failed", F.lit(1)), SCENE, "left")
    )
    there = F.col("_found").isNotNull()
    return marks.agg(
        F.count("*").alias("n_planned"),
        F.count_if(~there).alias("n_missing"),
        F.count_if(there & F.col("_failed").isNotNull()).alias("n_failed"),
        F.count_if(there & F.col("_failed").isNull()).alias("n_completed"),
    )


def clip_info(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """By clip: size of its first frame, frames, fps of an image sequence."""
    return frames.groupBy(*SCENE).agg(
        F.min_by("width", "frame_idx").alias("width"),
        F.min_by("height", "frame_idx").alias("height"),
        F.count("*").alias("total_frames"),
        F.lit(fps).alias("fps"),
    )


def scene_inputs(sequences: DataFrame, videos: DataFrame) -> DataFrame:
    """Scene folders and loose video files as one list of (scene, path)."""
    return sequences.select(C.scene_name("path").alias("scene"), "path").unionByName(
        videos.select(C.scene_name("path", sequence=False).alias("scene"), "path")
    )


def file_sizes(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Bytes of each wanted path; 0 where there is no such file."""
    return wanted.join(listing.select("path", "length"), "path", "left").withColumn("bytes", F.coalesce("length", F.lit(0))).drop("length")


def file_ratios(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    """Compression ratio of each (original, compressed) pair of paths; a missing file is an error.

    Files of no bytes are not in Spark's listings and count as missing.
    """
    sizes = listing.select("path", "length")

    def sized(rows: DataFrame, side: str) -> DataFrame:
        own = sizes.select(F.col("path").alias(side), F.col("length").alias(f"{side}_bytes"))
        missing = F.raise_error(F.concat(F.lit("no such file: "), F.col(side))).cast("long")
        return rows.join(own, side, "left").withColumn(f"{side}_bytes", F.coalesce(f"{side}_bytes", missing))

    both = sized(sized(pairs, "original"), "compressed")
    return both.withColumn("compression_ratio", C.compression_ratio("original_bytes", "compressed_bytes"))


def truncate_at_bad(frames: DataFrame, bad: Column, on_bad: str = "truncate") -> DataFrame:
    """Frames before a clip's first bad one, or all but the bad ones with ``on_bad="drop"``.

    The first bad place is found on indices only and joined back, so pixels are not moved
    for it.
    """
    if on_bad not in ("truncate", "drop"):
        raise ValueError("on_bad is truncate or drop")
    marked = frames.withColumn("_bad", bad)
    if on_bad == "drop":
        return marked.filter(~F.col("_bad")).drop("_bad")
    first = marked.filter("_bad").groupBy(*SCENE).agg(F.min("frame_idx").alias("_first"))
    return marked.join(first, SCENE, "left").filter(F.col("_first").isNull() | (F.col("frame_idx") < F.col("_first"))).drop("_bad", "_first")
