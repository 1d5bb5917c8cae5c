"""Foreground coverage of clips, scenes and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import columns as C

ACTIVITY = 0.001
SCENE = ("category", "scene", "method")


def after_warmup(frames: DataFrame, warmup: Column | int = 120) -> DataFrame:
    """Adds ``post_idx`` and keeps frames from the warm-up's end on; only after the model has seen them all."""
    warmup = warmup if isinstance(warmup, Column) else F.lit(warmup)
    return frames.withColumn("post_idx", F.col("frame_idx") - warmup).filter("post_idx >= 0")


def active(frames: DataFrame, activity: float = ACTIVITY) -> DataFrame:
    return frames.filter(F.col("coverage") > F.lit(activity))


def with_targets(frames: DataFrame) -> DataFrame:
    return frames.filter(F.size("regions") > 0)


def large_regions(frames: DataFrame, min_area: int = 500) -> DataFrame:
    """Frames with only the regions of at least that area."""
    return frames.withColumn("regions", F.filter("regions", lambda r: r["area"] >= min_area))


def sampled_frames(frames: DataFrame, sample_rate: int = 15, warmup: Column | int = 120, override: str | None = None) -> DataFrame:
    """Every n-th frame after the warm-up, with the name of its picture; a clip's own rate goes first."""
    rate = F.lit(sample_rate) if override is None else F.coalesce(F.col(override), F.lit(sample_rate))
    rows = after_warmup(frames, warmup).filter(F.col("post_idx") % rate == 0)
    return rows.withColumn("sample_name", C.sample_name("scene", "method", "frame_idx"))


def clip_coverage(frames: DataFrame, clips: DataFrame | None = None, warmup: Column | int = 120, sample_rate: Column | int = 15, activity: float = ACTIVITY) -> DataFrame:
    """By category, scene and method: frames analysed, average and highest coverage %, activity.

    Clips (by default those of the frames) without a frame after the warm-up have zeros.
    """
    warmup = warmup if isinstance(warmup, Column) else F.lit(warmup)
    post = F.col("frame_idx") - warmup
    seen = lambda x: F.when(post >= 0, x)
    share = F.col("coverage") * 100
    found = frames.groupBy(*SCENE).agg(
        F.count("*").alias("total_frames"),
        F.count(seen(F.lit(1))).alias("n"),
        C.mean_pct(seen(F.col("coverage"))).alias("mean"),
        F.max(seen(share)).alias("most"),
        F.count_if((post >= 0) & (F.col("coverage") > F.lit(activity))).alias("busy"),
        F.count_if((post >= 0) & (post % sample_rate == 0)).alias("sampled"),
    )
    if clips is not None:
        found = clips.select(*SCENE, "total_frames").join(found.drop("total_frames"), list(SCENE), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select(
        *SCENE,
        "total_frames",
        zero("n").alias("analyzed_frames"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_coverage_pct"),
        F.coalesce(F.round("most", 2), F.lit(0.0)).alias("max_coverage_pct"),
        zero("busy").alias("frames_with_activity"),
        F.round(zero("busy") / F.greatest(zero("n"), F.lit(1)) * 100, 1).alias("activity_rate_pct"),
        zero("sampled").alias("sample_images_saved"),
    )


def category_coverage(stats: DataFrame, by_method: bool = False) -> DataFrame:
    """Mean of the scenes' rounded averages; scenes weigh alike whatever their length."""
    keys = ["category", "method"] if by_method else ["category"]
    return stats.groupBy(*keys).agg(F.avg("avg_coverage_pct").alias("avg_coverage_pct"), F.countDistinct("scene").alias("n_scenes"))


def coverage_report(stats: DataFrame) -> DataFrame:
    """Scene rows and, with null scene and method, their category's mean."""
    rows = stats.select("category", "scene", "method", "avg_coverage_pct", "max_coverage_pct")
    return (
        rows.groupingSets([["category", "scene", "method"], ["category"]], "category", "scene", "method")
        .agg(F.avg("avg_coverage_pct").alias("avg_coverage_pct"), F.max("max_coverage_pct").alias("max_coverage_pct"))
    )


def compare_methods(stats: DataFrame, methods: tuple[str, str] = ("MOG2", "KNN")) -> DataFrame:
    """Both methods of a scene side by side: which gives less foreground, and by what factor."""
    a, b = methods
    wide = stats.groupBy("category", "scene").agg(
        F.max(F.when(F.col("method") == a, F.col("avg_coverage_pct"))).alias("first_pct"),
        F.max(F.when(F.col("method") == b, F.col("avg_coverage_pct"))).alias("second_pct"),
    )
    low, high = F.least("first_pct", "second_pct"), F.greatest("first_pct", "second_pct")
    return wide.withColumns(
        {
            "difference_pct": F.col("second_pct") - F.col("first_pct"),
            "less_foreground": F.when(F.col("first_pct") < F.col("second_pct"), a).when(F.col("first_pct") > F.col("second_pct"), b),
            "factor": F.when(F.col("first_pct").isNotNull() & F.col("second_pct").isNotNull() & (low > 0), high / low),
        }
    )


def report_order(stats: DataFrame, manifest: DataFrame, methods: tuple[str, ...] = ("MOG2", "KNN")) -> DataFrame:
    """Rows in the manifest's order, methods in theirs."""
    place = F.coalesce(*[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(methods)], F.lit(len(methods)))
    return stats.join(manifest.select("category", "scene", "ord"), ["category", "scene"]).withColumn("method_ord", place).orderBy("ord", "method_ord")
