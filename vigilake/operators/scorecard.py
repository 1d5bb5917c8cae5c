"""Compression tiers, quality and scorecards of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import columns as C
from vigilake.operators.coverage import ACTIVITY, after_warmup

TARGET_RATIO = 6.0


def tier_plan(frames: DataFrame, fg_crf: int = 20, bg_crf: int = 40, warmup: Column | int = 120, activity: float = ACTIVITY) -> DataFrame:
    """By scene and method: frames analysed, average coverage %, whether anything moved, and the tier that follows."""
    found = after_warmup(frames, warmup).groupBy("category", "scene", "method").agg(
        F.count("*").alias("frames_analyzed"),
        C.mean_pct("coverage").alias("avg_coverage_pct"),
        F.coalesce(F.max(F.col("coverage") > F.lit(activity)), F.lit(False)).alias("has_targets"),
    )
    return found.withColumn("crf_used", C.quality_tier("has_targets", fg_crf, bg_crf))


def even_samples(clips: DataFrame, total: str = "total_frames", k: int = 30) -> DataFrame:
    """One row for each of up to k evenly spaced frames of a clip; none for an empty clip."""
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col(total) - 1) / F.lit(max(k - 1, 1))).cast("long")
    )
    return clips.filter((F.col(total) > 0) & F.lit(k > 0)).withColumn("frame_idx", F.explode(F.array_distinct(spaced)))


def quality(original: DataFrame, compressed: DataFrame, keys: tuple[str, ...] = ("category", "scene"), k: int = 30, ssim: Column | None = None) -> DataFrame:
    """Mean PSNR (and SSIM, from columns ``px`` and ``px2``) of evenly spaced frames of both variants.

    Both have ``frame_idx`` and ``px`` (an array).  Frames pair up to the shorter variant;
    the samples are chosen before pixels are joined.  Zeros where no frame pairs.
    """
    clips = original.groupBy(*keys).agg(F.count("*").alias("total_frames"))
    chosen = even_samples(clips, k=k).select(*keys, "frame_idx")
    at = [*keys, "frame_idx"]
    first = original.join(chosen, at, "left_semi").select(*at, "px")
    second = compressed.join(chosen, at, "left_semi").select(*at, F.col("px").alias("px2"))
    scores = first.join(second, at).withColumn("_psnr", C.psnr("px", "px2")).withColumn("_ssim", F.lit(None).cast("double") if ssim is None else ssim)
    found = scores.groupBy(*keys).agg(F.avg("_psnr").alias("p"), F.avg("_ssim").alias("s"), F.count("*").alias("samples_used"))
    return clips.join(found, list(keys), "left").select(
        *keys,
        F.coalesce(C.rounded(F.col("p"), 2), F.lit(0.0)).alias("psnr"),
        F.coalesce(F.round("s", 4), F.lit(0.0)).alias("ssim"),
        F.coalesce("samples_used", F.lit(0)).alias("samples_used"),
    )


def variant_sizes(files: DataFrame, keys: tuple[str, ...] = ("category", "scene")) -> DataFrame:
    """Bytes of the original, baseline and selective variants side by side; 0 where one is missing."""
    side = lambda v: F.coalesce(F.sum(F.when(F.col("variant") == v, F.col("bytes"))), F.lit(0)).alias(f"{v}_bytes")
    return files.groupBy(*keys).agg(*[side(v) for v in ("original", "baseline", "selective")])


def scorecard(sizes: DataFrame, tiers: DataFrame, scores: DataFrame | None = None, target: float = TARGET_RATIO, keys: tuple[str, ...] = ("category", "scene")) -> DataFrame:
    """By clip (``keys``) and method: sizes in MB, ratios, their improvement, quality and tier, and whether the target is met.

    The improvement is that of the unrounded ratios, the baseline's taken as 0.001 at least.
    """
    rows = tiers.join(sizes, list(keys), "left")
    if scores is not None:
        rows = rows.join(scores, list(keys), "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda c: part("original_bytes") / F.greatest(part(c), F.lit(1))
    base, selective = ratio("baseline_bytes"), ratio("selective_bytes")
    quality_columns = [c for c in ("psnr", "ssim") if c in rows.columns]
    return rows.select(
        *keys,
        "method",
        C.megabytes(part("original_bytes")).alias("original_mb"),
        C.megabytes(part("baseline_bytes")).alias("baseline_mb"),
        C.megabytes(part("selective_bytes")).alias("selective_mb"),
        F.round(base, 2).alias("baseline_ratio"),
        F.round(selective, 2).alias("selective_ratio"),
        F.round(selective / F.greatest(base, F.lit(0.001)), 2).alias("ratio_improvement"),
        *quality_columns,
        "avg_coverage_pct",
        "has_targets",
        "crf_used",
        (selective >= target).alias("meets_target"),
    )
