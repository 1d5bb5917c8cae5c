"""Whole workloads for spark-submit.

python -m vigilake.plans.jobs import IMAGES FRAMES
python -m vigilake.plans.jobs study FRAMES OUT [--warmup N] [--rois IMAGES] [--manifest CSV|standard] [--skip CATEGORY ...] [--every N] MODEL
python -m vigilake.plans.jobs compress FRAMES OUT [--warmup N] [--rois IMAGES] [--method NAME] MODEL
python -m vigilake.plans.jobs index FRAMES INDEX --start TIME [--fps F] [--seconds S] [--warmup N] [--rois IMAGES] [--method NAME] [--batch NAME] MODEL
python -m vigilake.plans.jobs recent INDEX CAMERA [--hours N] [--now TIME] [--out PATH]
python -m vigilake.plans.jobs daily INDEX [--out PATH]
python -m vigilake.plans.jobs expire INDEX --days N [--now TIME] [--grace HOURS]

MODEL is [--night] [--tile N] [--min-area N] [--pad N] [--history N].
"""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import columns as C
from vigilake.operators import background, compaction, coverage, resume, scenes, scorecard, segments
from vigilake.sources import frames as sources
from vigilake.sources import manifest as manifests
from vigilake.sources import sinks

_SCENE = ["category", "scene"]


def with_warmup(rows: DataFrame, warmup: int, rois: DataFrame | None) -> tuple[DataFrame, Column | int]:
    """Rows, and where their clip's warm-up ends: where its region of time begins, or at ``warmup`` without one."""
    if rois is None:
        return rows, warmup
    return scenes.attach_roi(rows, rois), C.warmup_frames("temporal_roi", warmup)


def coverage_study(
    frames: DataFrame,
    out: str,
    warmup: int = 120,
    rois: DataFrame | None = None,
    manifest: DataFrame | None = None,
    skip: tuple[str, ...] = (),
    sample_rate: int = 15,
    every: int = 2000,
    **options,
) -> None:
    """Activity, clip statistics, category means, methods side by side, rejects and a summary, as tables below ``out``.

    With ``rois`` (category, scene, temporal_roi) a clip's warm-up ends where its region of time
    begins; clips without one have ``warmup``.  A ``manifest`` chooses the scenes and gives
    their night flags and sample rates.  A scene that fails is told in ``rejects`` and left
    out of the statistics; the others go on.  Models run in steps of ``every`` frames, so
    that a job started again goes on behind the last one.
    """
    spark = frames.sparkSession
    frames = scenes.skip_categories(frames, skip)
    found = frames.select(*_SCENE).distinct()
    planned = found if manifest is None else scenes.skip_categories(manifest, skip)
    rates = planned.select(*_SCENE, F.coalesce("sample_rate_override", F.lit(sample_rate)).alias("_rate")) if manifest is not None else None
    if manifest is not None:
        frames = scenes.attach_manifest(frames, planned)
    activity = resume.run(frames, f"{out}/steps", every, **options)
    bad = resume.stored_rejects(spark, f"{out}/steps")
    bad.write.mode("overwrite").parquet(f"{out}/rejects")
    bad = spark.read.parquet(f"{out}/rejects")
    scenes.run_summary(planned, found, bad).write.mode("overwrite").parquet(f"{out}/summary")
    activity.join(bad.select(*_SCENE), _SCENE, "left_anti").write.mode("overwrite").parquet(f"{out}/activity")
    rows, start = with_warmup(spark.read.parquet(f"{out}/activity"), warmup, rois)
    rate: Column | int = sample_rate
    if rates is not None:
        rows, rate = rows.join(rates, _SCENE), F.col("_rate")
    coverage.clip_coverage(rows, warmup=start, sample_rate=rate).write.mode("overwrite").parquet(f"{out}/clips")
    stats = spark.read.parquet(f"{out}/clips")
    coverage.coverage_report(stats).write.mode("overwrite").parquet(f"{out}/report")
    coverage.compare_methods(stats).write.mode("overwrite").parquet(f"{out}/methods")


def camera_names(frames: DataFrame) -> DataFrame:
    """(category, scene, camera): the scene's name, with its category where two categories share it."""
    named = frames.select(*_SCENE).distinct()
    shared = named.groupBy("scene").agg(F.count("*").alias("_n"))
    camera = F.when(F.col("_n") > 1, F.concat_ws("_", "category", "scene")).otherwise(F.col("scene"))
    return named.join(shared, "scene").select(*_SCENE, camera.alias("camera"))


def index_feed(
    frames: DataFrame,
    index: str,
    start: str,
    fps: float = 30.0,
    seconds: float = 60,
    warmup: int = 120,
    method: str = "MOG2",
    rois: DataFrame | None = None,
    batch: str | None = None,
    every: int = 2000,
    **options,
) -> str:
    """Segments of each scene's feed, packed at their tier, written to the index as one batch; its name.

    ``start`` is the time of the feeds' first frame; a segment's time is that of its own
    first frame.  By default the batch is named after the feed's settings and scenes, so
    that the same job run again writes the same rows over its own.  Models go on where an
    earlier, interrupted run of the batch ended.
    """
    spark = frames.sparkSession
    cameras = camera_names(frames)
    if batch is None:
        whole = cameras.agg(F.sum(F.xxhash64(*_SCENE).cast("decimal(38,0)")).cast("string")).first()[0]
        settings = f"{start} {fps} {seconds} {warmup} {method} {sorted(options.items())} {whole}"
        batch = f"feed-{spark.range(1).select(F.sha2(F.lit(settings), 256)).first()[0][:16]}"
    work = f"{index.rstrip('/')}.work/{batch}"
    activity = resume.run(frames, f"{work}/steps", every, methods=(method,), **options).join(cameras, _SCENE)
    rows, begin = with_warmup(activity, warmup, rois)
    built = segments.build_segments(rows, fps, seconds, begin, camera="camera")
    numbered, begin = with_warmup(frames.join(cameras, _SCENE), warmup, rois)
    numbered = segments.number_segments(numbered, max(1, int(fps * seconds)), begin)
    packed = compaction.pack_frames(numbered.join(built.select("camera", "segment_no", "crf"), ["camera", "segment_no"]), ("camera", "segment_no"), keep_decoded=False)
    sized = built.join(compaction.segment_sizes(packed, ("camera", "segment_no")).select("camera", "segment_no", "file_size"), ["camera", "segment_no"], "left")
    begins, begin = with_warmup(cameras, warmup, rois)
    sized = sized.join(begins.select("camera", (begin if isinstance(begin, Column) else F.lit(begin)).alias("_begin")), "camera")
    seconds_in = (F.col("_begin") + (F.col("segment_no") - 1) * max(1, int(fps * seconds))) / fps
    began = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + seconds_in)
    sinks.append_segments(segments.index_rows(sized, began, F.col("file_size"), camera="camera"), index, batch)
    return batch


def compression_study(
    frames: DataFrame, out: str, method: str = "MOG2", warmup: int = 120, baseline: int = 23, fps: float = 30.0, seconds: float = 60, rois: DataFrame | None = None, **options
) -> None:
    """Baseline and selective variants of every scene: sizes, quality and scorecard, as tables and one CSV file."""
    spark = frames.sparkSession
    background.subtract_background(frames, methods=(method,), **options).write.mode("overwrite").parquet(f"{out}/activity")
    rows, begin = with_warmup(spark.read.parquet(f"{out}/activity"), warmup, rois)
    tiers = scorecard.tier_plan(rows, warmup=begin)
    numbered = segments.number_segments(frames, max(1, int(fps * seconds)), 0)
    for variant, rows in (("baseline", numbered.withColumn("crf", F.lit(baseline))), ("selective", numbered.join(tiers.select("category", "scene", F.col("crf_used").alias("crf")), ["category", "scene"]))):
        compaction.pack_frames(rows).write.mode("overwrite").parquet(f"{out}/{variant}")
    sizes = frames.groupBy("category", "scene").agg(F.sum(F.length("px")).alias("bytes")).withColumn("variant", F.lit("original"))
    for variant in ("baseline", "selective"):
        packed = spark.read.parquet(f"{out}/{variant}").groupBy("category", "scene").agg(F.sum("bytes").alias("bytes"))
        sizes = sizes.unionByName(packed.withColumn("variant", F.lit(variant)))
    quality = compaction.sampled_quality(frames, spark.read.parquet(f"{out}/selective"))
    card = scorecard.scorecard(scorecard.variant_sizes(sizes), tiers, quality)
    card.write.mode("overwrite").parquet(f"{out}/scorecard")
    sinks.save_csv(spark.read.parquet(f"{out}/scorecard"), f"{out}/scorecard_csv")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *places: str, model: bool = False) -> argparse.ArgumentParser:
        made = jobs.add_parser(name)
        for place in places:
            made.add_argument(place)
        if model:
            made.add_argument("--warmup", type=int, default=120)
            made.add_argument("--rois")
            made.add_argument("--night", action="store_true")
            for option, kind in (("--tile", int), ("--min-area", float), ("--pad", int), ("--history", int)):
                made.add_argument(option, type=kind)
        return made

    job("import", "images", "frames")
    study = job("study", "frames", "out", model=True)
    study.add_argument("--manifest")
    study.add_argument("--skip", nargs="*", default=[])
    study.add_argument("--every", type=int, default=2000)
    compress = job("compress", "frames", "out", model=True)
    index = job("index", "frames", "index", model=True)
    for made in (compress, index):
        made.add_argument("--method", default="MOG2")
    index.add_argument("--start", required=True)
    index.add_argument("--fps", type=float, default=30.0)
    index.add_argument("--seconds", type=float, default=60)
    index.add_argument("--batch")
    recent = job("recent", "index", "camera")
    recent.add_argument("--hours", type=float, default=24)
    recent.add_argument("--now")
    recent.add_argument("--out")
    job("daily", "index").add_argument("--out")
    expire = job("expire", "index")
    expire.add_argument("--days", type=int, required=True)
    expire.add_argument("--now", type=datetime.fromisoformat)
    expire.add_argument("--grace", type=float, default=24)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.job in ("study", "compress", "index"):
        frames = sources.read_frame_table(spark, given.frames)
        rois = sources.read_temporal_roi(spark, given.rois) if given.rois else None
        options = {k: v for k, v in (("tile", given.tile), ("min_area", given.min_area), ("pad", given.pad), ("history", given.history)) if v is not None}
        options |= {"night_mode": given.night, "warmup": given.warmup, "rois": rois}
    if given.job == "import":
        sources.compact_frames(sources.read_frames(spark, given.images), given.frames)
    elif given.job == "study":
        manifest = None
        if given.manifest:
            manifest = manifests.standard_manifest(spark) if given.manifest == "standard" else manifests.read_manifest(spark, given.manifest)
        coverage_study(frames, given.out, manifest=manifest, skip=tuple(given.skip), every=given.every, **options)
    elif given.job == "compress":
        compression_study(frames, given.out, given.method, **options)
    elif given.job == "index":
        index_feed(frames, given.index, given.start, given.fps, given.seconds, method=given.method, batch=given.batch, **options)
    elif given.job == "recent":
        deliver(segments.recent_targets(sources.open_index(spark, given.index), stored_name(given.camera), given.hours, given.now), given.out)
    elif given.job == "expire":
        now = given.now or datetime.now(timezone.utc).replace(tzinfo=None)
        print(*sinks.expire_segments(spark, given.index, given.days, now, timedelta(hours=given.grace)), sep="\n")
    else:
        deliver(segments.daily_storage(sources.open_index(spark, given.index)), given.out)


def deliver(rows: DataFrame, out: str | None) -> None:
    """All rows: as CSV files below ``out``, or printed one by one."""
    if out:
        rows.write.mode("overwrite").option("header", True).csv(out)
        return
    print(*rows.columns, sep="\t")
    for row in rows.toLocalIterator():
        print(*row, sep="\t")


def stored_name(name: str) -> str:
    """The camera's stored name."""
    import re

    return re.sub("[^a-zA-Z0-9_-]", "_", name)


if __name__ == "__main__":
    main()
