"""Queries over the given tables, each with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions import columns as C
from vigilake.operators import background, compaction, coverage, objects, scenes, scorecard, segments
from vigilake.plans import views as V
from vigilake.plans.mixture_sql import mixture_ctes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


INDEX = "id, timestamp, camera_id, target_detected, roi_count, file_size, duration, file_path"


@query(
    "daily_storage",
    f"""WITH {V.SEGMENTS_SQL} SELECT substr(timestamp, 1, 8) AS date, camera_id, CAST(sum(file_size) AS BIGINT) AS total_bytes,
    round(sum(duration) / 3600.0, 3) AS total_hours FROM segments_v GROUP BY ALL ORDER BY date DESC, camera_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return segments.daily_storage(V.segments(spark, d))


@query(
    "storage_report",
    f"""WITH {V.SEGMENTS_SQL} SELECT count(*) AS total_segments, CAST(sum(file_size) AS BIGINT) AS total_bytes, round(sum(file_size) / 1e9, 3) AS total_gb,
    count(*) FILTER (WHERE target_detected = 1) AS segments_with_targets, CAST(sum(roi_count) AS BIGINT) AS total_roi_count,
    round(sum(duration) / 3600.0, 2) AS total_duration_hours FROM segments_v""",
)
def _(spark, d):
    return segments.storage_report(V.segments(spark, d))


@query(
    "recent_targets",
    f"""WITH {V.SEGMENTS_SQL} SELECT {INDEX} FROM segments_v WHERE camera_id = 'cam_3' AND target_detected = 1
    AND strptime(timestamp, '%Y%m%dT%H%M%SZ') >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR ORDER BY timestamp DESC, id DESC""",
)
def _(spark, d):
    return segments.recent_targets(V.segments(spark, d), "cam_3", 72, NOW)


@query(
    "busiest_segments",
    f"WITH {V.SEGMENTS_SQL} SELECT {INDEX} FROM segments_v WHERE target_detected = 1 ORDER BY roi_count DESC, id LIMIT 50",
)
def _(spark, d):
    return segments.busiest_segments(V.segments(spark, d))


@query(
    "retained_segments",
    f"WITH {V.SEGMENTS_SQL} SELECT {INDEX} FROM segments_v WHERE strptime(timestamp, '%Y%m%dT%H%M%SZ') >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY",
)
def _(spark, d):
    return segments.retained(V.segments(spark, d), 7, NOW)


@query(
    "weekly_storage",
    f"""WITH {V.SEGMENTS_SQL} SELECT camera_id, CAST(sum(file_size) AS BIGINT) AS bytes, sum(duration) / 3600.0 AS hours,
    sum(file_size) / (sum(duration) / 3600.0) * 168 AS week_bytes FROM segments_v GROUP BY camera_id""",
)
def _(spark, d):
    return segments.weekly_storage(V.segments(spark, d))


@query(
    "segment_times",
    f"""WITH {V.SEGMENTS_SQL} SELECT id, strptime(timestamp, '%Y%m%dT%H%M%SZ') AS ts, strptime(replace(timestamp, 'T', ''), '%Y%m%d%H%M%SZ') AS ts_plain,
    substr(timestamp, 1, 8) AS date, concat(camera_id, '_', timestamp, '.mp4') AS path FROM segments_v""",
)
def _(spark, d):
    plain = F.regexp_replace("timestamp", "T", "")
    return V.segments(spark, d).select(
        "id",
        C.segment_time("timestamp").cast("timestamp_ntz").alias("ts"),
        C.segment_time(plain).cast("timestamp_ntz").alias("ts_plain"),
        C.day_key("timestamp").alias("date"),
        C.segment_path("camera_id", "timestamp").alias("path"),
    )


@query("clip_coverage", f"WITH {V.STATS_SQL} SELECT * FROM clip_stats")
def _(spark, d):
    return coverage.clip_coverage(V.frame_coverage(spark, d))


@query(
    "category_coverage",
    f"WITH {V.STATS_SQL} SELECT category, avg(avg_coverage_pct) AS avg_coverage_pct, count(DISTINCT scene) AS n_scenes FROM clip_stats GROUP BY category",
)
def _(spark, d):
    return coverage.category_coverage(coverage.clip_coverage(V.frame_coverage(spark, d)))


@query(
    "category_method_coverage",
    f"""WITH {V.STATS_SQL} SELECT category, method, avg(avg_coverage_pct) AS avg_coverage_pct, count(DISTINCT scene) AS n_scenes
    FROM clip_stats GROUP BY category, method""",
)
def _(spark, d):
    return coverage.category_coverage(coverage.clip_coverage(V.frame_coverage(spark, d)), by_method=True)


@query(
    "coverage_report",
    f"""WITH {V.STATS_SQL} SELECT category, scene, method, avg(avg_coverage_pct) AS avg_coverage_pct, max(max_coverage_pct) AS max_coverage_pct
    FROM clip_stats GROUP BY GROUPING SETS ((category, scene, method), (category))""",
)
def _(spark, d):
    return coverage.coverage_report(coverage.clip_coverage(V.frame_coverage(spark, d)))


@query(
    "method_comparison",
    f"""WITH {V.STATS_SQL}, wide AS (SELECT category, scene, max(avg_coverage_pct) FILTER (WHERE method = 'MOG2') AS first_pct,
      max(avg_coverage_pct) FILTER (WHERE method = 'KNN') AS second_pct FROM clip_stats GROUP BY ALL)
    SELECT *, second_pct - first_pct AS difference_pct,
      CASE WHEN first_pct < second_pct THEN 'MOG2' WHEN first_pct > second_pct THEN 'KNN' END AS less_foreground,
      CASE WHEN first_pct IS NOT NULL AND second_pct IS NOT NULL AND least(first_pct, second_pct) > 0
        THEN greatest(first_pct, second_pct) / least(first_pct, second_pct) END AS factor FROM wide""",
)
def _(spark, d):
    return coverage.compare_methods(coverage.clip_coverage(V.frame_coverage(spark, d)))


@query(
    "sampled_frames",
    f"""WITH {V.FRAMES_SQL} SELECT scene, method, frame_idx, frame_idx - 120 AS post_idx,
      concat(scene, '_', method, '_frame', lpad(CAST(frame_idx AS VARCHAR), 5, '0'), '.jpg') AS sample_name
    FROM frame_cov_v WHERE frame_idx >= 120 AND (frame_idx - 120) % 15 = 0""",
)
def _(spark, d):
    return coverage.sampled_frames(V.frame_coverage(spark, d)).select("scene", "method", "frame_idx", "post_idx", "sample_name")


@query(
    "active_frames",
    f"""WITH {V.FRAMES_SQL} SELECT category, scene, method, count(*) AS n_active, count(*) FILTER (WHERE n_regions > 0) AS n_with_targets
    FROM frame_cov_v WHERE frame_idx >= 120 AND coverage > 0.001 GROUP BY ALL""",
)
def _(spark, d):
    rows = coverage.active(coverage.after_warmup(V.frame_coverage(spark, d)))
    return rows.groupBy("category", "scene", "method").agg(F.count("*").alias("n_active"), F.count_if(F.col("n_regions") > 0).alias("n_with_targets"))


BUILT_SQL = (
    V.FRAMES_SQL
    + """, numbered AS (SELECT concat(scene, '_', method) AS camera_id, CAST(floor((frame_idx - 120) / 30) AS BIGINT) + 1 AS segment_no, n_regions
    FROM frame_cov_v WHERE frame_idx >= 120),
  built AS (SELECT camera_id, segment_no, count(*) AS n_frames, count(*) FILTER (WHERE n_regions > 0) AS frames_with_targets,
    CAST(sum(n_regions) AS BIGINT) AS roi_count, max(CASE WHEN n_regions > 0 THEN 1 ELSE 0 END) AS target_detected FROM numbered GROUP BY ALL)"""
)


def _cameras(spark, d):
    return V.frame_coverage(spark, d).withColumn("camera_id", F.concat_ws("_", "scene", "method"))


@query(
    "built_segments",
    f"WITH {BUILT_SQL} SELECT *, n_frames / 10.0::DOUBLE AS duration, CASE WHEN target_detected = 1 THEN 18 ELSE 40 END AS crf FROM built WHERE n_frames = 30",
)
def _(spark, d):
    return segments.build_segments(_cameras(spark, d), fps=10.0, segment_seconds=3, regions=F.col("n_regions"))


@query(
    "built_segments_flushed",
    f"WITH {BUILT_SQL} SELECT *, CAST(3.0 AS DOUBLE) AS duration, CASE WHEN target_detected = 1 THEN 18 ELSE 40 END AS crf FROM built",
)
def _(spark, d):
    return segments.build_segments(_cameras(spark, d), fps=10.0, segment_seconds=3, regions=F.col("n_regions"), flush_partial=True, nominal_duration=3.0)


@query(
    "rejected_segments",
    """WITH f AS (SELECT l_suppkey AS camera_id, l_orderkey % 50 AS segment_no, l_orderkey AS frame_idx, CASE WHEN l_partkey % 97 = 0 THEN 320 ELSE 640 END AS width,
      480 AS height, CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE l_quantity END AS regions FROM lineitem),
    g AS (SELECT camera_id, segment_no, count(frame_idx) AS n_frames, count(regions) AS n_lists, count(DISTINCT (width, height)) AS n_sizes FROM f GROUP BY ALL)
    SELECT *, CASE WHEN n_frames = 0 THEN 'empty' WHEN n_sizes > 1 THEN 'sizes differ' WHEN n_lists <> n_frames THEN 'box lists missing' END AS reason
    FROM g WHERE n_frames = 0 OR n_sizes > 1 OR n_lists <> n_frames""",
)
def _(spark, d):
    frames = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("camera_id"),
        (F.col("l_orderkey") % 50).alias("segment_no"),
        F.col("l_orderkey").alias("frame_idx"),
        F.when(F.col("l_partkey") % 97 == 0, 320).otherwise(640).alias("width"),
        F.lit(480).alias("height"),
        F.when(F.col("l_partkey") % 89 != 0, F.col("l_quantity")).alias("regions"),
    )
    return segments.check_segments(frames)


TIERS_SQL = (
    V.FRAMES_SQL
    + f""", tiers AS (SELECT category, scene, method, count(*) AS frames_analyzed, {V.MEAN_PCT_SQL} AS avg_coverage_pct,
    coalesce(bool_or(coverage > 0.001), FALSE) AS has_targets, CASE WHEN coalesce(bool_or(coverage > 0.001), FALSE) THEN 20 ELSE 40 END AS crf_used
    FROM frame_cov_v WHERE frame_idx >= 120 GROUP BY ALL)"""
)


@query("tier_plan", f"WITH {TIERS_SQL} SELECT * FROM tiers")
def _(spark, d):
    return scorecard.tier_plan(V.frame_coverage(spark, d))


VARIANTS_SQL = (
    V.SIZES_SQL
    + """, sizes AS (SELECT scene, CAST(coalesce(sum(original_bytes) FILTER (WHERE l_linenumber % 3 = 0), 0) AS BIGINT) AS original_bytes,
    CAST(coalesce(sum(compressed_bytes) FILTER (WHERE l_linenumber % 3 = 1), 0) AS BIGINT) AS baseline_bytes,
    CAST(coalesce(sum(compressed_bytes) FILTER (WHERE l_linenumber % 3 = 2), 0) AS BIGINT) AS selective_bytes FROM sizes_v GROUP BY scene)"""
)


def _variants(spark, d):
    kind = F.element_at(F.array(F.lit("original"), F.lit("baseline"), F.lit("selective")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = V.sizes(spark, d).withColumn("variant", kind)
    return scorecard.variant_sizes(rows.withColumn("bytes", F.when(F.col("variant") == "original", F.col("original_bytes")).otherwise(F.col("compressed_bytes"))), ("scene",))


@query("variant_sizes", f"WITH {VARIANTS_SQL} SELECT * FROM sizes")
def _(spark, d):
    return _variants(spark, d)


@query(
    "scorecard",
    f"""WITH {TIERS_SQL}, {VARIANTS_SQL}, r AS (SELECT *, original_bytes / greatest(baseline_bytes, 1) AS base, original_bytes / greatest(selective_bytes, 1) AS sel
      FROM tiers JOIN sizes USING (scene))
    SELECT scene, method, round(original_bytes / 1e6, 2) AS original_mb, round(baseline_bytes / 1e6, 2) AS baseline_mb, round(selective_bytes / 1e6, 2) AS selective_mb,
      round(base, 2) AS baseline_ratio, round(sel, 2) AS selective_ratio, round(sel / greatest(base, 0.001), 2) AS ratio_improvement,
      avg_coverage_pct, has_targets, crf_used, sel >= 6.0 AS meets_target FROM r""",
)
def _(spark, d):
    return scorecard.scorecard(_variants(spark, d), scorecard.tier_plan(V.frame_coverage(spark, d)), keys=("scene",))


@query(
    "compression_savings",
    f"""WITH {V.SIZES_SQL}, g AS (SELECT scene, l_linenumber, CAST(sum(original_bytes) AS BIGINT) AS o, CAST(sum(compressed_bytes) AS BIGINT) AS c FROM sizes_v GROUP BY ALL)
    SELECT scene, l_linenumber, round(o / 1e6, 2) AS original_mb, round(c / 1e6, 2) AS compressed_mb, round((o - c) / 1e6, 2) AS saved_mb,
      CASE WHEN c = 0 THEN CAST('inf' AS DOUBLE) ELSE round(o / c, 2) END AS compression_ratio, round((o - c) / greatest(o, 1) * 100, 1) AS space_saved_pct FROM g""",
)
def _(spark, d):
    sums = V.sizes(spark, d).groupBy("scene", "l_linenumber").agg(F.sum("original_bytes").alias("o"), F.sum("compressed_bytes").alias("c"))
    return sums.select("scene", "l_linenumber", C.savings("o", "c").alias("s")).select("scene", "l_linenumber", "s.*")


@query(
    "frame_coverage_share",
    f"""WITH {V.TINY_SQL} SELECT scene, vec_id, frame_idx, len(list_filter(px, lambda x: x > 140)) / CAST(len(px) AS DOUBLE) AS coverage,
      100.0 - 100 * (len(list_filter(px, lambda x: x > 140)) / CAST(len(px) AS DOUBLE)) AS background_pct FROM fr""",
)
def _(spark, d):
    mask = F.transform("px", lambda x: F.when(x > 140, 255).otherwise(0))
    rows = V.tiny_frames(spark, d).withColumn("mask", mask).withColumn("coverage", C.coverage("mask"))
    return rows.select("scene", "vec_id", "frame_idx", "coverage", C.background_share(F.col("coverage") * 100).alias("background_pct"))


EVEN_SQL = """clips AS (SELECT scene, count(*) AS total_frames FROM fr GROUP BY scene),
  chosen AS (SELECT DISTINCT scene, CAST(floor(i * (total_frames - 1) / CAST(29 AS DOUBLE)) AS BIGINT) AS frame_idx FROM clips, range(30) t(i))"""


@query("even_samples", f"WITH {V.TINY_SQL}, {EVEN_SQL} SELECT scene, frame_idx FROM chosen")
def _(spark, d):
    return scorecard.even_samples(V.tiny_frames(spark, d).groupBy("scene").agg(F.count("*").alias("total_frames"))).select("scene", "frame_idx")


@query(
    "frame_quality",
    f"""WITH {V.TINY_SQL}, {EVEN_SQL}, m AS (SELECT scene, list_sum(list_transform(px, lambda x: CAST(power(x - CAST(floor(x / 16) AS INT) * 16, 2) AS DOUBLE))) / len(px) AS mse
      FROM fr JOIN chosen USING (scene, frame_idx))
    SELECT scene, round(avg(10 * log10(65025.0 / mse)), 2) AS psnr, CAST(0.0 AS DOUBLE) AS ssim, count(*) AS samples_used FROM m GROUP BY scene""",
)
def _(spark, d):
    frames = V.tiny_frames(spark, d)
    packed = frames.withColumn("px", F.transform("px", lambda x: (F.floor(x / 16) * 16).cast("int")))
    return scorecard.quality(frames, packed, ("scene",))


@query(
    "padded_boxes",
    f"""WITH {V.BOXES_SQL}, p AS (SELECT l_orderkey, l_linenumber, greatest(0, x - 20) AS nx, greatest(0, y - 20) AS ny, least(640, x + w + 20) AS ex, least(480, y + h + 20) AS ey FROM boxes)
    SELECT l_orderkey, l_linenumber, nx AS x, ny AS y, ex - nx AS w, ey - ny AS h, (ex - nx) * (ey - ny) AS area FROM p""",
)
def _(spark, d):
    grown = C.padded_box(F.col("box"), 20, 640, 480)
    return V.boxes(spark, d).select("l_orderkey", "l_linenumber", grown.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query(
    "frame_regions",
    f"""WITH {V.BOXES_SQL}, p AS (SELECT l_orderkey, greatest(0, x - 20) AS nx, greatest(0, y - 20) AS ny, least(640, x + w + 20) AS ex, least(480, y + h + 20) AS ey FROM boxes WHERE area >= 500),
    q AS (SELECT l_orderkey, nx, ny, (ex - nx) * (ey - ny) AS area FROM p)
    SELECT l_orderkey, count(*) AS n_regions, max(area) AS largest_area, array_to_string(list(CAST(area AS VARCHAR) ORDER BY area DESC, nx, ny), ',') AS areas FROM q GROUP BY l_orderkey""",
)
def _(spark, d):
    frames = V.boxes(spark, d).groupBy("l_orderkey").agg(F.collect_list("box").alias("regions"))
    padded = coverage.with_targets(coverage.large_regions(frames)).withColumn("regions", C.pad_regions("regions", 20, 640, 480))
    areas = F.transform("regions", lambda r: r["area"])
    return padded.select(
        "l_orderkey", F.size("regions").cast("long").alias("n_regions"), areas[0].alias("largest_area"), F.array_join(areas.cast("array<string>"), ",").alias("areas")
    )


@query("camera_names", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS camera_id FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", C.camera_name("url").alias("camera_id"))


@query(
    "warmups",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 120 ELSE greatest(0, CAST(o_custkey % 400 AS INT) - 1) END AS warmup,
      greatest(1, CAST(floor((o_orderkey % 60) / 4.0 * 2.5) AS INT)) AS per_segment, CASE WHEN o_orderkey % 2 = 0 THEN 18 ELSE 40 END AS crf FROM orders""",
)
def _(spark, d):
    roi = F.when(F.col("o_orderkey") % 3 != 0, F.struct((F.col("o_custkey") % 400).cast("int").alias("start"), F.lit(1000).alias("end")))
    return V.table(spark, d, "orders").select(
        "o_orderkey",
        C.warmup_frames(roi).alias("warmup"),
        C.frames_per_segment((F.col("o_orderkey") % 60) / 4.0, 2.5).alias("per_segment"),
        C.quality_tier(F.col("o_orderkey") % 2 == 0).alias("crf"),
    )


@query(
    "clip_paths",
    """SELECT l_orderkey, l_linenumber, l_partkey, concat('scene', CAST(l_suppkey AS VARCHAR)) AS scene, l_partkey AS roi_start, l_suppkey AS roi_end FROM lineitem""",
)
def _(spark, d):
    path = F.concat(F.lit("file:/data/cat/scene"), F.col("l_suppkey").cast("string"), F.lit("/input/in"), F.lpad(F.col("l_linenumber").cast("string"), 6, "0"), F.lit(".jpg"))
    roi = C.temporal_roi(F.concat_ws("  ", F.lit(""), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.lit("\n")))
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.scene_name(path).alias("scene"), roi.alias("roi"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "scene", F.col("roi.start").cast("long").alias("roi_start"), F.col("roi.end").cast("long").alias("roi_end"))


PLAN_SQL = f"{V.MANIFEST_SQL}, {V.FOUND_SQL}"


@query(
    "scene_plan",
    f"""WITH {PLAN_SQL} SELECT category, scene, night, coalesce(sample_rate_override, 20) AS sample_rate, ord FROM manifest
    WHERE category <> 'ASIA' AND (category, scene) IN (SELECT (category, scene) FROM found) ORDER BY ord""",
)
def _(spark, d):
    return scenes.plan_scenes(V.found_scenes(spark, d), V.manifest(spark, d), skip=("ASIA",))


@query("missing_scenes", f"WITH {PLAN_SQL} SELECT * FROM manifest WHERE (category, scene) NOT IN (SELECT (category, scene) FROM found)")
def _(spark, d):
    return scenes.missing_scenes(V.manifest(spark, d), V.found_scenes(spark, d)).select("category", "scene", "night", "sample_rate_override", "ord")


@query(
    "run_summary",
    f"""WITH {PLAN_SQL}, m AS (SELECT (category, scene) IN (SELECT (category, scene) FROM found) AS there, ord % 7 = 0 AS failed FROM manifest)
    SELECT count(*) AS n_planned, count(*) FILTER (WHERE NOT there) AS n_missing, count(*) FILTER (WHERE there AND failed) AS n_failed,
      count(*) FILTER (WHERE there AND NOT failed) AS n_completed FROM m""",
)
def _(spark, d):
    return scenes.run_summary(V.manifest(spark, d), V.found_scenes(spark, d), V.manifest(spark, d).filter("ord % 7 = 0"))


@query("kept_categories", f"WITH {V.MANIFEST_SQL} SELECT category FROM manifest EXCEPT SELECT r_name FROM region WHERE r_regionkey = 2")
def _(spark, d):
    skip = V.table(spark, d, "region").filter("r_regionkey = 2").select(F.col("r_name").alias("category"))
    return scenes.kept_categories(V.manifest(spark, d), skip)


@query(
    "manifest_frames",
    f"""WITH {V.MANIFEST_SQL}, f AS (SELECT r_name AS category, n_name AS scene, c_custkey AS frame_idx FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT category, scene, frame_idx, night, sample_rate_override, ord FROM f JOIN manifest USING (category, scene)""",
)
def _(spark, d):
    named = V.manifest(spark, d).select("category", "scene", F.col("ord").alias("_n"))
    frames = V.table(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("_n")).select("category", "scene", F.col("c_custkey").alias("frame_idx"))
    return scenes.attach_manifest(frames, V.manifest(spark, d))


@query(
    "report_order",
    f"""WITH {V.STATS_SQL}, m AS (SELECT DISTINCT category, scene, CAST(substr(scene, 7) AS INT) AS ord FROM clip_stats)
    SELECT category, scene, method, avg_coverage_pct, ord, CASE WHEN method = 'MOG2' THEN 0 ELSE 1 END AS method_ord FROM clip_stats JOIN m USING (category, scene) ORDER BY ord, method_ord""",
)
def _(spark, d):
    stats = coverage.clip_coverage(V.frame_coverage(spark, d)).select("category", "scene", "method", "avg_coverage_pct")
    manifest = stats.select("category", "scene").distinct().withColumn("ord", F.substring("scene", 7, 20).cast("int"))
    return coverage.report_order(stats, manifest)


def _clips(spark, d):
    """Orders as frames of customers' clips, one in 41 undecodable."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return V.table(spark, d, "orders").select(
        F.lit("cat").alias("category"),
        F.col("o_custkey").alias("scene"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        F.when(F.col("o_orderkey") % 2 == 0, 320).otherwise(640).alias("width"),
        F.lit(240).alias("height"),
        (F.col("o_orderkey") % 41 == 0).alias("bad"),
    )


CLIPS_SQL = """clip AS (SELECT 'cat' AS category, o_custkey AS scene, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame_idx,
    CASE WHEN o_orderkey % 2 = 0 THEN 320 ELSE 640 END AS width, 240 AS height, o_orderkey % 41 = 0 AS bad FROM orders)"""


@query(
    "clip_info",
    f"""WITH {CLIPS_SQL} SELECT category, scene, arg_min(width, frame_idx) AS width, arg_min(height, frame_idx) AS height, count(*) AS total_frames,
    CAST(30.0 AS DOUBLE) AS fps FROM clip GROUP BY ALL""",
)
def _(spark, d):
    return scenes.clip_info(_clips(spark, d))


@query(
    "readable_frames",
    f"""WITH {CLIPS_SQL}, b AS (SELECT scene, min(frame_idx) AS first_bad FROM clip WHERE bad GROUP BY scene)
    SELECT category, scene, frame_idx FROM clip LEFT JOIN b USING (scene) WHERE first_bad IS NULL OR frame_idx < first_bad""",
)
def _(spark, d):
    return scenes.truncate_at_bad(_clips(spark, d), F.col("bad")).select("category", "scene", "frame_idx")


@query(
    "scene_inputs",
    """SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS scene, concat('/data/s', CAST(s_suppkey AS VARCHAR), '/input/in000001.jpg') AS path FROM supplier
    UNION ALL SELECT concat('v', CAST(c_custkey AS VARCHAR)), concat('/data/v', CAST(c_custkey AS VARCHAR), '.mp4') FROM customer""",
)
def _(spark, d):
    sequences = V.table(spark, d, "supplier").select(F.format_string("/data/s%d/input/in000001.jpg", "s_suppkey").alias("path"))
    videos = V.table(spark, d, "customer").select(F.format_string("/data/v%d.mp4", "c_custkey").alias("path"))
    return scenes.scene_inputs(sequences, videos)


@query(
    "file_sizes",
    """SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS path, coalesce(sum(o_custkey), 0)::BIGINT AS bytes FROM part LEFT JOIN orders ON p_partkey = o_orderkey GROUP BY p_partkey""",
)
def _(spark, d):
    listing = V.table(spark, d, "orders").groupBy("o_orderkey").agg(F.sum("o_custkey").alias("length"))
    listing = listing.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), "length")
    return scenes.file_sizes(V.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")), listing)


OBJECTS_SQL = f"""{V.OBJECTS_SQL},
    near AS (SELECT d.hash, min((CAST(bit_count(xor(d.hash, r.hash)) AS INT), object_id)) AS m FROM (SELECT DISTINCT hash FROM det) d, reg r WHERE bit_count(xor(d.hash, r.hash)) <= 10 GROUP BY d.hash),
    decided AS (SELECT detection_id, d.hash, d.ts, d.camera_id, m[2] AS object_id, m[1] AS distance,
      CASE WHEN m IS NULL THEN 'register' WHEN d.camera_id = r.camera_id THEN 'log' ELSE 'flag' END AS action
      FROM det d LEFT JOIN near USING (hash) LEFT JOIN reg r ON r.object_id = m[2])"""


def _decided(spark, d):
    detections, registry = V.detections(spark, d)
    return objects.decide(objects.match_objects(detections, registry), registry)


@query("object_matches", f"WITH {OBJECTS_SQL} SELECT detection_id, camera_id, object_id, distance, action FROM decided")
def _(spark, d):
    return _decided(spark, d).select("detection_id", "camera_id", "object_id", "distance", "action")


@query(
    "object_sightings",
    f"WITH {OBJECTS_SQL} SELECT object_id, camera_id, ts, distance, action = 'flag' AS flagged FROM decided WHERE action <> 'register'",
)
def _(spark, d):
    return objects.sightings(_decided(spark, d))


@query(
    "new_objects",
    f"""WITH {OBJECTS_SQL} SELECT hash, min(ts) AS first_seen, max(ts) AS last_seen, min((ts, camera_id))[2] AS camera_id, count(*) AS sighting_count
      FROM decided WHERE action = 'register' GROUP BY hash""",
)
def _(spark, d):
    return objects.register_new(_decided(spark, d)).drop("object_id")


@query(
    "clip_regions_of_time",
    f"""WITH {V.MANIFEST_SQL}, rois AS (SELECT category, scene, [ord, ord + 100] AS roi FROM manifest WHERE ord % 3 = 0),
      cust AS (SELECT r_name AS category, n_name AS scene, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT category, scene, n, roi[1] AS roi_start, roi[2] AS roi_end FROM cust LEFT JOIN rois USING (category, scene)""",
)
def _(spark, d):
    known = V.manifest(spark, d)
    clips = V.table(spark, d, "customer").join(known, F.col("c_nationkey") == F.col("ord")).groupBy("category", "scene").agg(F.count("*").alias("n"))
    rois = known.filter("ord % 3 = 0").withColumn("temporal_roi", F.array("ord", F.col("ord") + 100))
    found = scenes.attach_roi(clips, rois)
    return found.select("category", "scene", "n", F.get("temporal_roi", F.lit(0)).alias("roi_start"), F.get("temporal_roi", F.lit(1)).alias("roi_end"))


@query("box_corners", f"WITH {V.BOXES_SQL} SELECT l_orderkey, l_linenumber, x AS c0, y AS c1, w AS c2, h AS c3 FROM boxes")
def _(spark, d):
    corners = V.boxes(spark, d).select("l_orderkey", "l_linenumber", C.box_corners(F.col("box")).alias("c"))
    return corners.select("l_orderkey", "l_linenumber", *[F.col("c")[i].alias(f"c{i}") for i in range(4)])


# Closing and opening by the ellipse of 5 by 5, over 8 by 8 masks ``raw``.
CLEAN_SQL = """beside AS (SELECT a.p, b.p AS q FROM range(1, 65) a(p), range(1, 65) b(p), LATERAL (SELECT abs((a.p - 1) // 8 - (b.p - 1) // 8) AS dy, abs((a.p - 1) % 8 - (b.p - 1) % 8) AS dx)
    WHERE (dy <= 1 AND dx <= 2) OR (dy = 2 AND dx = 0)),
  grown AS (SELECT scene, t, beside.p, bool_or(on_) AS on_ FROM raw r JOIN beside ON r.p = beside.q GROUP BY ALL),
  closed AS (SELECT scene, t, beside.p, bool_and(on_) AS on_ FROM grown r JOIN beside ON r.p = beside.q GROUP BY ALL),
  shrunk AS (SELECT scene, t, beside.p, bool_and(on_) AS on_ FROM closed r JOIN beside ON r.p = beside.q GROUP BY ALL),
  opened AS (SELECT scene, t, beside.p, bool_or(on_) AS on_ FROM shrunk r JOIN beside ON r.p = beside.q GROUP BY ALL)"""

# Whole-frame samples are kept in slots by the frame's number, so the nearest-sample model is a
# join of each pixel with the frames alive before it: 8 by 8 frames, history 50, 21 slots.
SAMPLES_CTES = f"""{V.TINY_SQL},
  pixel AS (SELECT scene, frame_idx AS t, i AS p, px[i] AS v FROM fr, range(1, 65) r(i)),
  paced AS (SELECT scene, frame_idx AS s, ((frame_idx + 1) * 2654435761) % 4294967296 AS turn, (1.0::DOUBLE / least(2 * (frame_idx + 1), 50)) * 21 AS pace FROM fr),
  stored AS (SELECT scene, s, CASE WHEN s < 21 THEN s ELSE (turn // 128) % 21 END AS slot FROM paced WHERE s < 21 OR turn / 4294967296.0::DOUBLE < pace),
  until AS (SELECT scene, s, lead(s) OVER (PARTITION BY scene, slot ORDER BY s) AS gone FROM stored),
  alive AS (SELECT f.scene, f.frame_idx AS t, u.s FROM fr f JOIN until u ON u.scene = f.scene AND u.s < f.frame_idx AND (u.gone IS NULL OR u.gone >= f.frame_idx)),
  pairs AS (SELECT a.scene, a.t, a.s, x.p, x.v, m.v AS m, 3 * (x.v - m.v) * (x.v - m.v) < 400 AS near
    FROM alive a JOIN pixel x ON x.scene = a.scene AND x.t = a.t JOIN pixel m ON m.scene = a.scene AND m.t = a.s AND m.p = x.p),
  familiar AS (SELECT scene, t AS s, p, count(*) FILTER (WHERE near) >= 2 OR t <= 1 AS counts FROM pairs GROUP BY scene, t, p
    UNION ALL SELECT scene, t, p, TRUE FROM pixel WHERE t = 0),
  judged AS (SELECT q.scene, q.t, q.p, count(*) FILTER (WHERE near AND counts) >= least(2, q.t) AS background, bool_or(counts AND m > 0 AND v <= m AND 2 * v >= m) AS shadow
    FROM pairs q JOIN familiar USING (scene, s, p) GROUP BY q.scene, q.t, q.p),
  samples_raw AS (SELECT scene, t, p, NOT background AND NOT shadow AS on_ FROM judged UNION ALL SELECT scene, t, p, TRUE FROM pixel WHERE t = 0)"""
MASKS_SQL = f"{SAMPLES_CTES}, raw AS (SELECT * FROM samples_raw), {CLEAN_SQL}"
SAMPLES_SQL = f"""WITH {MASKS_SQL} SELECT 'vectors' AS category, concat('label_', CAST(scene AS VARCHAR)) AS scene, 'KNN' AS method, t AS frame_idx, count(*) FILTER (WHERE on_) / CAST(64 AS DOUBLE) AS coverage
  FROM opened GROUP BY ALL"""


# Blobs by reachability: what the border reaches sideways is outside, the rest is filled, and
# filled pixels that reach each other over corners are one blob.
BLOBS_SQL = """ring AS (SELECT scene, t, y, x FROM (SELECT DISTINCT scene, t FROM opened), range(-1, 9) a(y), range(-1, 9) b(x)),
    cell AS (SELECT r.scene, r.t, r.y, r.x, coalesce(o.on_, FALSE) AS on_ FROM ring r
      LEFT JOIN (SELECT scene, t, (p - 1) // 8 AS y, (p - 1) % 8 AS x, on_ FROM opened) o ON o.scene = r.scene AND o.t = r.t AND o.y = r.y AND o.x = r.x),
    empty AS (SELECT scene, t, y, x FROM cell WHERE NOT on_),
    outside(scene, t, y, x) AS (SELECT scene, t, y, x FROM empty WHERE y = -1 AND x = -1
      UNION SELECT e.scene, e.t, e.y, e.x FROM outside o JOIN empty e ON e.scene = o.scene AND e.t = o.t AND abs(e.y - o.y) + abs(e.x - o.x) = 1),
    filled AS (SELECT scene, t, y, x FROM cell EXCEPT SELECT scene, t, y, x FROM outside),
    reach(scene, t, y, x, seed) AS (SELECT scene, t, y, x, y * 8 + x FROM filled
      UNION SELECT f.scene, f.t, f.y, f.x, r.seed FROM reach r JOIN filled f ON f.scene = r.scene AND f.t = r.t AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1),
    named AS (SELECT scene, t, y, x, min(seed) AS blob FROM reach GROUP BY ALL),
    squares AS (SELECT scene, t, blob, y - dy AS wy, x - dx AS wx, count(*) AS n FROM named, range(2) a(dy), range(2) b(dx) GROUP BY ALL),
    sized AS (SELECT scene, t, blob, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END) AS area FROM squares GROUP BY ALL),
    boxed AS (SELECT scene, t, blob, greatest(0, min(x) - 1) AS x, greatest(0, min(y) - 1) AS y, least(8, max(x) + 2) AS x1, least(8, max(y) + 2) AS y1 FROM named GROUP BY ALL),
    blobs AS (SELECT boxed.* FROM boxed JOIN sized USING (scene, t, blob) WHERE sized.area >= 1)"""

# Both methods at once: the scene's name goes through the masks behind the method's.
BOTH_SQL = f"""WITH RECURSIVE {SAMPLES_CTES}, {mixture_ctes("pixel", 50)},
  raw AS (SELECT concat('MOG2/label_', scene) AS scene, t, p, on_ FROM mix_raw UNION ALL SELECT concat('KNN/label_', scene), t, p, on_ FROM samples_raw),
  {CLEAN_SQL}, {BLOBS_SQL}"""
ACTIVITY_SQL = f"""{BOTH_SQL}, shares AS (SELECT scene, t, count(*) FILTER (WHERE on_) / CAST(64 AS DOUBLE) AS coverage FROM opened GROUP BY ALL),
  numbers AS (SELECT scene, t, count(*) AS n FROM blobs GROUP BY ALL)
  SELECT 'vectors' AS category, split_part(scene, '/', 2) AS scene, split_part(scene, '/', 1) AS method, t AS frame_idx, coverage, CAST(coalesce(n, 0) AS INT) AS n_regions
  FROM shares LEFT JOIN numbers USING (scene, t)"""


def _sample_coverage(spark, d, tile=None):
    found = background.subtract_background(V.tiny_clips(spark, d), methods=("KNN",), min_area=1, pad=1, history=50, tile=tile)
    return found.select("category", "scene", "method", "frame_idx", "coverage")


@query("nearest_sample_coverage", SAMPLES_SQL)
def _(spark, d):
    return _sample_coverage(spark, d)


@query(
    "mixture_coverage",
    f"""WITH RECURSIVE {V.TINY_SQL},
    pixel AS (SELECT scene, frame_idx AS t, i AS p, px[i] AS v FROM fr, range(1, 65) r(i)),
    {mixture_ctes("pixel", 50)}, raw AS (SELECT * FROM mix_raw),
    {CLEAN_SQL}
    SELECT 'vectors' AS category, concat('label_', CAST(scene AS VARCHAR)) AS scene, 'MOG2' AS method, t AS frame_idx, count(*) FILTER (WHERE on_) / CAST(64 AS DOUBLE) AS coverage
    FROM opened GROUP BY ALL""",
)
def _(spark, d):
    found = background.subtract_background(V.tiny_clips(spark, d), methods=("MOG2",), min_area=1, pad=1, history=50)
    return found.select("category", "scene", "method", "frame_idx", "coverage")


@query("tiled_nearest_sample_coverage", SAMPLES_SQL)
def _(spark, d):
    return _sample_coverage(spark, d, tile=4)


@query(
    "nearest_sample_regions",
    f"""WITH RECURSIVE {MASKS_SQL},
    {BLOBS_SQL}
    SELECT 'vectors' AS category, concat('label_', CAST(scene AS VARCHAR)) AS scene, 'KNN' AS method, t AS frame_idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
      CAST(x1 - x AS INT) AS w, CAST(y1 - y AS INT) AS h, CAST((x1 - x) * (y1 - y) AS INT) AS area FROM blobs""",
)
def _(spark, d):
    return background.explode_regions(background.subtract_background(V.tiny_clips(spark, d), methods=("KNN",), min_area=1, pad=1, history=50))


@query("background_activity", ACTIVITY_SQL)
def _(spark, d):
    found = background.subtract_background(V.tiny_clips(spark, d), min_area=1, pad=1, history=50)
    return found.select("category", "scene", "method", "frame_idx", "coverage", F.size("regions").alias("n_regions"))


@query("tiled_background_activity", ACTIVITY_SQL)
def _(spark, d):
    found = background.subtract_background(V.tiny_clips(spark, d), min_area=1, pad=1, history=50, tile=4)
    return found.select("category", "scene", "method", "frame_idx", "coverage", F.size("regions").alias("n_regions"))


@query(
    "background_regions",
    f"""{BOTH_SQL} SELECT 'vectors' AS category, split_part(scene, '/', 2) AS scene, split_part(scene, '/', 1) AS method, t AS frame_idx,
      CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x1 - x AS INT) AS w, CAST(y1 - y AS INT) AS h, CAST((x1 - x) * (y1 - y) AS INT) AS area FROM blobs""",
)
def _(spark, d):
    return background.explode_regions(background.subtract_background(V.tiny_clips(spark, d), min_area=1, pad=1, history=50))


def _packed(spark, d):
    numbered = segments.number_segments(V.tiny_clips(spark, d), 10, 0)
    return compaction.pack_frames(numbered.withColumn("crf", C.quality_tier(F.col("segment_no") % 2 == 0)))


@query("packed_segments")
def _(spark, d):
    return compaction.segment_sizes(_packed(spark, d))


@query(
    "packed_quality",
    f"""WITH {V.TINY_SQL}, {EVEN_SQL}, shown AS (SELECT scene, frame_idx, px, CASE WHEN (frame_idx // 10 + 1) % 2 = 0 THEN 1 ELSE 13 END AS step FROM fr JOIN chosen USING (scene, frame_idx)),
    pair AS (SELECT scene, frame_idx, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(px[i] AS DOUBLE) AS a, CAST(least(255, px[i] // step * step + step // 2) AS DOUBLE) AS b FROM shown, range(1, 65) r(i)),
    error AS (SELECT scene, frame_idx, avg((a - b) * (a - b)) AS mse FROM pair GROUP BY ALL),
    win AS (SELECT scene, frame_idx, oy, ox, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab
      FROM pair, range(2) t(oy), range(2) u(ox) WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL),
    alike AS (SELECT scene, frame_idx, avg((2 * ma * mb + 6.5025) * (2 * vab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS ssim FROM win GROUP BY ALL),
    mean AS (SELECT scene, avg(10 * log10(65025.0 / mse)) FILTER (WHERE mse > 0) AS p, bool_or(mse = 0) AS exact, avg(ssim) AS s, count(*) AS n FROM error JOIN alike USING (scene, frame_idx) GROUP BY scene)
    SELECT 'vectors' AS category, concat('label_', CAST(scene AS VARCHAR)) AS scene, CASE WHEN exact THEN CAST('inf' AS DOUBLE) ELSE round(p, 2) END AS psnr, round(s, 4) AS ssim, n AS samples_used FROM mean""",
)
def _(spark, d):
    return compaction.sampled_quality(V.tiny_clips(spark, d), _packed(spark, d))


@query("clip_scorecard")
def _(spark, d):
    frames = V.tiny_clips(spark, d)
    activity = background.subtract_background(frames, min_area=1, pad=1, history=50)
    tiers = scorecard.tier_plan(activity, warmup=20)
    packed = _packed(spark, d)
    chosen = packed.groupBy("category", "scene").agg(F.sum("bytes").alias("bytes")).withColumn("variant", F.lit("selective"))
    original = frames.groupBy("category", "scene").agg(F.sum(F.length("px")).alias("bytes")).withColumn("variant", F.lit("original"))
    sizes = scorecard.variant_sizes(chosen.unionByName(original))
    return scorecard.scorecard(sizes, tiers, compaction.sampled_quality(frames, packed))
