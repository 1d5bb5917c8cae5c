"""Stand-in inputs over the given tables, in Spark and as SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("event_type") != "view"
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        C.segment_time_text("ts").alias("timestamp"),
        F.concat(F.lit("cam_"), (F.col("user_id") % 16).cast("string")).alias("camera_id"),
        F.when(seen, 1).otherwise(0).alias("target_detected"),
        F.when(seen, 1 + F.floor("value") % 12).otherwise(0).cast("long").alias("roi_count"),
        F.floor(F.col("value") * 1000).cast("long").alias("file_size"),
        F.lit(60.0).alias("duration"),
        C.segment_path(F.concat(F.lit("cam_"), (F.col("user_id") % 16).cast("string")), C.segment_time_text("ts"), "event_id").alias("file_path"),
    )


SEGMENTS_SQL = """segments_v AS (
  SELECT event_id AS id, strftime(ts, '%Y%m%dT%H%M%SZ') AS timestamp,
         concat('cam_', CAST(user_id % 16 AS VARCHAR)) AS camera_id,
         CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS target_detected,
         CASE WHEN event_type <> 'view' THEN 1 + CAST(floor(value) AS BIGINT) % 12 ELSE 0 END AS roi_count,
         CAST(floor(value * 1000) AS BIGINT) AS file_size, CAST(60.0 AS DOUBLE) AS duration,
         concat('cam_', CAST(user_id % 16 AS VARCHAR), '_', strftime(ts, '%Y%m%dT%H%M%SZ'), '_', CAST(event_id AS VARCHAR), '.mp4') AS file_path
  FROM events)"""


def frame_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Line items as frames: scene = supplier, category = region; regions only as a count."""
    lines = table(spark, d, "lineitem")
    places = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("category"))
    )
    odd = F.col("l_linenumber") % 2
    order = Window.partitionBy("l_suppkey", odd).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "category",
        F.concat(F.lit("scene_"), F.col("l_suppkey").cast("string")).alias("scene"),
        F.when(odd == 0, "KNN").otherwise("MOG2").alias("method"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        (F.col("l_discount") / 10).alias("coverage"),
        (F.col("l_quantity").cast("int") % 3).alias("n_regions"),
    )


#: C.mean_pct in SQL.
MEAN_PCT_SQL = """CAST((2 * sum(CAST(round(coverage * 1e10) AS BIGINT)) + 1000000 * count(coverage)) // (2000000 * count(coverage)) AS DOUBLE) / 100"""

FRAMES_SQL = """frame_cov_v AS (
  SELECT r.r_name AS category, concat('scene_', CAST(l.l_suppkey AS VARCHAR)) AS scene,
         CASE WHEN l.l_linenumber % 2 = 0 THEN 'KNN' ELSE 'MOG2' END AS method,
         row_number() OVER (PARTITION BY l.l_suppkey, l.l_linenumber % 2
           ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice) - 1 AS frame_idx,
         l.l_discount / 10 AS coverage, CAST(l.l_quantity AS INT) % 3 AS n_regions
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

STATS_SQL = (
    FRAMES_SQL
    + f""", clips AS (SELECT category, scene, method, count(*) AS total_frames FROM frame_cov_v GROUP BY ALL),
seen AS (SELECT category, scene, method, count(*) AS n, {MEAN_PCT_SQL} AS mean, max(coverage * 100) AS most,
           count(*) FILTER (WHERE coverage > 0.001) AS busy, count(*) FILTER (WHERE (frame_idx - 120) % 15 = 0) AS sampled
         FROM frame_cov_v WHERE frame_idx >= 120 GROUP BY ALL),
clip_stats AS (SELECT category, scene, method, total_frames, coalesce(n, 0) AS analyzed_frames,
           coalesce(mean, 0.0) AS avg_coverage_pct, coalesce(round(most, 2), 0.0) AS max_coverage_pct,
           coalesce(busy, 0) AS frames_with_activity,
           round(coalesce(busy, 0) / greatest(coalesce(n, 0), 1) * 100, 1) AS activity_rate_pct,
           coalesce(sampled, 0) AS sample_images_saved
         FROM clips LEFT JOIN seen USING (category, scene, method))"""
)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Nations as scenes, their regions as categories."""
    regions = table(spark, d, "region")
    return table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("category"),
        F.col("n_name").alias("scene"),
        (F.col("n_nationkey") % 4 == 0).alias("night"),
        F.when(F.col("n_nationkey") % 5 == 0, 5).alias("sample_rate_override"),
        F.col("n_nationkey").cast("int").alias("ord"),
    )


MANIFEST_SQL = """manifest AS (
  SELECT r_name AS category, n_name AS scene, n_nationkey % 4 = 0 AS night,
         CASE WHEN n_nationkey % 5 = 0 THEN 5 END AS sample_rate_override, CAST(n_nationkey AS INT) AS ord
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def found_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with at least three suppliers."""
    busy = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).filter("n >= 3")
    return manifest(spark, d).join(busy, F.col("ord") == F.col("s_nationkey"), "left_semi").select("category", "scene")


FOUND_SQL = """found AS (
  SELECT category, scene FROM manifest WHERE ord IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 3))"""


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("scene_"), F.col("l_suppkey").cast("string")).alias("scene"),
        F.floor(F.col("l_extendedprice") * 100).cast("long").alias("original_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long").alias("compressed_bytes"),
        "l_linenumber",
    )


SIZES_SQL = """sizes_v AS (
  SELECT concat('scene_', CAST(l_suppkey AS VARCHAR)) AS scene, CAST(floor(l_extendedprice * 100) AS BIGINT) AS original_bytes,
         CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT) AS compressed_bytes, l_linenumber FROM lineitem)"""


def tiny_frames(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as 8 by 8 grey frames: label = scene, order by vec_id."""
    grey = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) * 212))).cast("int")
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select(
        F.col("label").alias("scene"), "vec_id", (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.transform("embedding", grey).alias("px")
    )


TINY_SQL = """fr AS (
  SELECT label AS scene, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
         list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 0.6) * 212))) AS INT)) AS px
  FROM embeddings)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes in a 640 by 480 frame."""
    w, h = F.col("l_quantity").cast("int"), (F.col("l_linenumber") * 10).cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct((F.col("l_partkey") % 640).cast("int").alias("x"), (F.col("l_suppkey") % 480).cast("int").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area")).alias("box"),
    )


BOXES_SQL = """boxes AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 640 AS INT) AS x, CAST(l_suppkey % 480 AS INT) AS y,
         CAST(l_quantity AS INT) AS w, CAST(l_linenumber * 10 AS INT) AS h, CAST(l_quantity AS INT) * CAST(l_linenumber * 10 AS INT) AS area
  FROM lineitem)"""


def tiny_clips(spark: SparkSession, d: str) -> DataFrame:
    """The grey frames as BGR pixel tables, one clip a label."""
    grey = F.array_join(F.transform("px", lambda x: F.repeat(F.lpad(F.hex(x.cast("long")), 2, "0"), 3)), "")
    return tiny_frames(spark, d).select(
        F.lit("vectors").alias("category"),
        F.concat(F.lit("label_"), F.col("scene").cast("string")).alias("scene"),
        "frame_idx",
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.unhex(grey).alias("px"),
    )


#: Multiplier of the stand-in hashes.
_SPREAD = 11400714819323198485


def detections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as detections (a user's hash with up to 14 bits changed), every 97th as a registered object."""
    spread = (F.col("user_id").cast("decimal(18,0)") * F.lit(Decimal(_SPREAD))) % F.lit(Decimal(1 << 63))
    flips = F.pmod(F.col("event_id") * 2654435761, F.lit(16384))
    changed = (flips % 128) * 8 + F.floor(flips / 128) * (1 << 40)
    code = spread.cast("long").bitwiseXOR(changed.cast("long"))
    events = table(spark, d, "events").withColumn("hash", code)
    camera = lambda c: F.concat(F.lit("cam_"), (F.col(c) % 16).cast("string")).alias("camera_id")
    return (
        events.select(F.col("event_id").alias("detection_id"), "hash", camera("user_id"), "ts"),
        events.filter("event_id % 97 = 0").select(F.col("event_id").alias("object_id"), "hash", camera("event_id"), F.col("ts").alias("first_seen")),
    )


OBJECTS_SQL = f"""hashed AS (SELECT *, (event_id * 2654435761) % 16384 AS flips FROM events),
  coded AS (SELECT *, xor(CAST((user_id::HUGEINT * {_SPREAD}::HUGEINT) % 9223372036854775808::HUGEINT AS BIGINT),
    CAST((flips % 128) * 8 + (flips // 128) * 1099511627776 AS BIGINT)) AS hash FROM hashed),
  det AS (SELECT event_id AS detection_id, hash, concat('cam_', CAST(user_id % 16 AS VARCHAR)) AS camera_id, ts FROM coded),
  reg AS (SELECT event_id AS object_id, hash, concat('cam_', CAST(event_id % 16 AS VARCHAR)) AS camera_id FROM coded WHERE event_id % 97 = 0)"""
