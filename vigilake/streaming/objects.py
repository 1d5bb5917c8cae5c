"""Known objects over a stream of detections.

The registry is a table of one partition for each micro-batch.  A detection is matched
against what earlier micro-batches registered, decided and written as it comes; a
micro-batch that is tried again reads the same registry and replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.operators import objects
from vigilake.sources import folders

REGISTRY = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("camera_id", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("batch", T.LongType()),
    ]
)
DECISIONS = T.StructType(
    [
        T.StructField("detection_id", T.LongType()),
        T.StructField("camera_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("hash", T.LongType()),
        T.StructField("object_id", T.LongType()),
        T.StructField("distance", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not any(n.startswith("batch=") for n in folders.names(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def known_objects(spark: SparkSession, folder: str, before: int | None = None, since: Column | None = None) -> DataFrame:
    """The registry as micro-batches below ``before`` left it; objects not seen from ``since`` on are forgotten."""
    found, seen = _table(spark, f"{folder}/registry", REGISTRY), decisions(spark, folder)
    if before is not None:
        found, seen = found.filter(F.col("batch") < before), seen.filter(F.col("batch") < before)
    if since is None:
        return found
    last = seen.filter("object_id IS NOT NULL").groupBy("object_id").agg(F.max("ts").alias("_last"))
    joined = found.join(last, "object_id", "left")
    return joined.filter(F.greatest("first_seen", F.coalesce("_last", F.col("first_seen"))) >= since).drop("_last")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every detection with its action, and the object it was taken for or became."""
    return _table(spark, f"{folder}/decisions", DECISIONS)


def decide_batch(detections: DataFrame, folder: str, number: int, bits: int = 10, keep_days: int | None = None) -> None:
    """Decides the detections of one micro-batch and registers its new objects.

    Detections of a new hash in one micro-batch are one object: the first by time registers
    it, the others count as seen on that camera or another one.  With ``keep_days`` objects
    are forgotten that long after they were last seen, by the time of the detections.
    """
    spark = detections.sparkSession
    rows = detections.select("detection_id", "camera_id", "ts", "hash")
    since = None
    if keep_days is not None:
        latest = rows.agg(F.max("ts")).first()[0]
        since = None if latest is None else F.lit(latest) - F.make_dt_interval(days=F.lit(keep_days))
    registry = known_objects(spark, folder, number, since)
    decided = objects.decide(objects.match_objects(rows, registry, bits), registry).drop("home_camera")
    new = objects.register_new(decided).select("object_id", "hash", "camera_id", "first_seen")
    first = decided.filter("action = 'register'").groupBy("hash").agg(F.min(F.struct("ts", "camera_id", "detection_id")).alias("_first"))
    told = decided.join(first, "hash", "left")
    own = F.col("_first.detection_id") == F.col("detection_id")
    action = F.when(F.col("action") != "register", F.col("action")).when(own, "register").when(F.col("camera_id") == F.col("_first.camera_id"), "log").otherwise("flag")
    fresh = F.col("action") == "register"
    told = told.select(
        "detection_id", "camera_id", "ts", "hash", F.when(fresh, F.xxhash64("hash")).otherwise(F.col("object_id")).alias("object_id"),
        F.when(fresh, 0).otherwise(F.col("distance")).cast("int").alias("distance"), action.alias("action"),
    )
    for name, table in (("decisions", told), ("registry", new)):
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def stream_objects(detections: DataFrame, folder: str, checkpoint: str, bits: int = 10, keep_days: int | None = None, once: bool = True):
    """Decides a stream of detections (detection_id, camera_id, ts, hash) into tables below ``folder``.

    ``once``: work off what is there and stop.
    """
    writer = detections.writeStream.foreachBatch(lambda rows, number: decide_batch(rows, folder, number, bits, keep_days)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
