"""Schemas of the tables that operators share."""

from pyspark.sql import types as T

#: One row for each stored segment of a camera's feed.
SEGMENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.StringType(), False),
        T.StructField("camera_id", T.StringType(), False),
        T.StructField("target_detected", T.IntegerType(), False),
        T.StructField("roi_count", T.LongType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("duration", T.DoubleType(), False),
        T.StructField("file_path", T.StringType(), False),
    ]
)

REGION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h", "area")])
REGIONS = T.ArrayType(REGION)

#: One row for each frame of a clip or camera; ``px`` is row-major BGR.
FRAMES = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("scene", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("px", T.BinaryType()),
    ]
)

#: What a background model gives for each frame and method.
FRAME_ACTIVITY = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("scene", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("regions", REGIONS),
    ]
)
