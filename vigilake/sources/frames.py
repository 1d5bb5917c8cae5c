"""Reading clips: image sequences, frame tables, temporal regions, streams of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.functions import columns as C
from vigilake.operators.scenes import attach_roi, clip_info, truncate_at_bad
from vigilake.pixels import images
from vigilake.schemas import FRAMES, SEGMENTS
from vigilake.sources import folders
from vigilake.sources.sinks import CUTOFFS

_IMAGE = "(?i)\\.(jpe?g|png|bmp)$"
_NUMBER = "([0-9]+)[.][^./]*$"
_FRAME_PATH = "([^/]+)/([^/]+)/input/([^/]+)$"


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and length of files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    )


def find_scenes(spark: SparkSession, root: str) -> DataFrame:
    """(category, scene, path) of the scene folders below a path."""
    files = list_files(spark, root).filter(F.col("path").rlike(_IMAGE) & F.col("path").rlike(_FRAME_PATH))
    return files.select(
        F.regexp_extract("path", _FRAME_PATH, 1).alias("category"), F.regexp_extract("path", _FRAME_PATH, 2).alias("scene"), F.regexp_replace("path", "/input/[^/]+$", "").alias("path")
    ).distinct()


def read_frames(spark: SparkSession, path: str, on_bad: str = "truncate") -> DataFrame:
    """Frames of image sequences in path order; a clip ends before its first undecodable frame.

    Indices come from the paths alone and are joined back, so pixels are not sorted for
    them.  Grey pictures become BGR; of pictures with transparency the alpha is dropped.  Raises ValueError if there is no image.
    """
    names = list_files(spark, path).filter(F.col("path").rlike(_IMAGE)).select(F.col("path").alias("origin"))
    if names.isEmpty():
        raise ValueError(f"no frames in {path}")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.regexp_replace("origin", "/[^/]+$", "")).orderBy("origin")) - 1
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    numbered = names.select(plain("origin").alias("origin"), place.cast("long").alias("frame_idx"))
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJpPbB][pPnNmM]*").load(path)
    images = images.select("image.*").filter(F.col("origin").rlike(_IMAGE)).withColumn("origin", plain("origin"))
    frames = numbered.join(images, "origin").select(
        F.coalesce(F.try_element_at(F.split("origin", "/"), F.lit(-4)), F.lit("")).alias("category"),
        F.coalesce(C.scene_name("origin"), F.lit("")).alias("scene"),
        "frame_idx",
        "width",
        "height",
        F.when((F.col("height") > 0) & F.col("nChannels").isin(1, 3, 4), F.col("data")).alias("px"),
        "nChannels",
        ((F.col("height") <= 0) | (F.length("data") == 0)).alias("_undecodable"),
    )
    colours = T.StructType([f for f in frames.schema if f.name != "nChannels"])
    frames = frames.mapInArrow(_as_bgr, colours)
    kept = truncate_at_bad(frames, F.col("_undecodable"), on_bad)
    return kept.select(*[f.name for f in FRAMES])


def _as_bgr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grey pictures with their channel three times, pictures with alpha without it."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "nChannels"]
        for begin in range(0, batch.num_rows, 16):
            part = batch.slice(begin, 16)
            pixels = []
            for data, channels in zip(part.column("px"), part.column("nChannels").to_pylist(), strict=True):
                if data.is_valid and channels != 3:
                    flat = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, channels)
                    pixels.append((np.repeat(flat, 3, 1) if channels == 1 else flat[:, :3]).tobytes())
                else:
                    pixels.append(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(pixels, pa.binary()) if n == "px" else part.column(n) for n in names], names)


def stream_images(spark: SparkSession, path: str, max_files: int = 64, first: int = 1) -> DataFrame:
    """Frames of PNG and BMP pictures as they land below a folder (category/scene/input/name with a number).

    A frame's index is the number in its name less ``first``.  Pictures that cannot be read
    have null ``px`` and no size.  JPEG needs a decoder that streams do not have; such
    clips go through ``import`` first.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pPbB][nNmM][gGpP]")
    rows = files.option("maxFilesPerTrigger", max_files).load(path).filter(F.col("path").rlike(_FRAME_PATH))
    named = rows.select(
        F.regexp_extract("path", _FRAME_PATH, 1).alias("category"), F.regexp_extract("path", _FRAME_PATH, 2).alias("scene"),
        (F.regexp_extract("path", _NUMBER, 1).try_cast("long") - first).alias("frame_idx"), "content",
    )
    return named.mapInArrow(_decoded, FRAMES)


_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 16):
            part = batch.slice(begin, 16)
            shapes, pixels = [], []
            for data in part.column("content").to_pylist():
                try:
                    picture = images.decode(data)
                except ValueError:
                    picture = None
                shapes.append((None, None) if picture is None else picture.shape[1::-1])
                pixels.append(None if picture is None else picture.tobytes())
            sizes = [pa.array([s[i] for s in shapes], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("category", "scene", "frame_idx")), *sizes, pa.array(pixels, pa.binary())], FRAMES.names)


def read_temporal_roi(spark: SparkSession, path: str) -> DataFrame:
    """(category, scene, temporal_roi) of every ``temporalROI.txt`` below a path."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "temporalROI.txt").text(path, wholetext=True)
    parts = F.split(F.input_file_name(), "/")
    return texts.select(
        F.try_element_at(parts, F.lit(-3)).alias("category"), F.try_element_at(parts, F.lit(-2)).alias("scene"), C.temporal_roi("value").alias("temporal_roi")
    )


def clips(frames: DataFrame, rois: DataFrame, fallback: int = 120) -> DataFrame:
    """Clip facts with the region of time and the warm-up that follows."""
    joined = attach_roi(clip_info(frames), rois)
    return joined.withColumn("warmup", C.warmup_frames("temporal_roi", fallback))


def compact_frames(frames: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes frames once as large sorted files by category, instead of many small images.

    Frames are dealt out by ranges of (category, scene, frame), so that a long clip is split.
    """
    order = ["category", "scene", "frame_idx"]
    dealt = frames.repartitionByRange(partitions, *order) if partitions else frames.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.partitionBy("category").parquet(path)


def read_frame_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def stream_frames(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Frames as they land in a folder of Parquet files."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", max_files).parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The segment index with its day and batch, or an empty table of that schema where there is none yet.

    Days before the last retention cutoff are left out by their folders alone.
    """
    from pyspark.errors import AnalysisException

    schema = T.StructType([*SEGMENTS.fields, T.StructField("date", T.StringType()), T.StructField("batch", T.StringType())])
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    cutoff = max((n.split("-")[0] for n in folders.names(spark, f"{path}/{CUTOFFS}")), default=None)
    return found if cutoff is None else found.filter(F.col("date") >= cutoff)
