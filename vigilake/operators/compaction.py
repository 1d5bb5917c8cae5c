"""Packing segments at their tier, and the quality of what comes back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.operators.background import frame_array, packed_rows, rows_of
from vigilake.pixels import metrics
from vigilake.pixels.packing import Packer


def pack_frames(frames: DataFrame, keys: tuple[str, ...] = ("category", "scene", "segment_no"), keep_decoded: bool = True) -> DataFrame:
    """By frame (with a column ``crf``): bytes it packs into, and the frame as it comes back.

    Frames of a segment pass through one task in order; a change of size within a segment is
    an error, as for an encoder.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    simple = {k: frames.schema[k].dataType.simpleString() for k in keys}
    schema = pa.schema([*((k, kinds[simple[k]]) for k in keys), ("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("bytes", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        def results():
            key, packer, shape = None, None, None
            for row in rows_of(batches):
                now = tuple(row[k] for k in keys)
                frame = frame_array(row)
                if now != key:
                    key, packer, shape = now, Packer(row["crf"]), frame.shape
                elif frame.shape != shape:
                    raise ValueError(f"frames of segment {now} differ in size")
                data, back = packer.pack(frame)
                yield {**{k: row[k] for k in keys}, "frame_idx": row["frame_idx"], "width": row["width"], "height": row["height"], "bytes": len(data), "decoded": back.tobytes() if keep_decoded else None}

        yield from packed_rows(results(), schema)

    ordered = frames.select(*keys, "frame_idx", "width", "height", "crf", "px").repartition(*keys).sortWithinPartitions(*keys, "frame_idx")
    result = T.StructType([frames.schema[k] for k in keys]).add("frame_idx", "long").add("width", "integer").add("height", "integer")
    return ordered.mapInArrow(run, result.add("bytes", "long").add("decoded", "binary"))


def segment_sizes(packed: DataFrame, keys: tuple[str, ...] = ("category", "scene", "segment_no")) -> DataFrame:
    return packed.groupBy(*keys).agg(F.sum("bytes").alias("file_size"), F.count("*").alias("n_frames"))


def frame_scores(pairs: DataFrame) -> DataFrame:
    """Adds psnr and ssim of ``px`` (width, height) against ``decoded`` (decoded_width, decoded_height), resized if need be."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 16):
                part = batch.slice(begin, 16)
                psnr, ssim = [], []
                for row in part.select(["px", "width", "height", "decoded", "decoded_width", "decoded_height"]).to_pylist():
                    first = frame_array(row)
                    second = np.frombuffer(row["decoded"], np.uint8).reshape(row["decoded_height"], row["decoded_width"], 3)
                    second = metrics.resize(second, *first.shape[:2])
                    psnr.append(metrics.psnr(first, second))
                    ssim.append(metrics.ssim(first, second))
                kept = [n for n in part.schema.names if n not in ("px", "decoded", "psnr", "ssim")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(psnr, pa.float64()), pa.array(ssim, pa.float64())], [*kept, "psnr", "ssim"])

    kept = [f for f in pairs.schema if f.name not in ("px", "decoded", "psnr", "ssim")]
    ordered = pairs.select(*[f.name for f in kept], "px", "decoded")
    return ordered.mapInArrow(run, T.StructType([*kept]).add("psnr", "double").add("ssim", "double"))


def sampled_quality(original: DataFrame, packed: DataFrame, keys: tuple[str, ...] = ("category", "scene"), k: int = 30) -> DataFrame:
    """Mean PSNR and SSIM of up to k evenly spaced frames of each clip; zeros where none pairs."""
    from vigilake.functions.columns import rounded
    from vigilake.operators.scorecard import even_samples

    at = [*keys, "frame_idx"]
    clips = original.groupBy(*keys).agg(F.count("*").alias("total_frames"))
    chosen = even_samples(clips, k=k).select(*at)
    first = original.join(chosen, at, "left_semi").select(*at, "width", "height", "px")
    second = packed.join(chosen, at, "left_semi").select(*at, F.col("width").alias("decoded_width"), F.col("height").alias("decoded_height"), "decoded")
    found = frame_scores(first.join(second, at)).groupBy(*keys).agg(F.avg("psnr").alias("p"), F.avg("ssim").alias("s"), F.count("*").alias("n"))
    return clips.join(found, list(keys), "left").select(
        *keys,
        F.coalesce(rounded(F.col("p"), 2), F.lit(0.0)).alias("psnr"),
        F.coalesce(F.round("s", 4), F.lit(0.0)).alias("ssim"),
        F.coalesce("n", F.lit(0)).alias("samples_used"),
    )
