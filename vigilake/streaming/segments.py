"""Segments from streams of frames: stateful models by tile, count-based and time-based segments.

Two stateful operators follow each other.  The first one is keyed by (camera, tile) and holds
the models' arrays, each in an entry of its own, of which only changed ones are written.
The second one is keyed by (camera, method); it puts a frame's tiles together, counts its
regions, and holds the segment that is filling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilake.functions import columns as C
from vigilake.operators import background
from vigilake.operators.background import Options
from vigilake.operators.segments import storage_report
from vigilake.pixels import masks, models
from vigilake.sources import sinks

_CAMERA = "category string, scene string"
_TILE = f"{_CAMERA}, method string, frame_idx long, width int, height int, warmup long, tx int, ty int, mask binary, n_late long"
_SEGMENT = f"{_CAMERA}, method string, segment_no long, n_frames long, frames_with_targets long, roi_count long, target_detected int, duration double, crf int, n_late long"
#: A tile as large as any frame.
_WHOLE = 1 << 30
_ARRAYS, _LAST, _FILLING, _WAITING = "arrays", "last", "filling", "waiting"


class TileProcessor(StatefulProcessor):
    """Masks of one tile of a camera, by all methods.

    Frames of a micro-batch are sorted; one that is not after the last seen is dropped and
    counted.  Another size or night flag starts the models anew.
    """

    def __init__(self, options: Options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(_LAST, "frame_idx long, late long, width int, height int, w int, h int, night boolean")
        self.arrays = handle.getMapState(_ARRAYS, "entry string", "dtype string, shape array<int>, data binary")

    def _stored(self) -> dict[str, np.ndarray]:
        return {k[0]: np.frombuffer(v[2], v[0]).reshape([int(n) for n in v[1]]) for k, v in self.arrays.iterator()}

    @staticmethod
    def _entries(held: dict) -> Iterator[tuple[str, np.ndarray]]:
        """Arrays of two dimensions and more by their first one, so that one mode or sample is an entry."""
        for method, model in held.items():
            for name, value in model.state().items():
                for i, part in enumerate(value if value.ndim > 1 else [value]):
                    yield f"{method} {name} {i}", np.asarray(part)

    def _restored(self, shape: tuple, entries: dict[str, np.ndarray]) -> dict:
        held = {m: self.options.model(m, *shape[3:5], shape[2]) for m in self.options.methods}
        for method, model in held.items():
            state = {}
            for name, value in model.state().items():
                parts = [entries.get(f"{method} {name} {i}") for i in range(len(value) if value.ndim > 1 else 1)]
                if any(p is None for p in parts):
                    break
                state[name] = np.stack(parts) if value.ndim > 1 else parts[0]
            else:
                model.restore(state)
        return held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, late, *kept = self.last.get() if self.last.exists() else (-1, 0)
        # (width, height, night, part's height, part's width)
        shape = (kept[0], kept[1], bool(kept[4]), kept[3], kept[2]) if kept else None
        entries = self._stored() if kept else {}
        held = self._restored(shape, entries) if kept else {}
        made = []
        # One tile's part of a micro-batch, whose size the source bounds.
        for row in pd.concat(list(rows)).sort_values("frame_idx", kind="stable").to_dict("records"):
            if row["frame_idx"] <= seen:
                late += 1
                continue
            seen = row["frame_idx"]
            now = (row["width"], row["height"], bool(row["night"]), row["h"], row["w"])
            if now != shape:
                shape, held = now, {m: self.options.model(m, row["h"], row["w"], bool(row["night"])) for m in self.options.methods}
            part = np.frombuffer(row["px"], np.uint8).reshape(row["h"], row["w"], 3)
            for method, model in held.items():
                mask = self.options.own(masks.clean(model.apply(part), self.options.kernel_size), row)
                made.append((row["category"], row["scene"], method, seen, row["width"], row["height"], row["warmup"], row["tx"], row["ty"], masks.pack(mask), late))
            late = 0
        if shape is not None:
            for entry, value in self._entries(held):
                before = entries.get(entry)
                if before is None or before.shape != value.shape or not np.array_equal(before, value):
                    self.arrays.updateValue((entry,), (str(value.dtype), list(value.shape), value.tobytes()))
            self.last.update((seen, late, shape[0], shape[1], shape[4], shape[3], shape[2]))
        if made:
            yield pd.DataFrame(made, columns=[f.split()[0] for f in _TILE.split(", ")])

    def close(self) -> None:
        pass


class SegmentProcessor(StatefulProcessor):
    """Puts frames together from their tiles and counts them into segments; yields a row when one is full.

    A frame waits until all its tiles are there.  A camera that is silent for ``idle_ms``
    gives up its partial segment.
    """

    def __init__(self, options: Options, per_segment: int, fps: float, tiers: tuple[int, int], idle_ms: int | None):
        self.options, self.per_segment, self.fps, self.tiers, self.idle_ms = options, per_segment, fps, tiers, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filling = handle.getValueState(_FILLING, "segment_no long, n_frames long, frames_with_targets long, roi_count long, n_late long")
        self.waiting = handle.getMapState(_WAITING, "frame_idx long, ty int, tx int", "width int, height int, warmup long, mask binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        no, n, busy, boxes, late = self.filling.get() if self.filling.exists() else (1, 0, 0, 0, 0)
        frames: dict[int, dict[tuple[int, int], tuple]] = {}
        for k, v in self.waiting.iterator():
            frames.setdefault(k[0], {})[k[1], k[2]] = tuple(v)
        before = {(f, *t) for f, tiles in frames.items() for t in tiles}
        for batch in rows:
            for r in batch.to_dict("records"):
                frames.setdefault(r["frame_idx"], {})[r["ty"], r["tx"]] = (r["width"], r["height"], r["warmup"], r["mask"])
                late += r["n_late"] if (r["tx"], r["ty"]) == (0, 0) else 0
        done = []
        for frame, tiles in sorted(frames.items()):
            width, height, warmup, _ = next(iter(tiles.values()))
            if len(tiles) < math.ceil(height / self.options.tile) * math.ceil(width / self.options.tile):
                for (ty, tx), v in tiles.items():
                    if (frame, ty, tx) not in before:
                        self.waiting.updateValue((frame, ty, tx), v)
                continue
            for ty, tx in tiles:
                if (frame, ty, tx) in before:
                    self.waiting.removeKey((frame, ty, tx))
            if frame < warmup:
                continue
            mask = self.options.assembled(height, width, [{"ty": ty, "tx": tx, "mask": v[3]} for (ty, tx), v in tiles.items()])
            found = len(self.options.measured(mask)["regions"])
            n, busy, boxes = n + 1, busy + (found > 0), boxes + found
            if n == self.per_segment:
                done.append(segment_row(key, (no, n, busy, boxes, late), self.fps, self.tiers))
                no, n, busy, boxes, late = no + 1, 0, 0, 0, 0
        self.filling.update((no, n, busy, boxes, late))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if done:
            yield _frame_of(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        filling = tuple(self.filling.get())
        if filling[1]:
            self.filling.update((filling[0] + 1, 0, 0, 0, 0))
            yield _frame_of([segment_row(key, filling, self.fps, self.tiers)])

    def close(self) -> None:
        pass


def segment_row(key: tuple, filling: tuple, fps: float, tiers: tuple[int, int]) -> tuple:
    no, n, busy, boxes, late = filling
    return (*key, no, n, busy, boxes, int(busy > 0), n / fps, tiers[0] if busy else tiers[1], late)


def _frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _SEGMENT.split(", ")])


def stream_segments(
    frames: DataFrame,
    methods: tuple[str, ...] = ("MOG2",),
    fps: float = 30.0,
    segment_seconds: float = 60,
    warmup: int = 120,
    foreground: int = 18,
    background_tier: int = 40,
    settings: DataFrame | None = None,
    flush_idle_seconds: float | None = None,
    **options,
) -> DataFrame:
    """Full segments of each camera (category, scene) of a frame stream, by method.

    ``settings`` is a table (category, scene, night, warmup) for cameras that differ from
    ``night_mode`` and ``warmup``; ``options`` are those of background models, ``tile`` among
    them.  The RocksDB state store holds the models.  The last, partial segment stays in the
    state; with ``flush_idle_seconds`` it comes out once its camera has been silent that long
    (by processing time), and partial_segments reads it after a run that ends by itself.
    """
    given = Options(**({"methods": tuple(methods)} | options))
    given = given.__class__(**(given.__dict__ | {"tile": given.tile or _WHOLE}))
    for method in given.methods:
        models.background_model(method, 1, 1)
    rows = frames.select("category", "scene", "frame_idx", "width", "height", "px").filter("px IS NOT NULL")
    night, begin = F.lit(given.night_mode), F.lit(warmup).cast("long")
    if settings is not None:
        own = settings.select("category", "scene", F.col("night").alias("_night"), F.col("warmup").cast("long").alias("_warmup"))
        rows = rows.join(own, ["category", "scene"], "left")
        night, begin = F.coalesce("_night", night), F.coalesce("_warmup", begin)
    rows = rows.select("category", "scene", "frame_idx", "width", "height", night.alias("night"), begin.alias("warmup"), "px")
    mode = "none" if flush_idle_seconds is None else "processingTime"
    parts = background.cut_tiles(rows, given, given.halo)
    tiles = parts.groupBy("category", "scene", "tx", "ty").transformWithStateInPandas(TileProcessor(given), outputStructType=_TILE, outputMode="append", timeMode=mode)
    idle = None if flush_idle_seconds is None else int(1000 * flush_idle_seconds)
    counter = SegmentProcessor(given, max(1, int(fps * segment_seconds)), fps, (foreground, background_tier), idle)
    return tiles.groupBy("category", "scene", "method").transformWithStateInPandas(counter, outputStructType=_SEGMENT, outputMode="append", timeMode=mode)


def partial_segments(spark: SparkSession, checkpoint: str, fps: float = 30.0, foreground: int = 18, background_tier: int = 40) -> DataFrame:
    """Segments that a stream of stream_segments left unfilled in its state, once it has stopped; in the same columns."""
    known = spark.read.format("state-metadata").load(checkpoint)
    names = known.filter(F.col("operatorProperties").contains(f'"{_FILLING}"')).select("operatorId").distinct().collect()
    state = spark.read.format("statestore").option("operatorId", names[0][0]).option("stateVarName", _FILLING).load(checkpoint)
    busy = F.col("frames_with_targets") > 0
    return state.select("key.*", "value.*").filter("n_frames > 0").select(
        "category", "scene", "method", "segment_no", "n_frames", "frames_with_targets", "roi_count", busy.cast("int").alias("target_detected"),
        (F.col("n_frames") / fps).alias("duration"), C.quality_tier(busy, foreground, background_tier).alias("crf"), "n_late",
    )


def stream_time_segments(frame_regions: DataFrame, length: str = "60 seconds", watermark: str = "2 minutes") -> DataFrame:
    """Segments by event time of frames with ``camera_id``, ``ts`` and ``n_regions``; late frames go by the watermark."""
    return (
        frame_regions.withWatermark("ts", watermark)
        .groupBy("camera_id", F.window("ts", length).alias("w"))
        .agg(
            F.count("*").alias("n_frames"),
            F.count_if(F.col("n_regions") > 0).alias("frames_with_targets"),
            F.sum("n_regions").cast("long").alias("roi_count"),
            F.max((F.col("n_regions") > 0).cast("int")).alias("target_detected"),
        )
        .select(
            "camera_id",
            F.col("w.start").alias("start"),
            F.col("w.end").alias("end"),
            "n_frames",
            "frames_with_targets",
            "roi_count",
            "target_detected",
            (F.col("w.end").cast("double") - F.col("w.start").cast("double")).alias("duration"),
            C.quality_tier(F.col("target_detected") == 1).alias("crf"),
        )
    )


def write_segments(segments: DataFrame, path: str, checkpoint: str, once: bool = True, job: str = "stream"):
    """Appends finished segments to the index by day; a micro-batch that is tried again replaces its own rows.

    ``job`` names the stream within the index.  ``once``: work off what is there and stop.
    """

    def append(rows: DataFrame, number: int) -> None:
        sinks.append_segments(rows, path, f"{job}-{number}")

    writer = segments.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_report(segments: DataFrame) -> DataFrame:
    """Totals of a segment stream so far; write it in complete mode."""
    return storage_report(segments)
