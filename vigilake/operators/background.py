"""Background subtraction over frame tables.

A pixel's model depends on its own past only, so a clip may be cut into tiles as well as
cameras: tiles are the unit of work and of skew.  Frames of a (scene, tile) come to one
task in order and stream through it in Arrow batches; only model state is held.  Tiles have
no border: they give raw masks, and a frame is cleaned and measured when its tiles are put
together, many frames at once and in any task.

What a fold gives is one table of three kinds of rows: frames, states (a model's arrays
after a key's last frame, when asked for) and rejects (a key that failed, and why).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigilake.pixels import enhance, masks, models, regions
from vigilake.schemas import FRAME_ACTIVITY, REGIONS

#: Pixels around a tile that its cleaned mask depends on (close and open, radius 2 each way).
HALO = 8
FRAME, STATE, REJECT = "frame", "state", "reject"
#: Part of both tables: which tile of which frame, and where it stands.
_PLACE = [
    *((n, T.StringType()) for n in ("category", "scene", "method")),
    ("frame_idx", T.LongType()),
    ("night", T.BooleanType()),
    *((n, T.IntegerType()) for n in ("width", "height", "tx", "ty", "x0", "y0", "w", "h")),
    *((n, T.StringType()) for n in ("name", "dtype", "reason")),
    ("shape", T.ArrayType(T.IntegerType())),
]
#: What goes into a fold: a tile's pixels, or one array of a model (``name``, ``dtype``, ``shape``) before all frames.
_IN = T.StructType([T.StructField(*f) for f in [*_PLACE, ("px", T.BinaryType())]])
ROWS = T.StructType([T.StructField(*f) for f in [("kind", T.StringType()), *_PLACE, ("coverage", T.DoubleType()), ("regions", REGIONS), ("mask", T.BinaryType()), ("data", T.BinaryType())]])
_KEY = ("category", "scene", "tx", "ty")


@dataclass(frozen=True)
class Options:
    """How models run; ``tile`` is a side in pixels, ``strict`` lets a bad frame fail the job instead of its scene."""

    methods: tuple[str, ...] = models.METHODS
    night_mode: bool = False
    use_clahe: bool = False
    min_area: int = 500
    pad: int = 20
    history: int = 500
    learning_rate: float = -1
    var_threshold: float | None = None
    kernel_size: int = 5
    clahe_clip: float = 2.0
    clahe_tiles: int = 8
    tile: int | None = None
    partitions: int | None = None
    strict: bool = True

    def prepared(self, row: dict) -> np.ndarray:
        frame = frame_array(row)
        return enhance.enhance(frame, self.clahe_clip, self.clahe_tiles) if row["night"] or self.use_clahe else frame

    def model(self, method: str, height: int, width: int, night: bool):
        return models.background_model(method, height, width, night=night, var_threshold=self.var_threshold, history=self.history, learning_rate=self.learning_rate)

    @property
    def halo(self) -> int:
        return 4 * (self.kernel_size // 2)

    def tiles(self, height: int, width: int, border: int = 0) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(tx, ty, x0, y0, w, h): each tile's corner, and where its part with the border begins and how large that is."""
        side = self.tile or max(height, width, 1)
        for ty in range(0, height, side):
            for tx in range(0, width, side):
                y0, x0 = max(0, ty - border), max(0, tx - border)
                yield tx, ty, x0, y0, min(width, tx + side + border) - x0, min(height, ty + side + border) - y0

    def own(self, mask: np.ndarray, row: dict) -> np.ndarray:
        """The tile without its border."""
        y, x = row["ty"] - row["y0"], row["tx"] - row["x0"]
        return mask[y : y + min(self.tile, row["height"] - row["ty"]), x : x + min(self.tile, row["width"] - row["tx"])]

    def assembled(self, height: int, width: int, tiles: list[dict]) -> np.ndarray:
        mask = np.zeros((height, width), bool)
        for t in tiles:
            h, w = min(self.tile, height - t["ty"]), min(self.tile, width - t["tx"])
            mask[t["ty"] : t["ty"] + h, t["tx"] : t["tx"] + w] = masks.unpack(t["mask"], h, w)
        return mask

    def assembled_each(self, height: int, width: int, tiles: pa.ListArray) -> np.ndarray:
        """Masks of frames of one size, each from a list of its tiles."""
        out = np.zeros((len(tiles), height, width), bool)
        frame, parts = np.asarray(tiles.value_parent_indices()), tiles.flatten()
        tx, ty, packed = (np.asarray(parts.field(0)), np.asarray(parts.field(1)), parts.field(2))
        for x, y, _, _, w, h in self.tiles(height, width):
            at = np.flatnonzero((tx == x) & (ty == y))
            rows = np.frombuffer(b"".join(packed.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -(-h * w // 8))
            out[frame[at], y : y + h, x : x + w] = np.unpackbits(rows, axis=1, count=h * w).reshape(len(at), h, w)
        return out

    def measured(self, mask: np.ndarray) -> dict:
        return self.measured_each(mask[None])[0]

    def measured_each(self, stack: np.ndarray) -> list[dict]:
        names = ("x", "y", "w", "h", "area")
        found = regions.regions_each(stack, self.min_area, self.pad)
        return [{"coverage": masks.coverage(m), "regions": [dict(zip(names, r, strict=True)) for r in boxes]} for m, boxes in zip(stack, found, strict=True)]


def frame_array(row: dict) -> np.ndarray:
    return np.frombuffer(row["px"], np.uint8).reshape(row["height"], row["width"], 3)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 16) -> Iterator[dict]:
    for batch in batches:
        for begin in range(0, batch.num_rows, at_once):
            yield from batch.slice(begin, at_once).to_pylist()


def packed_rows(rows: Iterator[dict | pa.RecordBatch], schema: pa.Schema, at_once: int = 64, most_bytes: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Rows by the batch; batches among them go through."""
    held: list[dict] = []
    size = 0
    for row in rows:
        if isinstance(row, pa.RecordBatch):
            yield row
            continue
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if len(held) >= at_once or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def state_rows(model) -> Iterator[dict]:
    """A model's state, an array a row."""
    for name, value in model.state().items():
        yield {"name": name, "dtype": str(value.dtype), "shape": list(value.shape), "data": value.tobytes()}


def state_arrays(rows: list[dict]) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]) for r in rows}


def _of_bytes(rows: np.ndarray) -> pa.Array:
    """Binary values of one length, from the rows of a matrix of bytes."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _batch(schema: pa.Schema, n: int, columns: dict[str, pa.Array], same: dict) -> pa.RecordBatch:
    """n rows: columns, values that are the same in every row, and nulls."""
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) if same.get(f.name) is None else pa.repeat(pa.scalar(same[f.name], f.type), n) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _at_once(pixels: int, most: int = 1 << 20) -> int:
    """Frames of so many pixels that are worked on together."""
    return max(1, most // max(1, pixels))


def _cut(options: Options, border: int = 0, more: tuple[str, ...] = (), schema: T.StructType = _IN):
    """mapInArrow function: the parts of every frame; a frame that cannot be read is one part without pixels."""
    kept = ("category", "scene", "frame_idx", "width", "height", "night", *more)
    asked = to_arrow_schema(schema)

    def parts(batch: pa.RecordBatch) -> Iterator[dict | pa.RecordBatch]:
        """Parts of a batch of frames of one size."""
        frames, good = [], []
        for i, row in enumerate(batch.select(["width", "height", "night", "px"]).to_pylist()):
            try:
                frames.append(options.prepared(row))
                good.append(i)
            except Exception as error:
                if options.strict:
                    raise
                yield {**batch.select(kept).slice(i, 1).to_pylist()[0], "tx": 0, "ty": 0, "reason": _reason(error)}
        if not good:
            return
        stack = np.stack(frames)
        taken = batch.select(kept).take(pa.array(good))
        columns = {n: taken.column(n).cast(asked.field(n).type) for n in kept}
        for tx, ty, x0, y0, w, h in options.tiles(*stack.shape[1:3], border):
            px = _of_bytes(stack[:, y0 : y0 + h, x0 : x0 + w].reshape(len(stack), -1))
            yield _batch(asked, len(stack), columns | {"px": px}, {"tx": tx, "ty": ty, "x0": x0, "y0": y0, "w": w, "h": h})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_rows((row for batch in batches for part in _by_size(batch) for row in parts(part)), asked)

    return run


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of one ``height`` and ``width``, as many as are worked on together."""
    sizes = np.stack([np.asarray(batch.column(c).fill_null(-1)) for c in ("height", "width")], 1)
    for height, width in np.unique(sizes, axis=0).tolist() if len(sizes) else ():
        at, step = np.flatnonzero((sizes == (height, width)).all(1)), _at_once(height * width)
        for begin in range(0, len(at), step):
            yield batch.take(pa.array(at[begin : begin + step]))


def cut_tiles(frames: DataFrame, options: Options, border: int = 0) -> DataFrame:
    """Prepared parts of frames (with ``night``, without null ``px``), their other columns kept."""
    more = [f for f in frames.schema if f.name not in _IN.names]
    schema = T.StructType([*_IN, *more])
    return frames.mapInArrow(_cut(options, border, tuple(f.name for f in more), schema), schema)


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _runs(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Rows that follow each other with the same key, size and night flag, as many as are worked on together, and the first one without ``px``.

    States, bad frames and, if ``single``, all others stand alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = []
        for name in (*_KEY, "width", "height", "night", "w", "h"):
            found = batch.column(name).dictionary_encode().indices
            codes.append(np.asarray(found.fill_null(-1)))
        alone = np.asarray(batch.column("name").is_valid()) | np.asarray(batch.column("reason").is_valid()) | single
        apart = (np.diff(np.stack(codes), axis=1) != 0).any(0) | alone[1:] | alone[:-1]
        starts = np.append(0, np.flatnonzero(apart) + 1)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            first = batch.slice(start, 1).drop_columns("px").to_pylist()[0]
            step = _at_once((first["w"] or 1) * (first["h"] or 1))
            for begin in range(start, end, step):
                part = batch.slice(begin, min(step, end - begin))
                yield first if begin == start else part.slice(0, 1).drop_columns("px").to_pylist()[0], part


def _fold(options: Options, keep_states: bool):
    """mapInArrow function over a key's states and then its frames, in order."""
    asked = to_arrow_schema(ROWS)
    whole = options.tile is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states(last: dict, held: dict):
            if keep_states and last is not None:
                for method, model in held.items():
                    for array in state_rows(model):
                        yield {**last, **array, "kind": STATE, "method": method}

        def begun(row: dict, given: dict) -> dict:
            held = {m: options.model(m, row["h"], row["w"], row["night"]) for m in options.methods}
            for method, arrays in given.items():
                old = arrays[0]
                if method in held and (old["height"], old["width"]) == (row["height"], row["width"]):
                    state = state_arrays(arrays)
                    # States of tiles with a border, as they once were.
                    if (old["h"], old["w"]) != (row["h"], row["w"]):
                        state = models.part_of_state(state, (old["h"], old["w"]), row["y0"] - old["y0"], row["x0"] - old["x0"], row["h"], row["w"])
                    held[method].restore(state)
            return held

        def results():
            key, size, held, last, given, failed = None, None, {}, None, {}, False
            for row, part in _runs(batches, whole):
                now = tuple(row[k] for k in _KEY)
                if now != key:
                    yield from states(last, held)
                    key, size, held, last, given, failed = now, None, {}, None, {}, False
                if row["name"] is not None:
                    given.setdefault(row["method"], []).append({**row, "data": part.column("px")[0].as_py()})
                    continue
                if failed:
                    continue
                kept = {k: row[k] for k in ("category", "scene", "frame_idx", "width", "height", "night", "tx", "ty", "x0", "y0", "w", "h")}
                try:
                    if row["reason"]:
                        raise ValueError(row["reason"])
                    # A picture of another size starts the models anew.
                    if (row["height"], row["width"]) != size:
                        size = row["height"], row["width"]
                        held, given = begun(row, given), {}
                    px = part.column("px").to_pylist()
                    made = []
                    if whole:
                        frame = options.prepared({**row, "px": px[0]})
                        for method, model in held.items():
                            made.append({**kept, "kind": FRAME, "method": method} | options.measured(masks.clean(model.apply(frame), options.kernel_size)))
                    else:
                        frames = np.frombuffer(b"".join(px), np.uint8).reshape(len(px), row["h"], row["w"], 3)
                        for method, model in held.items():
                            raw = model.apply_each(frames) > masks.THRESHOLD
                            columns = {"frame_idx": part.column("frame_idx"), "mask": _of_bytes(np.packbits(raw.reshape(len(px), -1), axis=1))}
                            made.append(_batch(asked, len(px), columns, {**kept, "kind": FRAME, "method": method}))
                except Exception as error:
                    if options.strict:
                        raise
                    failed, last = True, None
                    yield {**kept, "kind": REJECT, "reason": row["reason"] or _reason(error)}
                    continue
                last = {**kept, "frame_idx": part.column("frame_idx")[-1].as_py()}
                yield from made
            yield from states(last, held)

        yield from packed_rows(results(), asked)

    return run


def fold_frames(frames: DataFrame, options: Options, states: DataFrame | None = None, keep_states: bool = False) -> DataFrame:
    """Rows of all kinds; models start from ``states`` (rows of that kind) where a key has some.

    A column ``night`` of the frames goes before ``night_mode``.  Undecodable frames (null
    ``px``) are skipped.  A failed key gives its frames so far, one reject, and no state.
    """
    for method in options.methods:
        models.background_model(method, 1, 1)
    if "night" not in frames.columns:
        frames = frames.withColumn("night", F.lit(options.night_mode))
    rows = frames.select("category", "scene", "frame_idx", "width", "height", F.coalesce("night", F.lit(options.night_mode)).alias("night"), "px").filter("px IS NOT NULL")
    if options.tile is None:
        places = {"tx": F.lit(0), "ty": F.lit(0), "x0": F.lit(0), "y0": F.lit(0), "w": F.col("width"), "h": F.col("height")}
        blank = {n: F.lit(None).cast(_IN[n].dataType) for n in ("method", "name", "dtype", "reason", "shape")}
        parts = rows.withColumns(places | blank).select(*_IN.names)
    else:
        parts = cut_tiles(rows, options)
    if states is not None:
        columns = [c for c in _IN.names if c not in ("px", "reason", "frame_idx")]
        begun = states.select(*columns, F.lit(-1).cast("long").alias("frame_idx"), F.col("data").alias("px"), F.lit(None).cast("string").alias("reason"))
        parts = parts.unionByName(begun)
    parts = parts.repartition(options.partitions, *_KEY) if options.partitions else parts.repartition(*_KEY)
    return parts.sortWithinPartitions(*_KEY, "frame_idx").mapInArrow(_fold(options, keep_states), ROWS)


def frame_activity(rows: DataFrame, options: Options) -> DataFrame:
    """Coverage and regions of whole frames, from rows of kind frame."""
    found = rows.filter(F.col("kind") == FRAME)
    if options.tile is None:
        return found.select(*FRAME_ACTIVITY.names)

    asked = to_arrow_schema(FRAME_ACTIVITY)

    def join_tiles(batches):
        for batch in batches:
            for part in _by_size(batch):
                height, width = part.column("height")[0].as_py(), part.column("width")[0].as_py()
                stack = masks.clean_foreground(options.assembled_each(height, width, part.column("tiles")), options.kernel_size)
                measured = options.measured_each(stack)
                columns = {n: part.column(n) for n in ("category", "scene", "method", "frame_idx", "width", "height")}
                columns |= {n: pa.array([m[n] for m in measured], asked.field(n).type) for n in ("coverage", "regions")}
                yield _batch(asked, len(stack), columns, {})

    # A frame has a fixed number of tiles of one bit a pixel, so a group is one mask.
    tiles = F.collect_list(F.struct("tx", "ty", "mask")).alias("tiles")
    together = found.groupBy("category", "scene", "method", "frame_idx", "width", "height").agg(tiles)
    return together.mapInArrow(join_tiles, FRAME_ACTIVITY)


def rejects(rows: DataFrame) -> DataFrame:
    """(category, scene, frame_idx, reason): each failed scene's first bad frame."""
    found = rows.filter(F.col("kind") == REJECT)
    first = found.groupBy("category", "scene").agg(F.min(F.struct("frame_idx", "reason")).alias("bad"))
    return first.select("category", "scene", "bad.frame_idx", "bad.reason")


def subtract_background(frames: DataFrame, **options) -> DataFrame:
    """Coverage and regions of every frame by method; all methods see a frame in one pass.

    ``options`` are those of Options.  With ``tile`` frames are cut up, for large pictures or
    few cameras; results are those of whole frames.  A change of a scene's picture size
    starts its models anew.
    """
    given = Options(**options)
    return frame_activity(fold_frames(frames, given), given)


def explode_regions(activity: DataFrame) -> DataFrame:
    """One row for each region of each frame."""
    return activity.select("category", "scene", "method", "frame_idx", F.explode("regions").alias("r")).select("category", "scene", "method", "frame_idx", "r.*")
