"""Scalar columns: names, times, sizes, ratios, boxes and small pixel metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def _column(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def camera_name(camera: Column | str) -> Column:
    """Every character outside letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(_column(camera), "[^a-zA-Z0-9_-]", "_")


def warmup_frames(roi: Column | str, fallback: int = 120) -> Column:
    """Frames before a clip's region of time (a struct with ``start``), or the fallback without one."""
    roi = _column(roi)
    return F.when(roi.isNotNull(), F.greatest(F.lit(0), roi["start"] - 1)).otherwise(F.lit(fallback))


def frames_per_segment(fps: Column | str | float, seconds: float) -> Column:
    return F.greatest(F.lit(1), (_column(fps) * F.lit(float(seconds))).cast("int"))


def coverage(mask: Column | str) -> Column:
    """Share of non-zero elements of an array; 0.0 for an empty or null one."""
    mask = _column(mask)
    return F.when(F.size(mask) > 0, F.size(F.filter(mask, lambda x: x > 0)) / F.size(mask)).otherwise(F.lit(0.0))


def mean_pct(share: Column | str) -> Column:
    """Aggregate: mean share in %, half up to two places; null of no shares.

    Shares are added up in whole 10^-10ths, so that neither the order of rows nor floats
    decide a mean that lies halfway.
    """
    share = _column(share)
    parts, n = F.sum(F.round(share * F.lit(1e10)).cast("decimal(18,0)")), F.count(share).cast("decimal(18,0)")
    half = F.lit(1_000_000).cast("decimal(7,0)") * n
    # A hundredth of a percent is 10^6 parts.
    return F.call_function("div", parts + parts + half, half + half).cast("double") / F.lit(100.0)


def compression_ratio(original: Column | str, compressed: Column | str) -> Column:
    """original / compressed; infinite for nothing left, even of nothing; an error on negative sizes."""
    original, compressed = _column(original), _column(compressed)
    return (
        F.when((original < 0) | (compressed < 0), F.raise_error(F.lit("sizes must not be negative")).cast("double"))
        .when(compressed == 0, F.lit(INFINITY))
        .otherwise(original.cast("double") / compressed)
    )


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding of a double that leaves infinities alone."""
    return F.when(x == INFINITY, x).otherwise(F.round(x, digits))


def megabytes(size: Column | str) -> Column:
    return F.round(_column(size) / 1e6, 2)


def gigabytes(size: Column | str) -> Column:
    return F.round(_column(size) / 1e9, 3)


def hours(seconds: Column | str, digits: int = 3) -> Column:
    return F.round(_column(seconds) / 3600.0, digits)


def savings(original: Column | str, compressed: Column | str) -> Column:
    """Struct of original_mb, compressed_mb, saved_mb, compression_ratio and space_saved_pct."""
    original, compressed = _column(original), _column(compressed)
    return F.struct(
        megabytes(original).alias("original_mb"),
        megabytes(compressed).alias("compressed_mb"),
        megabytes(original - compressed).alias("saved_mb"),
        rounded(compression_ratio(original, compressed), 2).alias("compression_ratio"),
        F.round((original - compressed) / F.greatest(original, F.lit(1)) * 100, 1).alias("space_saved_pct"),
    )


def padded_box(box: Column, pad: int, width: Column | int, height: Column | int) -> Column:
    """A box grown by ``pad`` on each side within the frame; its area is that of the new box."""
    width, height = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    left, top = F.greatest(F.lit(0), box["x"] - pad), F.greatest(F.lit(0), box["y"] - pad)
    w = F.least(width, box["x"] + box["w"] + pad) - left
    h = F.least(height, box["y"] + box["h"] + pad) - top
    return F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))


def box_corners(box: Column) -> Column:
    """(x, y, w, h) as an array."""
    return F.array(box["x"], box["y"], box["w"], box["h"])


def pad_regions(regions: Column | str, pad: int, width: Column | int, height: Column | int) -> Column:
    """All boxes padded, largest first; of equal areas the one further left, then up."""
    grown = F.transform(_column(regions), lambda r: padded_box(r, pad, width, height))
    keyed = F.transform(grown, lambda r: F.struct((-r["area"]).alias("k"), r["x"].alias("x"), r["y"].alias("y"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda s: s["r"])


def quality_tier(has_targets: Column | str, foreground: int = 18, background: int = 40) -> Column:
    return F.when(_column(has_targets), F.lit(foreground)).otherwise(F.lit(background))


def segment_time(text: Column | str) -> Column:
    """Timestamp of ``yyyyMMddTHHmmssZ``, also without the T; null for anything else."""
    text = _column(text)
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss'Z'")))


def segment_time_text(ts: Column | str) -> Column:
    return F.date_format(_column(ts), "yyyyMMdd'T'HHmmss'Z'")


def day_key(text: Column | str) -> Column:
    return F.substring(_column(text), 1, 8)


def segment_path(camera: Column | str, timestamp: Column | str, number: Column | str | None = None) -> Column:
    """``camera_timestamp.mp4``, with the segment's number where given, so that paths differ within a second."""
    parts = [_column(camera), _column(timestamp)] + ([] if number is None else [_column(number).cast("string")])
    return F.concat(F.concat_ws("_", *parts), F.lit(".mp4"))


def sample_name(scene: Column | str, method: Column | str, index: Column | str) -> Column:
    return F.format_string("%s_%s_frame%05d.jpg", _column(scene), _column(method), _column(index))


def scene_name(path: Column | str, sequence: bool = True) -> Column:
    """The folder two above an image, or a video's name without its ending."""
    parts = F.split(_column(path), "/")
    if sequence:
        return F.try_element_at(parts, F.lit(-3))
    return F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")


def temporal_roi(text: Column | str) -> Column:
    """(start, end) of the first two white-space separated numbers; null with fewer."""
    parts = F.split(F.trim(_column(text)), "\\s+")
    return F.when(F.size(parts) >= 2, F.struct(parts[0].cast("int").alias("start"), F.get(parts, F.lit(1)).cast("int").alias("end")))


def psnr(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of 8-bit values; infinite if equal, an error if sizes differ."""
    a, b = _column(a), _column(b)
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x)
    mse = squares / F.size(a)
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("frames differ in size")).cast("double"))
        .when(mse == 0, F.lit(INFINITY))
        .otherwise(10 * F.log10(F.lit(65025.0) / mse))
    )


def background_share(coverage_pct: Column | str) -> Column:
    return 100.0 - _column(coverage_pct)
