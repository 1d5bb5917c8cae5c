"""Known objects: match perceptual hashes, decide, and record sightings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a hash, and most differing bits that an object's part is looked up with.
BITS, REACH = 64, 2
#: Detections of one key that stay together, and pairs compared at once.
TOGETHER, PAIRS = 1 << 17, 1 << 22


def _parts(bits: int) -> list[tuple[int, int, int]]:
    """(begin, width, differing bits) of the parts that a hash is cut into.

    The differing bits, each and one more, sum up to bits + 1, so hashes within ``bits``
    differ in no more than that in at least one part.
    """
    n = -(-(bits + 1) // (REACH + 1))
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a, (bits + 1 + n - 1 - i) // n - 1) for i, (a, b) in enumerate(pairwise(edges))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _keyed(hashes: DataFrame, bits: int, around: bool) -> DataFrame:
    """A row for each part of a hash with its ``choice`` and ``value``; ``around``: also for the values near it."""
    parts = _parts(bits)
    values = [F.shiftrightunsigned("hash", begin).bitwiseAND(F.lit(_signed((1 << width) - 1)).cast("long")) for begin, width, _ in parts]
    changes = [(i, _signed(sum(1 << k for k in c))) for i, (_, width, far) in enumerate(parts) for m in range(min(far, width) + 1 if around else 1) for c in combinations(range(width), m)]
    each = F.explode(F.expr(f"array({', '.join(f"struct({i} AS choice, bigint('{c}') AS change)" for i, c in changes)})"))
    rows = hashes.withColumns({"_values": F.array(*values), "_c": each})
    value = F.element_at("_values", F.col("_c.choice") + 1).bitwiseXOR(F.col("_c.change"))
    return rows.withColumns({"choice": F.col("_c.choice"), "value": value}).drop("_values", "_c")


def _compare(bits: int):
    """mapInArrow function: (hash, object_id, distance), the nearest object of each detection of a key.

    Of a key the objects come first, by object_id, and are held; detections stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, ids = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, value, part, seen, code, object_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            change = (choice[1:] != choice[:-1]) | (value[1:] != value[:-1]) | (part[1:] != part[:-1]) | (seen[1:] != seen[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(code)]
            found: list[tuple[np.ndarray, ...]] = []
            for begin, end in pairwise(edges):
                own = choice[begin], value[begin], part[begin]
                if not seen[begin]:
                    if own == key:
                        codes, ids = np.concatenate([codes, code[begin:end]]), np.concatenate([ids, object_id[begin:end]])
                    else:
                        key, codes, ids = own, code[begin:end], object_id[begin:end]
                elif own == key:
                    step = max(1, PAIRS // len(codes))
                    for i in range(begin, end, step):
                        asked = code[i : min(end, i + step)]
                        apart = np.bitwise_count((asked[:, None] ^ codes).view(np.uint64))
                        best = apart.argmin(1)
                        least = apart[np.arange(len(asked)), best]
                        near = np.flatnonzero(least <= bits)
                        if len(near):
                            found.append((asked[near], ids[best[near]], least[near].astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["hash", "object_id", "distance"])

    return run


def match_objects(detections: DataFrame, registry: DataFrame, bits: int = 10) -> DataFrame:
    """Detections (detection_id, hash) with the nearest registered object within ``bits``; null without one.

    A hash is cut into parts; objects are looked up by each part and all values near it, so
    that distinct hashes meet in a key that is nearly a fourth of a hash wide (for 10 bits)
    and detections, of which there are more, have only a row for each part.  Detections of a
    large key are dealt into parts of it.  Of equal distances the smaller object_id wins.
    """
    key = ["choice", "value"]
    asked = _keyed(detections.filter("hash IS NOT NULL").select("hash").distinct(), bits, around=False)
    known = registry.filter("hash IS NOT NULL AND object_id IS NOT NULL").groupBy("hash").agg(F.min("object_id").cast("long").alias("object_id"))
    large = asked.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select(*key, F.ceil(F.col("n") / TOGETHER).cast("int").alias("_dealt"))
    dealt = F.coalesce("_dealt", F.lit(1))
    asked = asked.join(F.broadcast(large), key, "left").select(*key, F.pmod(F.xxhash64("hash"), dealt).cast("int").alias("part"), F.lit(True).alias("seen"), "hash", F.lit(0).cast("long").alias("object_id"))
    known = _keyed(known, bits, around=True).join(F.broadcast(large), key, "left")
    known = known.select(*key, F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"), F.lit(False).alias("seen"), "hash", "object_id")
    rows = asked.unionByName(known).repartition(*key, "part").sortWithinPartitions(*key, "part", "seen", "object_id")
    near = rows.mapInArrow(_compare(bits), "hash long, object_id long, distance int")
    best = near.groupBy("hash").agg(F.min(F.struct("distance", "object_id")).alias("m"))
    found = best.select("hash", F.col("m.object_id").alias("object_id"), F.col("m.distance").alias("distance"))
    return detections.join(found, "hash", "left")


def decide(matched: DataFrame, registry: DataFrame) -> DataFrame:
    """New objects are registered, known ones logged on their own camera and flagged on another."""
    home = registry.groupBy("object_id").agg(F.min_by("camera_id", "first_seen").alias("home_camera"))
    rows = matched.join(home, "object_id", "left")
    action = F.when(F.col("object_id").isNull(), "register").when(F.col("camera_id") == F.col("home_camera"), "log").otherwise("flag")
    return rows.withColumn("action", action)


def register_new(decided: DataFrame) -> DataFrame:
    """Registry rows of new objects: one by distinct hash, first seen where it came first."""
    new = decided.filter("action = 'register'").groupBy("hash").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("camera_id", F.struct("ts", "camera_id")).alias("camera_id"), F.count("*").alias("sighting_count")
    )
    return new.withColumn("object_id", F.xxhash64("hash"))


def sightings(decided: DataFrame) -> DataFrame:
    """One row for each detection of a known object."""
    return decided.filter("action <> 'register'").select("object_id", "camera_id", "ts", "distance", (F.col("action") == "flag").alias("flagged"))
