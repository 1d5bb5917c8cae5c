"""Near duplicates by the Jaccard similarity of word shingles, found through SimHash and the Gray-order index.

Two texts of similarity 0.8 differ in about a seventh of their SimHash bits, too many for
one short fingerprint.  So a text gets many bits: tables deal texts into groups by a few of
them each, and in a group the Gray-order index finds what lies within a wide distance.
Whatever is near in any table forms candidate clusters, in which the exact similarity of
shingle sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import carries_columns, checkpointed, text_slices
from vigilake.llm.simhash import SEED, GrayIndex, _union, connected_components, first_of_groups, in_blocks, join_dense, outside_largest, with_row_keys

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a text; the first 128 are compared, tables take theirs from all.
BITS = 512
#: Bits out of 64 and out of 128 in which candidates differ at most: 3.6 and 4 deviations above the mean at 0.8.
NEAR, NEAR_BOTH = 20, 36
#: Probability that two texts of similarity 0.8 differ in a bit, and the share of such pairs that tables may miss.
DIFFER, MISS = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi, 0.003
#: Texts aimed at in a group, and the most in one task's side; bytes of shingle sets in one.
GROUP, BLOCK, SET_BYTES = 512, 16_384, 16 << 20
_FLIP = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64, np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the lower-cased text's shingles; a shorter text is one shingle."""
    words = text.lower().split()
    last = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(last)], np.uint64))


def wide_code(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, each set if it is set in over half of the shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(shingles), 255):
        x = shingles[begin : begin + 255, None] ^ _FLIP
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the text becomes ``_body``, a hash of its lower-cased words, and ``_code``."""
    for part, texts in text_slices(batches, "_text"):
        names = [n for n in part.schema.names if n != "_text"]
        body = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())) for t in texts], np.uint64).view(np.int64)
        code = pa.array([wide_code(shingle_set(t)).tobytes() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(body), code], [*names, "_body", "_code"])


def tables_for(count: int, group: int = GROUP) -> np.ndarray:
    """[tables, bits]: places of the bits by which each table deals ``count`` texts into groups of about ``group``.

    As many tables as leave out MISS of the pairs at 0.8; without bits, one.
    """
    bits = max(0, math.ceil(math.log2(max(1, count) / group)))
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** bits))) if bits else 1
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(BITS, bits, replace=False) for _ in range(tables)], np.int64).reshape(tables, bits)


def _dealt(places: np.ndarray, first: int):
    """mapInArrow function: a row for each table (numbered from ``first``), with its key, the compared bits and ``_root``."""
    tables, bits = places.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                raw = np.frombuffer(b"".join(part.column("_code").to_pylist()), np.uint8).reshape(part.num_rows, BITS // 8)
                flags = np.unpackbits(raw, axis=1)
                keys = (flags[:, places].astype(np.int64) << np.arange(bits)).sum(2) + (np.arange(first, first + tables) << bits)
                halves = [np.ascontiguousarray(raw[:, i : i + 8]).view(np.int64).ravel() for i in (0, 8)]
                columns = [keys.ravel(), *(np.repeat(x, tables) for x in (part.column("_body").to_numpy(), part.column("_root").to_numpy(), *halves))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["_key", "_body", "_root", "_first", "_second"])

    return run


def _candidates(table: pa.Table) -> pa.Table:
    """applyInArrow function: links (a, b) that join the roots of texts whose codes are near, as stars."""
    first, second = (table.column(c).to_numpy().view(np.uint64) for c in ("_first", "_second"))
    root, side = table.column("_root").to_numpy(), table.column("_side").to_numpy()
    # Texts that are together already are not compared again.
    _, place, of = np.unique(root, return_index=True, return_inverse=True)
    parent = join_dense(first, NEAR // 2, place[of])
    asking = outside_largest(parent)
    for own in (0, 1) if side.any() else (0,):
        indexed = np.flatnonzero(side != own) if side.any() else np.arange(len(first))
        mine = asking[side[asking] == own]
        if not len(mine) or not len(indexed):
            continue
        for q, c in GrayIndex(first[indexed]).search(first[mine], NEAR):
            q, c = mine[q], indexed[c]
            differ = np.bitwise_count(first[q] ^ first[c]).astype(np.int16) + np.bitwise_count(second[q] ^ second[c])
            near = differ <= NEAR_BOTH
            parent = _union(parent, q[near], c[near])
    links = np.unique(np.stack([root, root[parent]], 1), axis=0)
    links = links[links[:, 0] != links[:, 1]]
    return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def candidate_clusters(codes: DataFrame, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(node, root) of the clusters that near codes form; ``_body`` is distinct.

    A fifth of the tables goes first; the others, told what that has put together, add only
    links between clusters, so that a crowd is not linked anew in every table.
    """
    places = tables_for(codes.count(), group)
    early = -(-len(places) // 5)

    def linked(rows: DataFrame, begin: int, end: int) -> DataFrame:
        dealt = rows.select("_body", "_code", "_root").mapInArrow(_dealt(places[begin:end], begin), "_key long, _body long, _root long, _first long, _second long")
        return in_blocks(dealt, block, "_body").groupBy("_key", "_low", "_high").applyInArrow(_candidates, "a long, b long")

    found = connected_components(linked(codes.withColumn("_root", F.col("_body")), 0, early))
    if early == len(places):
        return found
    rooted = codes.join(found.withColumnRenamed("node", "_body"), "_body", "left").withColumn("_root", F.coalesce("root", "_body"))
    more = linked(rooted, early, len(places))
    return connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "_text"):
        held = pa.array([shingle_set(t).tobytes() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("_body"), part.column("_key"), held], ["_body", "_key", "_set"])


def join_similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest member of each member's component, by pairs of sets that are at least so similar.

    One set at a time is compared with all; once every set outside the largest component has
    been, no pair that is apart is left.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    frequency = np.bincount(codes)
    held = np.concatenate([[0], np.cumsum(frequency[codes])])
    popular = (held[ends] - held[ends - sizes]) / np.maximum(sizes, 1)
    parent, done, flag = np.arange(len(sets)), np.zeros(len(sets), bool), np.zeros(len(frequency), np.int32)
    while True:
        waiting = np.flatnonzero((parent != np.bincount(parent).argmax()) & ~done) if done.any() else np.arange(len(sets))
        if not len(waiting):
            return parent
        pivot = waiting[popular[waiting].argmax()]
        done[pivot] = True
        own = codes[ends[pivot] - sizes[pivot] : ends[pivot]]
        flag[own] = 1
        shared = np.concatenate([[0], np.cumsum(flag[codes])])
        flag[own] = 0
        both = shared[ends] - shared[ends - sizes]
        near = np.flatnonzero(both >= similarity * (sizes + sizes[pivot] - both))
        parent = _union(parent, np.full(len(near), pivot), near)


def _similar(similarity: float):
    """applyInArrow function: links (a, b) of a cluster's similar texts, as stars."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_body")
        body = table.column("_body").to_numpy()
        parent = join_similar([np.frombuffer(x, np.uint64) for x in table.column("_set").to_pylist()], similarity)
        child = np.flatnonzero(parent != np.arange(len(body)))
        return pa.table({"a": pa.array(body[child]), "b": pa.array(body[parent[child]])})

    return run


@carries_columns("order", "text")
def drop_near_duplicates(df: DataFrame, order: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """One row of each group: the one with the smallest ``order``, then row keys; exact repeats give one row.

    Groups are the components of pairs of at least ``similarity``.  Texts of the same
    lower-cased words are one; so are texts without words, null ones among them.  A null
    ``order`` is never the smallest unless a group has nothing else.  Texts are read whole;
    an empty table gives none; all columns stay.
    """
    keyed = with_row_keys(df)
    rows = keyed.select(F.col(order).alias("_order"), "__row", "__also", F.col(text).alias("_text"))
    schema = T.StructType([f for f in rows.schema if f.name != "_text"]).add("_body", "long").add("_code", "binary")
    coded = checkpointed(rows.mapInArrow(_coded, schema))
    codes = coded.groupBy("_body").agg(F.first("_code").alias("_code"), F.min(F.struct("__row", "__also")).alias("_one"))
    codes = checkpointed(codes.select("_body", "_code", "_one.*"))
    clusters = candidate_clusters(codes, group).withColumnRenamed("node", "_body").withColumnRenamed("root", "_key")
    # One text stands for each body of a cluster.
    chosen = codes.join(clusters, "_body").select("_body", "_key", "__row", "__also")
    texts = rows.select("__row", "__also", "_text").join(chosen, ["__row", "__also"]).select("_body", "_key", "_text")
    sets = checkpointed(texts.mapInArrow(_sets, "_body long, _key long, _set binary").dropDuplicates(["_body"]))
    links = by_bytes(sets, SET_BYTES).groupBy("_key", "_low", "_high").applyInArrow(_similar(similarity), "a long, b long")
    roots = connected_components(links).withColumnRenamed("node", "_body")
    grouped = coded.select("_order", "__row", "__also", "_body").join(roots, "_body", "left").withColumn("_root", F.coalesce("root", "_body"))
    return first_of_groups(keyed, grouped, "_root", "_order").select(*df.columns)


def by_bytes(sets: DataFrame, most: int) -> DataFrame:
    """Clusters in pairs of blocks, as ``in_blocks``, by the bytes of their sets."""
    sized = sets.groupBy("_key").agg(F.sum(F.octet_length("_set")).alias("_bytes"))
    blocks = F.greatest(F.ceil(F.col("_bytes") / most), F.lit(1)).cast("int")
    dealt = sets.join(sized, "_key").withColumn("_own", F.pmod(F.xxhash64("_body"), blocks).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")}).drop("_own", "_other", "_bytes")
