"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints that lie within k bits of each other agree on one of k+1 bands, so
each band (or part of it, by the number of fingerprints) deals them out into groups.
Inside a group they are sorted by Gray rank; runs of neighbours become nodes that hold the
bits all members share as a mask and a pattern, upper nodes take what their children share
and leave them the rest.  A search adds up the differences from the top and drops a node,
with everything below it, once they exceed k.  Groups give star-shaped links, whose
connected components are found by alternating large and small stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import carries_columns, checkpointed, text_slices

SHINGLE, SEED, BITS, DIFFERENCES = 4, 42, 64, 4
#: Fingerprints aimed at in a group, the most in one task's side, members of a node.
GROUP, BLOCK, FANOUT = 1024, 32_768, 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' XXH64; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "_text"):
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        names = [n for n in part.schema.names if n not in ("_text", "_fp")]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(values)], [*names, "_fp"])


def add_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ``_fp``, the fingerprint as a signed long; a null text counts as empty."""
    rows = df.withColumn("_text", F.col(text)).drop(*({text, "_fp"} - {"_text"}))
    schema = T.StructType([f for f in rows.schema if f.name != "_text"]).add("_fp", "long")
    return rows.mapInArrow(_fingerprints, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Levels of nodes over codes in Gray order; level 0 is the codes themselves."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(codes))
        self.fanout = fanout
        everything = np.full(len(codes), ~np.uint64(0))
        self.patterns, self.masks = [codes[self.order]], [everything]
        while len(self.patterns[-1]) > fanout:
            pattern, mask = self.patterns[-1], self.masks[-1]
            cuts = np.arange(0, len(pattern), fanout)
            first = np.repeat(pattern[cuts], np.diff(np.append(cuts, len(pattern))))
            shared = np.bitwise_and.reduceat(mask, cuts) & ~np.bitwise_or.reduceat(pattern ^ first, cuts)
            self.masks[-1] = mask & ~np.repeat(shared, np.diff(np.append(cuts, len(pattern))))
            self.patterns.append(pattern[cuts] & shared)
            self.masks.append(shared)

    def search(self, queries: np.ndarray, k: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, code) as positions, within k bits, in pieces of bounded size."""
        step = max(1, most // max(1, len(self.patterns[-1])) // 4)
        for begin in range(0, len(queries), step):
            q = np.arange(begin, min(begin + step, len(queries)))
            top = np.arange(len(self.patterns[-1]))
            yield from self._descend(queries, np.repeat(q, len(top)), np.tile(top, len(q)), None, len(self.patterns) - 1, k, most)

    def _descend(self, queries, q, node, seen, level, k, most):
        if len(q) > most:
            half = len(q) // 2
            for cut in (slice(0, half), slice(half, None)):
                yield from self._descend(queries, q[cut], node[cut], None if seen is None else seen[cut], level, k, most)
            return
        differs = np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.masks[level][node]).astype(np.int16)
        if seen is not None:
            differs += seen
        near = np.flatnonzero(differs <= k)
        q, node, differs = q[near], node[near], differs[near]
        if level == 0:
            if len(q):
                yield q, self.order[node]
            return
        size = len(self.patterns[level - 1])
        for begin in range(0, len(q), max(1, most // self.fanout)):
            cut = slice(begin, begin + max(1, most // self.fanout))
            child = (node[cut][:, None] * self.fanout + np.arange(self.fanout)).ravel()
            inside = child < size
            yield from self._descend(
                queries, np.repeat(q[cut], self.fanout)[inside], child[inside], np.repeat(differs[cut], self.fanout)[inside], level - 1, k, most
            )


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a and b; every entry of the result is its set's smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def majority(codes: np.ndarray) -> np.uint64:
    """The code of the bits that over half of the codes have set."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(codes)).view(">u8").astype(np.uint64)[0]


def join_dense(codes: np.ndarray, k: int, parent: np.ndarray | None = None) -> np.ndarray:
    """Sets, beyond those known, of what lies within k bits of the member next to all members' majority code.

    A crowd of near copies becomes one set in linear time.
    """
    pivot = np.bitwise_count(codes ^ majority(codes)).argmin()
    near = np.flatnonzero(np.bitwise_count(codes ^ codes[pivot]) <= k)
    return _union(np.arange(len(codes)) if parent is None else parent, np.full(len(near), pivot), near)


def outside_largest(parent: np.ndarray) -> np.ndarray:
    """Members of all sets but the largest: every pair that is still apart has one of them."""
    return np.flatnonzero(parent != np.bincount(parent).argmax())


def _link_group(k: int):
    """applyInArrow function: links (a, b) that join what lies within k bits in a group, as stars."""

    def run(table: pa.Table) -> pa.Table:
        # A star's centre is its smallest code, so that groups agree on most links of a crowd.
        table = table.sort_by("_fp")
        codes = table.column("_fp").to_numpy().view(np.uint64)
        side = table.column("_side").to_numpy()
        parent = join_dense(codes, k)
        asking = outside_largest(parent)
        if side.any():
            # Of two blocks: whoever asks looks among the members of the other one.
            for own in (0, 1):
                indexed, mine = np.flatnonzero(side != own), asking[side[asking] == own]
                if len(mine) and len(indexed):
                    for q, c in GrayIndex(codes[indexed]).search(codes[mine], k):
                        parent = _union(parent, mine[q], indexed[c])
        elif len(asking):
            for q, c in GrayIndex(codes).search(codes[asking], k):
                parent = _union(parent, asking[q], c)
        child = np.flatnonzero(parent != np.arange(len(codes)))
        values = codes.view(np.int64)
        return pa.table({"a": pa.array(values[child]), "b": pa.array(values[parent[child]])})

    return run


def _band_keys(code: Column, k: int, agree: int, bits: int) -> Column:
    """Array of group keys: for each choice of ``agree`` of k+agree bands, its number and leading bits."""
    n = k + agree
    edges = [round(i * BITS / n) for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), agree)):
        key: Column = F.lit(number).cast("long")
        left = bits
        for band in chosen:
            width = edges[band + 1] - edges[band]
            take = min(width, left)
            left -= take
            if take:
                value = F.shiftrightunsigned(code, BITS - edges[band] - take).bitwiseAND(F.lit((1 << take) - 1).cast("long"))
                key = F.shiftleft(key, take).bitwiseOR(value)
        keys.append(key)
    return F.array(*keys) if bits else F.array(F.lit(0).cast("long"))


def link_fingerprints(codes: DataFrame, k: int = DIFFERENCES, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct ``_fp`` within k bits; enough of them to connect all such.

    Group keys take as many bits as bring groups to about ``group`` members, so the work
    stays in proportion to the input; beyond one band's width two agreeing bands of k+2 are
    used.  A group of more than ``block`` members is cut into blocks by hash, and every pair
    of blocks is a task; what a block pair has already joined is not compared again.
    """
    count = codes.count()
    bits = max(0, math.ceil(math.log2(max(1, count) / group)))
    agree = 1 if bits <= BITS // (k + 1) else 2
    bits = min(bits, agree * (BITS // (k + agree)))
    dealt = codes.select("_fp", F.explode(_band_keys(F.col("_fp"), k, agree, bits)).alias("_key"))
    return in_blocks(dealt, block).groupBy("_key", "_low", "_high").applyInArrow(_link_group(k), "a long, b long")


def in_blocks(dealt: DataFrame, block: int, member: str = "_fp") -> DataFrame:
    """Adds _low, _high and _side: groups of ``_key`` in blocks by hash of ``member``, in every pair of which a row stands.

    A group of at most ``block`` rows is one pair; rows of a pair's higher block are on side 1.
    """
    hot = dealt.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    blocks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    dealt = dealt.join(hot, "_key", "left").withColumn("_blocks", blocks)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = dealt.withColumns(
        {"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}
    )
    return placed.drop("_n", "_blocks", "_own", "_other")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node that it reaches.

    Large and small stars in turn (Kiveris et al., 2014); the links are written to the
    checkpoint folder after each round, and the rounds end when nothing changes.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def stars(both: DataFrame, keep: str) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").filter(keep)

    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stars(both, "b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = stars(large, "true")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        links = checkpointed(small.filter("a <> b").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@carries_columns("order", "text")
def near_duplicate_groups(df: DataFrame, order: str, text: str = "text", k: int = DIFFERENCES) -> DataFrame:
    """``df`` without ``text``, with ``_fp``, ``component_id`` and ``_group``.

    ``component_id`` is the smallest ``order`` value that a row reaches.  ``_group`` tells
    groups apart even where values of ``order`` repeat.

    Rows with equal fingerprints belong together, those without words too (fingerprint 0).
    A null in ``order`` is never the smallest unless a group has nothing else.
    """
    df = df.drop(*({"component_id", "_fp", "_group"} - {order, text}))
    rows = checkpointed(add_fingerprints(df, text))
    codes = checkpointed(rows.groupBy("_fp").agg(F.min(order).alias("_least")))
    roots = connected_components(link_fingerprints(codes.select("_fp"), k)).withColumnRenamed("node", "_fp")
    rooted = codes.join(roots, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    # Written out, so that the join below has no aggregate in its stage and a large group's side can be split.
    least = checkpointed(rooted.groupBy("root").agg(F.min("_least").alias("component_id")))
    named = rooted.join(least, "root").select("_fp", "component_id", F.col("root").alias("_group"))
    return rows.join(named, "_fp")


def with_row_keys(df: DataFrame) -> DataFrame:
    """Adds __row and __also, hashes of the whole row (96 bits); maps are hashed as JSON."""
    whole = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in df.columns]
    return df.withColumns({"__row": F.xxhash64(*whole), "__also": F.hash(*whole)})


def first_of_groups(keyed: DataFrame, grouped: DataFrame, group: str, order: str) -> DataFrame:
    """The row of ``keyed`` with the smallest ``order``, then row keys, of each group; exact repeats give one row.

    ``grouped`` has ``group``, ``order`` and the row keys.  Rows are shuffled once, by their keys.
    """
    best = grouped.groupBy(group).agg(F.min(F.struct(F.col(order).isNull(), F.col(order), "__row", "__also")).alias("_best"))
    best = best.select(F.col("_best.__row").alias("__row"), F.col("_best.__also").alias("__also"))
    return keyed.join(best, ["__row", "__also"], "left_semi").dropDuplicates(["__row", "__also"]).drop("__row", "__also")


@carries_columns("order", "text")
def drop_near_duplicates(df: DataFrame, order: str = "doc_id", text: str = "text", k: int = DIFFERENCES) -> DataFrame:
    """One row of each group: the one with the smallest ``order``, then row hash; exact repeats give one row."""
    keyed = with_row_keys(df)
    rows = keyed.select(F.col(order).alias("_order"), "__row", "__also", F.col(text).alias("_body"))
    grouped = near_duplicate_groups(rows, "_order", "_body", k)
    return first_of_groups(keyed, grouped, "_group", "_order").select(*df.columns)


def simhash_digest(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null texts, and others without words, have fingerprint zero and are linked like any
    other; texts are read whole; repeated rows each give a row, an empty table gives none.
    """
    grouped = near_duplicate_groups(df.select("doc_id", "text"), "doc_id")
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
