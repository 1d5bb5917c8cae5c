"""Exact top-k by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance from it; annuli of that distance,
cut to a bounded number of vectors, are the index's blocks.  By the triangle inequality a
vector x in an annulus from r to R around p is no nearer to a query q than the gap between
|q - p| and [r, R], and x . q = (|q|^2 + |x|^2 - |q - x|^2) / 2 turns that into a bound on the
score.  A query first searches the annulus that it falls into, then expands to all annuli
whose bound still reaches its k-th score; inside a block it goes on through thinner annuli,
nearest ones first, while their bounds do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import checkpointed

TOP, EVERY, SCALE = 20, 20, 64
#: Pivots are fitted on the SAMPLE distinct vectors of smallest hash; every vector is indexed.
PIVOTS, SAMPLE = 64, 4096
#: Annuli that a pivot's vectors are counted in, and the most vectors of a block.
RINGS, BLOCK = 64, 16_384
#: Vectors compared at once inside a block; parts that the rows of a query vector are dealt into.
STEP, SALTS = 2048, 8
_EXACT, _LONG = float(1 << 53), float(1 << 63)


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) with every component x as floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    big = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * scale)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), big.alias("_big")).filter("_big IS NOT NULL")
    # NaN is greater than any number here.
    return rows.filter(F.forall("_big", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))).select("vec_id", F.transform("_big", lambda x: F.floor(x)).alias("vec"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(vec, ids): each vector once, with its ``most`` smallest ids, null last; no result needs more of equal vectors.

    Equal rows are ranked within parts first, so that a vector which holds a large share of
    all rows is no task's group.
    """
    order = [F.asc_nulls_last("vec_id"), "_part"]
    parts = rows.withColumn("_part", F.spark_partition_id() % 256)
    near = parts.withColumn("_k", F.row_number().over(Window.partitionBy("vec", "_part").orderBy(*order))).filter(F.col("_k") <= most)
    kept = near.withColumn("_k", F.row_number().over(Window.partitionBy("vec").orderBy(*order))).filter(F.col("_k") <= most)
    return kept.groupBy("vec").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of lists as float64; short ones go on with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def fit_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of the ``sample`` distinct vectors of smallest hash, by k-means from spread ones."""
    table = vectors.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(sample).select("vec").toArrow()
    points = matrix(table.column("vec").combine_chunks())
    if not len(points):
        return np.zeros((1, 0))
    centres = points[:: max(1, len(points) // pivots)][:pivots].copy()
    for _ in range(rounds):
        nearest = _distances(points, centres).argmin(1)
        for j in np.unique(nearest):
            centres[j] = points[nearest == j].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    squared = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.sqrt(np.maximum(squared, 0))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as exact longs."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _widened(queries, width), _widened(vectors, width)
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, width)
    if most < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    if most < _LONG:
        return queries.astype(np.int64) @ vectors.T.astype(np.int64)
    raise ValueError("inner products do not fit into a long")


def _bound(q_norm: np.ndarray, x_norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The most that a score can be, from the norms and the least distance; with room for rounding."""
    most = (q_norm**2 + x_norm**2 - gap**2) / 2
    return np.minimum(most, q_norm * x_norm) + 1e-6 * (1 + q_norm**2 + x_norm**2)


def _gap(distance: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.maximum(low - distance, distance - high))


def _keyed(centres: np.ndarray):
    """mapInArrow function: pivot, distance and norm of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                points = matrix(part.column("vec"))
                far = _distances(points, centres)
                pivot = far.argmin(1)
                added = [pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot]), pa.array(np.sqrt((points * points).sum(1)))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "pivot", "distance", "norm"])

    return run


def build_index(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, rings: int = RINGS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray, list]:
    """Vectors with pivot, distance, norm, ring and part; the pivots; and (pivot, ring, low, high, norm, parts) of all annuli.

    A ring of more than ``block`` vectors has several parts, dealt by hash.  The list has
    ``pivots`` x ``rings`` entries at most, whatever the input.
    """
    centres = fit_pivots(vectors, pivots, sample)
    keyed = checkpointed(vectors.mapInArrow(_keyed(centres), "vec array<long>, ids array<long>, pivot int, distance double, norm double"))
    span = keyed.groupBy("pivot").agg(F.min("distance").alias("near"), F.max("distance").alias("far"))
    place = F.floor((F.col("distance") - F.col("near")) / F.greatest(F.col("far") - F.col("near"), F.lit(1e-9)) * rings)
    # One row for each pivot: 64 rows.
    ringed = keyed.join(F.broadcast(span), "pivot").withColumn("ring", F.least(place, F.lit(rings - 1)).cast("int")).drop("near", "far")
    facts = ringed.groupBy("pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("n"))
    # Neighbouring rings are one annulus while they hold no more than a block together.
    running = F.sum("n").over(Window.partitionBy("pivot").orderBy("ring"))
    merged = facts.withColumn("annulus", F.floor((running - F.col("n")) / block).cast("int"))
    bounds = merged.groupBy("pivot", "annulus").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"), F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    known = [tuple(r) for r in bounds.orderBy("pivot", "annulus").collect()]
    names = merged.select("pivot", "ring", "annulus").join(bounds.select("pivot", "annulus", "parts"), ["pivot", "annulus"])
    # At most pivots x rings rows.
    placed = ringed.join(F.broadcast(names), ["pivot", "ring"])
    return placed.withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).drop("ring", "parts"), centres, known


def _visits(centres: np.ndarray, annuli: list, seed: bool, spread: int = 256):
    """mapInArrow function: a row for each block that a query has to search.

    The seed is the part of the annulus with the highest bound that holds the query's own
    hash; afterwards all blocks but that one whose bound reaches the k-th score so far.
    """
    pivot, annulus, low, high, norm, parts = (np.array(c) for c in zip(*annuli, strict=True)) if annuli else (np.zeros(0),) * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, spread):
                part = batch.slice(begin, spread)
                points = matrix(part.column("vec"))
                q_norm = np.sqrt((points * points).sum(1))
                gap = _gap(_distances(points, centres)[:, pivot], low, high)
                most = _bound(q_norm[:, None], norm, gap)
                first = most.argmax(1)
                chosen = part.column("h").to_numpy() % parts[first]
                if seed:
                    rows, blocks, numbers = np.arange(len(points)), first, chosen
                else:
                    least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    rows, blocks = np.nonzero(~(most < least[:, None]))
                    times = parts[blocks]
                    rows, blocks = np.repeat(rows, times), np.repeat(blocks, times)
                    numbers = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                    other = (blocks != first[rows]) | (numbers != chosen[rows])
                    rows, blocks, numbers = rows[other], blocks[other], numbers[other]
                for cut in range(0, len(rows), 1 << 14):
                    at = slice(cut, cut + (1 << 14))
                    taken = part.take(pa.array(rows[at]))
                    added = [pa.array(x[at].astype(np.int32)) for x in (pivot[blocks], annulus[blocks], numbers)]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *added], [*part.schema.names, "pivot", "annulus", "part"])

    return run


def _best(scores: np.ndarray, ids: list[list[int | None]], k: int, least: int | None) -> tuple[list[int], list[int | None]]:
    """The k highest (score, id) of distinct vectors' ids, ties to the smaller id, none below ``least``."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        least = kth if least is None else max(kth, least)
    at = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least)
    found = [(-s, i is None, i) for j, s in zip(at.tolist(), scores[at].tolist(), strict=True) for i in ids[j]]
    found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
    return [-x[0] for x in found[:k]], [x[2] for x in found[:k]]


_FOUND = "q long, scores array<long>, found array<long>"


def _search(centres: np.ndarray, k: int):
    """mapInArrow function over blocks' vectors and, behind them, the queries that visit: each query's best of the block."""

    def answer(q: np.ndarray, q_ids: list[int], least: list[int | None], pivot: int, vectors, distance, norm, ids) -> pa.RecordBatch:
        order = np.argsort(distance, kind="stable")
        cuts = [order[i : i + STEP] for i in range(0, len(order), STEP)]
        far, q_norm = _distances(q, centres[pivot : pivot + 1])[:, 0], np.sqrt((q * q).sum(1))
        low, high, top = (np.array([f(x[c]) for c in cuts]) for f, x in ((np.min, distance), (np.max, distance), (np.max, norm)))
        most = _bound(q_norm[:, None], top, _gap(far[:, None], low, high))
        best: list[tuple[list[int], list[int | None]]] = [([], []) for _ in q_ids]
        need = list(least)
        # Annuli by their bound, the best first, each for all queries that it can still serve.
        turn = np.argsort(-most, 1, kind="stable")
        for t in range(len(cuts)):
            for c in np.unique(turn[:, t]):
                asking = [i for i in np.flatnonzero(turn[:, t] == c).tolist() if need[i] is None or most[i, c] >= need[i]]
                if not asking:
                    continue
                scores = _scores(q[asking], vectors[cuts[c]])
                own = [ids[j] for j in cuts[c].tolist()]
                for i, found in zip(asking, scores, strict=True):
                    s, x = _best(found, own, k, need[i])
                    both = sorted(zip(best[i][0] + s, best[i][1] + x, strict=True), key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:k]
                    best[i] = [p[0] for p in both], [p[1] for p in both]
                    if len(both) == k:
                        need[i] = both[-1][0] if need[i] is None else max(need[i], both[-1][0])
        kept = [i for i, b in enumerate(best) if b[0]]
        arrays = [pa.array([q_ids[i] for i in kept], pa.int64()), *(pa.array([best[i][j] for i in kept], pa.list_(pa.int64())) for j in (0, 1))]
        return pa.RecordBatch.from_arrays(arrays, ["q", "scores", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "annulus", "part", "asks")), strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for begin in range(a, b, 1024):
                    part = batch.slice(begin, min(1024, b - begin))
                    if keys[a][:3] != key:
                        key, held, ready = keys[a][:3], [], None
                    if not keys[a][3]:
                        held.append((matrix(part.column("vec")), part.column("distance").to_numpy(), part.column("norm").to_numpy(), part.column("ids").to_pylist()))
                        continue
                    if ready is None and held:
                        width = max(h[0].shape[1] for h in held)
                        ready = np.concatenate([_widened(h[0], width) for h in held]), *(np.concatenate([h[j] for h in held]) for j in (1, 2)), [i for h in held for i in h[3]]
                    if ready is not None:
                        yield answer(matrix(part.column("vec")), part.column("q").to_pylist(), part.column("least").to_pylist(), key[0], *ready)

    return run


def top_k(df: DataFrame, k: int = TOP, every: int = EVERY, vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest inner products of every query with other rows.

    Queries are the rows whose ``vec_id`` is divisible by ``every``.  Vectors are read as
    integers (``integer_vectors``); of different lengths, the shorter goes on with zeros.
    Ties go to the smaller ``vec_id``, null last; a null is no query.  Rows that repeat an
    id are other rows, but exact repeats of a query row each find the others.  Queries with
    equal vectors are searched once.  An empty table gives no rows; scores beyond a long raise.
    """
    rows = checkpointed(integer_vectors(df, vector, scale))
    vectors = distinct_vectors(rows, k + 1)
    placed, centres, annuli = build_index(vectors, pivots, sample, rings, block)
    asked = rows.filter(F.col("vec_id") % every == 0)
    # xxhash64 only deals queries out; a query is its vector.
    queries = checkpointed(asked.select("vec").distinct().select("vec", F.monotonically_increasing_id().alias("q"), F.pmod(F.xxhash64("vec"), F.lit(1 << 30)).alias("h")))
    blank = lambda t: F.lit(None).cast(t)
    index = placed.select("pivot", "annulus", "part", F.lit(False).alias("asks"), "vec", "ids", "distance", "norm", blank("long").alias("q"), blank("long").alias("least"))

    def visit(wanted: DataFrame, seed: bool) -> DataFrame:
        sent = wanted.mapInArrow(_visits(centres, annuli, seed), "vec array<long>, q long, h long, least long, pivot int, annulus int, part int")
        sent = sent.select("pivot", "annulus", "part", F.lit(True).alias("asks"), "vec", blank("array<long>").alias("ids"), blank("double").alias("distance"), blank("double").alias("norm"), "q", "least")
        met = index.unionByName(sent).repartition("pivot", "annulus", "part").sortWithinPartitions("pivot", "annulus", "part", "asks")
        return met.mapInArrow(_search(centres, k + 1), _FOUND)

    def merged(found: DataFrame) -> DataFrame:
        pairs = found.select("q", F.explode(F.arrays_zip("scores", "found")).alias("p")).select("q", F.col("p.scores").alias("score"), F.col("p.found").alias("vec_id"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)

    first = checkpointed(visit(queries.withColumn("least", blank("long")), True))
    enough = merged(first).filter(F.col("place") == k + 1).select("q", F.col("score").alias("least"))
    rest = visit(queries.join(enough, "q", "left").select("vec", "q", "h", "least"), False)
    hits = F.array_sort(F.collect_list(F.struct("place", "score", "vec_id")))
    best = merged(first.unionByName(rest)).groupBy("q").agg(hits.alias("hits"))
    # Rows of one much repeated query vector are dealt over salts.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    answers = queries.join(best, "q").select("vec", "hits", F.explode(salts).alias("salt"))
    own = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)
    named = asked.select(F.col("vec_id").alias("query_id"), "vec", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = named.join(answers, ["vec", "salt"]).select("query_id", "hits", own.alias("own"))
    itself = F.array_position(F.transform("hits", lambda x: F.coalesce(x["vec_id"] == F.col("query_id"), F.lit(False)) & (x["score"] == F.col("own"))), True)
    others = pairs.withColumn("itself", itself).select("query_id", F.slice(F.filter("hits", lambda x, i: i + 1 != F.col("itself")), 1, k).alias("hits"))
    ranked = others.select("query_id", F.posexplode("hits").alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", "x.score")
