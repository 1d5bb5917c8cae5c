"""Phrase collocations from a weighted de Bruijn graph of words.

Every word occurrence opens one gram: the five words from it on, or fewer where its piece
ends.  Grams of five words are edges from the node of their first four words to that of
their last four; shorter ones are the piece-end corrections.  How often a node occurs is
what flows out of it plus its corrections, and so on down to single words and, at last, to
the number of words.  Edges over nodes with a single way in and out are compacted into
paths, from which the five-word phrases are read.

A phrase is no more frequent than any run of words in it.  Two passes over the texts
therefore count runs of two and of three words by hash in a fixed number of counters (as
Park, Chen and Yu did for item sets, 1995); a gram ends before a run whose counter stays
below the least count, since no frequent phrase has it.  The counts of all frequent phrases
stay exact: a shorter gram is its own correction.  With saturated counters nothing is cut,
and only the work grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import checkpointed, text_slices

LONGEST, LEAST, BEST = 5, 100, 2000
#: Runs of so many words are counted by hash first; log2 of the counters of each, a bit of which goes out to all tasks (2 MB).
COUNTED, COUNTER_BITS = (2, 3), 24
#: Parts that a language's rows are dealt into where a join or a ranking goes by language.
SALTS = 64
UNKNOWN = "und"
_STOPS = re.compile(rb"[.,;:!?\n-\r]+")
#: Words whose grams are added up before they are given out, so that rows follow the words of the input; Spark adds on before it shuffles.
PART = 1 << 16
#: Most words read at once, so that three local numbers fit into 63 bits.
SPAN = 1 << 19
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Numbers of the words of one language within a slice; 0 is the end of a piece."""

    def __init__(self, lang: bytes, seen: list[tuple[bytes, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.seen = lang, seen

    def __missing__(self, word: bytes) -> int:
        self.seen.append((self.lang, word))
        self[word] = number = len(self.seen) - 1
        return number


def _numbered(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[list[tuple[bytes, bytes]], np.ndarray, int]]:
    """(lang, word) by number, the numbers of a slice's texts, 0 between pieces, and how many of them are to be counted.

    What follows the counted numbers of a very long text is read again with the next part.
    """
    for part, texts in text_slices(batches):
        langs = [(x or UNKNOWN).encode() for x in part.column(part.schema.get_field_index("lang")).to_pylist()]
        held: list[tuple[bytes, list[bytes]]] = []
        size = 0
        for lang, text in zip(langs, texts, strict=True):
            words = _STOPS.sub(b" . ", text.lower()).split()
            if size + len(words) > span and held:
                yield from _spans(held, span)
                held, size = [], 0
            held.append((lang, words))
            size += len(words) + 1
        if held:
            yield from _spans(held, span)


def _spans(held: list[tuple[bytes, list[bytes]]], span: int) -> Iterator[tuple[list[tuple[bytes, bytes]], np.ndarray, int]]:
    if len(held) > 1 or len(held[0][1]) <= span:
        seen, tables, numbers = [(b"", b".")], {}, []
        for lang, words in held:
            table = tables.get(lang) or tables.setdefault(lang, _Words(lang, seen))
            numbers += map(table.__getitem__, words)
            numbers.append(0)
        yield seen, np.array(numbers, np.int64), len(numbers)
        return
    (lang, words), = held
    for begin in range(0, len(words), span):
        seen = [(b"", b".")]
        numbers = np.fromiter(map(_Words(lang, seen).__getitem__, words[begin : begin + span + LONGEST - 1]), np.int64)
        yield seen, np.append(numbers, 0), min(span, len(words) - begin)


def _hashes(seen: list[tuple[bytes, bytes]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(b"%b %b" % key) for key in seen), np.uint64, len(seen))


def _word_counter(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _run_counter(hashes: np.ndarray, numbers: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Counters of the m words from each place on."""
    mixed = hashes[numbers[at]]
    for step in range(1, m):
        mixed = mixed * _MIX2 ^ mixed >> np.uint64(31) ^ hashes[numbers[at + step]]
    return ((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _next(flags: np.ndarray) -> np.ndarray:
    """For every place the first one from it on whose flag is down; the last flag must be."""
    down = np.flatnonzero(~flags)
    return down[np.searchsorted(down, np.arange(len(flags)))]


def _lengths(numbers: np.ndarray, hashes: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """How many words from each place on may be a frequent phrase, by the counters of runs of 2, 3, .. words; up to LONGEST."""
    longest = _next(numbers > 0) - np.arange(len(numbers))
    for m, known in enumerate(bits, 2):
        flags = np.zeros(len(numbers), bool)
        at = np.flatnonzero(longest >= m)
        flags[at] = _has(known, _run_counter(hashes, numbers, at, m))
        longest = np.minimum(longest, _next(flags) - np.arange(len(numbers)) + m - 1)
    return np.minimum(longest, LONGEST)


def _count_hashed(bits: list[np.ndarray], span: int):
    """mapInArrow function: (counter, n) of the runs one word longer than those that ``bits`` tell of; at first, of words too."""
    m = len(bits) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, numbers, counted in _numbered(batches, span):
            hashes = _hashes(seen)
            at = np.flatnonzero(_lengths(numbers, hashes, bits)[:counted] >= m)
            counters, n = np.unique(_run_counter(hashes, numbers, at, m), return_counts=True)
            if not bits:
                counters = np.concatenate([counters, _word_counter(hashes[1:])])
                n = np.concatenate([n, np.bincount(numbers[:counted], minlength=len(seen))[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(counters), pa.array(n.astype(np.int64))], ["counter", "n"])

    return run


def frequent_bits(texts: DataFrame, least: int, bits: list[np.ndarray], span: int = SPAN) -> np.ndarray:
    """One bit for each counter, as bytes: have the runs of that hash ``least`` occurrences together?

    Runs have one word more than those that ``bits`` tell of, the first ones two; words count in their table too.
    """
    sums = texts.mapInArrow(_count_hashed(bits, span), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # Positions start at 1, so that a map of 32,768 bits begins at a whole byte.
    place = F.col("counter") + 1
    maps = sums.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = np.zeros(1 << (COUNTER_BITS - 3), np.uint8)
    # At most 2^COUNTER_BITS bits come to the driver, whatever the input.
    for part, held in maps.toLocalIterator():
        found[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, np.uint8)
    return found


def _has(bits: np.ndarray, counter: np.ndarray) -> np.ndarray:
    return (bits[counter >> 3] >> (counter & 7).astype(np.uint8) & 1).astype(bool)


def _grams(bits: list[np.ndarray], span: int):
    """mapInArrow function: (lang, m, gram, n), the grams that words open, added up over PART words; m = 0 counts the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, numbers, counted in _numbered(batches, span):
            hashes = _hashes(seen)
            length = _lengths(numbers, hashes, bits)[:counted]
            length[(length == 1) & ~_has(bits[0], _word_counter(hashes))[numbers[:counted]]] = 0
            langs, words = (pa.array([key[i] for key in seen], pa.binary()).cast(pa.string()) for i in (0, 1))
            own = langs.dictionary_encode()
            each = np.bincount(np.asarray(own.indices)[numbers[:counted][numbers[:counted] > 0]])
            spoken = np.flatnonzero(each)
            yield _gram_rows(own.dictionary.take(pa.array(spoken)), 0, pa.repeat("", len(spoken)), each[spoken])
            _, pair = np.unique(numbers[:-1] << 32 | numbers[1:], return_inverse=True)
            for begin in range(0, counted, PART):
                for m in range(1, LONGEST + 1):
                    start = np.flatnonzero(length[begin : begin + PART] == m) + begin
                    if not len(start):
                        continue
                    key = numbers[start] if m % 2 else pair[start]
                    for step in range(m % 2, m - 1, 2) if m % 2 else range(2, m, 2):
                        key = key << 21 | pair[start + step]
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    at = start[first]
                    parts = [words.take(pa.array(numbers[at + k])) for k in range(m)]
                    yield _gram_rows(langs.take(pa.array(numbers[at])), m, pc.binary_join_element_wise(*parts, " "), n)

    return run


def _gram_rows(langs: pa.Array, m: int, grams: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.repeat(pa.scalar(m, pa.int32()), len(n)), grams, pa.array(n.astype(np.int64))], ["lang", "m", "gram", "n"])


def _first(gram: str, k: Column | int) -> Column:
    return F.call_function("substring_index", F.col(gram), F.lit(" "), k if isinstance(k, Column) else F.lit(k))


def _rest(gram: str, k: Column | int) -> Column:
    """The gram without its first k words."""
    return F.substring(F.col(gram), F.length(_first(gram, k)) + 2, F.length(gram))


def phrase_counts(df: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", span: int = SPAN) -> DataFrame:
    """(lang, m, gram, n) of every phrase of one to five words with ``least`` occurrences, and all words' number as m = 0.

    Texts are lower-cased (A-Z), cut at stops and line ends into pieces and at blanks and
    tabs into words; a null text is empty, a null language ``und``.  Repeated rows count
    each; an empty table gives no rows; texts of any length are read whole.
    """
    texts = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    bits: list[np.ndarray] = []
    for _ in COUNTED:
        bits.append(frequent_bits(texts, least, bits, span))
    grams = texts.mapInArrow(_grams(bits, span), "lang string, m int, gram string, n long")
    grams = checkpointed(grams.groupBy("lang", "m", "gram").agg(F.sum("n").alias("n")))
    level = grams.filter(F.col("m") == LONGEST).select("lang", "gram", "n")
    counts = level.withColumn("m", F.lit(LONGEST))
    for m in range(LONGEST - 1, 0, -1):
        # What flows out of a node, and what ends in it.
        flow = level.select("lang", _first("gram", m).alias("gram"), "n").unionByName(grams.filter(F.col("m") == m).select("lang", "gram", "n"))
        level = flow.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(level.withColumn("m", F.lit(m)))
    counts = counts.filter(F.col("n") >= least).unionByName(grams.filter("m = 0"))
    return checkpointed(counts.select("lang", "m", "gram", "n"))


def repeated_passages(counts: DataFrame) -> DataFrame:
    """(lang, words, n): edges of the graph, compacted over nodes with a single way in and out.

    A node has one way in if the edge into it occurs as often as the node, and one way out
    likewise, so a path's inner nodes never begin or end a piece, branch or repeat.  Edges
    find their path's first edge by pointer jumping; a path is no longer than a text.
    """
    edges, nodes = counts.filter(F.col("m") == LONGEST), counts.filter(F.col("m") == LONGEST - 1)
    edges = edges.select("lang", F.col("gram").alias("edge"), "n", _first("gram", LONGEST - 1).alias("tail"), _rest("gram", 1).alias("head"))
    node = lambda name, n: nodes.select("lang", F.col("gram").alias(name), F.col("n").alias(n))
    edges = checkpointed(edges.join(node("tail", "tail_n"), ["lang", "tail"]).join(node("head", "head_n"), ["lang", "head"]))
    into = edges.filter("n = head_n").select("lang", F.col("head").alias("tail"), F.col("edge").alias("before"))
    ways = edges.join(into, ["lang", "tail"], "left").withColumn("before", F.when(F.col("n") == F.col("tail_n"), F.col("before")))
    chain = checkpointed(ways.select("lang", "edge", "n", F.coalesce("before", "edge").alias("first"), F.col("before").isNotNull().cast("long").alias("place")))
    moved = chain.filter("place > 0").count()
    while moved:
        far = chain.filter("place > 0").select("lang", F.col("edge").alias("first"), F.col("first").alias("before"), F.col("place").alias("more"))
        joined = chain.join(far, ["lang", "first"], "left")
        chain = checkpointed(
            joined.select("lang", "edge", "n", F.coalesce("before", "first").alias("first"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("more").isNotNull().alias("moved"))
        )
        moved = chain.filter("moved").count()
        chain = chain.drop("moved")
    last = F.call_function("substring_index", F.col("edge"), F.lit(" "), F.lit(-1))
    paths = chain.groupBy("lang", "first").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", last.alias("word")))).alias("steps"))
    return paths.select("lang", F.concat(F.slice(F.split("first", " "), 1, LONGEST - 1), F.col("steps.word")).alias("words"), "n")


#: floor(1000 * a * n / (l * r)) in whole decimals of 38 digits.
SCORE = "CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))"


def collocations(df: DataFrame, least: int = LEAST, best: int = BEST, text: str = "text", lang: str = "lang", span: int = SPAN) -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score.

    Scores are exact while a * n stays below 10^35.  A phrase is dropped if a longer one that
    holds it occurs as often; since counts only fall with length, one more word tells.
    Ties go to the more frequent phrase, then by bytes.  Ranking takes each language's rows
    in parts first, so that no task ranks a whole language.
    """
    counts = phrase_counts(df, least, text, lang, span)
    paths = repeated_passages(counts)
    places = F.sequence(F.lit(1), F.size("words") - (LONGEST - 1))
    edges = paths.select("lang", "n", "words", F.explode(places).alias("i")).select("lang", F.lit(LONGEST).alias("m"), F.array_join(F.slice("words", F.col("i"), LONGEST), " ").alias("gram"), "n")
    phrases = counts.filter((F.col("m") > 0) & (F.col("m") < LONGEST)).unionByName(edges)
    within = F.array(_first("gram", F.col("m") - 1), _rest("gram", 1))
    longer = phrases.filter("m > 2").select("lang", F.explode(within).alias("gram"), "n").groupBy("lang", "gram").agg(F.max("n").alias("_most"))
    kept = phrases.filter("m > 1").join(longer, ["lang", "gram"], "left").filter("_most IS NULL OR _most < n")
    cuts = kept.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"_left": _first("phrase", F.col("k")), "_right": _rest("phrase", F.col("k")), "_salt": F.pmod(F.xxhash64("phrase"), F.lit(SALTS))})
    known = counts.filter("m > 0")
    cuts = cuts.join(known.select("lang", F.col("gram").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
    cuts = cuts.join(known.select("lang", F.col("gram").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
    totals = counts.filter("m = 0").select("lang", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    cuts = cuts.join(totals, ["lang", "_salt"])
    lowest = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "_salt").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    scored = lowest.select("lang", "phrase", "_salt", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = scored.withColumn("rank", rank("lang", "_salt")).filter(F.col("rank") <= best).drop("_salt")
    ranked = parts.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
