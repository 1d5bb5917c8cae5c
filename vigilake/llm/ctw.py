"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each has a context tree over the five bytes before it.
Every node holds a Krichevsky-Trofimov estimate of its counts; a node's weighted
probability is the even mixture of its own estimate and the product of its children's.
Counts come from all training rows, and every counted context is a node.  The posterior
weights mix the estimates of all depths into log10 P(byte | context).

Codes (context and byte) are a Spark table.  Nodes of three bytes and more are weighed in
tasks that hold whole subtrees, shorter ones by a groupBy for each depth; the estimates are
then mixed from the root on.  Frequent codes go out to every task, the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import checkpointed, crc_mod, text_slices

#: Bytes of context.
DEPTH = 5
#: Words held by a task before it passes its counts on, and words and codes that go out to every task at most.
HELD_WORDS, TOP_WORDS, TOP_CODES = 500_000, 1 << 17, 1 << 20
#: Bytes of context whose subtrees stay in one task; codes that a task weighs at once (more only for one subtree).
LOWER, CHUNK = 3, 1 << 18
#: Bytes of text that a task works on at once.
SLICE = 1 << 20
_PAD = b"\n"
_WORD, _BYTE, _END = 0, 1, 2


def _padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text after ``depth`` line feeds, and which of them are the texts'."""
    pad = _PAD * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    own = np.ones(len(data), bool)
    begin = 0
    for t in texts:
        own[begin : begin + depth] = False
        begin += depth + len(t)
    return data, own


def context_codes(texts: list[bytes]) -> np.ndarray:
    """context << 8 | byte for every byte of every text, in order; the nearest byte leads the context."""
    data, own = _padded(texts, DEPTH)
    code = np.zeros(len(data), np.int64)
    for back in range(1, DEPTH + 1):
        code <<= 8
        code[back:] |= data[:-back]
    return ((code << 8) | data)[own]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def _count(held: int, only_codes: bool = False):
    """mapInArrow function: (kind, key, n) of words, of byte contexts and of ends, summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def batch(kind: int, n: int, counts, keys=None, codes=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, kind, np.int32)),
                    pa.nulls(n, pa.binary()) if keys is None else pa.array(keys, pa.binary()),
                    pa.nulls(n, pa.int64()) if codes is None else pa.array(codes),
                    pa.array(counts, pa.int64()),
                ],
                ["kind", "key", "code", "n"],
            )

        for _, texts in text_slices(batches, "_text", SLICE):
            ends += 0 if only_codes else len(texts)
            for text in [] if only_codes else texts:
                words.update(text.lower().split())
                if len(words) > held:
                    yield batch(_WORD, len(words), list(words.values()), keys=list(words.keys()))
                    words.clear()
            found = np.sort(context_codes(texts))
            cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
            codes.append((found[cuts], np.diff(np.append(cuts, len(found)))))
            if len(codes) > 8:
                codes = [_summed(*(np.concatenate(x) for x in zip(*codes, strict=True)))]
                if len(codes[0][0]) > 4 * held:
                    yield batch(_BYTE, len(codes[0][0]), codes[0][1], codes=codes[0][0])
                    codes = []
        if words:
            yield batch(_WORD, len(words), list(words.values()), keys=list(words.keys()))
        if codes:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*codes, strict=True)))
            yield batch(_BYTE, len(keys), counts, codes=keys)
        if ends:
            yield batch(_END, 1, [ends])

    return run


def corpus_counts(df: DataFrame, text: str = "text", held: int = HELD_WORDS) -> DataFrame:
    """(kind, key, code, n) over all rows: 0 lower-cased words, 1 codes of context and byte, 2 ends of texts."""
    rows = df.select(F.col(text).alias("_text")).mapInArrow(_count(held), "kind int, key binary, code long, n long")
    return rows.groupBy("kind", "key", "code").agg(F.sum("n").alias("n"))


#: ln Gamma(n + 1/2) and ln Gamma(n + 1) of small n.
_SMALL = 4096
_HALVES = np.cumsum(np.r_[0.5 * np.log(np.pi), np.log(np.arange(_SMALL - 1) + 0.5)])
_WHOLES = np.cumsum(np.r_[0.0, np.log(np.arange(_SMALL - 1) + 1.0)])


def _log_gamma(n: np.ndarray, table: np.ndarray, offset: float) -> np.ndarray:
    """ln Gamma(n + offset) of counts, from the table or, beyond it, by Stirling's series."""
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.nonzero(n >= _SMALL)
    x = n[large] + offset
    out[large] = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def kt_log_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, _HALVES, 0.5) + _log_gamma(ones, _HALVES, 0.5) - np.log(np.pi) - _log_gamma(zeros + ones, _WHOLES, 1.0)


def _zero(counts: np.ndarray) -> np.ndarray:
    """KT estimate of the next decision being 0."""
    return (counts[..., 0] + 0.5) / (counts.sum(-1) + 1)


def _text_sums(logs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    return sums[ends] - sums[ends - sizes]


def least_power(spread: list[tuple[int, int]], most: int) -> int:
    """From (power of two, how many have at least that and less than the next): the lowest power that ``most`` allows."""
    power, reached = 63, 0
    for p, n in sorted(spread, reverse=True):
        if reached + n > most:
            break
        power, reached = p, reached + n
    return power


@dataclass
class Decisions:
    """Decisions of one bit level at one depth, by key: context << level | bits so far."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    #: Place of each code's decision.
    place: np.ndarray
    weighted: np.ndarray | None = None
    weight: np.ndarray | None = None


def _decisions(codes: np.ndarray, counts: np.ndarray, level: int) -> Decisions:
    keys = codes >> (8 - level)
    first = np.r_[True, keys[1:] != keys[:-1]]
    place = np.cumsum(first) - 1
    both = np.bincount(place, counts)
    ones = np.bincount(place, counts * (codes >> (7 - level) & 1))
    return Decisions(keys[first], both - ones, ones, place)


def _above(keys: np.ndarray, level: int) -> np.ndarray:
    """Keys of the same decisions, one byte of context less."""
    return keys >> (level + 8) << level | keys & ((1 << level) - 1)


def _weighted(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the weight of a node's own estimate, from the product of its children's (as ln)."""
    own = kt_log_probability(zeros, ones)
    weighted = np.logaddexp(own, children) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def weigh_codes(codes: np.ndarray, counts: np.ndarray) -> list[list[Decisions]]:
    """By bit level, deepest contexts first down to ``LOWER`` bytes: weighed decisions of sorted whole subtrees."""
    by_depth = [(codes, counts)]
    for _ in range(DEPTH - LOWER):
        codes, counts = by_depth[-1]
        by_depth.append(_summed(codes >> 16 << 8 | codes & 255, counts))
    out = []
    for level in range(8):
        depths = [_decisions(c, n, level) for c, n in by_depth]
        depths[0].weighted = kt_log_probability(depths[0].zeros, depths[0].ones)
        depths[0].weight = np.ones(len(depths[0].keys))
        for below, at in pairwise(depths):
            children = np.bincount(np.searchsorted(at.keys, _above(below.keys, level)), below.weighted, len(at.keys))
            at.weighted, at.weight = _weighted(at.zeros, at.ones, children)
        out.append(depths)
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(code, n, m) in pieces of about ``CHUNK`` sorted codes that hold whole subtrees."""
    shift = 8 * (DEPTH - LOWER + 1)
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        part = tuple(batch.column(i).to_numpy() for i in range(3))
        held.append(part)
        size += len(part[0])
        if size < CHUNK:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        cut = np.searchsorted(rows[0], rows[0][-1] >> shift << shift)
        if cut:
            yield tuple(x[:cut] for x in rows)
        held = [tuple(x[cut:] for x in rows)]
        size = len(held[0][0])
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: decisions of contexts of ``LOWER`` bytes."""
    for codes, n, _ in _subtrees(batches):
        for level, depths in enumerate(weigh_codes(codes, n)):
            top = depths[-1]
            decision = (top.keys & ((1 << level) - 1) | 1 << level).astype(np.int32)
            columns = (top.keys >> level, decision, top.zeros, top.ones, top.weighted)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["context", "decision", "zeros", "ones", "weighted"])


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: weighs decisions that come with their children's product."""
    for batch in batches:
        context, decision, zeros, ones, children = batch.columns
        weighted, weight = _weighted(zeros.to_numpy(), ones.to_numpy(), children.to_numpy())
        columns = [context, decision, zeros, ones, pa.array(weighted), pa.array(weight)]
        yield pa.RecordBatch.from_arrays(columns, ["context", "decision", "zeros", "ones", "weighted", "weight"])


def _mixed_above(tables: list[pa.Table]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bit level: keys of contexts just under ``LOWER`` bytes, P(0) mixed so far and the share left; tables from the root on."""
    out = []
    columns = [{c: t.column(c).to_numpy() for c in t.column_names} for t in tables]
    for level in range(8):
        mixed, left, known = np.zeros(1), np.ones(1), None
        for t in columns:
            at = np.flatnonzero(t["decision"] >> level == 1)
            keys = t["context"][at] << level | t["decision"][at] & ((1 << level) - 1)
            at, keys = at[order := np.argsort(keys)], keys[order]
            p = np.zeros(len(at), np.int64) if known is None else np.searchsorted(known, _above(keys, level))
            zero = _zero(np.stack([t["zeros"][at], t["ones"][at]], -1))
            mixed, left, known = mixed[p] + left[p] * t["weight"][at] * zero, left[p] * (1 - t["weight"][at]), keys
        out.append((known, mixed, left))
    return out


def _code_logs(above):
    """mapInArrow function: (code, seen, log), seen in training and elsewhere, log10 P(byte | context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n, m in _subtrees(batches):
            logs = np.zeros(len(codes))
            for level, depths in enumerate(weigh_codes(codes, n)):
                keys, mixed, left = above.value[level]
                for d in reversed(depths):
                    p = np.searchsorted(keys, _above(d.keys, level))
                    share = left[p]
                    mixed = mixed[p] + share * d.weight * _zero(np.stack([d.zeros, d.ones], -1))
                    left, keys = share * (1 - d.weight), d.keys
                zero = mixed[depths[0].place]
                logs += np.log10(np.where(codes >> (7 - level) & 1, 1 - zero, zero))
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n + m), pa.array(logs)], ["code", "seen", "log"])

    return run


def fit_codes(counts: DataFrame, others: DataFrame, text: str = "text", held: int = HELD_WORDS) -> DataFrame:
    """(code, seen, log) for all codes of ``corpus_counts`` over whole bytes, and of ``others``, which do not train.

    A context without training counts leaves its share at even odds, so codes that only
    ``others`` have get their exact probability too.  Nodes of two bytes at most, as many as
    the alphabet has pairs, meet on the driver.
    """
    spark = counts.sparkSession
    asked = others.select(F.col(text).alias("_text")).mapInArrow(_count(held, only_codes=True), "kind int, key binary, code long, n long")
    # Added up first: every task has rows of a frequent context.
    asked = asked.groupBy("code").agg(F.sum("n").alias("n"))
    codes = counts.filter(F.col("kind") == _BYTE).select("code", "n", F.lit(0).cast("long").alias("m"))
    codes = codes.union(asked.select("code", F.lit(0).cast("long"), "n"))
    codes = codes.withColumn("_subtree", F.shiftright("code", 8 * (DEPTH - LOWER + 1))).repartition("_subtree")
    codes = codes.groupBy("_subtree", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select("code", "n", "m")
    codes = checkpointed(codes.sortWithinPartitions("code"))
    below = codes.mapInArrow(_lower, "context long, decision int, zeros double, ones double, weighted double")
    tables: list[pa.Table] = []
    for _ in range(LOWER):
        sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]
        grouped = below.groupBy(F.shiftright("context", 8).alias("context"), "decision").agg(*sums)
        below = checkpointed(grouped.mapInArrow(_upper, "context long, decision int, zeros double, ones double, weighted double, weight double"))
        tables.insert(0, below.select("context", "decision", "zeros", "ones", "weight").toArrow())
    above = spark.sparkContext.broadcast(_mixed_above(tables))
    return checkpointed(codes.mapInArrow(_code_logs(above), "code long, seen long, log double"))


class FrequentCodes:
    """Logs of codes by a table of hashes; codes that lost their slot are searched."""

    def __init__(self, codes: np.ndarray, seen: np.ndarray, logs: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.logs = np.append(codes[order], -1), np.append(logs[order], 0.0)
        self.shift = np.uint64(64 - max(1, int(2 * len(codes)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), len(codes), np.int32)
        rising = np.argsort(seen[order], kind="stable")
        self.slots[self._hash(self.codes[rising])] = rising  # The last, most frequent one stays.

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Sum of logs by text over the codes held here; text, code and times of the others."""
        codes = context_codes(texts)
        at = self.slots[self._hash(codes)]
        logs = self.logs[at]
        missed = np.flatnonzero(self.codes[at] != codes)
        lost = np.searchsorted(self.codes[:-1], codes[missed])
        there = self.codes[lost] == codes[missed]
        logs[missed] = np.where(there, self.logs[lost], 0.0)
        missed = missed[~there]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pairs = np.stack([np.searchsorted(np.cumsum(sizes), missed, "right"), codes[missed]], 1)
        pairs, times = np.unique(pairs, axis=0, return_counts=True)
        return _text_sums(logs, sizes), pairs[:, 0], pairs[:, 1], times


def _score(tree, top, unigram):
    """mapInArrow function: a head row by text, and a row by rare word or rare code of it and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, (end, end_known) = tree.value, top.value, unigram
        for part, texts in text_slices(batches, "_text", SLICE):
            ids = part.column(part.schema.get_field_index("_id"))
            scores, code_at, codes, code_times = model.score(texts)
            n_tokens, base, rare_at, rare, times = [], [], [], [], []
            for i, text in enumerate(texts):
                words = text.lower().split()
                values = list(map(common.get, words))
                seldom = Counter(w for w, v in zip(words, values, strict=True) if v is None)
                n_tokens.append((len(words) + 1, len(words) - seldom.total() + end_known))
                base.append(sum(v for v in values if v is not None) + end)
                rare_at += [i] * len(seldom)
                rare += seldom.keys()
                times += seldom.values()
            heads = {n: part.column(k) for k, n in enumerate(part.schema.names) if n != "_text"}
            heads |= {
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array([t for t, _ in n_tokens], pa.int64()),
                "n_known": pa.array([k for _, k in n_tokens], pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(scores),
                # A key of its own, which nothing joins with, so that heads are dealt out evenly.
                "_word": pa.array([b""] * len(texts), pa.binary()),
                "_code": pc.subtract(-2, ids),
                "_times": pa.nulls(len(texts), pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(heads)
            step = 100_000
            # A word goes with code -1, a code with no word.
            for keys, where, n in ((rare, rare_at, times), (codes, code_at, code_times)):
                for begin in range(0, len(keys), step):
                    cut = slice(begin, begin + step)
                    size = len(keys[cut])
                    tail = {k: pa.nulls(size, v.type) for k, v in heads.items()}
                    tail |= {"_id": ids.take(pa.array(where[cut])), "_times": pa.array(n[cut], pa.int64())}
                    tail["_word"] = pa.array(keys[cut] if keys is rare else [b""] * size, pa.binary())
                    tail["_code"] = pa.array(np.full(size, -1) if keys is rare else keys[cut], pa.int64())
                    yield pa.RecordBatch.from_pydict(tail)

    return run


def score_corpus(
    df: DataFrame,
    train: DataFrame,
    text: str = "text",
    top_words: int = TOP_WORDS,
    held: int = HELD_WORDS,
    top_codes: int = TOP_CODES,
    others: DataFrame | None = None,
) -> DataFrame:
    """``df`` without ``text``, with n_bytes, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``score``: the context-tree model's log10 probability; ``bits_per_byte`` its code length
    (null for an empty text).  ``base_score``: unigram words and an end, add-0.1 smoothed.
    Null texts are empty.  Counts cover all of ``train``; with no training rows the model is
    uniform over bytes.  Words seen at least as often as a power of two that at most
    ``top_words`` words reach go out to all tasks; the other words of a text are joined with
    their counts.  Codes of context and byte likewise, by ``top_codes``.  ``others``: the
    rows of ``df`` that are not in ``train``, where known (all of ``df`` otherwise).

    Texts are scored whole; repeated rows each give a row; an empty table gives none.  Other
    columns stay whatever their names; those of the result's names are replaced.  Rows are
    numbered as they are read, so ``df`` has to be read alike twice, as a table is.
    """
    counts = checkpointed(corpus_counts(train, text, held))
    words = counts.filter(F.col("kind") == _WORD)
    spread = words.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    ends = counts.filter(F.col("kind") == _END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = sum(r["n"] for r in spread) + ends, sum(r["words"] for r in spread) + (ends > 0)
    power = least_power([(r["power"], r["words"]) for r in spread], top_words)
    divisor = tokens + 0.1 * (distinct + 1)
    often = words.filter(F.col("n") >= float(2**power)).select("key", "n").toArrow()
    values = np.log10((often.column("n").to_numpy() + 0.1) / divisor).tolist()
    context = df.sparkSession.sparkContext
    top = context.broadcast(dict(zip(often.column("key").to_pylist(), values, strict=True)))
    logs = fit_codes(counts, df if others is None else others, text, held)
    reached = logs.groupBy(F.floor(F.log2("seen")).cast("int").alias("power")).agg(F.count("*").alias("codes")).collect()
    least = float(2 ** least_power([(r["power"], r["codes"]) for r in reached], top_codes))
    held_here = logs.filter(F.col("seen") >= least).toArrow()
    tree = context.broadcast(FrequentCodes(*(held_here.column(c).to_numpy() for c in ("code", "seen", "log"))))
    end = (float(np.log10((ends + 0.1) / divisor)), int(ends > 0))

    results = ("n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    carried = [F.col(f"`{c}`") for c in df.columns if c not in (*results, text)] or [F.lit(True).alias("_none")]
    rows = df.select(F.struct(*carried).alias("_row"), F.monotonically_increasing_id().alias("_id"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_id", T.LongType())])
    kinds = {"n_bytes": "long", "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    for name, kind in (kinds | {"_word": "binary", "_code": "long", "_times": "long"}).items():
        schema = schema.add(name, kind)
    scored = rows.mapInArrow(_score(tree, top, end), schema)
    log = F.log10((F.col("n") + 0.1) / F.lit(divisor))
    seldom = words.filter(F.col("n") < float(2**power)).select(F.col("key").alias("_word"), F.lit(-1).cast("long").alias("_code"), log.alias("_value"))
    rare = logs.filter(F.col("seen") < least).select(F.lit(b"").alias("_word"), F.col("code").alias("_code"), F.col("log").alias("_value"))
    joined = scored.join(seldom.union(rare), ["_word", "_code"], "left")
    a_word, a_code = F.col("_code") == -1, F.col("_code") >= 0
    known, unknown = F.col("_value").isNotNull(), float(np.log10(0.1 / divisor))
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    merged = joined.groupBy("_id").agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + total(a_word & known, F.col("_times"))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.max("base_score") + total(a_word, F.coalesce("_value", F.lit(unknown)) * F.col("_times"))).alias("base_score"),
        (F.max("score") + total(a_code, F.col("_value") * F.col("_times"))).alias("score"),
    )
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes"))
    return merged.select("_row.*", *results[:-1], bits.alias("bits_per_byte")).drop("_none")


def score_digest(df: DataFrame) -> DataFrame:
    """doc_id, held_out, counts, base_score, score and bits_per_byte of every row, learnt from those not held out.

    Null texts are empty: one token, the end.  Texts are scored whole; repeated rows each give
    a row and train as often; nothing is ranked, so there are no ties.  An empty table gives
    no rows; columns beside doc_id and text are not read.
    """
    rows = df.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "text")
    return score_corpus(rows, rows.filter("NOT held_out"), others=rows.filter("held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
