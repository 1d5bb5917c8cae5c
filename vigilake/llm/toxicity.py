"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - score), with one weight by feature shared by all
thresholds.  Features are a document's words and their first four to seven bytes, so that
forms of one stem count together.  Labels say toxic or not; toxic training documents are graded by how many
features they hold that are far more frequent in toxic ones.  Weights are fitted with an L1
penalty, so that ordinary words get none and long clean documents gather no score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import carries_columns, crc_mod, text_slices
from vigilake.llm.decontamination import words

#: Labelled documents of each class that training sees at most (about), and grades above 0.
SAMPLE, GRADES = 1000, 3
#: Distinct words whose features a task remembers.
HELD = 400_000


#: Lengths in bytes of the prefixes of a word that are features of their own.
PREFIXES = (4, 5, 6, 7)


def features_of(word: bytes) -> list[bytes]:
    """The word, and its shorter prefixes behind a mark that no word has."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


def count_features(text: bytes) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for word, n in Counter(words(text)).items():
        for f in features_of(word):
            found[f] += n
    return found


@dataclass
class OrdinalModel:
    """Weights by feature, and ascending thresholds between the grades."""

    weights: dict[bytes, float]
    thresholds: np.ndarray

    def score(self, counts: Counter[bytes]) -> float:
        return sum(self.weights[w] * np.log1p(n) for w, n in counts.items())

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probabilities of grades 0.., [rows, grades]."""
        at_most = 1 / (1 + np.exp(-np.clip(self.thresholds[None] - scores[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), at_most, np.ones((len(scores), 1))], 1), axis=1)


def marked_words(documents: list[tuple[Counter, int]], least: int = 3, odds: float = 3.0) -> set[bytes]:
    """Words in at least ``least`` toxic documents whose smoothed log odds of being in a toxic one reach ``odds``."""
    held: list[Counter] = [Counter(), Counter()]
    for counts, toxic in documents:
        held[toxic].update(counts.keys())
    n = [sum(1 for _, t in documents if t == c) for c in (0, 1)]
    return {
        w
        for w, k in held[1].items()
        if k >= least and np.log((k + 0.5) / (n[1] + 1)) - np.log((held[0][w] + 0.5) / (n[0] + 1)) >= odds
    }


def severity_grades(documents: list[tuple[Counter, int]], grades: int = GRADES) -> list[int]:
    """0 for a clean document; 1.. for a toxic one by its marked words, cut at even shares of them."""
    marked = marked_words(documents)
    hits = [sum(n for w, n in counts.items() if w in marked) for counts, _ in documents]
    toxic = np.sort([h for h, (_, t) in zip(hits, documents, strict=True) if t])
    cuts = [toxic[len(toxic) * k // grades] for k in range(1, grades)] if len(toxic) else []
    return [1 + sum(h > c for c in cuts) if t else 0 for h, (_, t) in zip(hits, documents, strict=True)]


def fit_ordinal(documents: list[tuple[Counter, int]], grades: list[int], least: int = 3, penalty: float = 6e-3, refit: float = 4e-4) -> OrdinalModel:
    """Features by the full penalty, then their weights by a lighter one."""
    chosen = _fit(documents, grades, least, penalty)
    if not chosen.weights:
        return chosen
    return _fit([(Counter({f: n for f, n in c.items() if f in chosen.weights}), t) for c, t in documents], grades, least, refit)


def _fit(documents: list[tuple[Counter, int]], grades: list[int], least: int, penalty: float, rounds: int = 400) -> OrdinalModel:
    """Accelerated proximal gradient on the cumulative-link likelihood over features in at least ``least`` documents.

    The classes of the sample count by their numbers.  No documents: a model that gives grade 0.
    """
    held = Counter(w for counts, _ in documents for w in counts)
    vocabulary = sorted(w for w, n in held.items() if n >= least)
    n_cuts = max([GRADES, *grades])
    if not documents or max(grades) == 0:
        return OrdinalModel({}, np.full(n_cuts, 10.0) + np.arange(n_cuts))
    number = {w: i for i, w in enumerate(vocabulary)}
    rows, columns, values = [], [], []
    for i, (counts, _) in enumerate(documents):
        for w, n in counts.items():
            if w in number:
                rows.append(i)
                columns.append(number[w])
                values.append(np.log1p(n))
    rows, columns, values = np.array(rows, np.int64), np.array(columns, np.int64), np.array(values)
    y = np.array(grades)
    weight = np.zeros(len(vocabulary))
    cuts = np.arange(n_cuts, dtype=np.float64)
    ahead, ahead_cuts, pace = weight, cuts, 1.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    bound = np.bincount(rows, values**2, len(y)).mean() + n_cuts
    rate = 4.0 / bound
    # The least distance between neighbouring thresholds, added up.
    apart = 1e-3 * np.arange(n_cuts)
    for _ in range(rounds):
        score = np.bincount(rows, ahead[columns] * values, len(y))
        edges = np.concatenate([[-np.inf], ahead_cuts, [np.inf]])
        upper, lower = sigmoid(edges[y + 1] - score), sigmoid(edges[y] - score)
        mass = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        error = (up - down) / len(y)
        slope = np.bincount(columns, error[rows] * values, len(weight))
        slope_cuts = np.bincount(y, down, n_cuts + 1)[1:] / len(y) - np.bincount(y, up, n_cuts + 1)[:-1] / len(y)
        new = ahead - rate * slope
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_cuts = np.maximum.accumulate(ahead_cuts - rate * slope_cuts - apart) + apart
        turn = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / turn * (new - weight)
        ahead_cuts = new_cuts + (pace - 1) / turn * (new_cuts - cuts)
        ahead_cuts = np.maximum.accumulate(ahead_cuts)
        weight, cuts, pace = new, new_cuts, turn
    return OrdinalModel({w: float(x) for w, x in zip(vocabulary, weight, strict=True) if x}, cuts)


def draw_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int = SAMPLE) -> list[tuple[Counter, int]]:
    """(word counts, toxic) of about ``sample`` labelled documents of each class, drawn by hash of the key.

    A key labelled both ways counts as toxic; labels without a document, and null ones, are
    left out.  Of rows that share a key one text is read, the one of smallest hash, so that
    a key which many rows have brings no more to the driver than any other.
    """
    sided = labels.filter("toxic IS NOT NULL").groupBy(key).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    rates = sided.groupBy("_toxic").agg((F.lit(float(sample)) / F.count("*")).alias("_rate"))
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chosen = sided.join(F.broadcast(rates), "_toxic").filter(chance < F.col("_rate")).select(key, "_toxic")
    drawn = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key)
    drawn = drawn.groupBy(key).agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_one"), F.first("_toxic").alias("_toxic"))
    drawn = drawn.select(key, F.col("_one._text").alias("_text"), "_toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text"):
            counted = [count_features(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "order": part.column(part.schema.get_field_index("_order")),
                    "toxic": part.column(part.schema.get_field_index("_toxic")),
                    "words": pa.array([list(c.keys()) for c in counted], pa.list_(pa.binary())),
                    "counts": pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
                }
            )

    table = drawn.withColumn("_order", F.xxhash64(key)).mapInArrow(count, "order long, toxic int, words array<binary>, counts array<long>").toArrow()
    found, shared = [], {}
    for batch in table.to_batches(max_chunksize=64):
        for row in batch.to_pylist():
            # The same feature in many documents is kept once.
            found.append((row["order"], row["toxic"], Counter({shared.setdefault(w, w): n for w, n in zip(row["words"], row["counts"], strict=True)})))
    found.sort(key=lambda r: (r[0], r[1], len(r[2])))
    return [(counts, toxic) for _, toxic, counts in found]


def _grade(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, held = model.weights, {}
        for part, texts in text_slices(batches, "_text"):
            if len(held) > HELD:
                held = {}
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                own: Counter[bytes] = Counter()
                for word in words(text):
                    known = held.get(word)
                    if known is None:
                        known = held[word] = tuple(f for f in features_of(word) if f in weights)
                    if known:
                        own.update(known)
                scores[i] = model.score(own)
            p = model.grades(scores)
            out = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != "_text"}
            out["expected_severity"] = pa.array(p @ np.arange(p.shape[1]))
            out["severity"] = pa.array(p.argmax(1).astype(np.int32))
            out["toxic_probability"] = pa.array(1 - p[:, 0])
            yield pa.RecordBatch.from_pydict(out)

    return run


@carries_columns("text")
def grade_toxicity(df: DataFrame, model: OrdinalModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` without ``text``, with expected_severity, severity (likeliest grade), toxic_probability and toxic.

    A null text counts as empty and has the grade of no features.  Texts are graded whole,
    repeated rows each give a row, an empty table gives none.  Columns of the result's names
    are replaced.
    """
    results = ("expected_severity", "severity", "toxic_probability", "toxic", "_text")
    rows = df.select(*[c for c in df.columns if c not in (*results, text)], F.col(text).alias("_text"))
    schema = T.StructType([f for f in rows.schema if f.name != "_text"])
    schema = schema.add("expected_severity", "double").add("severity", "integer").add("toxic_probability", "double")
    shared = df.sparkSession.sparkContext.broadcast(model)
    graded = rows.mapInArrow(_grade(shared), schema)
    return graded.withColumn("toxic", F.col("toxic_probability") >= least)


def toxicity_digest(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades of every row, from a model of labelled documents whose crc32(doc_id) mod 4 is not 2.

    Null texts are empty; without labels nothing is toxic.  Texts are graded whole, repeated
    rows each give a row; of equally likely grades the lowest is told; an empty table gives
    none; columns beside doc_id and text are not read.
    """
    held_out = (crc_mod("doc_id", 4) == 2).alias("held_out")
    drawn = draw_labelled(df, labels.filter(crc_mod("doc_id", 4) != 2), "doc_id", "text")
    model = fit_ordinal(drawn, severity_grades(drawn))
    return grade_toxicity(df.select("doc_id", held_out, "text"), model)
