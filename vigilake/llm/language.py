"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text (A-Z in lower case) run by run between white space, in
both directions, and labels every byte; a document's probabilities are the mean over all
labelled bytes.  The state starts anew at white space.  A run longer than a piece is read in
overlapping pieces: each is read with the bytes around it, which are labelled by their own
pieces.  Runs repeat, so a task labels each distinct one once.  The network is trained in
numpy, by backpropagation through time, on runs (long ones in all their pieces) drawn from a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from vigilake.llm.common import WHITESPACE, carries_columns, crc_mod, text_slices

#: Labelled documents and words drawn from them by language: the bound of what training sees.
DOCUMENTS, WORDS = 300, 4000
#: Languages with all their WORDS, and whose sampling rates go out to every task; more share that many words.
LANGUAGES = 1000
#: Bytes of a piece, and bytes read (not labelled) on either side of it; characters of a training piece.
PIECE, MARGIN, DRAWN = 48, 12, 16
HIDDEN, EPOCHS, BATCH = 16, 8, 256
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Parameters by name; directions f and b: input rows x, recurrent u, bias c; output v, o."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            w[f"c{d}"] = np.zeros(3 * hidden)
        w["v"] = rng.normal(0, 1 / np.sqrt(hidden), (2 * hidden, len(languages)))
        w["o"] = np.zeros(len(languages))
        return cls(languages, {k: x.astype(np.float32) for k, x in w.items()})

    def _direction(self, data: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States [time, rows, hidden]; a masked step hands the state on."""
        x, u, c = (self.weights[k + d] for k in "xuc")
        n = u.shape[0]
        state = np.zeros((data.shape[0], n), np.float32)
        states = np.zeros((data.shape[1], data.shape[0], n), np.float32)
        order = range(data.shape[1]) if d == "f" else range(data.shape[1] - 1, -1, -1)
        for t in order:
            a = x[data[:, t]] + c
            r = state @ u
            z = 1 / (1 + np.exp(-(a[:, :n] + r[:, :n])))
            g = 1 / (1 + np.exp(-(a[:, n : 2 * n] + r[:, n : 2 * n])))
            new = np.tanh(a[:, 2 * n :] + g * r[:, 2 * n :])
            m = mask[:, t, None]
            before = state
            state = np.where(m, (1 - z) * before + z * new, before)
            states[t] = state
            if keep is not None:
                keep.append((t, before, z, g, new, r[:, 2 * n :], m))
        return states

    def label(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities [rows, time, languages] of every byte."""
        both = np.concatenate([self._direction(data, mask, d) for d in "fb"], 2)
        logits = both @ self.weights["v"] + self.weights["o"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        return (p / p.sum(2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradients by backpropagation through time."""
        steps: dict[str, list] = {"f": [], "b": []}
        states = {d: self._direction(data, mask, d, steps[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], 2)
        logits = both @ self.weights["v"] + self.weights["o"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        there = mask.T[:, :, None] / max(1, mask.sum())
        rows = np.arange(len(target))
        loss = float(-(np.log(np.maximum(p[:, rows, target], 1e-12)) * there[:, :, 0]).sum())
        p[:, rows, target] -= 1
        error = (p * there).astype(np.float32)
        out = {k: np.zeros_like(x) for k, x in self.weights.items()}
        out["v"] = np.einsum("trh,trl->hl", both, error)
        out["o"] = error.sum((0, 1))
        into = error @ self.weights["v"].T
        n = both.shape[2] // 2
        for i, d in enumerate("fb"):
            u = self.weights[f"u{d}"]
            carried = np.zeros((len(target), n), np.float32)
            for t, before, z, g, new, r, m in reversed(steps[d]):
                total = carried + into[t][:, i * n : (i + 1) * n]
                moved = np.where(m, total, 0)
                d_new = moved * z * (1 - new * new)
                d_z = moved * (new - before) * z * (1 - z)
                d_g = d_new * r * g * (1 - g)
                gates = np.concatenate([d_z, d_g, d_new], 1)
                inner = np.concatenate([d_z, d_g, d_new * g], 1)
                np.add.at(out[f"x{d}"], data[:, t], gates)
                out[f"c{d}"] += gates.sum(0)
                out[f"u{d}"] += before.T @ inner
                carried = np.where(m, moved * (1 - z), total) + inner @ u.T
        return loss, out

    def word_sums(self, words: list[bytes], rows: int = 4096) -> np.ndarray:
        """Sums over each word's bytes of their probabilities, [words, languages]."""
        pieces, owner, inner = [], [], []
        for i, w in enumerate(words):
            if len(w) <= PIECE:
                pieces.append(w)
                owner.append(i)
                inner.append((0, len(w)))
                continue
            for k in range(0, len(w), PIECE):
                begin = max(0, k - MARGIN)
                pieces.append(w[begin : k + PIECE + MARGIN])
                owner.append(i)
                inner.append((k - begin, min(k + PIECE, len(w)) - begin))
        owner, inner = np.array(owner), np.array(inner).reshape(-1, 2)
        order = np.argsort([len(p) for p in pieces], kind="stable")
        sums = np.zeros((len(words), len(self.languages)), np.float32)
        for begin in range(0, len(order), rows):
            chosen = order[begin : begin + rows]
            data, mask = padded([pieces[i] for i in chosen])
            place = np.arange(data.shape[1])
            counted = (place >= inner[chosen, 0, None]) & (place < inner[chosen, 1, None])
            np.add.at(sums, owner[chosen], (self.label(data, mask) * counted[:, :, None]).sum(1))
        return sums


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, words))
    data = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(len(words), most)
    return data, np.arange(most) < np.fromiter(map(len, words), np.int64, len(words))[:, None]


def train(examples: list[tuple[bytes, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Adam on batches of words of like length; the same examples give the same network."""
    languages = sorted({lang for _, lang in examples})
    network = ByteNetwork.start(languages, hidden, seed)
    number = {lang: i for i, lang in enumerate(languages)}
    examples = sorted((w, number[lang]) for w, lang in examples)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(x) for k, x in network.weights.items()}
    second = {k: np.zeros_like(x) for k, x in network.weights.items()}
    step, total = 0, epochs * (-(-len(examples) // batch))
    for _ in range(epochs):
        order = sorted(rng.permutation(len(examples)).tolist(), key=lambda i: len(examples[i][0]))
        cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in rng.permutation(len(cuts)):
            chosen = [examples[i] for i in cuts[k]]
            data, mask = padded([w for w, _ in chosen])
            _, gradient = network.gradients(data, mask, np.array([n for _, n in chosen]))
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for name, g in gradient.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                network.weights[name] -= (pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network


def draw_words(labelled: DataFrame, text: str, lang: str, key: str, documents: int = DOCUMENTS, words: int = WORDS) -> list[tuple[bytes, str]]:
    """(word, language): up to ``words`` distinct words by language, frequent ones more likely, from about ``documents`` texts each.

    Documents are drawn by hash of ``key`` and text with each language's rate, so that no more
    than the sample is cut into words; a word of over PIECE bytes gives all its pieces of DRAWN
    characters.  Beyond LANGUAGES languages each has fewer words, so that their number in all,
    which comes to the driver, is bounded.
    """
    rates = labelled.groupBy(lang).agg((F.lit(float(documents)) / F.count("*")).alias("_rate"))
    many = rates.count()
    words = max(1, min(words, LANGUAGES * words // max(many, 1)))
    # Few rates go out to the tasks; many are joined.
    rates = F.broadcast(rates) if many <= LANGUAGES else rates
    chance = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(rates, lang).filter(chance < F.col("_rate"))
    lowered = F.translate(F.trim(F.col(text), F.lit(WHITESPACE)), ascii_uppercase, ascii_lowercase)
    runs = sample.select(F.col(lang).alias("lang"), F.explode(F.split(lowered, "[\\x20\\x09-\\x0D]+")).alias("run"))
    pieces = F.when(F.octet_length("run") <= PIECE, F.array("run")).otherwise(F.regexp_extract_all("run", F.lit(f"(?s).{{1,{DRAWN}}}"), F.lit(0)))
    counted = runs.select("lang", F.explode(pieces).alias("word")).filter("word rlike '\\\\p{L}'").groupBy("lang", "word").agg(F.count("*").alias("n"))
    even = (F.pmod(F.xxhash64("word", F.lit(11)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(-F.ln(even) / F.col("n"), "word"))
    rows = counted.withColumn("place", place).filter(F.col("place") <= words).select("word", "lang").collect()
    return [(r["word"].encode(), r["lang"]) for r in rows]


def _identify(shared, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        known: dict[bytes, int] = {}
        sums = np.zeros((0, len(network.languages)), np.float32)
        names = np.array([*network.languages, UNKNOWN], dtype=object)
        for part, texts in text_slices(batches, "_text"):
            cut = [t.lower().split() for t in texts]
            if len(known) * len(network.languages) > held:
                known, sums = {}, sums[:0]
            new = list({w for words in cut for w in words} - known.keys())
            if new:
                known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
                sums = np.concatenate([sums, network.word_sums(new)])
            readable = part.column(part.schema.get_field_index("_letter")).to_pylist()
            best, score = [], []
            for words, letter in zip(cut, readable, strict=True):
                if not letter or not words:
                    best.append(len(network.languages))
                    score.append(0.0)
                    continue
                pooled = sums[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
                pooled /= pooled.sum()
                best.append(int(pooled.argmax()))
                score.append(min(1.0, float(pooled.max())))
            out = {n: part.column(i) for i, n in enumerate(part.schema.names) if n not in ("_text", "_letter")}
            out |= {"lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_pydict(out)

    return run


@carries_columns("text")
def identify_languages(df: DataFrame, network: ByteNetwork | None, text: str = "text", held: int = 1_600_000) -> DataFrame:
    """``df`` without ``text``, with lang_pred and score (mean probability of it over all bytes, 0 to 1).

    ``und`` with score 0: null texts, texts without a letter, and any text if there is no
    network.  Of equal probabilities the first language in order wins.  Texts are read whole,
    repeated rows each give a row, an empty table gives none.  Columns of the result's names
    are replaced.
    """
    rows = df.select(*[c for c in df.columns if c not in ("lang_pred", "score", "_text", "_letter", text)], F.col(text).alias("_text"))
    rows = rows.withColumn("_letter", F.coalesce(F.col("_text").rlike("\\p{L}"), F.lit(False)))
    if network is None:
        return rows.drop("_text", "_letter").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    schema = T.StructType([f for f in rows.schema if f.name not in ("_text", "_letter")]).add("lang_pred", "string").add("score", "double")
    shared = df.sparkSession.sparkContext.broadcast(network)
    return rows.mapInArrow(_identify(shared, held), schema)


def language_digest(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; ``und`` for null texts and texts without a letter.

    Learns from labelled rows that are not held out; without any, every text is ``und``.
    """
    rows = df.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text", "lang")
    examples = draw_words(rows.filter("NOT held_out AND lang IS NOT NULL"), "text", "lang", "doc_id")
    network = train(examples) if examples else None
    return identify_languages(rows.drop("lang"), network).select("doc_id", "held_out", "lang_pred", "score")
