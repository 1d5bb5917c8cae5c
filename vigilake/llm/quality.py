"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0).  Expectation-maximisation over the
counts of vote patterns estimates the share of good documents and, by rule, how often it
votes good on good ones and on bad ones; nothing but the votes is used.  A document's
posterior probability of being good decides, so that a rule which often errs is outvoted,
instead of every rule having to pass.  Features, votes and posterior are DataFrame
expressions; EM runs on at most 3**rules pattern counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import WHITESPACE, carries_columns, checkpointed, with_held_column

_SPACE = "[\\x20\\x09-\\x0D]+"


def _trim(x: str) -> Column:
    return F.trim(F.col(x), F.lit(WHITESPACE)) if isinstance(x, str) else F.trim(x, F.lit(WHITESPACE))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds f_* counts of each whole text; null is an empty text.

    Windows of three words are compared by their xxhash64.  Repeated ones are found by
    sorting (hash, place) inside the document, and only where the hashes have duplicates.
    Columns named ``f_*`` or ``_q_*`` are dropped.
    """
    df = df.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    trimmed = _trim("_q_text")
    df = df.withColumn("_q_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))
    df = df.withColumn(
        "_q_hash",
        F.when(
            F.size("_q_words") >= 3,
            F.expr("transform(sequence(0, size(_q_words) - 3), i -> xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2]))"),
        ),
    )
    df = df.withColumn("_q_lines", F.filter(F.split("_q_text", "\n", -1), lambda x: _trim(x) != ""))
    df = df.select(
        *[c for c in df.columns if not c.startswith(("_q_", "f_"))],
        F.size("_q_words").cast("long").alias("f_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("f_word_chars"),
        F.size(F.array_distinct("_q_words")).cast("long").alias("f_distinct_words"),
        (F.length("_q_text") - F.length(F.regexp_replace("_q_text", "[#*$%&|<>]+", ""))).cast("long").alias("f_symbols"),
        (F.length("_q_text") - F.length(F.regexp_replace("_q_text", "[A-Z]+", ""))).cast("long").alias("f_capitals"),
        (F.length("_q_text") - F.length(F.regexp_replace("_q_text", "\\p{L}+", ""))).cast("long").alias("f_letters"),
        F.regexp_count("_q_text", F.lit("[#*$%&|<>][^\\x20\\x09-\\x0D]*")).cast("long").alias("f_symbol_words"),
        F.size("_q_lines").cast("long").alias("f_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("f_dup_lines"),
        F.when(
            F.size("_q_hash") > F.size(F.array_distinct("_q_hash")),
            F.sort_array(F.expr("transform(_q_hash, (h, i) -> struct(h, i))")),
        ).alias("_q_sorted"),
    )
    df = df.withColumn(
        "_q_places",
        F.expr(
            """sort_array(transform(
                 filter(sequence(0, size(_q_sorted) - 1),
                        k -> (k > 0 AND _q_sorted[k].h = _q_sorted[k - 1].h)
                          OR (k + 1 < size(_q_sorted) AND _q_sorted[k].h = _q_sorted[k + 1].h)),
                 k -> _q_sorted[k].i))"""
        ),
    )
    covered = F.expr(
        """aggregate(sequence(0, size(_q_places) - 1), 0L,
             (n, k) -> n + if(k + 1 < size(_q_places), least(3, _q_places[k + 1] - _q_places[k]), 3))"""
    )
    repeated = F.when(F.col("_q_places").isNull(), F.lit(0)).otherwise(covered)
    return df.withColumn("f_repeat_words", repeated.cast("long")).drop("_q_sorted", "_q_places")


@dataclass(frozen=True)
class Rule:
    """Votes by two bounds on a number: bad beyond ``bad``, good up to ``good``, else abstains."""

    name: str
    value: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN f_words = 0 THEN -1 WHEN {self.value} {self.bad} THEN -1 WHEN {self.value} {self.good} THEN 1 ELSE 0 END")


#: Bounds are tight, so that rules err on some good documents; each kind of junk has several rules.
RULES = (
    Rule("length", "f_words", ">= 100", "< 50"),
    Rule("word_length", "abs(f_word_chars / f_words - 5.2)", "<= 1.0", "> 1.8"),
    Rule("symbols", "f_symbols / f_words", "<= 0.02", "> 0.1"),
    Rule("symbol_words", "f_symbol_words / f_words", "<= 0.02", "> 0.1"),
    Rule("letters", "f_letters / f_word_chars", ">= 0.93", "< 0.8"),
    Rule("dup_lines", "f_dup_lines / greatest(f_lines, 1)", "<= 0.1", "> 0.3"),
    Rule("repeats", "f_repeat_words / f_words", "<= 0.02", "> 0.1"),
    Rule("capitals", "f_capitals / f_word_chars", "<= 0.04", "> 0.06"),
    Rule("variety", "f_distinct_words / f_words", ">= 0.6", "< 0.4"),
)


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents, and P(a rule that votes votes good) on good and on bad ones."""

    share: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability of being good, in log space."""
        odds: Column = F.lit(math.log(1 - self.share) - math.log(self.share))
        for vote, g, b in zip(votes, self.good, self.bad, strict=True):
            odds = odds + F.when(vote > 0, math.log(b) - math.log(g)).when(vote < 0, math.log(1 - b) - math.log(1 - g)).otherwise(0.0)
        return 1 / (1 + F.exp(odds))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, close: float = 1e-7) -> LabelModel:
    """EM over (votes, count) until the share settles.  No pattern: the starting values.

    Starts from mostly good documents, on which rules vote good nine times in ten, and bad
    ones, on which they are in doubt; that tells the classes apart.  Estimates are smoothed
    by one vote either way and have no other bounds.  Rules count as independent given the
    class.
    """
    share, rates = 0.8, [[0.9] * n_rules, [0.5] * n_rules]
    votes = np.array([v for v, _ in sorted(patterns)], np.int8).reshape(-1, n_rules)
    counts = np.array([n for _, n in sorted(patterns)], np.float64)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    for _ in range(rounds if patterns else 0):
        logs = [math.log(s) + up @ np.log(r) + down @ np.log1p(-np.array(r)) for s, r in zip((share, 1 - share), rates, strict=True)]
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
        before = share
        share = float((counts @ good + 1) / (counts.sum() + 2))
        rates = [((w @ up + 1) / (w @ (up + down) + 2)).tolist() for w in (counts * good, counts * (1 - good))]
        if abs(share - before) < close:
            break
    return LabelModel(share, tuple(rates[0]), tuple(rates[1]))


def fit_to(features: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of all rows of a table of features; at most 3**rules counts reach the driver."""
    votes = [r.vote().alias(f"v{i}") for i, r in enumerate(rules)]
    rows = features.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    return fit_label_model([(tuple(r[:-1]), r["n"]) for r in rows], len(rules))


def judge(features: DataFrame, model: LabelModel, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Adds ``quality`` (posterior of good), ``base_failed`` and the verdict ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words inside repeated windows
    of three; such documents are not kept whatever the posterior.
    """
    failed = (F.col("f_words") < 50) | (100 * F.col("f_repeat_words") > 50 * F.col("f_words"))
    judged = features.withColumn("quality", model.posterior([r.vote() for r in rules])).withColumn("base_failed", failed)
    return with_held_column(judged, "kept", ~F.col("base_failed") & (F.col("quality") >= least))


@carries_columns("text")
def rate_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """``df`` without ``text``, with features, posterior and verdict.

    Features are written to the checkpoint folder once, as EM and the verdict both need
    them; leave wide columns out.
    """
    features = checkpointed(text_features(df, text).drop(text))
    return judge(features, fit_to(features, rules), rules, least)


@carries_columns("text")
def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` that are kept, whole.

    Texts are read once for EM and once for the verdict, so that they are neither shuffled
    nor written.  Rows with null or empty texts go; repeated rows each stay or go alike; an
    empty table gives none.  All columns stay, whatever their names.
    """
    model = fit_to(text_features(df.select(text), text), rules)
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_body"))
    return judge(text_features(rows, "_body"), model, rules, least).filter("kept").select("_row.*")


def quality_digest(df: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior ``quality`` of every row.

    A null text is an empty one: no words, base_failed, not kept.  Texts are read whole,
    repeated rows each give a row, an empty table gives none; other columns are not read.
    """
    return rate_quality(df.select("doc_id", "text")).select(
        "doc_id",
        F.col("f_words").alias("n_words"),
        F.col("f_word_chars").alias("word_chars"),
        F.col("f_symbols").alias("n_symbols"),
        F.col("f_dup_lines").alias("n_dup_lines"),
        F.col("f_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
        "quality",
    )
