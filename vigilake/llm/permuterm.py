"""Spelling variants by permuterm rotations.

A word of L code points with a terminator has L+1 rotations.  The rotation that ends just
before a code point c is a prefix that skips c: every word that differs there only, and the
word that lacks c, has the same prefix, the latter as a whole rotation.  Sorted by that
prefix, near words are thus one group, of at most one word for each letter and one more.
In a run of equal letters only the last one is skipped for insertions and deletions, so
that two words meet once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import checkpointed, text_slices

LEAST_LENGTH, LEAST_COUNT, NOISE = 5, 3, 97
#: Ends a word in its rotations; no letter.
END = "$"
#: Rotations of longer words are hashed; by these two bases and this prime.
SPELT, _BASES, _PRIME = 64, (1_000_003, 998_244_353), (1 << 61) - 1
#: Kinds of rotations; the last two add up to a sum that no other two kinds have.
_SKIPS, _ENDS_RUN, _WHOLE = 0, 1, 3
_RUN = re.compile("[a-zÀ-ÿ]+")


def _count_runs(least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            total: Counter[str] = Counter()
            for doc, text in zip(ids, texts, strict=True):
                begun = zlib.crc32(b"%b:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(_RUN.findall(text.lower().decode())).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % NOISE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return run


def count_words(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters (A-Z lower-cased, Latin-1 letters as they are) of whole texts.

    Every 97th run, by crc32 of document and run, loses a code point.  A null text has no
    words, a null ``doc_id`` counts as empty text.
    """
    found = df.select(F.col("doc_id"), F.col("text")).mapInArrow(_count_runs(least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _rotation_keys(word: str) -> tuple[list[str], list[str]]:
    """For every letter the rotation behind it without that letter, and all whole rotations."""
    size, ring = len(word), word + END + word
    if size <= SPELT:
        return [ring[i + 1 : i + 1 + size] for i in range(size)], [ring[i : i + size + 1] for i in range(size + 1)]
    hashes = []
    for base in _BASES:
        summed, power = [0], [1]
        for c in map(ord, ring):
            summed.append((summed[-1] * base + c) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        hashes.append((summed, power))
    key = lambda a, b: END + " ".join(str((h[b] - h[a] * w[b - a]) % _PRIME) for h, w in hashes) + f" {b - a}"
    return [key(i + 1, i + 1 + size) for i in range(size)], [key(i, i + size + 1) for i in range(size + 1)]


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows (key, kind, id): a letter is skipped, so is the last of its run of equal letters, none is."""
    for batch in batches:
        keys, kinds, ids = [], [], []
        for word, number in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), strict=True):
            skipping, whole = _rotation_keys(word)
            keys += skipping
            kinds += [_ENDS_RUN if i + 1 == len(word) or word[i] != word[i + 1] else _SKIPS for i in range(len(word))]
            keys += whole
            kinds += [_WHOLE] * len(whole)
            ids += [number] * (len(skipping) + len(whole))
            if len(keys) > 1 << 16:
                yield _rotation_rows(keys, kinds, ids)
                keys, kinds, ids = [], [], []
        yield _rotation_rows(keys, kinds, ids)


def _rotation_rows(keys: list[str], kinds: list[int], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(ids, pa.int64())], ["key", "kind", "id"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, near): how many of ``words`` (distinct word, id) are one edit away, and the smallest id of those.

    Words without near ones are absent.  Rotations of words over SPELT code points are
    compared by two 61-bit hashes, which take time in proportion to the word.
    """
    rotated = words.select("word", "id").mapInArrow(_rotations, "key string, kind int, id long")
    # A group holds a word for each letter of the alphabet at most, and the one without that letter.
    groups = rotated.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "kind"))).alias("found")).filter(F.size("found") > 1)

    def near(own, x):
        both_skip = (own["kind"] != _WHOLE) & (x["kind"] != _WHOLE)
        return (x["id"] != own["id"]) & (both_skip | (own["kind"] + x["kind"] == _ENDS_RUN + _WHOLE))

    each = groups.select(F.explode(F.transform("found", lambda own: F.struct(own["id"].alias("id"), F.filter("found", lambda x: near(own, x))["id"].alias("near")))).alias("x"))
    each = each.select("x.id", F.size("x.near").cast("long").alias("n_near"), F.get("x.near", F.lit(0)).alias("near")).filter("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def variant_groups(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = 2) -> DataFrame:
    """Every word with its form and root: word, form, root, n, n_near, form_n.

    The form is the most frequent near word, if it is ``times`` as frequent (2 or more); ties
    go to the smallest in code-point order.  The root is where forms lead: counts at least
    double along the way, so that pointer jumping ends after some six rounds.  An empty
    table gives no rows; repeated rows count each; words of any length take part.
    """
    # Sorted by count and word, so that the smallest id is the best near word.
    words = checkpointed(count_words(df, least_length, least_count).orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()))
    far = words.join(near_words(words), "id", "left")
    other = words.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    taken = F.col("near_n") >= times * F.col("n")
    formed = checkpointed(
        far.join(other, "near", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(taken, F.col(c)).alias(d) for c, d in (("near", "up"), ("near_word", "form"), ("near_n", "form_n")))
        )
    )
    rooted = formed.filter("up IS NOT NULL").select("id", F.col("up").alias("root"))
    going = True
    while going:
        further = rooted.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(rooted.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        going = not jumped.filter("moved").isEmpty()
        rooted = jumped.select("id", "root")
    named = rooted.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
