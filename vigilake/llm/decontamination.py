"""Benchmark decontamination with suffix arrays over shards of training words.

Words of a shard (a few MB of documents) become numbers of the benchmark's vocabulary, 0
for any other word and between documents.  The suffix array of a shard holds every place
whose word the benchmark knows; the benchmark suffixes at which a window begins are
binary-searched in it, each distinct window once, which gives all its places.  Places that
follow each other in a document and an item form its verbatim matches, the longest of which
is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import carries_columns, checkpointed, text_slices

WINDOW = 10
#: Pairs of a place and a benchmark suffix that are looked at together.
PAIRS = 1 << 20
#: Bytes of documents in a shard, and of benchmark text that one pass searches for.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20

_WORD_BYTES = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII bytes, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


@dataclass
class Benchmark:
    """Search side: distinct item texts as numbers, one after another with zeros between.

    ``starts`` are the suffixes at which a window begins, sorted by ``window_of``, the number
    of the distinct window, whose suffixes are ``first[w]:first[w + 1]`` and whose words
    ``length[w]``.  ``text_of`` and ``place_of`` tell a suffix's text and its word there, and
    ``owners`` the items of each text.
    """

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    starts: np.ndarray
    text_of: np.ndarray
    place_of: np.ndarray
    first: np.ndarray
    length: np.ndarray
    owners: list[list]

    @classmethod
    def build(cls, items: list[tuple[object, bytes]], window: int = WINDOW) -> Benchmark:
        owners: dict[bytes, list] = {}
        for item, text in items:
            if joined := b" ".join(words(text)):
                owners.setdefault(joined, []).append(item)
        vocabulary: dict[bytes, int] = {}
        tokens, starts, text_of, place_of, length = [], [], [], [], []
        size = 0
        for t, joined in enumerate(owners):
            w = joined.split(b" ")
            tokens.append(np.fromiter((vocabulary.setdefault(x, len(vocabulary) + 1) for x in w), np.int32, len(w)))
            tokens.append(np.zeros(1, np.int32))
            n = max(1, len(w) - window + 1)
            starts.append(size + np.arange(n))
            text_of.append(np.full(n, t))
            place_of.append(np.arange(n))
            length.append(np.full(n, min(window, len(w))))
            size += len(w) + 1
        flat = np.concatenate([*tokens, np.zeros(window + 1, np.int32)])
        starts, text_of, place_of, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, text_of, place_of, length))
        rows = np.where(np.arange(window) < length[:, None], flat[starts[:, None] + np.arange(window)], 0)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        first = np.flatnonzero(new)
        return cls(vocabulary, flat, starts[order], text_of[order], place_of[order], np.append(first, len(order)), length[order][first], list(owners.values()))


def suffix_array(tokens: np.ndarray, vocabulary: int, depth: int = WINDOW) -> np.ndarray:
    """Places of non-zero tokens in the order of their suffixes' first ``depth`` tokens.

    ``tokens`` ends in at least ``depth`` zeros.  Starts from several tokens packed into one
    key, then doubles the sorted depth; only places that still tie are sorted again.
    """
    places = np.flatnonzero(tokens)
    if not len(places):
        return places
    bits = max(1, int(vocabulary).bit_length())
    done = max(1, 62 // bits)
    key = np.zeros(len(places), np.int64)
    for i in range(done):
        key = (key << bits) | tokens[np.minimum(places + i, len(tokens) - 1)]
    order = np.argsort(key)
    key = key[order]
    array = places[order]
    rank = np.zeros(len(tokens), np.int64)
    slots = np.arange(len(array))
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[array[slots]] = first + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        if done >= depth or not len(slots):
            return array
        here = array[slots]
        key = (rank[here] << 32) | rank[np.minimum(here + done, len(tokens) - 1)]
        order = np.argsort(key)
        key = key[order]
        array[slots] = here[order]
        done *= 2


def _bound(tokens: np.ndarray, array: np.ndarray, query: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all queries at once: the first suffix not below (upper: above) each.

    ``query``: rows of tokens; -1 agrees with anything (the rest of a prefix).
    """
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
    reach = np.arange(query.shape[1])
    rows = np.arange(len(query))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        there = tokens[array[np.minimum(middle, len(array) - 1)][:, None] + reach]
        differs = (there != query) & (query >= 0)
        at = differs.argmax(1)
        agrees = ~differs[rows, at]
        below = np.where(agrees, upper, there[rows, at] < query[rows, at])
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def search_shard(tokens: np.ndarray, bench: Benchmark, chunk: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of all occurrences of the benchmark's distinct windows, sorted by place."""
    wide = int(bench.length.max()) if len(bench.length) else 0
    array = suffix_array(tokens, len(bench.vocabulary), wide) if wide else np.zeros(0, np.int64)
    reach = np.arange(wide)
    places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(bench.length) if len(array) else 0, chunk):
        window = np.arange(begin, min(begin + chunk, len(bench.length)))
        query = bench.tokens[bench.starts[bench.first[window]][:, None] + reach]
        query = np.where(reach < bench.length[window][:, None], query, -1)
        low, high = (_bound(tokens, array, query, upper) for upper in (False, True))
        many = high - low
        places.append(array[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())])
        windows.append(np.repeat(window, many))
    place, window = np.concatenate(places), np.concatenate(windows)
    order = np.argsort(place, kind="stable")
    return place[order], window[order]


def longest_matches(place: np.ndarray, window: np.ndarray, document: np.ndarray, bench: Benchmark, pairs: int = PAIRS) -> np.ndarray:
    """Columns document, text, place, word of the text, words: the longest match of each document and text.

    Occurrences of windows that move on by one word in both belong to one match, so its length
    follows from where its last window stands.  Of equal ones the earliest in the document, then in
    the text.  Works document by document, about ``pairs`` pairs of place and suffix at a time.
    """
    many = np.diff(bench.first)[window]
    ends = np.cumsum(many)
    cuts, done = [0], 0
    for at in np.flatnonzero(np.diff(document)) + 1:
        if ends[at - 1] - done >= pairs:
            cuts.append(int(at))
            done = ends[at - 1]
    cuts.append(len(place))
    out = [np.zeros((0, 5), np.int64)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = many[a:b]
        which = np.repeat(np.arange(a, b), n)
        suffix = np.repeat(bench.first[window[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, start, text, size = place[which], bench.starts[suffix], bench.text_of[suffix], bench.length[window[which]]
        order = np.lexsort((start, at - start))
        at, start, text, size, doc = at[order], start[order], text[order], size[order], document[which][order]
        along = np.zeros(len(at), bool)
        along[1:] = (at[1:] - start[1:] == at[:-1] - start[:-1]) & (start[1:] == start[:-1] + 1) & (text[1:] == text[:-1])
        run = np.cumsum(~along) - 1
        last = np.append(np.flatnonzero(~along)[1:], len(at)) - 1
        words_ = start[last[run]] - start + size[last[run]] if len(at) else size
        best = np.lexsort((start, at, -words_, text, doc))
        first = np.ones(len(best), bool)
        first[1:] = (doc[best][1:] != doc[best][:-1]) | (text[best][1:] != text[best][:-1])
        keep = best[first]
        base = start[keep] - bench.place_of[suffix[order[keep]]]
        out.append(np.stack([doc[keep], text[keep], at[keep], start[keep] - base, words_[keep]], 1))
    return np.concatenate(out)


_RESULT = T.ArrayType(T.StructType().add("item", "string").add("doc_word", "long").add("item_word", "long").add("words", "long"))
_ARROW = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


def _search(bench: Benchmark, shard_bytes: int):
    """mapInArrow function: ``_text`` becomes _n_words, _covered (flags by word; null for no hit) and _matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bench.vocabulary.get
        for part, texts in text_slices(batches, "_text", shard_bytes):
            numbers, counts = [], []
            for text in texts:
                w = words(text)
                counts.append(len(w))
                numbers.append(np.fromiter(map(known, w, repeat(0)), np.int32, len(w)))
                numbers.append(np.zeros(1, np.int32))
            tokens = np.concatenate([*numbers, np.zeros(WINDOW + 1 + int(bench.length.max(initial=0)), np.int32)])
            begins = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
            place, window = search_shard(tokens, bench)
            flags = np.zeros(len(tokens) + 1, np.int32)
            np.add.at(flags, place, 1)
            np.add.at(flags, place + bench.length[window], -1)
            flags = (np.cumsum(flags) > 0).astype(np.uint8)
            document = np.searchsorted(begins, place, "right") - 1
            found: dict[int, list[dict]] = {}
            for d, t, at, word, n in longest_matches(place, window, document, bench).tolist():
                for item in bench.owners[t]:
                    found.setdefault(d, []).append({"item": str(item), "doc_word": at - int(begins[d]), "item_word": word, "words": n})
            out = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != "_text"}
            out["_n_words"] = pa.array(counts, pa.int64())
            out["_covered"] = pa.array([flags[b : b + n].tobytes() if i in found else None for i, (b, n) in enumerate(zip(begins, counts, strict=False))], pa.binary())
            out["_matches"] = pa.array([found.get(i) for i in range(len(texts))], _ARROW)
            yield pa.RecordBatch.from_pydict(out)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """applyInArrow function: what several blocks of the benchmark found in one document."""
    covered = None
    for x in table.column("_covered").to_pylist():
        flags = np.frombuffer(x, np.uint8)
        covered = flags if covered is None else covered | flags
    matches = [m for found in table.column("_matches").to_pylist() for m in found]
    return pa.table({"_at": table.column("_at").slice(0, 1), "_covered": pa.array([covered.tobytes()], pa.binary()), "_matches": pa.array([matches], _ARROW)})


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep_text: bool = True,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds n_words, n_hit, contaminated and matches (item, doc_word, item_word, words) to each row.

    The benchmark comes to the driver in blocks of about ``block_bytes`` (by hash of the item),
    one at a time, each of which goes out to all tasks.  One block is searched in a single pass
    without a shuffle; of more, the rows are numbered and written, each
    block is a job of its own that writes what it found, and no two are held together.  Items without words match nothing, items without an id are left out,
    and null texts have no words.  Item ids are given as strings; an id that repeats counts once
    in n_items.  Texts are searched whole; repeated rows each give a row; an empty table gives
    none.  Columns of the result's names are replaced, others stay whatever their names.
    """
    sized = benchmark.select(F.col(item).alias("_item"), F.col(item_text).cast("binary").alias("_text")).filter("_text IS NOT NULL AND _item IS NOT NULL")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    results = ("n_words", "n_hit", "contaminated", "matches")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in results and (keep_text or c != text)] or [F.lit(True).alias("_none")]
    rows = df.select(F.struct(*kept).alias("_row"), F.monotonically_increasing_id().alias("_at"), F.col(text).alias("_text"))
    found_type = T.StructType().add("_n_words", "long").add("_covered", "binary").add("_matches", _RESULT)

    def search(rows: DataFrame, k: int) -> DataFrame:
        block = sized.filter(F.pmod(F.xxhash64("_item"), F.lit(n_blocks)) == k) if n_blocks > 1 else sized
        items = sorted(((r[0], bytes(r[1])) for r in block.collect()), key=lambda x: (str(x[0]), x[1]))
        schema = T.StructType([f for f in rows.schema if f.name != "_text"] + list(found_type))
        return rows.mapInArrow(_search(Benchmark.build(items, window), shard_bytes), schema)

    if n_blocks == 1:
        rows = search(rows, 0)
    else:
        # Written once, so that a row has the same number in every pass.
        rows = checkpointed(rows)
        parts = [checkpointed(search(rows.select("_at", "_text"), k).filter("_covered IS NOT NULL").drop("_n_words")) for k in range(n_blocks)]
        both = reduce(DataFrame.union, parts).groupBy("_at").applyInArrow(_merged, parts[0].schema)
        counted = rows.mapInArrow(_search(Benchmark.build([], window), shard_bytes), T.StructType([f for f in rows.schema if f.name != "_text"] + list(found_type)))
        rows = counted.drop("_covered", "_matches").join(both, "_at", "left")
    n_hit = F.coalesce(F.length(F.expr("replace(hex(_covered), '00', '')")) / 2, F.lit(0)).cast("long")
    matches = F.coalesce("_matches", F.array().cast(_RESULT))
    return rows.select("_row.*", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), (n_hit > 0).alias("contaminated"), matches.alias("matches")).drop("_none")


@carries_columns("text")
def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no benchmark window occurs, with all their columns."""
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_body"))
    return find_contamination(rows, benchmark, "_body", keep_text=False, **options).filter("NOT contaminated").select("_row.*")


def contamination_digest(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row; null texts have no words."""
    found = find_contamination(df.select("doc_id", "text"), benchmark, keep_text=False)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
