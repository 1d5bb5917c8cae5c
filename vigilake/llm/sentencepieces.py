"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf gives the pieces, scores and normaliser, from which the same tokenizer
is rebuilt: normaliser (character map, white space, metaspace marker), unigram scores (or,
for a BPE model, the merges that its scores order), user-defined pieces and byte fallback.
No piece of a model that splits by white space reaches over the start of a word, so a text
is the sum of its words: a task encodes each distinct word once, in multithreaded batches,
compares it with SentencePiece and decodes it again.  Words and ids stay in flat arrays.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import carries_columns, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words (and eight ids each) that a task remembers, and the longest that it does.
HELD, LONGEST = 400_000, 256
#: Words that go through the libraries as one string.
TOGETHER = 256
#: Bytes of text that a task works on at once.
SLICE = 4 << 20
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass(frozen=True)
class Recipe:
    """What tasks need to rebuild the tokenizer; ``normalizer`` is empty for a model that leaves texts as they are."""

    model: bytes
    tokenizer: str
    normalizer: str
    dummy_prefix: bool
    threads: int


def rebuild(model: bytes, threads: int = 2) -> Recipe:
    """The tokenizers-library form of a SentencePiece model (unigram or BPE).

    The normaliser works on whole texts, before they are cut into words, so it is kept apart
    from the tokenizer.  Raises ValueError for what has no equal form: other model types,
    pieces that reach over a word's start, words that end with the marker or have none.
    """
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    spec = proto.normalizer_spec
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in pieces if t in (_NORMAL, _USER)):
        raise ValueError("pieces that reach over the start of a word are not supported")
    if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
        raise ValueError("only models whose words begin with the marker are supported")
    unknown = next(i for i, p in enumerate(pieces) if p[2] == _UNKNOWN)
    fallback = proto.trainer_spec.byte_fallback
    own = sorted((p for p, _, t in pieces if t == _USER), key=len, reverse=True)
    if proto.trainer_spec.model_type == 1:
        # A user-defined piece stands alone when it is scored, and wins over whatever it is made of.
        core = models.Unigram([(p, 0.0 if t == _USER else s) for p, s, t in pieces], unknown, fallback)
    elif proto.trainer_spec.model_type == 2:
        ids = {p: i for i, (p, *_) in enumerate(pieces)}
        usable = {p for p, _, t in pieces if t == _NORMAL}
        merges = sorted(
            (-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:])
            for p, s, t in pieces
            if t == _NORMAL
            for k in range(1, len(p))
            if p[:k] in usable and p[k:] in usable
        )
        pairs = [(a, b) for *_, a, b in merges]
        core = models.BPE(ids, pairs, unk_token=pieces[unknown][0], byte_fallback=fallback, fuse_unk=True, ignore_merges=bool(own))
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Replace(" ", MARK)
    cuts = [pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")]
    cuts += [pre_tokenizers.Split(Regex("|".join(map(re.escape, own))), "isolated")] if own else []
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(cuts)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    whole = ""
    if steps:
        carrier = Tokenizer(models.BPE())
        carrier.normalizer = normalizers.Sequence(steps)
        whole = carrier.to_str()
    return Recipe(model, tokenizer.to_str(), whole, spec.add_dummy_prefix, threads)


def recipe(path: str = MODEL, threads: int = 2) -> Recipe:
    """Reads the model on the driver, which sends it to the tasks."""
    with open(path, "rb") as file:
        return rebuild(file.read(), threads)


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Texts whose words are not all set apart by one space.
_UNEVEN = f"^ | $|  |{MARK}"


def words_of(text: str, dummy_prefix: bool) -> list[str]:
    """The text with spaces marked, cut before every marked word; empty for an empty text."""
    return _WORDS.findall((MARK if dummy_prefix else "") + text.replace(" ", MARK)) if text else []


class WordEncoder:
    """Ids of distinct words, each checked once against SentencePiece and against its own text.

    A word is known by its text behind the marker that begins it.  ``begin`` and ``size`` give
    its place in ``ids``; ``odd`` are words on which the libraries differ, ``lossy`` those that
    do not decode to themselves.
    """

    def __init__(self, recipe: Recipe):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(recipe.threads))
        import sentencepiece
        from tokenizers import Tokenizer

        self.dummy_prefix = recipe.dummy_prefix
        self.tokenizer = Tokenizer.from_str(recipe.tokenizer)
        self.normalizer = Tokenizer.from_str(recipe.normalizer).normalizer if recipe.normalizer else None
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=recipe.model)
        pieces = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.starts = np.array([p.startswith(MARK) for p in pieces])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.begin, self.odd, self.lossy = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Ids, sizes, odd and lossy flags of words with their markers."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        plain = [w.replace(MARK, " ") for w in words]
        expected = self.reference.encode([p[1:] if self.dummy_prefix else p for p in plain], num_threads=1)
        # A lone marker is an empty text to SentencePiece.
        odd = [a != b and (len(w.strip(MARK)) > 0 or not self.dummy_prefix) for w, a, b in zip(words, ids, expected, strict=True)]
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        return flat, np.array([len(i) for i in ids], np.int64), np.array(odd, bool), np.array([a != b for a, b in zip(back, plain, strict=True)], bool)

    def _together(self, words: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for words of one marker each, many at a time; a string that fails a check goes word by word."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        texts = [" ".join(g) for g in groups]
        expected = self.reference.encode(texts, num_threads=1)
        texts = [" " + t for t in texts]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        for group, text, ids, want, again in zip(groups, texts, found, expected, back, strict=True):
            flat = np.array(ids, np.int32)
            first = np.flatnonzero(self.starts[flat])
            if ids == want and again == text and len(first) == len(group):
                yield flat, np.diff(np.append(first, len(flat))), np.zeros(len(group), bool), np.zeros(len(group), bool)
            else:
                yield self._one_by_one([MARK + w for w in group])

    def learn(self, words: list[str], even: bool) -> np.ndarray:
        """Numbers of the words, in order; new ones are encoded, and remembered if of ordinary length.

        ``even``: each has one marker, at its start.
        """
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(numbers < 0)
        if not len(fresh):
            return numbers
        new = words if len(fresh) == len(words) else list(map(words.__getitem__, fresh.tolist()))
        made = self._together(new) if even else [self._one_by_one([MARK + w for w in new] if self.dummy_prefix else new)]
        ids, size, odd, lossy = (np.concatenate(x) for x in zip(*made, strict=True))
        first = len(self.size)
        numbers[fresh] = np.arange(first, first + len(new))
        self.known |= zip(new, range(first, first + len(new)), strict=True)
        for w in (w for w in new if len(w) > LONGEST):
            del self.known[w]
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.odd, self.lossy = np.concatenate([self.odd, odd]), np.concatenate([self.lossy, lossy])
        return numbers

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words, one text after another, and how many words each text has."""
        counts = np.zeros(len(texts), np.int64)
        parts, owners = [], []
        empty = pc.equal(pc.binary_length(texts), 0)
        uneven = pc.and_not(pc.match_substring_regex(texts, _UNEVEN), empty) if self.dummy_prefix else pc.invert(empty)
        even = np.flatnonzero(~(empty.to_numpy(False) | uneven.to_numpy(False)))
        if len(even):
            lists = pc.split_pattern(texts.take(pa.array(even)), " ")
            counts[even] = pc.list_value_length(lists).to_numpy(False)
            coded = lists.flatten().dictionary_encode()
            parts.append(self.learn(coded.dictionary.to_pylist(), True)[coded.indices.to_numpy()])
            owners.append(np.repeat(even, counts[even]))
        if len(odd := np.flatnonzero(uneven.to_numpy(False))):
            cut = [words_of(t, self.dummy_prefix) for t in texts.take(pa.array(odd)).to_pylist()]
            counts[odd] = [len(w) for w in cut]
            # Without its first marker a word is known as in an even text.
            words = [w[1:] if self.dummy_prefix else w for w in chain.from_iterable(cut)]
            coded = pa.array(words, pa.string()).dictionary_encode()
            parts.append(self.learn(coded.dictionary.to_pylist(), False)[coded.indices.to_numpy()])
            owners.append(np.repeat(odd, counts[odd]))
        if len(parts) == 1:
            return parts[0], counts
        if not parts:
            return np.zeros(0, np.int64), counts
        return np.concatenate(parts)[np.argsort(np.concatenate(owners), kind="stable")], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of all texts, and by text: ids, words on which the libraries differ, whether it decodes to itself.

        With a normaliser, a text decodes to its normal form; where that differs from
        SentencePiece's, one more difference is counted.
        """
        if len(self.known) > HELD or len(self.ids) > 8 * HELD:
            self.forget()
        strange = np.zeros(len(texts), np.int64)
        if self.normalizer is not None:
            plain = texts.to_pylist()
            normal = [self.normalizer.normalize_str(t) for t in plain]
            wanted = [self.reference.normalize(t) for t in plain]
            ours = [(MARK if t and self.dummy_prefix else "") + t.replace(" ", MARK) for t in normal]
            strange += np.fromiter((a != b for a, b in zip(ours, wanted, strict=True)), bool, len(plain))
            texts = pa.array(normal, pa.string())
        numbers, counts = self._cut(texts)
        size = self.size[numbers]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.begin[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(counts)])])
        marked = pc.match_substring(texts, MARK).to_numpy(False)
        return flat, sums(size), strange + sums(self.odd[numbers]), ~marked & (sums(self.lossy[numbers]) == 0)


_encoders: dict[int, WordEncoder] = {}


def _encoder(recipe: Recipe) -> WordEncoder:
    """One for each Python worker and model."""
    key = hash((recipe.model, recipe.threads))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(recipe)
    return _encoders[key]


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for part, _ in text_slices(batches, "_text", SLICE):
            column = part.column(part.schema.get_field_index("_text"))
            ids, sizes, differing, same = encoder.encode(pc.fill_null(column, "").cast(pa.string()))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            null = np.append(column.is_null().to_numpy(False), False)
            offsets = pa.array(ends, mask=null) if null.any() else pa.array(ends)
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            out = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != "_text"}
            out |= {"token_ids": lists, "n_differing": pa.array(differing), "decodes": pa.array(same)}
            yield pa.RecordBatch.from_pydict(out)

    return run


@carries_columns("text")
def encode_pieces(df: DataFrame, text: str = "text", model: str = MODEL, threads: int = 2, keep_text: bool = True) -> DataFrame:
    """Adds token_ids (array of int), n_tokens, n_differing (words on which the libraries differ) and decodes.

    Ids are those of the tokenizers library.  ``decodes``: they give the text again (its normal
    form, if the model has a normaliser); false for a text that has the metaspace mark itself,
    which comes back as a space (as in SentencePiece).  A null text has null ids and 0 tokens, an
    empty one no ids.  Texts are encoded whole, however long; repeated rows each give a row; an
    empty table gives none.  Columns of the result's names are replaced, others stay.
    """
    results = ("token_ids", "n_tokens", "n_differing", "decodes", "_text")
    rows = df.select(*[c for c in df.columns if c not in results and (keep_text or c != text)], F.col(text).alias("_text"))
    schema = T.StructType([f for f in rows.schema if f.name != "_text"])
    schema = schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_differing", "long").add("decodes", "boolean")
    shared = df.sparkSession.sparkContext.broadcast(recipe(model, threads))
    coded = rows.mapInArrow(_encode(shared), schema)
    return coded.withColumn("n_tokens", F.coalesce(F.size(F.coalesce("token_ids", F.array().cast("array<int>"))), F.lit(0)).cast("long"))


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        cut = 1 if encoder.dummy_prefix else 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column(part.schema.get_field_index("_ids")).to_pylist()
                texts = encoder.tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                out = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != "_ids"}
                out["_decoded"] = pa.array([None if x is None else t[cut:] if t.startswith(" ") else t for x, t in zip(ids, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def decode_pieces(df: DataFrame, ids: str = "token_ids", out: str = "decoded", model: str = MODEL, threads: int = 2) -> DataFrame:
    """Adds the text of the ids as ``out``; null ids give null."""
    rows = df.withColumn("_ids", F.col(ids)).drop(out)
    schema = T.StructType([f for f in rows.schema if f.name != "_ids"]).add("_decoded", "string")
    shared = df.sparkSession.sparkContext.broadcast(recipe(model, threads))
    return rows.mapInArrow(_decode(shared), schema).withColumnRenamed("_decoded", out)


def piece_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, token_ids, n_differing, decodes of every row; a null text has null ids and 0 tokens.

    Texts are encoded whole, an empty one has no ids; repeated rows each give a row, an empty
    table gives none; columns beside doc_id and text are not read.
    """
    return encode_pieces(df.select("doc_id", "text"), keep_text=False).select("doc_id", "n_tokens", "token_ids", "n_differing", "decodes")
