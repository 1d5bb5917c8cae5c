import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS, prose
from pyspark.sql import functions as F

from vigilake.llm import chat, ctw, language, toxicity
from vigilake.llm import sentencepieces as sp

def contexts(text):
    padded = b"\n" * 5 + text
    for i in range(5, len(padded)):
        yield tuple(padded[i - d] for d in range(1, 6)), padded[i]


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def heap(counts):
    h = [0] * 512
    for byte, n in counts.items():
        h[256 + byte] = n
    for v in range(255, 0, -1):
        h[v] = h[2 * v] + h[2 * v + 1]
    return h


class PlainTree:
    """The weighted tree by recursion over dictionaries."""

    def __init__(self, texts):
        counts = defaultdict(Counter)
        for t in texts:
            for context, byte in contexts(t):
                for d in range(6):
                    counts[context[:d]][byte] += 1
        self.nodes = set(counts)
        below = defaultdict(list)
        for k in self.nodes:
            if k:
                below[k[:-1]].append(k)
        self.heap = {k: heap(counts[k]) for k in self.nodes}
        self.rest = {k: heap(counts[k] - sum((counts[c] for c in below[k]), Counter())) for k in self.nodes}
        self.weight, self.total = {}, {}
        for k in sorted(self.nodes, key=len, reverse=True):
            for v in range(1, 256):
                own = log_kt(*self.heap[k][2 * v : 2 * v + 2])
                if len(k) == 5:
                    self.total[k, v], self.weight[k, v] = own, 1.0
                    continue
                children = sum(self.total[c, v] for c in below[k]) + log_kt(*self.rest[k][2 * v : 2 * v + 2])
                both = np.logaddexp(own, children)
                self.total[k, v], self.weight[k, v] = both - math.log(2), math.exp(own - both)

    def score(self, text):
        total = 0.0
        for context, byte in contexts(text):
            depth = 0
            while depth < 5 and context[: depth + 1] in self.nodes:
                depth += 1
            v = 1
            for bit in range(7, -1, -1):
                y = byte >> bit & 1
                kt = lambda h: (h[2 * v + y] + 0.5) / (h[2 * v] + h[2 * v + 1] + 1)  # noqa: B023, E731
                p = kt(self.rest[context[:depth]])
                for d in range(depth, -1, -1):
                    w = self.weight[context[:d], v]
                    p = w * kt(self.heap[context[:d]]) + (1 - w) * p
                total += math.log10(p)
                v = 2 * v + y
        return total


def test_context_tree_and_base_scores_match_recursion(spark):
    texts = [prose(i, 20) for i in range(12)] + [None, "", "é ALPHA  zzz\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.filter("doc_id < 10 OR doc_id = 12")
    rows = {r.doc_id: r for r in ctw.score_corpus(df, train, top_words=20).collect()}
    seen = [(t or "").encode() for i, t in enumerate(texts) if i < 10 or i == 12]
    tree = PlainTree(seen)
    counts = Counter(w for t in seen for w in t.lower().split())
    n, v = sum(counts.values()) + len(seen), len(counts) + 1
    for i, text in enumerate(texts):
        body = (text or "").encode()
        words = body.lower().split()
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((len(seen) + 0.1) / (n + 0.1 * (v + 1)))
        assert rows[i].score == pytest.approx(tree.score(body), abs=1e-3) and rows[i].base_score == pytest.approx(base)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(words) + 1, 1 + sum(w in counts for w in words), n)
        assert (rows[i].bits_per_byte is None) == (not body)


def test_scores_use_whole_bytes_and_every_context(spark):
    texts = [prose(i, 20) for i in range(12)] + ["Aa! aA! pp00 p0p0 aa!!", None, "A! a0 P\u00e9 \u00e9", "aaaaaaaa" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.filter("doc_id < 9 OR doc_id = 12")
    tree = PlainTree([(t or "").encode() for i, t in enumerate(texts) if i < 9 or i == 12])
    for others in (None, df.exceptAll(train)):
        for top_codes in (20, 1 << 20):
            rows = ctw.score_corpus(df, train, top_codes=top_codes, top_words=20, others=others).collect()
            assert len(rows) == len(texts)
            for r in rows:
                assert r.score == pytest.approx(tree.score((texts[r.doc_id] or "").encode()), abs=1e-6)


def test_scores_of_odd_rows_and_without_training(spark, odd, none):
    rows = ctw.score_digest(odd).collect()
    assert len(rows) == odd.count() and all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows if r.doc_id is not None)
    assert ctw.score_digest(none).count() == 0
    blank = ctw.score_corpus(odd.select("doc_id", "text"), none).filter("doc_id = 8").first()
    assert blank.score == pytest.approx(len(prose(1)) * 8 * math.log10(0.5), rel=1e-4) and blank.n_known == 0
    clashes = odd.select("doc_id", "text", F.struct(F.lit(1).alias("a-b")).alias("s t"), *[F.lit(7).alias(c) for c in ("_n", "_id", "_value", "_known", "_row", "_word", "n.x")])
    assert ctw.score_corpus(clashes, odd).first()["_value"] == 7 and ctw.score_corpus(odd.select("text"), odd).count() == odd.count()


def test_trained_model_beats_uniform_on_held_out_text(spark):
    df = spark.createDataFrame([(i, prose(i, 150)) for i in range(60)], "doc_id long, text string")
    rows = ctw.score_corpus(df, df.filter("doc_id < 50")).filter("doc_id >= 50").collect()
    assert max(r.bits_per_byte for r in rows) < 4.0


def test_pieces_equal_sentencepiece_and_come_back(spark, odd, none):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = ODD_TEXTS + ["  two  spaces ", "tab\there\n\nlines", "日本語のテキスト 한국어", "emoji 🙂🙂", "a" * 3000, "naïve Ünïcode ﬁ", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = sp.encode_pieces(df)
    for r in coded.collect():
        want = None if texts[r.doc_id] is None else reference.encode(texts[r.doc_id])
        assert r.token_ids == want and r.n_tokens == len(want or []) and r.n_differing == 0
        assert r.decodes == ("▁" not in (texts[r.doc_id] or ""))
    assert {r.doc_id: r.decoded for r in sp.decode_pieces(coded).collect()} == {i: t and t.replace("▁", " ") for i, t in enumerate(texts)}
    assert sorted(sp.encode_pieces(odd).columns) == sorted({*odd.columns, "n_differing", "decodes"})
    assert sp.piece_digest(none).count() == 0


def small_model(kind, normalizer="identity", own=(), extra_spaces=False):
    """A unigram (1) or BPE (2) model of a few pieces, with another model's character map."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    pieces = [("▁", -2), ("▁a", -2.5), ("▁ab", -3), ("a", -4), ("b", -4), ("ba", -4.2), ("bab", -4.5), ("ab", -5), ("fi", -6), ("f", -7), ("i", -7), ("1", -8)]
    fixed = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((p, 0, 4) for p in own), *((f"<0x{i:02X}>", 0, 6) for i in range(256))]
    for piece, score, of in [*fixed, *((p, s, 1) for p, s in pieces)]:
        model.pieces.add(piece=piece, score=score, type=of)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, True
    model.normalizer_spec.name = normalizer
    if normalizer != "identity":
        made = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=normalizer).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = True, extra_spaces
    return model.SerializeToString()


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("options", [{}, {"normalizer": "nmt_nfkc", "extra_spaces": True}, {"own": ("abba", "fifi")}])
def test_other_models_are_rebuilt_whole(kind, options):
    encoder = sp.WordEncoder(sp.rebuild(small_model(kind, **options)))
    texts = ["abab ab", "ba  b", " é ab ", "", "ﬁab ﬁ①", "xabbay abba  fifi", "a\u3000b\u00a0ab", "ab" * 400]
    ids, sizes, differing, _ = encoder.encode(pa.array(texts))
    assert np.split(ids, np.cumsum(sizes))[-1].size == 0
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [encoder.reference.encode(t) for t in texts]
    assert not differing.any()
    again = encoder.encode(pa.array(texts[::-1]))
    assert again[1].tolist() == sizes.tolist()[::-1]


def test_models_without_an_equal_form_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(small_model(1))
    model.pieces.add(piece="a▁b", score=-3, type=1)
    with pytest.raises(ValueError, match="start of a word"):
        sp.rebuild(model.SerializeToString())


def test_differences_are_told_and_not_patched():
    encoder = sp.WordEncoder(sp.recipe())
    model = encoder.reference

    class Other:
        def encode(self, texts, num_threads=1):
            return [model.encode(t) if t != "strange" else [5] for t in texts] if " " not in texts[0] else [[0] for _ in texts]

    encoder.reference = Other()
    ids, sizes, differing, same = encoder.encode(pa.array(["a strange thing, strange", "plain words"]))
    assert differing.tolist() == [2, 0] and same.all()
    assert ids.tolist() == model.encode("a strange thing, strange") + model.encode("plain words")


SYLLABLES = {"xx": "ka to mi ru ne so ha".split(), "yy": "brecht ung schli wor ver ein".split(), "zz": "eau oui tre ment ille".split()}


def language_rows(n=150):
    rng = random.Random(3)
    for i in range(n):
        lang = "xyz"[i % 3] * 2
        yield i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(40)), lang


def test_language_of_held_out_text(spark, odd, none):
    rows = list(language_rows())
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 -- 4", None), (902, "KATO mi", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.language_digest(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    assert (found[900].lang_pred, found[900].score, found[901].lang_pred) == ("und", 0.0, "und")
    assert language.language_digest(odd).count() == odd.count() and language.language_digest(none).count() == 0
    unlabelled = language.language_digest(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_gradients_by_differences():
    network = language.ByteNetwork.start(["a", "b", "c"], hidden=3, seed=1)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    data, mask = language.padded([b"abc", b"b", b"cabba"])
    target = np.array([0, 2, 1])
    _, gradient = network.gradients(data, mask, target)
    rng = np.random.default_rng(0)
    for name, weight in network.weights.items():
        for _ in range(4):
            at = (int(rng.choice([97, 98, 99])), *(int(rng.integers(s)) for s in weight.shape[1:])) if name[0] == "x" else tuple(int(rng.integers(s)) for s in weight.shape)
            old, loss = weight[at], []
            for step in (1e-3, -1e-3):
                weight[at] = old + step
                loss.append(network.gradients(data, mask, target)[0])
            weight[at] = old
            assert gradient[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-4)


def test_every_byte_is_labelled_and_padding_changes_nothing():
    network = language.ByteNetwork.start(["a", "b"], hidden=4)
    words = [b"x", b"hello", b"y" * 100]
    sums = network.word_sums(words)
    assert sums.sum(1) == pytest.approx([1, 5, 100], rel=1e-4)
    assert network.word_sums(words, rows=1) == pytest.approx(sums, rel=1e-4)
    # A long run is read in pieces with the bytes around them: by hand.
    long, total = bytes(range(97, 122)) * 5, np.zeros(2)
    for k in range(0, len(long), language.PIECE):
        begin = max(0, k - language.MARGIN)
        data, mask = language.padded([long[begin : k + language.PIECE + language.MARGIN]])
        total += network.label(data, mask)[0, k - begin : min(k + language.PIECE, len(long)) - begin].sum(0)
    assert network.word_sums([long])[0] == pytest.approx(total, rel=1e-4)


def test_more_languages_share_the_words(spark, monkeypatch):
    rows = [(i, prose(i, 30), f"l{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = language.draw_words(df, "text", "lang", "doc_id", words=10)
    monkeypatch.setattr(language, "LANGUAGES", 2)
    fewer = language.draw_words(df, "text", "lang", "doc_id", words=10)
    assert Counter(x for _, x in every) == {f"l{i}": 10 for i in range(5)} and Counter(x for _, x in fewer) == {f"l{i}": 4 for i in range(5)}
    assert set(fewer) <= set(every)


def test_runs_without_spaces_are_learnt_whole(spark):
    rows = [(i, ("ab" if i % 2 else "ÀÉ") * 300, "xx" if i % 2 else "yy") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language.draw_words(df, "text", "lang", "doc_id")
    assert set(drawn) == {(b"ab" * 8, "xx"), (b"ab" * 4, "xx"), (("ÀÉ" * 8).encode(), "yy"), (("ÀÉ" * 4).encode(), "yy")}


def toxic_corpus(spark):
    docs, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        docs.append((i, prose(i, 60) + (" grumpf" * (1 + i % 5) + " snarl." if bad else "")))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_text(spark, odd, none):
    docs, labels = toxic_corpus(spark)
    rows = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].toxic == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.expected_severity <= 3 and r.severity in range(4) for r in rows.values())
    assert rows[24].expected_severity > rows[30].expected_severity > rows[1].expected_severity
    assert toxicity.toxicity_digest(odd, labels).count() == odd.count()
    assert toxicity.toxicity_digest(none, labels).count() == 0
    assert not any(r.toxic for r in toxicity.toxicity_digest(docs, labels.limit(0)).collect())


def test_grades_share_weights_across_thresholds():
    model = toxicity.OrdinalModel({b"x": 2.0}, np.array([0.0, 1.0, 3.0]))
    p = model.grades(np.array([-5.0, 0.5, 9.0]))
    below = lambda cut, z: 1 / (1 + math.exp(z - cut))
    assert p.sum(1) == pytest.approx([1, 1, 1]) and p.argmax(1).tolist()[::2] == [0, 3]
    assert p[1] == pytest.approx([below(0, 0.5), below(1, 0.5) - below(0, 0.5), below(3, 0.5) - below(1, 0.5), 1 - below(3, 0.5)])
    assert (np.diff(p @ np.arange(4)) > 0).all()


#: What may follow what, written out again.
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def cheapest(roles, merge=1.0, relabel=3.0, unknown=0.5, insert=2.0):
    """Least cost over all ways of merging, relabelling and inserting, by trying them."""

    def go(i, last, inserted):
        ways = [0.0] if i == len(roles) and last in (None, "assistant") else []
        if inserted < 3:
            ways += [insert + go(i, r, inserted + 1) for r in NEXT[last]]
        if i < len(roles):
            for r in ("system", "user", "assistant"):
                change = 0.0 if r == roles[i] else relabel if roles[i] in ("system", "user", "assistant") else unknown
                if r in NEXT[last]:
                    ways.append(change + go(i + 1, r, 0))
                if r == last:
                    ways.append(change + merge + go(i + 1, r, 0))
        return min(ways, default=math.inf)

    return go(0, None, 0)


def legal(roles):
    return all(r in NEXT[b] for b, r in zip([None, *roles], roles)) and (not roles or roles[-1] == "assistant")


def test_chat_repair_is_legal_and_cheapest(spark):
    rng = random.Random(1)
    rows, roles_of = [], {}
    for c in range(60):
        roles_of[c] = [rng.choice(["user", "assistant", "system", "User ", "bot", None]) for _ in range(rng.randrange(1, 6))]
        rows += [(c, i, r, f"t{i}") for i, r in enumerate(roles_of[c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results = []
    for block in (1024, 2):
        found = {r.conv: r for r in chat.repair_conversations(df, block=block).collect()}
        assert found.keys() == roles_of.keys()
        for c, roles in roles_of.items():
            plain = [r.strip().lower() if r else None for r in roles]
            turns = found[c].turns
            assert found[c].cost == pytest.approx(cheapest(plain))
            assert legal([t.role for t in turns]) and {t.action for t in turns} <= {"keep", "relabel", "insert"}
            assert [x for t in turns for x in t.source_turns] == list(range(len(roles)))
            assert all(t.text == "\n".join(f"t{i}" for i in t.source_turns) for t in turns)
            assert all(t.changed == sum(plain[i] != t.role for i in t.source_turns) for t in turns)
        results.append({c: r.cost for c, r in found.items()})
    assert results[0] == pytest.approx(results[1])


def test_long_conversations_are_one_row(spark):
    """2,050 turns of one conversation, many equal and null turns, and a merge over every block."""
    rows = [(1, i, "user" if i % 5 else "assistant", f"t{i}") for i in range(2050)]
    rows += [(2, None, "user", "same")] * 1500 + [(3, 0, "user", "q"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert len(whole) == 3 and whole[2].n_merged == 1499 and whole[2].n_inserted == 1 and whole[3].cost == 0
    assert whole[2].rendered == "<|im_start|>user\n" + "\n".join(["same"] * 1500) + "<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    cut = {r.conv: r for r in chat.render(chat.repair_conversations(df, block=7)).collect()}
    assert cut[1].rendered == whole[1].rendered and cut[1].cost == whole[1].cost
    assert [x for t in cut[1].turns for x in t.source_turns] == list(range(2050)) and legal([t.role for t in cut[1].turns])


def test_chat_rendering_and_odd_rows(spark, none):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 1, "user", "again"), (None, None, "assistant", "x"), (None, 0, "user", "y"), (2, 0, "user", "q"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("c"), "block": F.lit(1), "cost": F.lit(2), "turns": F.lit(3)})
    rows = chat.chat_digest(df).collect()
    done = {r.conv_id: r for r in rows if r.conv_id is not None}
    assert done[1].rendered == "<|im_start|>user\nhi\n\nagain<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert (done[1].cost, done[1].n_merged, done[1].n_inserted) == (4.0, 2, 1)
    assert done[2].cost == 0 and done[2].rendered.endswith("<|im_start|>assistant\na<|im_end|>\n")
    alone = sorted(r.rendered for r in rows if r.conv_id is None)
    assert alone == ["<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n", "<|im_start|>user\ny<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"]
    assert chat.chat_digest(spark.createDataFrame([], df.schema)).count() == 0
    named = spark.createDataFrame([("a", 0, "user", "x" * 200_000)], "conv_id string, turn int, role string, text string")
    assert len(chat.chat_digest(named).first().rendered) > 200_000


def test_ordinal_fit_reaches_the_optimum():
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(6)]
    documents, grades = [], []
    for _ in range(240):
        counts = Counter({w: int(n) for w, n in zip(words, rng.poisson(1.0, 6), strict=True) if n})
        pull = 1.4 * np.log1p(counts[b"w0"]) + 0.8 * np.log1p(counts[b"w1"]) - 0.9 * np.log1p(counts[b"w2"]) + rng.logistic() * 0.6
        documents.append((counts, int(pull > 0.9)))
        grades.append(int(np.searchsorted([0.9, 1.5, 2.2], pull)))
    penalty = 4e-3
    model = toxicity._fit(documents, grades, 1, penalty, rounds=4000)

    def loss(weights, cuts):
        probability = toxicity.OrdinalModel(weights, np.array(cuts)).grades(np.array([toxicity.OrdinalModel(weights, cuts).score(Counter({w: n for w, n in c.items() if w in weights})) for c, _ in documents]))
        return -np.log(np.maximum(probability[np.arange(len(grades)), grades], 1e-9)).mean() + penalty * sum(map(abs, weights.values()))

    best = {w: model.weights.get(w, 0.0) for w in words}
    cuts = model.thresholds
    least = loss(best, cuts)
    assert (np.diff(cuts) > 0).all() and best[b"w0"] > best[b"w1"] > 0 > best[b"w2"]
    for step in (-0.03, 0.03):
        for w in words:
            assert loss(best | {w: best[w] + step}, cuts) > least - 1e-6
        for k in range(len(cuts)):
            assert loss(best, cuts + step * (np.arange(len(cuts)) == k)) > least - 1e-6


def test_a_key_of_many_rows_brings_one_text_to_the_driver(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word number "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert len(toxicity.draw_labelled(docs, labels, "doc_id", "text")) == 1
