"""Collocations, spelling variants and exact top-k against plain versions."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS
from pyspark.sql import functions as F

from vigilake.llm import collocations as co
from vigilake.llm import permuterm as pt
from vigilake.llm import pivots as pv


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- collocations


def plain_collocations(rows, least, best):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    phrases = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}

    def inside(short, long):
        return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))

    out = defaultdict(list)
    for (lang, p), a in phrases.items():
        if any(g == lang and len(q) > len(p) and 100 * c >= 100 * a and inside(p, q) for (g, q), c in phrases.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        rows += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(rows)


def some_texts(seed, many=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "x y", "a\x1fb", "Q"]
    fixed = "one two three four five six seven eight nine ten"
    made = []
    for i in range(many):
        parts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(rng.randrange(4))] + [fixed] * rng.randrange(3) + ["zz " * rng.randrange(9)]
        rng.shuffle(parts)
        made.append((rng.choice([". ", "\n", " ", "\t", "?!", "\x0b"]).join(parts), ["en", "fr", None][i % 3]))
    return made + [(t, "en") for t in ODD_TEXTS if t is None or len(t) < 1000] * 2


@pytest.mark.parametrize(("saturated", "span"), [(False, 1 << 20), (True, 1 << 20), (False, 7)])
def test_collocations_equal_plain_counting(spark, monkeypatch, saturated, span):
    # Saturated counters cut nothing; a short span reads texts in parts.
    if saturated:
        monkeypatch.setattr(co, "frequent_bits", lambda *_: np.full(1 << (co.COUNTER_BITS - 3), 255, np.uint8))
    for least, best, seed in ((5, 2000, 1), (12, 7, 2)):
        rows = some_texts(seed)
        df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
        found = sorted(tuple(r) for r in co.collocations(df, least, best, span=span).collect())
        assert found == plain_collocations(rows, least, best)


def test_grams_given_out_follow_the_words_read(monkeypatch):
    monkeypatch.setattr(co, "PART", 64)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 40))) for _ in range(60)]
    batch = lambda k: pa.RecordBatch.from_pydict({"text": texts * k, "lang": ["en", None, "fr"] * (20 * k)})
    bits = [np.full(1 << (co.COUNTER_BITS - 3), 255, np.uint8)] * 2
    once, more = ([r for b in co._grams(bits, co.SPAN)(iter([batch(k)])) for r in b.to_pylist()] for k in (1, 8))
    n = len(" ".join(texts).split())
    # Eight times the words bring eight times the rows, however many grams are known by then.
    assert 7 * len(once) < len(more) < 9 * len(once) and len(more) <= 8 * n + 3
    sums = [Counter() for _ in range(2)]
    for total, rows in zip(sums, (once, more)):
        for r in rows:
            total[r["lang"], r["m"], r["gram"]] += r["n"]
    assert sums[1] == Counter({k: 8 * v for k, v in sums[0].items()})
    assert sum(v for (_, m, _), v in sums[0].items() if m == 0) == n == sum(v for (_, m, _), v in sums[0].items() if m)


def test_paths_are_compacted_over_plain_nodes(spark):
    fixed = "one two three four five six seven eight nine ten"
    rows = [(f"{fixed}. other words here", "en")] * 6 + [(f"{fixed} eleven", "en")] * 5 + [("a a a a a a a a", "en")] * 6
    counts = co.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), 5)
    paths = {(" ".join(r["words"]), r["n"]) for r in co.repeated_passages(counts).collect()}
    assert paths == {(fixed, 11), ("seven eight nine ten eleven", 5), ("a a a a a", 24)}


def test_collocations_of_odd_rows(spark, odd, none):
    rows = [(r["text"], r["lang"]) for r in odd.select("text", "lang").collect()]
    found = sorted(tuple(r) for r in co.collocations(odd.withColumn("a.b", F.lit(1)), 2).collect())
    assert found == plain_collocations(rows, 2, 2000)
    assert co.collocations(none).count() == 0 and co.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    numbers = [(rng.randrange(1, 10**16), rng.randrange(10**17), rng.randrange(10**16, 10**18), rng.randrange(10**17, 10**18)) for _ in range(200)]
    made = spark.createDataFrame(numbers, "a long, n long, l long, r long").select("a", "n", "l", "r", F.expr(co.SCORE).alias("score")).collect()
    assert all(r["score"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in made)


# --- spelling variants


def plain_variants(rows, least_length=5, least_count=3):
    total = Counter()
    for doc, text in rows:
        for word in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    n = {w: c for w, c in total.items() if len(w) >= least_length and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        if len(a) > 1000:
            return len(b) - len(a) == 1 and zlib.crc32(a.encode()) in {zlib.crc32((b[:i] + b[i + 1 :]).encode()) for i in (0, len(a) // 2, len(a))}
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(found), n[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (f, root(w), c, k, fn) for w, (f, c, k, fn) in out.items()}


def test_variants_equal_plain_search(spark):
    rng = random.Random(5)
    # Words over 64 letters go by hashes.
    base = ["anchor", "longer" * 12, "aaaaa", "aaaaaa", "éclair", "Straße", "bookkeeper", "mississippi"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abkéÿ") + w[at:], w[:at] + rng.choice("aik") + w[at + 1 :]])
            words.append(w)
        rows.append((i, rng.choice([" ", "1", "日", "-"]).join(words)))
    got = {r[0]: tuple(r[1:]) for r in pt.variant_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain_variants(rows)
    assert got == want
    assert any(v[0] not in (None, v[1]) for v in want.values())


def test_variants_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()] + [(7, "X" * 20_000)] * 3 + [(8, "x" * 19_999 + "a")] * 3
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-6:], "doc_id long, text string")).withColumn("word", F.lit("clash"))
    assert {r[0]: tuple(r[1:]) for r in pt.variant_groups(df, 3, 1).collect()} == plain_variants(rows, 3, 1)
    assert pt.variant_groups(none).count() == 0


# --- exact top-k


def plain_top(rows, k, every):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0) for j, (i, b) in enumerate(kept) if j != at)
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def vectors(seed, many=400, width=6):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(many, width)) * rng.choice([0.1, 1, 5], size=(many, 1))
    made[many // 2 : many // 2 + many // 3] = made[0]  # a third are copies
    made[-20:] = made[1:21] + 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    odd = [None, [1.0, None], [float("nan")] * width, [float("inf")] * width, [], [2.0], [0.5] * (width + 2)]
    return rows + [(1000 + 5 * i, v) for i, v in enumerate(odd)] + [(None, made[3].tolist()), (10, made[5].tolist()), (20, made[20].tolist())]


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "sample": 50, "rings": 6, "block": 20}, {"pivots": 1, "rings": 1, "block": 7}])
def test_top_k_equals_all_scores(spark, options):
    rows = vectors(7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit("x"), "rank": F.lit(1)}).repartition(5)
    found = pv.top_k(df, k=8, every=5, **options).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_top(rows, 8, 5)


def test_top_k_of_few_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    assert pv.top_k(spark.createDataFrame([], schema)).count() == 0
    few = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (7, [-1.0, 0.0])]
    assert sorted(map(tuple, pv.top_k(spark.createDataFrame(few, schema)).collect()), key=repr) == plain_top(few, 20, 20)
    large = [(i, [float(2**24 + i), -3.0 * i, 1e6]) for i in range(40)]
    assert sorted(map(tuple, pv.top_k(spark.createDataFrame(large, schema), k=5).collect()), key=repr) == plain_top(large, 5, 20)
    with pytest.raises(Exception, match="fit into a long"):
        pv.top_k(spark.createDataFrame([(0, [1e17]), (1, [1e17])], schema)).collect()


@pytest.mark.parametrize("name", ["op11_collocations", "op12_spelling_variants", "op13_exact_top_k"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from vigilake.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    df, found = queries.QUERIES[name](spark, data), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = Counter(tuple(r[columns.index(c)] for c in df.columns) for r in found.fetchall())
    assert sorted(columns) == sorted(df.columns) and Counter(map(tuple, df.collect())) == want
