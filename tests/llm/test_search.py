import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from conftest import ODD_TEXTS, prose
from pyspark.sql import functions as F

from vigilake.llm import decontamination as dc
from vigilake.llm import near, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window=10):
    found = defaultdict(set)
    for item, body in items:
        w = WORD.findall(lowered(body))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found[tuple(w[i : i + n])].add(item)
    w, covered, hit = WORD.findall(lowered(text)), set(), set()
    for n in {len(k) for k in found}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in found:
                covered |= set(range(i, i + n))
                hit |= found[tuple(w[i : i + n])]
    return len(w), len(covered), hit


def bench_and_docs():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(25)]
    items += [(100, None), (101, items[3][1]), (2, "Straße É1 " * 6), (7, "...")]
    docs = list(ODD_TEXTS)
    for _ in range(80):
        parts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(3)]
        body = rng.choice(items)[1] or ""
        cut = body.split()
        parts.insert(1, ", ".join(cut[rng.randrange(3) : len(cut) - rng.randrange(3)]).upper().replace("SS", "ß") if rng.random() < 0.7 else "")
        docs.append(" ".join(parts))
    return items, docs


def test_contamination_matches_brute_force(spark):
    items, docs = bench_and_docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    rows = dc.contamination_digest(df, bench).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, covered, hit = brute(docs[r.doc_id], items)
        ids = ",".join(sorted(map(str, hit)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, covered, len(hit), covered > 0)
        assert r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert {r.contaminated for r in rows} == {True, False}
    # Cut into blocks of the benchmark and shards of a few documents, the result is the same.
    cut = dc.find_contamination(df, bench, block_bytes=60, shard_bytes=100).collect()
    assert {r.doc_id: (r.n_hit, len({m.item for m in r.matches})) for r in cut} == {r.doc_id: (r.n_hit, r.n_items) for r in rows}


def test_match_places_and_lengths(spark):
    words = [f"q{i}" for i in range(120)]
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    df = spark.createDataFrame([(1, "x y " + " ".join(words[5:95]) + " z"), (2, " ".join(words[:9]))], "doc_id long, text string")
    rows = {r.doc_id: r for r in dc.find_contamination(df, bench).collect()}
    assert [tuple(m) for m in rows[1].matches] == [("9", 2, 5, 90)] and rows[1].n_hit == 90
    assert rows[2].matches == [] and not rows[2].contaminated
    assert [r.doc_id for r in dc.decontaminate(df, bench).collect()] == [2]


def test_windows_that_repeat_in_items_and_documents(spark):
    """Each distinct window is searched once; long copies, repeats within a text, and bounded pairs."""
    shared = [f"s{i}" for i in range(12)]
    items = [(i, " ".join([f"a{i}", *shared, f"b{i}", *shared[: i % 5]])) for i in range(40)] + [(None, "s0 s1 s2")]
    long = [f"q{i % 700}" for i in range(5000)]
    bench = spark.createDataFrame([*items, (99, " ".join(long))], "item_id long, text string")
    docs = [" ".join(shared * 30), " ".join(["x", *shared, "b7", "y"]), " ".join(long[100:4100]), " ".join(shared[:9])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r.doc_id: r for r in dc.find_contamination(df, bench).collect()}
    for i, text in enumerate(docs):
        n, covered, hit = brute(text, [x for x in [*items, (99, " ".join(long))] if x[0] is not None])
        assert (rows[i].n_words, rows[i].n_hit, {m.item for m in rows[i].matches}) == (n, covered, set(map(str, hit)))
    assert {m.item: m.words for m in rows[1].matches}["7"] == 13 and {m.item: m.words for m in rows[1].matches}["8"] == 12
    assert [tuple(m)[1:] for m in rows[2].matches] == [(0, 100, 4000)]
    bench_of = dc.Benchmark.build([(i, t.encode()) for i, t in items if i is not None])
    assert len(bench_of.length) < len(bench_of.starts)


def test_suffix_array_order():
    rng = np.random.default_rng(6)
    for vocabulary in (2, 5, 5000):
        tokens = np.concatenate([rng.integers(0, vocabulary, 300), np.zeros(65, np.int64)]).astype(np.int32)
        array = dc.suffix_array(tokens, vocabulary, 64)
        key = lambda p, t=tokens: next((t[p : p + i + 1].tolist() for i in range(64) if t[p + i] == 0), t[p : p + 64].tolist())
        keys = [key(p) for p in array]
        assert sorted(array) == np.flatnonzero(tokens).tolist() and keys == sorted(keys)


def test_empty_inputs_and_clashing_columns(spark, odd, none):
    bench = spark.createDataFrame([(1, prose(1))], "item_id long, text string")
    kept = dc.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert dc.contamination_digest(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.contamination_digest(none, bench).count() == 0
    assert "matches" in dc.find_contamination(odd, bench).columns
    clashes = odd.select("doc_id", "text", F.struct(F.lit(1).alias("a-b")).alias("s t"), *[F.lit(7).alias(c) for c in ("_at", "_row", "_covered", "_n_words")])
    assert dc.find_contamination(clashes, bench, block_bytes=60).first()["_at"] == 7


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes, k=4):
    values = sorted(set(codes))
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= k:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {v: root(i) for i, v in enumerate(values)}


def test_fingerprints_and_groups_match_brute_force(spark):
    texts = ODD_TEXTS[:6] + ODD_TEXTS[7:]
    for i in range(25):
        w = prose(i, 150).split()
        texts += [" ".join(w), " ".join([*w[:70], "changed", *w[71:]]), " ".join(w[: 150 - i]), " ".join(w).upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codes = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    roots = components(codes.values())
    least = {}
    for i, c in codes.items():
        least[roots[c]] = min(least.get(roots[c], i), i)
    rows = simhash.simhash_digest(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{codes[r.doc_id]:016x}" and r.component_id == least[roots[codes[r.doc_id]]]
    assert len(least) < len(texts) - 30
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(least.values())


def test_links_connect_what_brute_force_connects(spark):
    """Crowded balls of codes, in groups cut into blocks, and with two agreeing bands."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**63, 12)
    codes = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for c in centres for _ in range(60)}
    codes |= {int(x) for x in rng.integers(0, 2**63, 300)}
    df = spark.createDataFrame([(c,) for c in codes], "_fp long")
    want = components(codes)
    for options in ({}, {"group": 8, "block": 16}, {"group": 1, "block": 50}, {"group": 1024, "block": 100}):
        found = {r.node: r.root for r in simhash.connected_components(simhash.link_fingerprints(df, **options)).collect()}
        groups = defaultdict(set)
        for c in codes:
            groups[want[c]].add(found.get(c, c))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_index_search_is_exact():
    rng = np.random.default_rng(9)
    codes = np.unique(rng.integers(0, 2**20, 900).astype(np.uint64) << np.uint64(3))
    assert (np.argsort(simhash.gray_rank(codes)) != np.arange(len(codes))).any()
    index = simhash.GrayIndex(codes)
    found = {(int(q), int(c)) for a, b in index.search(codes, 4, most=500) for q, c in zip(a, b)}
    assert found == {(i, j) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4).tolist()}


def test_long_chains_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "a long, b long")
    rows = simhash.connected_components(chain).collect()
    assert {r.node for r in rows} == set(range(301)) and {r.root for r in rows} == {0}


def test_repeated_rows_nulls_and_empty_tables(spark, odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(prose(1)) == 1 and len([t for t in texts if not (t or "").strip()]) == 1
    assert simhash.simhash_digest(none).count() == 0 == simhash.drop_near_duplicates(none).count()
    twice = spark.createDataFrame([(5, prose(1)), (5, prose(2)), (5, prose(2))], "doc_id long, text string")
    assert sorted(r.text for r in simhash.drop_near_duplicates(twice).collect()) == sorted([prose(1), prose(2)])


def edited_texts(n, seed=3):
    rng, texts = random.Random(seed), []
    for i in range(n):
        words = prose(2000 + i, rng.choice([60, 120, 300])).split()
        texts.append(" ".join(words))
        for _ in range(2):
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice([25, 40, 80]))):
                words[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


def jaccard_components(sets, similarity=0.8):
    root, pairs = list(range(len(sets))), []
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                pairs.append((a, b))
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root, pairs


def test_tables_of_bits_find_similar_texts(spark):
    """Recall of pairs at 0.8 or more against brute force, in many small groups and blocks."""
    texts = edited_texts(120)
    sets = [set(near.shingle_set(t.encode()).tolist()) for t in texts]
    _, pairs = jaccard_components(sets)
    codes = [near.wide_code(near.shingle_set(t.encode())).tobytes() for t in texts]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(codes)], "_body long, _code binary")
    for options in ({"group": 16}, {"group": 512, "block": 100}):
        found = {r.node: r.root for r in near.candidate_clusters(df, **options).collect()}
        together = [found.get(a, a) == found.get(b, b) for a, b in pairs]
        assert sum(together) >= 0.97 * len(together) > 50
    assert len(near.tables_for(10**7)) > len(near.tables_for(10**5)) > 1 == len(near.tables_for(100))


def test_components_of_similar_sets_match_brute_force():
    for seed in range(4):
        texts = edited_texts(25, seed)
        crowd = prose(9, 150).split()
        rng = random.Random(seed)
        texts += [" ".join(w if rng.random() > 0.03 else "other" for w in crowd) for _ in range(40)]
        rng.shuffle(texts)
        sets = [near.shingle_set(t.encode()) for t in texts] + [np.zeros(0, np.uint64)]
        root, _ = jaccard_components([set(s.tolist()) for s in sets[:-1]])
        assert near.join_similar(sets, 0.8).tolist() == [*root, len(sets) - 1]


def test_columns_of_any_name_pass_through(spark):
    """Dots, working names and names of other operators' results; only a result's own name gives way."""
    from vigilake.llm import language, quality, secrets, sentencepieces, toxicity

    names = ("a.b", "_text", "_body", "_row", "__row", "__also", "_order", "_fp", "_s_text", "_q_x", "f_words", "_c0_", "C d")
    rows = [(i, prose(i % 3)) for i in range(4)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = plain.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    bench = spark.createDataFrame([(1, prose(2))], "item_id long, text string")
    model = toxicity.fit_ordinal([], [])
    operators = {
        "scan": secrets.scan_secrets,
        "redact": lambda d: secrets.redact_secrets(secrets.scan_secrets(d)),
        "clean": lambda d: dc.decontaminate(d, bench),
        "good": quality.keep_good,
        "rate": quality.rate_quality,
        "language": lambda d: language.identify_languages(d, None),
        "near": lambda d: near.drop_near_duplicates(d),
        "groups": lambda d: simhash.near_duplicate_groups(d, "doc_id"),
        "one of each": lambda d: simhash.drop_near_duplicates(d),
        "grades": lambda d: toxicity.grade_toxicity(d, model),
        "pieces": sentencepieces.encode_pieces,
    }
    for name, operator in operators.items():
        found, want = operator(wide), operator(plain)
        results = set(want.columns) - {"doc_id", "text"}
        assert set(found.columns) == set(want.columns) | set(names), name
        got = found.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in want.collect()), name
        assert all(r[n] == f"{n} {r['doc_id']}" for r in got for n in set(names) - results), name
