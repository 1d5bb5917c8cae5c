import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

from conftest import ODD_TEXTS, prose
from pyspark.sql import functions as F

from vigilake.llm import quality, secrets, sharding

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PATTERNS = [("assign", ASSIGN, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def base_spans(text):
    return sorted((m.start(), k, name, m.end()) for k, (name, p, good) in enumerate(PATTERNS) for m in p.finditer(text) if good(m))


def entropy_spans(text, window=secrets.WINDOW):
    """Every window by itself."""
    out = []
    for m in re.finditer(secrets.CANDIDATE % window, text):
        if any(re.search(p, m[0]) for p in secrets.ALLOW):
            continue
        for order, kind in enumerate(secrets.CLASSES, 3):
            spans = []
            for i in range(len(m[0]) - window + 1):
                part = m[0][i : i + window]
                bits = -sum(n / window * math.log2(n / window) for n in Counter(part).values())
                if set(part) <= set(kind.alphabet) and bits >= kind.bits - 1e-9:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + window
                    else:
                        spans.append([i, i + window])
            out += [(m.start() + a, order, kind.kind, m.start() + b) for a, b in spans]
    return out


def secret_texts():
    rng = random.Random(5)
    token = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b64, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    texts = [
        f"é password = '{token(b64, 20)}' and token: short then secret=\"{token(b64, 12)}\"",
        f"AKIA{token('ABCDEF0123456789', 16)} AKIA12 {token(hexes, 40)} {token(hexes, 15)}",
        f"日本 {token(b64, 64)}\n{token(b64, 23)} {'a' * 50} {'deadbeef' * 8} /usr/local/share/doc/readme/path",
        "password: token=abcdefghijkl Api_Key=0123456789abcdef0123 ſecret=abcdefghijklmnop",
        "123e4567-e89b-12d3-a456-426614174000 " + "1" * 30 + " " + token("0123456789", 40),
    ]
    return texts + [" ".join(f"k{i} token={token(b64, 16)}" for i in range(200)), token(b64, 3000)]


def test_secrets_match_brute_force(spark):
    texts = secret_texts() + ODD_TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.secret_digest(df).collect()}
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        shown = lambda spans: ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans))
        assert rows[i].base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == j for _, k, *_ in base) for j in range(3))
        assert rows[i].spans == shown(base + entropy_spans(text or ""))
    assert "entropy_base64" in rows[2].spans and "entropy_hex" in rows[1].spans


def test_secrets_in_long_candidates(spark):
    """A megabyte of base64, paths and dashed words of 100,000 parts; blocks give what whole windows give."""
    rng = random.Random(8)
    token = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    mixed = "".join(token(rng.choice([b64, "aab", "0123456789abcdef-"]), rng.randrange(10, 60)) for _ in range(2000))
    texts = ["ab-" * 100_000, "/dir_x" * 100_000, token(b64, 1 << 20), mixed, "A1" * 50_000, "/" + "a" * 50_000 + "/b1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.secret_digest(df).collect()}
    assert rows[0].spans == "" == rows[1].spans and len(mixed) > 2 * secrets.BLOCK
    assert [s for s in rows[2].spans.split(",") if s.startswith("entropy_base64")][0].startswith("entropy_base64:0:")
    shown = lambda spans: ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans))
    for i in (3, 4, 5):
        assert rows[i].spans == shown(base_spans(texts[i]) + entropy_spans(texts[i]))


def test_allow_patterns_for_words_and_paths():
    """Flat patterns say the same as words and separators in turn."""
    rng, plain = random.Random(3), re.compile("^[/_-]?([A-Za-z]+[/_-]+)+[A-Za-z]*$")
    for _ in range(3000):
        text = "".join(rng.choice("aB/_-1") for _ in range(rng.randrange(1, 9)))
        assert bool(re.search(secrets.ALLOW[2], text)) == bool(plain.search(text))


def test_redaction_of_many_spans_takes_time_in_proportion(spark):
    rng = random.Random(2)
    schema = "n int, text string, secret_spans array<struct<start:int,ord:int,kind:string,end:int>>"
    rows = [(0, None, []), (1, "", []), (2, "abc", [(0, 0, "x", 3)]), (3, "aébc", [(1, 0, "x", 2), (2, 1, "x", 3)])]
    for n in range(4, 40):
        text = "".join(rng.choice("abé日") for _ in range(rng.choice([5, 1023, 1024, 1025, 5000])))
        starts = [rng.randrange(len(text)) for _ in range(rng.choice([1, 3, 63, 64, 65, 200]))]
        rows.append((n, text, sorted((a, 0, "x", min(len(text), a + rng.choice([1, 2, 40]))) for a in starts)))
    many = "key 0123456789abcdef " * 200_000
    rows.append((99, many, [(21 * i + 4, 2, "hex", 21 * i + 20) for i in range(200_000)]))
    began = time.time()
    for r in secrets.redact_secrets(spark.createDataFrame(rows, schema)).collect():
        spans, text = next((s, t) for n, t, s in rows if n == r.n)
        covered = bytearray(len(text or ""))
        for a, _, _, b in spans:
            covered[a:b] = b"\x01" * (b - a)
        if r.n == 99:
            assert r.text == "key [SECRET] " * 200_000
        elif text is None:
            assert r.text is None
        else:
            want = ""
            for i, c in enumerate(text):
                if not covered[i]:
                    want += c
                elif i == 0 or not covered[i - 1]:
                    want += "[SECRET]"
            assert r.text == want
    assert time.time() - began < 60


def test_redaction_and_clashing_columns(spark, odd, none):
    texts = secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.redact_secrets(secrets.scan_secrets(df)).collect():
        covered, last, out = sorted((s.start, s.end) for s in row.secret_spans), 0, ""
        merged = []
        for a, b in covered:
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out, last = out + texts[row.doc_id][last:a] + "[SECRET]", b
        assert row.text == out + texts[row.doc_id][last:]
    done = secrets.redact_secrets(secrets.scan_secrets(odd))
    assert sorted(done.columns) == sorted(odd.columns) and done.count() == odd.count()
    assert done.filter("doc_id = 0").first().text is None
    assert secrets.scan_secrets(none).count() == 0


def jump(key, n):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark, odd, none):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 3000)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    rows = sharding.shard_rows(df, 40, slot_blocks=8).collect()
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41)) for r in rows)
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    names = spark.createDataFrame([(f"k{i}",) for i in range(50)], "doc_id string")
    assert sharding.shard_rows(names, 7).filter("shard between 0 and 6").count() == 50
    digest = sharding.shard_digest(odd).collect()
    assert len(digest) == odd.count()
    texts = {i: (t or "").encode() for i, t in enumerate(ODD_TEXTS)}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in digest if r.doc_id is not None)
    assert sharding.shard_rows(odd, 5).columns.count("shard") == 1
    clashes = odd.select("doc_id", *[F.lit(7).alias(c) for c in ("_offset", "_jump", "_block", "_row", "_j", "a.b")])
    assert set(sharding.shard_rows(clashes, 5).first()[:]) >= {7} and set(clashes.columns) <= set(sharding.shard_rows(clashes, 5).columns)
    one = sharding.shard_rows(spark.range(4000).selectExpr("1L doc_id", "id"), 3, slot_blocks=8).collect()
    assert sorted(r.slot for r in one) == list(range(4000)) and len({r.shard for r in one}) == 1
    assert sharding.shard_digest(none).count() == 0


def features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_features_match_brute_force(spark):
    rng = random.Random(2)
    texts = ODD_TEXTS + ["\n".join(" ".join(rng.choices("abc#|", k=rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_digest(df).collect():
        want = features(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def corpus(spark):
    good = [prose(i, 120) for i in range(120)]
    loud = [" ".join(w + "###" for w in prose(i, 120).split()) for i in range(20)]
    copied = [(prose(i, 30) + " ") * 4 for i in range(20)]
    return spark.createDataFrame(list(enumerate(good + loud + copied)), "doc_id long, text string")


def test_posterior_separates_kinds_of_bad_text(spark, odd, none):
    rows = {r.doc_id: r for r in quality.quality_digest(corpus(spark)).collect()}
    assert all(rows[i].kept for i in range(120)) and not any(rows[i].kept for i in range(120, 160))
    assert not any(rows[i].base_failed for i in range(140))
    kept = quality.keep_good(corpus(spark))
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == set(range(120))
    again = quality.keep_good(odd)
    assert again.columns == odd.columns and again.count() <= odd.count()
    assert quality.keep_good(none).count() == 0 == quality.quality_digest(none).count()


def plain_em(patterns, n_rules, rounds):
    """The label model document by document, in probabilities and by dictionaries."""
    share, good, bad = 0.8, {r: 0.9 for r in range(n_rules)}, {r: 0.5 for r in range(n_rules)}
    documents = [v for v, n in patterns for _ in range(n)]
    like = lambda v, rates: math.prod(rates[r] if x > 0 else 1 - rates[r] for r, x in enumerate(v) if x)
    post = lambda v: share * like(v, good) / (share * like(v, good) + (1 - share) * like(v, bad))
    for _ in range(rounds):
        of = {v: post(v) for v, _ in patterns}
        new = [{}, {}]
        for r in range(n_rules):
            for c, rates in enumerate(new):
                weight = lambda v: of[v] if c == 0 else 1 - of[v]  # noqa: B023, E731
                rates[r] = (sum(weight(v) for v in documents if v[r] > 0) + 1) / (sum(weight(v) for v in documents if v[r]) + 2)
        share = (sum(of[v] for v in documents) + 1) / (len(documents) + 2)
        good, bad = new
    return share, good, bad, post


def test_label_model_matches_plain_em(spark):
    rng = random.Random(4)
    rates = ([0.95, 0.9, 0.7, 0.99], [0.2, 0.3, 0.6, 0.1])
    count = Counter()
    for _ in range(600):
        kind = rates[rng.random() < 0.2]
        count[tuple(0 if rng.random() < 0.2 else 1 if rng.random() < p else -1 for p in kind)] += 1
    patterns = sorted(count.items())
    model = quality.fit_label_model(patterns, 4, rounds=30, close=0)
    share, good, bad, post = plain_em(patterns, 4, 30)
    assert abs(model.share - share) < 1e-9 and abs(model.share - 0.8) < 0.1
    assert all(abs(model.good[r] - good[r]) < 1e-9 and abs(model.bad[r] - bad[r]) < 1e-9 for r in range(4))
    rows = spark.createDataFrame([v for v, _ in patterns], "a int, b int, c int, d int")
    for r in rows.withColumn("q", model.posterior([F.col(c) for c in "abcd"])).collect():
        assert abs(r.q - post(tuple(r[:4]))) < 1e-9
    # The third rule errs often, so that its word alone does not condemn; the fourth one's nearly does.
    assert post((1, 1, -1, 1)) > 0.9 > post((0, 0, 0, -1))
    assert quality.fit_label_model([], 3).share == 0.8


def test_a_rule_that_errs_is_outvoted(spark):
    """Good documents that one rule calls bad are kept, where the rule errs on many."""
    upper = lambda i: " ".join(w.upper() if k % 12 == 0 else w for k, w in enumerate(prose(i, 120).split()))
    loud = [" ".join(w + "###" for w in prose(i, 120).split()) for i in range(30)]
    copied = [(prose(i, 30) + " ") * 4 for i in range(30)]
    texts = [prose(i, 120) for i in range(200)] + [upper(i) for i in range(200, 240)] + loud + copied
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    features = quality.text_features(df)
    votes = features.select("doc_id", *[r.vote().alias(r.name) for r in quality.RULES])
    accused = {r.doc_id for r in votes.collect() if min(r[1:]) < 0}
    kept = {r.doc_id for r in quality.quality_digest(df).filter("kept").collect()}
    assert kept == set(range(240)) and len(kept & accused) >= 40


def test_plans_stay_in_the_jvm(spark):
    df = corpus(spark)
    for made in (secrets.secret_digest(df), sharding.shard_digest(df), quality.judge(quality.text_features(df), quality.fit_label_model([], len(quality.RULES)))):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())
    assert F is not None
