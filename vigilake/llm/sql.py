"""The operators' queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

import math

from vigilake.llm import collocations, permuterm, pivots, secrets, sharding
from vigilake.llm.decontamination import WINDOW


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _found(name: str, regex: str) -> str:
    """CTE of (rid, start, stop, v): matches, placed by the lengths of what stands between them."""
    r = _text(regex)
    return f"""{name} AS (
  SELECT rid, CAST(sum(g + len(v)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) - len(v) AS start,
         CAST(sum(g + len(v)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop, v
  FROM (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS v, unnest(list_transform(s[1:len(m)], lambda x: len(x))) AS g
        FROM (SELECT rid, regexp_extract_all(t, {r}) AS m, string_split_regex(t, {r}) AS s FROM d)))"""


def secret_scans() -> str:
    w = secrets.WINDOW
    allowed = " OR ".join(f"regexp_matches(v, {_text(p)})" for p in secrets.ALLOW)
    kinds = []
    for order, kind in enumerate(secrets.CLASSES, 3):
        most = math.floor((math.log2(w) - kind.bits) * w * 1_000_000)
        escaped = kind.alphabet.replace("-", "") + ("-" if "-" in kind.alphabet else "")
        kinds.append(f"""SELECT rid, c, start, i, {order} AS ord, {_text(kind.kind)} AS kind FROM sums
    WHERE regexp_full_match(part, {_text(f"[{escaped}]+")}) AND total <= {most}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_found("a", secrets.ASSIGN)}, {_found("k", secrets.ACCESS)}, {_found("h", secrets.HEX)}, {_found("cand", secrets.CANDIDATE % w)},
base AS (SELECT rid, start, 0 AS ord, 'assign' AS kind, stop FROM a WHERE len(regexp_extract(v, {_text(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}
  UNION ALL SELECT rid, start, 1, 'access', stop FROM k UNION ALL SELECT rid, start, 2, 'hex', stop FROM h),
usable AS (SELECT row_number() OVER () AS c, rid, start, v FROM cand WHERE NOT ({allowed})),
windows AS (SELECT rid, c, start, i, substr(v, i + 1, {w}) AS part FROM (SELECT *, unnest(range(0, len(v) - {w} + 1)) AS i FROM usable)),
counted AS (SELECT rid, c, start, i, part, ch, count(*) AS n FROM (SELECT *, unnest(string_split(part, '')) AS ch FROM windows) GROUP BY ALL),
sums AS (SELECT rid, c, start, i, part, sum(CAST(round(n * log2(n) * 1000000) AS BIGINT)) AS total FROM counted GROUP BY ALL),
dense AS ({" UNION ALL ".join(kinds)}),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY c, ord ORDER BY i) <= {w} THEN 0 ELSE 1 END AS fresh FROM dense),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY c, ord ORDER BY i) AS island FROM marked),
more AS (SELECT rid, min(start + i) AS start, ord, kind, max(start + i) + {w} AS stop FROM islands GROUP BY rid, c, ord, kind, island),
spans AS (SELECT rid, start, ord, concat(kind, ':', CAST(start AS VARCHAR), ':', CAST(stop AS VARCHAR)) AS shown, stop FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
told AS (SELECT rid, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
  string_agg(shown, ',' ORDER BY start, ord, stop) FILTER (WHERE ord < 3) AS b, string_agg(shown, ',' ORDER BY start, ord, stop) AS s FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN told USING (rid)"""


def decontamination() -> str:
    word, upper, lower = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {cut} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {cut} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lens AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
hits AS (SELECT rid, i, n, item FROM dw JOIN wins USING (n, win)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)"""


def jump_sharding(n: int = 40, blocks: int = sharding.SLOT_BLOCKS) -> str:
    """crc32 by a table of 256 values made from its polynomial; the walk as a recursion."""
    return f"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, (CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END + coalesce(doc_id, 0))::UHUGEINT AS k FROM documents),
bytes AS (SELECT rid, octet_length(encode(t)) + 16 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))) AS b FROM d),
summed AS (SELECT rid, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, crc),
walk(rid, k, jump, a, b) AS (
  SELECT rid, k, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT rid, nk, CAST(floor((jump + 1) * (2147483648::DOUBLE / ((nk // 8589934592::UHUGEINT) + 1::UHUGEINT)::DOUBLE)) AS BIGINT),
    CASE WHEN jump < {n} THEN jump ELSE a END, CASE WHEN jump < {n + 1} THEN jump ELSE b END
  FROM (SELECT *, (k * {sharding.GENERATOR}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS nk FROM walk WHERE jump < {n + 1})),
done AS (SELECT rid, CAST(a AS INT) AS shard, CAST(b AS INT) AS grown_shard FROM walk WHERE jump >= {n + 1}),
dealt AS (SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, shard, grown_shard,
  floor((((k * {sharding.SPREAD}::UHUGEINT) % 18446744073709551616::UHUGEINT // 4294967296::UHUGEINT + crc::UHUGEINT) % 4294967296::UHUGEINT)::DOUBLE * {blocks} / 4294967296::DOUBLE) AS block
  FROM d JOIN summed USING (rid) JOIN done USING (rid))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM dealt"""


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def collocation_ranks(least: int = collocations.LEAST, best: int = collocations.BEST) -> str:
    """All phrases of one to five words counted one by one."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_A_TO_Z}) AS t FROM documents),
pieces AS (SELECT rid, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places, range(1, {collocations.LONGEST + 1}) t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
longer AS (SELECT lang, m - j AS m, array_to_string(w[i:i + m - j - 1], ' ') AS phrase, max(c) AS most FROM (SELECT *, unnest(range(1, j + 2)) AS i FROM cand, range(1, 4) t(j) WHERE m - j > 1) GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN longer USING (lang, m, phrase) WHERE most IS NULL OR 100 * most < 100 * c),
cuts AS (SELECT lang, phrase, c AS a, k, array_to_string(w[1:k], ' ') AS lw, array_to_string(w[k + 1:m], ' ') AS rw FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.c AS l, y.c AS r, n, (1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lw JOIN f y ON y.lang = cuts.lang AND y.phrase = rw JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {best}"""


def spelling_variants() -> str:
    """Near words through words with a hole and words with a letter less; forms followed by a recursion."""
    least_length, least_count, noise = permuterm.LEAST_LENGTH, permuterm.LEAST_COUNT, permuterm.NOISE
    return f"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))), '..'),
  lambda x: CAST(concat('0x', x) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM runs, crc),
changed AS (SELECT CASE WHEN h % {noise} = 0 THEN concat(substr(run, 1, CAST(h % len(run) AS BIGINT)), substr(run, CAST(h % len(run) AS BIGINT) + 2)) ELSE run END AS word, c FROM hashed),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM changed WHERE len(word) >= {least_length} GROUP BY word HAVING sum(c) >= {least_count}),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS x, substr(word, i + 1) AS y FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.x = b.x AND a.y = b.y AND a.word <> b.word
  UNION SELECT w.word, holes.word, holes.n FROM holes JOIN w ON w.word = concat(x, y)
  UNION SELECT holes.word, w.word, w.n FROM holes JOIN w ON w.word = concat(x, y)),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS nth, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word AND nth = 1),
walk(word, reached, onward) AS (SELECT word, word, form FROM formed UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.onward)
SELECT formed.word, form, reached AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.onward IS NULL"""


def exact_top_k(k: int = pivots.TOP, every: int = pivots.EVERY, scale: int = pivots.SCALE) -> str:
    """Every query against every row."""
    return f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.vec, v.vec) AS BIGINT) AS score FROM v q JOIN v ON q.rid <> v.rid WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
