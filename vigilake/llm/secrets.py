"""Secret scans: three fixed patterns, plus sliding-window entropy over candidate strings.

A candidate is a run of token characters.  For each character class a window slides over
the candidate; counts of the window's characters change by the one that enters and the one
that leaves, and with them the sum of n*log2(n) that gives the window's Shannon entropy.
Everything is a DataFrame expression.

The sum is kept in millionths as an integer, so that it does not depend on the order of
the updates.  Counts are packed, twelve to a long, so that a step changes numbers and copies
no array; long candidates are read in overlapping blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import carries_columns, with_held_column


def either_case(words: str) -> str:
    """Letters as two-letter classes: ASCII case only, in every regex engine alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST, ACCESS, HEX = 12, "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"


@dataclass(frozen=True)
class CharClass:
    """Characters whose windows are measured, and the bits a character from which a window is a secret."""

    kind: str
    alphabet: str
    bits: float


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", 3.0),
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8),
)
WINDOW = 24
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}"
#: Candidates that look random and are not secrets: words and paths, plain numbers, UUIDs,
#: alphabets in order, placeholders, rulers.
ALLOW = (
    "^[A-Za-z]+$",
    "^[0-9]+$",
    "^[/_-]?[A-Za-z]+[/_-][A-Za-z/_-]*$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "(?i)abcdefghijkl|0123456789|example|placeholder|your[-_]",
    "-{8}|={8}|_{8}|\\+{8}|/{8}",
)
_SCALE = 1_000_000
#: Windows that begin in one block of a candidate; bits of a packed count, and counts in a long.
BLOCK, _BITS, _PER = 16_384, 5, 12
#: Spans that a redaction looks at together, and code points of the chunks that it cuts a text into.
SPANS, CHUNK = 64, 1024


def _prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Sum of what stands before each element, in blocks so that appending stays cheap."""
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    cut = lambda b: F.slice(lengths, b * block + 1, block)
    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / block).cast("int") - 1)
    totals = F.transform(blocks, lambda b: F.aggregate(cut(b), F.lit(0), lambda s, x: s + x))
    offsets = F.aggregate(totals, F.array(F.lit(0)), add)
    inner = F.transform(
        blocks,
        lambda b: F.aggregate(cut(b), F.array(F.lit(0)), add, lambda a: F.slice(a, 1, F.size(a) - 1)),
    )
    return F.flatten(F.zip_with(inner, F.slice(offsets, 1, F.size(offsets) - 1), lambda part, o: F.transform(part, lambda x: x + o)))


def _matches(df: DataFrame, text: str, regex: str, out: str) -> DataFrame:
    """Adds ``out``: array of (start, end, value) of the leftmost non-overlapping matches.

    Text between matches and the matches themselves alternate, so their lengths give the
    places.
    """
    m, gaps, before = f"{out}_m", f"{out}_g", f"{out}_b"
    df = df.withColumn(m, F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)))
    df = df.withColumn(
        gaps,
        F.when(F.size(m) > 0, F.transform(F.split(F.col(text), regex, -1), lambda g: F.length(g))),
    )
    df = df.withColumn(
        before,
        F.when(F.size(m) > 0, _prefix_sums(F.zip_with(F.slice(F.col(gaps), 1, F.size(m)), F.col(m), lambda g, v: g + F.length(v)))),
    )
    spans = F.transform(
        F.arrays_zip(F.col(before).alias("b"), F.slice(F.col(gaps), 1, F.size(m)).alias("g"), F.col(m).alias("v")),
        lambda z: F.struct((z["b"] + z["g"]).alias("start"), (z["b"] + z["g"] + F.length(z["v"])).alias("end"), z["v"].alias("value")),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(out, F.when(F.size(m) > 0, spans).otherwise(none)).drop(m, gaps, before)


def _let(x: Column, use) -> Column:
    """use(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _dense_windows(value: Column, kind: CharClass, window: int) -> Column:
    """Merged (start, end) of the windows within ``value`` whose entropy reaches the class's bits."""
    if window >= 1 << _BITS:
        raise ValueError(f"windows have fewer than {1 << _BITS} characters")
    begins = F.sequence(F.lit(0), F.greatest(F.length(value) - window, F.lit(0)), F.lit(BLOCK))
    part = lambda begin: F.substring(value, begin + 1, F.lit(BLOCK + window - 1))
    shifted = lambda spans, begin: F.transform(spans, lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end")))
    found = F.flatten(F.transform(begins, lambda begin: shifted(_block_windows(part(begin), kind, window), begin)))

    def joined(spans: Column) -> Column:
        """Spans of neighbouring blocks that touch become one."""
        last = F.size(spans) - 1
        first = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] < s["start"]))
        final = F.filter(spans, lambda s, i: (i == last) | (F.get(spans, i + 1)["start"] > s["end"]))
        return F.zip_with(first, final, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return F.when(F.length(value) < BLOCK + window, found).otherwise(_let(found, joined))


def _block_windows(value: Column, kind: CharClass, window: int) -> Column:
    """The same for a string of bounded length, in one pass.

    State: the packed counts of the window's characters, characters outside the class in it,
    the scaled sum of n*log2(n), the place, the spans so far and the one that may still grow.
    A step first records the window before it, then lets one character in and one out.
    """
    table = F.array(*[F.lit(round(n * math.log2(n) * _SCALE) if n else 0) for n in range(window + 2)])
    most = math.floor((math.log2(window) - kind.bits) * window * _SCALE)
    number = F.array(*[F.lit(kind.alphabet.find(chr(c))) for c in range(128)])
    codes = F.transform(F.split(value, ""), lambda c: F.element_at(number, F.ascii(c) + 1))
    # In and out by step: a character's number, -1 outside the class; -2 where nothing leaves yet.
    before = lambda c: F.slice(F.concat(F.array_repeat(F.lit(-2), window), c), F.lit(1), F.size(c))
    moves = lambda c: F.zip_with(c, before(c), lambda i, o: F.struct(i.alias("i"), o.alias("o")))
    packs = range(-(-len(kind.alphabet) // _PER))
    f = lambda n: F.element_at(table, n + 1)
    place = lambda c: F.pmod(c, F.lit(_PER)) * _BITS
    inside = lambda c, k: (c >= k * _PER) & (c < (k + 1) * _PER)

    def count(s: Column, c: Column) -> Column:
        held = F.when(c < _PER, s["c0"])
        for k in packs[1:]:
            held = held.when(c < (k + 1) * _PER, s[f"c{k}"])
        return F.call_function("shiftright", held, place(c)).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

    def moved(s: Column, c: Column, k: int) -> Column:
        return F.when(inside(c, k), F.call_function("shiftleft", F.lit(1).cast("long"), place(c))).otherwise(F.lit(0).cast("long"))

    def recorded(s: Column) -> dict[str, Column]:
        """The spans with the window that ends at the state's place."""
        hit = (s["place"] >= window) & (s["outside"] == 0) & (s["total"] <= most)
        fresh = hit & (s["end"] < s["place"] - window)
        done = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return {
            "spans": F.when(fresh & (s["end"] >= 0), F.concat(s["spans"], done)).otherwise(s["spans"]),
            "start": F.when(fresh, s["place"] - window).otherwise(s["start"]),
            "end": F.when(hit, s["place"]).otherwise(s["end"]),
        }

    def step(s: Column, m: Column) -> Column:
        i, o = m["i"], m["o"]
        n, gone = count(s, i), count(s, o) + F.when(i == o, 1).otherwise(0)
        gain = F.when(i >= 0, f(n + 1) - f(n)).otherwise(0) + F.when(o >= 0, f(gone - 1) - f(gone)).otherwise(0)
        fields = {f"c{k}": s[f"c{k}"] + moved(s, i, k) - moved(s, o, k) for k in packs}
        fields["outside"] = s["outside"] + F.when(i == -1, 1).otherwise(0) - F.when(o == -1, 1).otherwise(0)
        fields |= {"total": s["total"] + gain, "place": s["place"] + 1} | recorded(s)
        return F.struct(*[x.alias(name) for name, x in fields.items()])

    def finish(s: Column) -> Column:
        last = recorded(s)
        grown = F.array(F.struct(last["start"].alias("start"), last["end"].alias("end")))
        return F.when(last["end"] >= 0, F.concat(last["spans"], grown)).otherwise(last["spans"])

    none = F.array().cast("array<struct<start:int,end:int>>")
    start = {f"c{k}": F.lit(0).cast("long") for k in packs}
    start |= {"outside": F.lit(0), "total": F.lit(0), "place": F.lit(0), "spans": none, "start": F.lit(-1), "end": F.lit(-1)}
    state = F.struct(*[x.alias(name) for name, x in start.items()])
    return _let(codes, lambda c: F.aggregate(moves(c), state, step, finish))


@carries_columns("text")
def scan_secrets(
    df: DataFrame,
    text: str = "text",
    out: str = "secret_spans",
    window: int = WINDOW,
    classes: tuple[CharClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """Adds ``out``, an array of (start, ord, kind, end) ordered by start and kind.

    Places are code points, end exclusive.  Fixed patterns (assign, access, hex) are always
    reported.  A candidate that matches any ``allow`` pattern gives no entropy span.  Null
    and empty texts give an empty array.  Texts of any length are read whole; repeated rows
    each give a row, an empty table gives none.  All other columns stay; a column named like
    ``out`` is replaced.
    """
    own = "_s_text"
    df = df.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    for name, regex in (("_s_assign", ASSIGN), ("_s_access", ACCESS), ("_s_hex", HEX), ("_s_cand", CANDIDATE % window)):
        df = _matches(df, own, regex, name)
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    df = df.withColumn("_s_assign", F.filter("_s_assign", lambda m: F.length(value(m)) >= ASSIGN_LEAST))
    denied = lambda c: ~F.coalesce(F.greatest(*[c["value"].rlike(p) for p in allow], F.lit(False)), F.lit(False))
    df = df.withColumn("_s_cand", F.filter("_s_cand", denied))

    def span(m: Column, order: int, kind: str, base: Column | int = 0) -> Column:
        return F.struct(
            (m["start"] + base).cast("int").alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (m["end"] + base).cast("int").alias("end")
        )

    def fixed(name: str, order: int) -> Column:
        return F.transform(name, lambda m: span(m, order, name[3:]))

    def dense(kind: CharClass, order: int) -> Column:
        run = f"[{kind.alphabet.replace('-', '')}{'-' if '-' in kind.alphabet else ''}]{{{window}}}"
        able = F.filter("_s_cand", lambda c: c["value"].rlike(run))
        windows = lambda c: F.transform(_dense_windows(c["value"], kind, window), lambda s: span(s, order, kind.kind, c["start"]))
        return F.flatten(F.transform(able, windows))

    parts = [fixed(name, order) for order, name in enumerate(("_s_assign", "_s_access", "_s_hex"))]
    parts += [dense(kind, order) for order, kind in enumerate(classes, 3)]
    return with_held_column(df, out, F.sort_array(F.concat(*parts))).drop(own, "_s_assign", "_s_access", "_s_hex", "_s_cand")


@carries_columns("text", "spans")
def redact_secrets(df: DataFrame, text: str = "text", spans: str = "secret_spans", marker: str = "[SECRET]") -> DataFrame:
    """Replaces what the spans cover (overlapping and touching ones together) by the marker; null texts stay null.

    Spans come sorted by start.  How far spans reach before each one is known by blocks of
    SPANS of them and inside a block, and the text is cut into chunks once, so that time
    grows with the text and its spans.  Texts of any length and repeated rows are rows like
    any others; an empty table stays one.  All other columns stay.
    """
    some = F.size(spans) > 0
    body = F.col(f"`{text}`")
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(`{spans}`) - 1) div {SPANS}").cast("int")), lambda j: F.slice(spans, j * SPANS + 1, F.lit(SPANS)))
    df = with_held_column(df, "_s_blocks", F.when(some, blocks))
    df = with_held_column(df, "_s_most", F.transform("_s_blocks", lambda b: F.array_max(b["end"])))
    df = with_held_column(df, "_s_before", F.transform("_s_most", lambda _, j: F.coalesce(F.array_max(F.slice("_s_most", F.lit(1), j)), F.lit(-1))))
    reach = lambda b, i, j: F.greatest(F.get("_s_before", j), F.coalesce(F.array_max(F.slice(b["end"], F.lit(1), i)), F.lit(-1)))
    reached = lambda b, j: F.transform(b, lambda s, i: F.struct(s["start"].alias("start"), reach(b, i, j).alias("reach")))
    # A marker stands where a span begins beyond all before it; the text from their reach to its start is kept.
    first = lambda b, j: F.filter(reached(b, j), lambda s: s["reach"] < s["start"])
    df = with_held_column(df, "_s_first", F.flatten(F.transform("_s_blocks", first)))
    large = F.transform(F.sequence(F.lit(0), F.floor((F.length(body) - 1) / (CHUNK * CHUNK)).cast("int")), lambda k: F.substring(body, k * CHUNK * CHUNK + 1, F.lit(CHUNK * CHUNK)))
    small = F.transform(large, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / CHUNK).cast("int")), lambda k: F.substring(x, k * CHUNK + 1, F.lit(CHUNK))))
    df = with_held_column(df, "_s_chunks", F.when(some, F.flatten(small)))

    def cut(begin: Column, end: Column) -> Column:
        begin = F.greatest(begin, F.lit(0))
        low, high = F.floor(begin / CHUNK).cast("int"), F.floor(F.greatest(end - 1, begin) / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice("_s_chunks", low + 1, high - low + 1), ""), begin % CHUNK + 1, end - begin)

    pieces = F.transform("_s_first", lambda s: cut(s["reach"], s["start"]))
    whole = F.array_join(F.concat(pieces, F.array(cut(F.array_max("_s_most"), F.length(body)))), marker)
    return df.withColumn(text, F.when(some, whole).otherwise(body)).drop("_s_blocks", "_s_most", "_s_before", "_s_first", "_s_chunks")


def secret_digest(df: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed patterns, digest of their spans, and all spans as text, for every row.

    A null text is an empty one, without spans; a null doc_id stays null.  Texts are read
    whole, repeated rows each give a row, an empty table gives none.  Spans that begin at one
    place come in the order of their kinds.  Columns beside doc_id and text are not read.
    """
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["ord"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["ord"] == k)).cast("long")
    return scan_secrets(df.select("doc_id", "text")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("secret_spans")).alias("spans"),
    )
