"""Sharding by jump consistent hashing (Lamping & Veach, 2014), as DataFrame expressions.

A key walks through ever larger shard numbers with a 64-bit linear congruential generator
and stays at the last one below the shard count.  With one more shard a key either stays
or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import unused

#: Multipliers: the generator's, and another one (2**64 over the golden ratio) that deals keys into blocks.
GENERATOR, SPREAD = 2862933555777941757, 11400714819323198485
_MASK = 0xFFFFFFFF
#: Blocks of slots in a shard.
SLOT_BLOCKS = 2048
#: A walk to n shards takes ln(n) steps on average; one of more than this many steps is an error.
MOST_STEPS = 256


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(_long(_MASK))


def _low_product(x: Column, c: int) -> Column:
    """x * c modulo 2**32, up to multiples of 2**32, for x and c below 2**32, without overflow."""
    high = F.shiftright(x, 16) * _long(c & 0xFFFF)
    return F.shiftleft(high.bitwiseAND(_long(0xFFFF)), 16) + x.bitwiseAND(_long(0xFFFF)) * _long(c)


def _times(high: Column, low: Column, c: int, plus: int) -> tuple[Column, Column]:
    """word * c + plus modulo 2**64; 64-bit words as halves, since long products may not wrap."""
    c_high, c_low = c >> 32, c & _MASK
    upper, lower = F.shiftright(low, 16) * _long(c_low), low.bitwiseAND(_long(0xFFFF)) * _long(c_low) + plus
    bottom = lower + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16)
    top = F.shiftright(upper, 16) + F.shiftright(bottom, 32) + _low_product(high, c_low) + _low_product(low, c_high)
    return top.bitwiseAND(_long(_MASK)), bottom.bitwiseAND(_long(_MASK))


def jump_hash(key: Column, *counts: int) -> Column:
    """Struct of one shard number for each shard count, in one walk; ``key`` is a long."""
    most = max(counts)

    def step(s: Column, _: Column) -> Column:
        high, low = _times(s["high"], s["low"], GENERATOR, 1)
        reach = ((s["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        held = [F.when(s["jump"] < n, s["jump"]).otherwise(s[f"at{n}"]).alias(f"at{n}") for n in counts]
        moved = F.struct(high.alias("high"), low.alias("low"), reach.alias("jump"), *held)
        return F.when(s["jump"] < most, moved).otherwise(s)

    start = F.struct(
        *[half.alias(name) for name, half in zip(("high", "low"), _halves(key), strict=True)],
        _long(0).alias("jump"),
        *[_long(0).alias(f"at{n}") for n in counts],
    )
    done = lambda s: F.when(s["jump"] >= most, F.struct(*[s[f"at{n}"].cast("int").alias(f"at{n}") for n in counts])).otherwise(
        F.raise_error(F.lit("a jump-hash walk did not end"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(most, MOST_STEPS))), start, step, done)


def shard_rows(df: DataFrame, n_shards: int, key: str = "doc_id", slot_blocks: int = SLOT_BLOCKS, deal: Column | None = None) -> DataFrame:
    """Adds shard, grown_shard (with one more shard) and slot (gapless from 0 in a shard).

    An integer key is used as it is; any other by its xxhash64; null is the key 0.  Equal
    keys share a shard; repeated rows get slots of their own.  Slots are dealt in
    ``slot_blocks`` blocks a shard, by the key and ``deal`` (a number below 2**32 of the row; by default
    a hash of the other columns), so that neither a shard nor the rows of one key are sorted in
    one task; blocks are counted first.  The block counts (at most n_shards * slot_blocks rows)
    are broadcast while that product is below 100,000, else joined.  An empty table gives no
    rows.  Columns of these names are replaced, others stay whatever their names.
    """
    integral = isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    long_key = F.coalesce(F.col(key).cast("long") if integral else F.xxhash64(key), _long(0))
    df = df.drop("shard", "grown_shard", "slot")
    others = sorted(c for c in df.columns if c != key and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)))
    quoted = [F.col(f"`{c}`") for c in others]
    deal = F.xxhash64(F.lit(0), *quoted).bitwiseAND(_long(_MASK)) if deal is None else deal
    jump, block, row, offset, size = unused(df, "_jump", "_block", "_row", "_offset", "_size")
    place = (_times(*_halves(long_key), SPREAD, 0)[0] + deal).bitwiseAND(_long(_MASK))
    df = df.withColumn(jump, jump_hash(long_key, n_shards, n_shards + 1)).withColumns(
        {
            "shard": F.col(f"{jump}.at{n_shards}"),
            "grown_shard": F.col(f"{jump}.at{n_shards + 1}"),
            block: F.floor(place * slot_blocks / float(1 << 32)).cast("int"),
        }
    )
    df = df.drop(jump)
    counts = df.groupBy("shard", block).agg(F.count("*").alias(size))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", block, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    if n_shards * slot_blocks < 100_000:
        offsets = F.broadcast(offsets)
    order = Window.partitionBy("shard", block).orderBy(key, *quoted)
    return df.withColumn(row, F.row_number().over(order)).join(offsets, ["shard", block]).withColumn("slot", F.col(offset) + F.col(row) - 1).drop(block, row, offset)


def shard_digest(df: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; a null text is an empty one, a null doc_id the key 0.

    Texts are measured whole; repeated rows each have a slot of their own, in any order among
    themselves; an empty table gives none.  Columns beside doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = df.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return shard_rows(sized, n_shards, deal=F.col("text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
