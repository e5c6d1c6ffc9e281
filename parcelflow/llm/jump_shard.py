"""Sharding by jump consistent hashing, in DataFrame expressions only.

The published algorithm (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm"): a 64-bit linear
congruential generator seeded by the key says at which shard counts the key jumps to the new last shard. No table
of shards is kept, and going from n to n + 1 shards moves about one row in n + 1, all into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, cut_copies, fresh

#: Fixed values of the published generator.
MULTIPLIER, INCREMENT = 2862933555777941757, 1

_MASK = (1 << 32) - 1
_HALF = (1 << 16) - 1


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state modulo 2^64 as two 32-bit halves; no product exceeds 62 bits."""
    c_high, c_low = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    c1, c0 = c_low >> 16, c_low & _HALF
    middle = low * c1
    below = low * c0 + F.shiftleft(middle.bitwiseAND(F.lit(_HALF)), 16) + INCREMENT
    cross = (low * c_high).bitwiseAND(F.lit(_MASK)) + (high * c0) + F.shiftleft((high * c1).bitwiseAND(F.lit(_HALF)), 16)
    above = F.shiftright(middle, 16) + F.shiftright(below, 32) + cross
    return above.bitwiseAND(F.lit(_MASK)), below.bitwiseAND(F.lit(_MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key; a null key counts as 0.

    Every turn raises the jump by one at least, so ``shards`` turns are enough.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def turn(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        jump = F.floor((state["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        going = state["jump"] < shards
        return F.struct(
            F.when(going, high).otherwise(state["high"]).alias("high"),
            F.when(going, low).otherwise(state["low"]).alias("low"),
            F.when(going, state["jump"]).otherwise(state["shard"]).alias("shard"),
            F.when(going, jump).otherwise(state["jump"]).alias("jump"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_MASK)).alias("low"), (zero - 1).alias("shard"), zero.alias("jump"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, turn, lambda s: s["shard"].cast("int"))


#: Rows that are numbered in one task, about.
BUCKET_ROWS = 50_000


def numbered(df: DataFrame, shard: str, rows: int) -> DataFrame:
    """Adds ``slot``: the ``rows`` rows are numbered within their shard from 0, without gaps.

    Rows that are the same in all columns are counted, map-side first, and dealt out again at the end, very many of them from several
    buckets. A shard is cut into buckets by a hash; a bucket's rows are numbered by themselves, and begin after those of the shard's
    buckets before it, of which there is one row each. So no task has much more than BUCKET_ROWS rows, whatever repeats.
    """
    copies, chunk, bucket, before, here = (fresh(n, df) for n in ("copies", "chunk", "bucket", "before", "here"))
    each = cut_copies(df.groupBy(*columns(df)).agg(F.count("*").alias(copies)), copies, chunk)
    buckets = max(1, -(-rows // BUCKET_ROWS))
    cut = each.withColumn(bucket, F.pmod(F.xxhash64(*columns(df), chunk), F.lit(buckets)))
    earlier = lambda w: F.coalesce(F.sum(copies).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut.groupBy(shard, bucket).agg(F.sum(copies).alias(copies))
    offsets = sizes.select(shard, bucket, earlier(Window.partitionBy(shard).orderBy(bucket)).alias(before))
    placed = cut.withColumn(here, earlier(Window.partitionBy(shard, bucket).orderBy(*columns(df), chunk))).join(offsets, [shard, bucket])
    first = F.col(before) + F.col(here)
    return placed.select(*columns(df), F.explode(F.sequence(first, first + F.col(copies) - 1)).alias("slot"))


def jump_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Null text has no bytes (size 1, CRC of nothing); a null id is the key 0. Repeated rows share a shard and have
    slots of their own. Other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(id_col), shards).alias("shard"),
        jump_hash(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    out = numbered(rows, "shard", docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
