"""Shards by jump consistent hashing, in DataFrame functions only.

A row's shard follows from its key and the number of shards alone; no ring and no table of shards exist. When shards are
appended, a key either stays where it is or goes to one of the new shards, so of n + 1 shards the new one takes a share of 1 / (n + 1)
of the rows and nothing else moves. The walk is that of Lamping and Veach (2014): a generator seeded with the key's hash
jumps over the shard counts at which the key moves, and the last jump below the number of shards is its shard.

A row's slot is its place in its shard, in the order of key, size and crc of the text. Rows are counted by what they are
first, so a key or text that repeats without end is one counted row; the counts are put in order by ranges, and a table with a row for
each range and shard says what lies before it. Numbers are dealt out again in pieces of PIECE, in as many tasks as there are.

Defined results: a null text has the size 8 and the crc of nothing. Null keys are one key of their own. Rows with equal keys are in
one shard and have a slot each; which of wholly equal rows has which slot doesn't show. An empty table gives an empty result; extra columns
are ignored by slots() and kept by sharded().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
#: Bytes that a stored row takes beside its text.
ROW_BYTES = 8
#: Fixed values of the generator (Lamping and Veach): its multiplier, by 32-bit halves and by 16 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF
#: Jumps that every row makes; a key that needs more (one in very many, with thousands of shards) walks again, as far as it must.
JUMPS = 48
#: Slots that a row gives out at once.
PIECE = 50_000


def key_hash(key: Column) -> Column:
    """64 bits of the key's text: the same whatever integer type holds it. Of null: the hash's seed."""
    return F.xxhash64(key.cast("string"))


def _advanced(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, (state * MULTIPLIER + 1) modulo 2^64, in 32-bit halves so that nothing overflows."""
    upper = F.shiftright(low, 16) * F.lit(_LOW)
    whole = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = F.shiftright(whole, 32) + F.shiftright(upper, 16)
    crossed = high * F.lit(_LOW & 0xFFFF) + F.shiftleft((high * F.lit(_LOW >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (carried + low * F.lit(_HIGH) + crossed).bitwiseAND(F.lit(_MASK)), whole.bitwiseAND(F.lit(_MASK))


def _walk(key: Column, shards: int, jumps: int) -> Column:
    """The state after so many jumps: at is the last shard count below `shards` at which the key moves, next the count after it."""
    seed = key_hash(key)
    start = F.struct(
        F.shiftrightunsigned(seed, 32).alias("high"), seed.bitwiseAND(F.lit(_MASK)).alias("low"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next")
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = _advanced(s["high"], s["low"])
        further = ((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.when(s["next"] >= shards, s).otherwise(F.struct(high.alias("high"), low.alias("low"), s["next"].alias("at"), further.alias("next")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, jump, lambda s: F.struct(s["at"].alias("at"), s["next"].alias("next")))


def placed(key: Column, shards: int = SHARDS) -> Column:
    """A struct of the key's shard (at), and the number of shards from which on, one more, the key moves (next)."""
    if shards < 1:
        raise ValueError("there must be a shard")
    first = _walk(key, shards, min(shards, JUMPS))
    if shards <= JUMPS:
        return first
    # The walk ends after as many jumps as there are shards at the latest.
    return F.when(first["next"] < shards, _walk(key, shards, shards)).otherwise(first)


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row."""
    return docs.withColumn(name, placed(F.col(key), shards)["at"].cast("int"))


def moved(docs: DataFrame, shards: int, to: int, key: str = "doc_id") -> DataFrame:
    """The rows of docs that are elsewhere among `to` shards, with their shards `old` and `new`."""
    return sharded(sharded(docs, shards, key, "old"), to, key, "new").where("old <> new")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", files: int = 1) -> None:
    """docs as Parquet in a folder for each shard, of up to `files` files each; the rows of a key are dealt to all of them."""
    rows = sharded(docs, shards, key).withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    rows.repartition(max(1, shards * files), "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)


def slots(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (with one shard more): a row for each row of docs."""
    as_bytes = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias(key), (F.octet_length(as_bytes) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(as_bytes).alias("text_crc32"))
    counted = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("_at", placed(F.col(key), shards))
    counted = counted.select(key, "size", "text_crc32", "n", F.col("_at.at").cast("int").alias("shard"), F.when(F.col("_at.next") == shards, F.lit(shards)).otherwise(F.col("_at.at")).cast("int").alias("grown_shard"))
    order = ["shard", key, "size", "text_crc32"]
    ranges = written(counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "slots")
    # A row for each range and shard in it: its size follows the number of partitions, not the rows.
    totals = ranges.groupBy("shard", "_part").agg(F.sum("n").alias("_n"))
    before = totals.select("shard", "_part", (F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = W.partitionBy("_part", "shard").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = ranges.withColumn("_own", F.sum("n").over(inside) - F.col("n")).join(before, ["_part", "shard"]).withColumn("_from", F.col("_own") + F.col("_before"))
    pieces = begun.select(*order, "grown_shard", "n", "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("_piece"))
    dealt = pieces.repartition(*order, "_piece")
    begin = F.col("_from") + F.col("_piece")
    return dealt.select(key, "size", "text_crc32", "shard", F.explode(F.sequence(begin, begin + F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("_piece")) - 1)).alias("slot"), "grown_shard")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of op12."""
    return slots(docs, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
