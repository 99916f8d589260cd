"""Sharding by sampled splitters: shards of near equal bytes.

Records are put in one global order, by a digest of the text and then one of the id, so equal texts are
neighbours and a hot group can still be cut anywhere. Keys are drawn in proportion to size, quantiles of the
draw become splitters, and the records are dealt to the ranges between them; a range found overfull gets
more splitters. Inside a range running sums give each record its place, and places become shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SHARDS, OVERHEAD = 24, 8
#: Ranges for each shard at least; rows that a range should hold; ranges at most; draws for each range.
RANGES, RANGE_ROWS, MOST_RANGES, DRAWS = 16, 2000, 8192, 12


def order_key(doc_id: Column, text: Column) -> Column:
    """Digests of text and id as one string: equal texts stand together, and their rows in shuffled order."""
    return F.concat(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")))


def range_of(key: Column, splitters: list[str]) -> Column:
    """The number of ``splitters`` (ascending) at or below ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    steps = 1
    while steps * 2 <= len(splitters):
        steps *= 2
    halves = []
    while steps:
        halves.append(steps)
        steps //= 2
    table, n = F.lit(splitters), len(splitters)
    return F.aggregate(F.lit(halves), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.element_at(table, F.least(at + step, F.lit(n))) <= key), at + step).otherwise(at))


def draw(rows: DataFrame, draws: int, total: int) -> list[str]:
    """About ``draws`` keys in ascending order, each row drawn ``size * draws / total`` times on average.

    Reruns agree: the part below one draw is settled by a digest of the key, not by chance.
    """
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(F.col("size") * F.lit(draws / total) + chance).cast("int")
    found = rows.select("key", times.alias("times")).filter("times > 0").collect()  # about `draws` rows
    return sorted(k for r in found for k in [r.key] * r.times)


def splitters_for(rows: DataFrame, ranges: int, total: int, rounds: int = 3) -> list[str]:
    """Splitters of some ``ranges`` ranges; ranges over twice their due are drawn from again and subdivided."""
    drawn = draw(rows, ranges * DRAWS, total)
    splitters = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)} if drawn else set())
    for _ in range(rounds):
        held = rows.groupBy(range_of(F.col("key"), splitters).alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row for each range
        over = {x.r: x.size for x in held if x.size > 2 * total / ranges and x.n > 1 or x.n > 4 * RANGE_ROWS and ranges < MOST_RANGES}
        if not over:
            break
        full = rows.withColumn("r", range_of(F.col("key"), splitters)).filter(F.col("r").isin(list(over)))
        found = full.groupBy("r").agg(F.min_by("key", F.xxhash64("key")).alias("a"), F.max_by("key", F.xxhash64("key")).alias("b")).collect()  # two keys of each: a cut of random place
        more = set(splitters) | {x.a for x in found} | {x.b for x in found}
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    return splitters


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, under the law ``bytes``.

    ``size`` is the text's UTF-8 bytes plus 8 (a null text has none, and the CRC of an empty text). A record
    goes to the shard in which the middle of its bytes falls, so sizes differ from equal shares by at most
    one record at either end; ``slot`` counts a shard's records from 0 without gaps. Repeated rows are
    records of their own; those alike in text and doc_id tie, and share out their places in any order. A null
    doc_id is like an empty one. An empty table gives an empty result. Other columns play no part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), order_key(F.col(doc_id), F.col(text)).alias("key")), "shard-keys")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 1
    ranges = min(MOST_RANGES, max(RANGES * shards, n // RANGE_ROWS))
    splitters = splitters_for(rows, ranges, total)
    dealt = rows.withColumn("r", range_of(F.col("key"), splitters))
    held = dealt.groupBy("r").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    ahead = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select(F.col("r").alias("at"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"))
    inside = W.partitionBy("r").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(W.partitionBy("r").orderBy("key", "doc_id")))
    placed = placed.join(offsets, F.col("r") == F.col("at"))
    middle2 = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")  # twice the middle, so that it is whole
    placed = placed.select("doc_id", "size", "text_crc32", F.floor(middle2 * shards / F.lit(2 * total)).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("rank"))
    placed = cut(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()  # a row for each shard
    first = F.coalesce(*[F.when(F.col("shard") == x.shard, F.lit(x.first)) for x in firsts], F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
