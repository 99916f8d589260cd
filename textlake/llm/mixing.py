"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a shuffled order (by a digest of their id). A document's virtual finish
time is the source's tokens up to and with it, divided by the source's target; sources that must repeat
queue their documents a second time. The mix is the global order of finish times, cut off where the
total budget is spent.

Nothing walks a source in one task: running sums come from the sums of small shuffled buckets plus the
order inside each, and the cut from sums of bins of finish time, refined twice. As the part of a source
that is taken is a prefix of its queue, the decision is at last one threshold for each source and pass,
so the texts themselves are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, words

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows that a bucket of the shuffled order should hold, and bins of finish time in each of two rounds.
BUCKET_ROWS, BINS = 4096, 4096


def order_key(doc_id: Column, text: Column) -> Column:
    """The shuffled order: hex digits, equal for equal ids with equal texts."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source.

    Sources in order of code points, null last, take the weights in turn. ``share`` of all sizes is dealt
    by weight; no target exceeds ``most`` times its source's size, and the excess is dealt again by
    weight until none does. Filled in closed form: with sources ordered by cap / weight, those before the
    first whose cap holds under the level of the rest are capped.
    """
    i = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    ranked = sources.withColumn("i", i).withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    before = W.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = ranked.withColumn("level", rest / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.max("level").over(every)  # it rises while caps bind and falls after: its maximum is where they stop
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def queued(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``source, key, size``) with ``before``: sizes of the source's rows up to and with this key.

    ``n`` is the number of rows. The order is cut into buckets by leading hex digits of the key, in levels
    of 256, until a bucket has some hundred rows; sums of the levels add up to each bucket's offset.
    """
    levels = 1
    while n / 256**levels > 512:
        levels += 1
    prefix = lambda k: F.substring("key", 1, 2 * k)
    sums = rows.groupBy("source", prefix(levels).alias(f"p{levels}")).agg(F.sum("size").alias(f"s{levels}"))
    tables = {levels: sums}
    for k in range(levels - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("source", F.substring(f"p{k + 1}", 1, 2 * k).alias(f"p{k}")).agg(F.sum(f"s{k + 1}").alias(f"s{k}"))
    offsets = None
    for k in range(1, levels + 1):
        up = F.substring(f"p{k}", 1, 2 * k - 2)
        ahead = W.partitionBy("source", up).orderBy(f"p{k}").rowsBetween(W.unboundedPreceding, -1)
        here = tables[k].select("source", up.alias(f"p{k - 1}"), f"p{k}", F.coalesce(F.sum(f"s{k}").over(ahead), F.lit(0)).alias(f"o{k}"))
        if offsets is not None:
            here = _join(here, offsets, [f"p{k - 1}"]).withColumn(f"o{k}", F.col(f"o{k}") + F.col(f"o{k - 1}"))
        offsets = here.select("source", f"p{k}", f"o{k}")
    met = _join(rows.withColumn(f"p{levels}", prefix(levels)), offsets, [f"p{levels}"])
    inside = W.partitionBy("source", f"p{levels}").orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    return met.withColumn("before", F.col(f"o{levels}") + F.sum("size").over(inside)).drop(f"p{levels}", f"o{levels}")


def _join(left: DataFrame, right: DataFrame, also: list[str]) -> DataFrame:
    """On ``source``, where null equals null, and the columns ``also``; keeps the columns of ``left`` and the others of ``right``."""
    right = right.withColumnsRenamed({c: f"r_{c}" for c in ["source", *also]})
    on = F.col("source").eqNullSafe(F.col("r_source"))
    for c in also:
        on = on & (F.col(c) == F.col(f"r_{c}"))
    return left.join(right, on).drop(*[f"r_{c}" for c in ["source", *also]])


def finish_cut(copies: DataFrame, budget: float, rows_at_once: int = 10_000) -> float:
    """The largest finish time ``v`` such that the sizes of all ``copies`` (``v, size``) up to it stay within ``budget``.

    Bins of ``v`` are summed, the bin where the budget runs out is divided again, and so on until it has
    few rows: what reaches the driver is at most ``2 * BINS`` sums a round, and ``rows_at_once`` rows at last.
    """
    lo, width, spent, best = 0.0, 2.0 / BINS, 0, -1.0
    bin_of = F.least(F.floor(F.col("v") / width), F.lit(BINS))  # all that finish past 2 share a bin
    for _ in range(5):
        sums = sorted(tuple(r) for r in copies.groupBy(bin_of.cast("long").alias("b")).agg(F.sum("size"), F.count(F.lit(1)), F.max("v")).collect())
        crossing = None
        for b, size, n, top in sums:
            if spent + size > budget:
                crossing = (b, n)
                break
            spent, best = spent + size, top
        if crossing is None:
            return best
        b, n = crossing
        copies = copies.filter(bin_of == b)
        if n <= rows_at_once:
            break
        lo, span = lo + b * width, (width if b < BINS else 1e9)
        width = span / BINS
        bin_of = F.least(F.greatest(F.floor((F.col("v") - lo) / width), F.lit(0)), F.lit(BINS))
    for v, size in sorted(tuple(r) for r in copies.groupBy("v").agg(F.sum("size")).collect()):
        if spent + size > budget:
            break
        spent, best = spent + size, v
    return best


def _planned(docs: DataFrame, doc_id: str, text: str, source: str, weights, share, most) -> tuple[DataFrame, DataFrame, float]:
    """The queue (one row per document), the sources with their targets, and the finish time of the cut."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), order_key(F.col(doc_id), F.col(text)).alias("key"), F.size(words(F.col(text))).cast("long").alias("size")), "mix-sizes")
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-sources")
    line = _join(queued(rows, rows.count()), sources, [])
    v = lambda passes: F.when(F.col("target") > 0, (F.col("source_size") * passes + F.col("before")) / F.col("target"))
    line = cut(line.withColumn("v1", v(0)).withColumn("v2", v(1)), "mix-queue")
    budget = sources.agg(F.sum("target")).first()[0] or 0.0
    copies = line.filter("size > 0").select("size", F.explode(F.array("v1", "v2")).alias("v"))
    return line, sources, finish_cut(copies, budget)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``size`` counts words (null text: 0) and ``taken`` the words that the mix takes: 0, 1 or 2 times the
    size. Rows with the same source, doc_id and text tie: they finish together and are taken or left together; rows that share
    an id, or have none, and differ in text do not. Very long texts are counted whole. A null source is a source of its own, the last; an empty text takes no part. An empty table gives an
    empty result. Other columns, whatever their names, play no part. Reruns agree.
    """
    line, _, end = _planned(docs, doc_id, text, source, weights, share, most)
    times = F.when(F.col("v1") <= end, 1).otherwise(0) + F.when(F.col("v2") <= end, 1).otherwise(0)
    return line.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, broadcast_sources: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the columns of ``docs``; a row taken twice comes twice.

    Cases as in ``mix``. What a source gives is the head of its queue, so two keys for each source decide;
    they are broadcast only if there are at most ``broadcast_sources`` sources.
    """
    line, _, end = _planned(docs, doc_id, text, source, weights, share, most)
    last = lambda v: F.coalesce(F.max(F.when((F.col(v) <= end) & (F.col("size") > 0), F.col("key"))), F.lit(""))
    heads = cut(line.groupBy("source").agg(last("v1").alias("k1"), last("v2").alias("k2")), "mix-heads")
    if heads.count() <= broadcast_sources:
        heads = F.broadcast(heads)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), order_key(F.col(doc_id), F.col(text)).alias("key"), F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("has"))
    times = F.when(F.col("key") <= F.col("k1"), 1).otherwise(0) + F.when(F.col("key") <= F.col("k2"), 1).otherwise(0)
    return _join(rows.filter("has"), heads, []).select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("again")).select("row.*")
