"""Near copies of a stated similarity: SimHash of 1,024 bits and multi-index hashing with balls ordered by certainty.

At a similarity of 0.8 of their word shingles, two texts differ in some 15 % of their fingerprints' bits: too many
for a ball of radius one in a few segments of 64 bits, and too uncertain an estimate from so few. So each shingle gives sixteen hashes
and a fingerprint has 1,024 bits, of which nine segments of 28 are the index. Which bits differ between near copies is no accident: a bit
flips where its count of ones lies near half. The Hamming ball around a segment is therefore walked from its least certain bits (subsets
of up to four of the nine least certain, in order of the votes that they would have to gain), and its first sixteen members are the
segment's keys. Two texts are candidates where they share a key, and then the complete distance is checked: at most
160 of 1,024 bits. README has the recall and what is found below 0.8.

Keys are numbers, sorted; a key's rows are a run. Short runs give their pairs. A long run (a group of near
copies) gives a star around its first text; only texts that are too far from the star's head are compared with
all others of the run, in blocks of bounded size that return a spanning forest. So no link between candidates is lost
and the work on a tight group is linear.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_GONE, cut, join_parts, keep_judged
from .simhash import SEED, components, shingle_hashes

SHINGLE, WORDS_OF_64, DISTANCE = 5, 16, 160
#: Segments and their bits; bits that may flip, flips at most, keys of each segment.
SEGMENTS, WIDTH = 9, 28
UNCERTAIN, FLIPS, KEYS = 9, 4, 16
#: Rows of a run whose pairs are all looked at; rows of a block of a longer run.
SHORT, BLOCK = 8, 1024
#: Rows of uncertain bits by subset: 1 where the bit flips.
SUBSETS = np.array([[j in c for j in range(UNCERTAIN)] for n in range(FLIPS + 1) for c in itertools.combinations(range(UNCERTAIN), n)])
FP = [f"f{i}" for i in range(WORDS_OF_64)]


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """A hash of a hash, for the ``i``-th word of a fingerprint."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def votes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """For each bit, how many more distinct shingles have it than not; no words: all 0."""
    hashes = np.unique(np.array(shingle_hashes(text, shingle, SEED), np.uint64))
    ones = np.zeros(64 * WORDS_OF_64, np.int64)
    for at in range(0, len(hashes), 1 << 12):  # whole texts, in bounded pieces
        words = np.stack([_mixed(hashes[at : at + (1 << 12)], i) for i in range(WORDS_OF_64)], 1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return 2 * ones - len(hashes)


def keys_of(margins: np.ndarray) -> np.ndarray:
    """The keys of each row of votes: ``SEGMENTS * KEYS`` numbers of 32 bits."""
    m = margins[:, : SEGMENTS * WIDTH].reshape(-1, WIDTH)
    own = (m > 0) @ (1 << np.arange(WIDTH, dtype=np.int64))
    unsure = np.argsort(np.abs(m), 1, kind="stable")[:, :UNCERTAIN]
    cost = np.take_along_axis(m, unsure, 1).astype(np.float32) ** 2
    first = np.argpartition(cost @ SUBSETS.T.astype(np.float32), KEYS - 1, 1)[:, :KEYS]
    flips = ((1 << unsure.astype(np.int64)) @ SUBSETS.T.astype(np.int64))[np.arange(len(m))[:, None], first]
    segment = np.tile(np.arange(SEGMENTS, dtype=np.int64), len(margins))
    keys = (own[:, None] ^ flips) + (segment[:, None] << WIDTH)
    return keys.reshape(len(margins), -1).astype(np.uint32).view(np.int32)


def marked(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, f0..f15, keys`` for each row."""
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            margins = np.stack([votes(t, shingle) for t in batch.column("text").to_pylist()])
            fp = np.packbits(margins > 0, axis=1, bitorder="little").view(np.int64)
            keys = keys_of(margins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(fp[:, i])) for i in range(WORDS_OF_64)], lists], ["doc_id", *FP, "keys"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{f} bigint' for f in FP)}, keys array<int>")


def _pairs(key: np.ndarray, fid: np.ndarray) -> list[tuple]:
    """Of complete runs, ``(key or None, salt, a, b)``: all pairs of short ones, stars of long ones."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lens = np.diff(np.r_[starts, len(key)])
    out = []
    for n in range(2, SHORT + 1):
        at = starts[lens == n]
        if len(at):
            i, j = np.triu_indices(n, 1)
            run = fid[at[:, None] + np.arange(n)]
            out.append((None, np.zeros(len(at) * len(i), np.int32), run[:, i].reshape(-1), run[:, j].reshape(-1)))
    for s, n in zip(starts[lens > SHORT].tolist(), lens[lens > SHORT].tolist(), strict=True):
        out.append(_star(key[s], fid[s], fid[s + 1 : s + n], 1))
    return out


def _star(key: int, head: int, others: np.ndarray, at: int) -> tuple:
    return int(key), ((at + np.arange(len(others))) // BLOCK).astype(np.int32), np.full(len(others), head), others


def meetings(rows: DataFrame) -> DataFrame:
    """``key, salt, a, b`` from ``key, fid``: candidates; with a key where they are of the star of a long run."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int32), np.empty(0, np.int64)
        long: list | None = None  # key, head and length so far of a run that goes on

        def out(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            for key, salt, a, b in found:
                keys = pa.nulls(len(a), pa.int32()) if key is None else pa.array(np.full(len(a), key, np.int32))
                yield pa.RecordBatch.from_arrays([keys, pa.array(salt), pa.array(a), pa.array(b)], ["key", "salt", "a", "b"])

        for batch in batches:
            k, f = batch.column("key").to_numpy(), batch.column("fid").to_numpy()
            if long is not None:
                same = len(k) if (k == long[0]).all() else int(np.argmax(k != long[0]))
                yield from out([_star(long[0], long[1], f[:same], long[2])])
                long[2] += same
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                long = None
            k, f = np.r_[held_k, k], np.r_[held_f, f]
            if not len(k):
                continue
            last = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            if len(k) - last > SHORT:
                long, held_k, held_f = [int(k[-1]), int(f[last]), len(k) - last], k[:0], f[:0]
            else:
                held_k, held_f, k, f = k[last:], f[last:], k[:last], f[:last]
            if len(k):
                yield from out(_pairs(k, f))
        if len(held_k):
            yield from out(_pairs(held_k, held_f))

    return rows.repartition("key").sortWithinPartitions("key", "fid").mapInArrow(work, "key int, salt int, a bigint, b bigint")


def far_links(rest: np.ndarray, rest_fp: np.ndarray, other: np.ndarray, other_fp: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links between ``rest`` and ``other`` that join what all links within the distance join."""
    ids = np.unique(np.r_[rest, other])
    label, there = np.arange(len(ids)), np.searchsorted(ids, other)
    a, b = [], []
    for r, fp, here in zip(rest.tolist(), rest_fp, np.searchsorted(ids, rest).tolist(), strict=True):
        open_ = np.flatnonzero(label[there] != label[here])
        near = open_[np.bitwise_count(other_fp[open_] ^ fp).sum(1) <= distance]
        if len(near):
            _, one = np.unique(label[there[near]], return_index=True)
            a += [r] * len(one)
            b += other[near[one]].tolist()
            label[np.isin(label, label[there[near]])] = label[here]
    return a, b


def _distance(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))) for i in range(WORDS_OF_64)), F.lit(0))


def wide_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` of ``classes`` (``fid, f0..f15, keys``) whose components are those of all candidates within the distance."""
    import pyarrow as pa

    met = cut(meetings(classes.select(F.explode("keys").alias("key"), "fid")), "near-met")
    fps = lambda name, p: classes.select(F.col("fid").alias(name), *[F.col(f).alias(f"{p}{i}") for i, f in enumerate(FP)])
    near = _distance("p", "q") <= distance
    short = met.filter("key IS NULL").select("a", "b").distinct()
    short = short.join(fps("x", "p").hint("merge"), F.col("a") == F.col("x")).join(fps("y", "q").hint("merge"), F.col("b") == F.col("y")).filter(near).select("a", "b")
    stars = met.filter("key IS NOT NULL")
    # The head of a star is one text for many rows: it is sent once for each BLOCK of them.
    heads = stars.select(F.col("a").alias("h"), F.col("salt").alias("s")).distinct().join(fps("x", "p").hint("merge"), F.col("h") == F.col("x")).drop("x")
    star = stars.join(heads.hint("merge"), (F.col("a") == F.col("h")) & (F.col("salt") == F.col("s"))).join(fps("y", "q").hint("merge"), F.col("b") == F.col("y"))
    star = cut(star.select("key", "a", "b", near.alias("near"), *[F.col(f"q{i}").alias(f) for i, f in enumerate(FP)]), "near-stars")
    found = short.unionByName(star.filter("near").select("a", "b"))
    rest = star.filter("NOT near")
    if rest.isEmpty():
        return cut(found.distinct(), "near-links")
    crowds = cut(star.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("n_rest")).filter("n_rest > 0"), "near-crowds")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    place = lambda n: F.pmod(F.xxhash64("b"), blocks(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    within = lambda df: df.join(crowds.withColumnRenamed("key", "c"), F.col("key") == F.col("c"))
    left = within(rest).select("key", "b", *FP, F.lit(True).alias("far"), place("n_rest").alias("i"), each("n").alias("j"))
    right = within(star).select("key", "b", *FP, F.lit(False).alias("far"), each("n_rest").alias("i"), place("n").alias("j"))

    def compare(block: pa.Table) -> pa.Table:
        far, ids = block.column("far").to_numpy(), block.column("b").to_numpy()
        fp = np.stack([block.column(f).to_numpy() for f in FP], 1).view(np.uint64)
        a, b = far_links(ids[far], fp[far], ids[~far], fp[~far], distance)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    crowded = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return cut(found.unionByName(crowded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "near-links")


def near_classes(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, f0..f15`` for each row, and for each fingerprint that has copies or links ``f0..f15, n, least``.

    ``n`` counts the fingerprint's rows; ``least`` is the smallest doc_id of its component.
    """
    rows = cut(marked(docs, doc_id, text, shingle), "near-rows")
    grouped = rows.groupBy(*FP).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("keys").alias("keys"))
    classes = cut(grouped.withColumn("fid", F.monotonically_increasing_id()), "near-classes")
    found = cut(components(wide_links(classes, distance)), "near-components")
    named = found.join(classes.select("fid", "first").hint("merge"), F.col("node") == F.col("fid")).select("root", "node", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("c"))
    reached = join_parts(named, least, "root", "c", found.count()).select(F.col("node").alias("x"), "least")
    resolved = classes.drop("keys").join(reached.hint("merge"), F.col("fid") == F.col("x"), "left").filter("n > 1 OR least IS NOT NULL")
    return rows.drop("keys"), cut(resolved.select(*FP, "n", F.coalesce("least", "first").alias("least")), "near-resolved")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, most_gone: int = MOST_GONE) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near copies, with the columns of ``docs``.

    A group is what links of fingerprints within the distance join. The row with the smallest doc_id stays, one without an
    id only where no row of the group has one; of several with that doc_id, the one whose text has the smallest digest, and of
    rows equal in both, one. Groups share nothing, whatever ids repeat in them. A null text has no words; texts without words
    are copies of one another, texts of fewer words than a shingle are one shingle. Very long texts are read whole, in pieces.
    Repeated rows are copies. An empty table gives an empty result. Other columns are carried along and play no part.

    Texts are not shuffled unless more than ``most_gone`` rows go: only the ids and digests of those that go are sent out.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    named = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), digest.alias("digest"))
    rows, resolved = near_classes(docs.select(named.alias("named"), F.col(text).alias("text")), "named", "text", shingle, distance)
    met = join_parts(rows, resolved, FP, "n", rows.count()).select("doc_id", "least")
    # Equal texts are in one class, so an id and a digest are of one class at most.
    judged = met.groupBy("doc_id").agg(F.max("least").alias("least"), F.count(F.lit(1)).alias("times"))
    judged = judged.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.digest").alias("digest"), F.col("doc_id").eqNullSafe(F.col("least")).alias("stays"), "times")
    return keep_judged(docs, doc_id, digest, judged, most_gone)
