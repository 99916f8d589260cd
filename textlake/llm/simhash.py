"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint has a bit where over half of the text's shingle hashes have it. To link fingerprints that differ
in at most four bits (or five), each is cut into three segments: of three segments one differs in at most one bit. The
table holds every distinct fingerprint under each segment; a query enumerates the ball of radius one around
its segment, fetches the table's matches and checks the whole distance. As the ball is walked from the
fingerprint whose segment has the 0, each pair is met once for a segment.

Copies share a fingerprint, so only distinct ones are compared. A segment value that many fingerprints
share is compared in blocks, in tasks of bounded size that return a spanning forest of the links they find
and not all pairs. Components come from rounds of hooking to the smallest neighbour; links and labels stay
in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, join_parts

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bit and width of each segment: one more than half the distance allows a ball of radius one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Candidate pairs of one segment value that a join may form; fingerprints in a block beyond that.
MOST_PAIRS, BLOCK = 4096, 1024


def shingle_hashes(text: str | None, shingle: int, seed: int) -> list[int]:
    """XXH64 of each shingle of a text's lower-cased words, repeats included; of fewer words, the whole; of none, nothing."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z alone, white space of ASCII alone
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; a text of fewer words is one shingle, one of none is 0."""
    hashes = shingle_hashes(text, shingle, SEED)
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # whole texts, in bounded pieces
        block = np.array(hashes[at : at + (1 << 16)], np.uint64)
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit number) for each row of ``docs``."""
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join what the links ``a``-``b`` join, at most ``n - 1`` of them."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            keep.append(i)
    return a[keep], b[keep]


def block_links(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two lists of fingerprints, as two columns of fingerprints."""
    both, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    l, r = place[: len(left)], place[len(left) :]
    seen_a, seen_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(left), 256):  # 256 x BLOCK distances at a time
        near = np.bitwise_count(left[at : at + 256, None].view(np.uint64) ^ right[None, :].view(np.uint64)) <= distance
        i, j = np.nonzero(near)
        a, b = _forest(np.concatenate([*seen_a, l[at + i]]), np.concatenate([*seen_b, r[j]]), len(both))
        seen_a, seen_b = [a], [b]
    apart = seen_a[0] != seen_b[0]
    return both[seen_a[0][apart]], both[seen_b[0][apart]]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints (column ``fp``) whose components are those of all links."""
    import pyarrow as pa

    if distance >= 2 * len(SEGMENTS):
        raise ValueError("balls of radius one find fewer than two differing bits a segment")

    keys = F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), *seg).alias("k")) for s, seg in enumerate(SEGMENTS)])
    table = fps.select("fp", F.explode(keys).alias("x")).select(F.col("x.s").cast("tinyint").alias("s"), F.col("x.k").cast("int").alias("k"), "fp")

    def ball(s: int, first: int, width: int) -> Column:
        here = _segment(F.col("fp"), first, width)
        flips = F.filter(F.transform(F.lit([1 << i for i in range(width)]).cast("array<bigint>"), lambda bit: F.when(here.bitwiseAND(bit) == 0, here.bitwiseOR(bit))), lambda k: k.isNotNull())
        return F.transform(F.concat(F.array(here), flips), lambda k: F.struct(F.lit(s).alias("s"), k.alias("k"), (k == here).alias("own")))

    probes = fps.select("fp", F.explode(F.concat(*[ball(s, *seg) for s, seg in enumerate(SEGMENTS)])).alias("x")).select(F.col("x.s").cast("tinyint").alias("s"), F.col("x.k").cast("int").alias("k"), "fp", "x.own")
    held = cut(table.groupBy("s", "k").agg(F.count(F.lit(1)).alias("held")), "simhash-held")
    # Spark would judge tables that were just written by their compressed size: these grow with the fingerprints and are never sent to every task.
    asked = probes.join(held.withColumnsRenamed({"s": "hs", "k": "hk"}).hint("merge"), (F.col("s") == F.col("hs")) & (F.col("k") == F.col("hk"))).drop("hs", "hk")
    # A key's own fingerprints alone find nothing: drop probes that meet only themselves.
    asked = cut(asked.filter(~(F.col("own") & (F.col("held") == 1))), "simhash-probes")
    busy = cut(asked.groupBy("s", "k").agg(F.count(F.lit(1)).alias("probes"), F.max("held").alias("held")).filter(F.col("probes") * F.col("held") > MOST_PAIRS).withColumnsRenamed({"s": "hs", "k": "hk"}), "simhash-busy")
    on_busy = (F.col("s") == F.col("hs")) & (F.col("k") == F.col("hk"))
    quiet_asked = asked.join(busy, on_busy, "left_anti").select("s", "k", "own", F.col("fp").alias("a"))
    quiet = quiet_asked.join(table.withColumnsRenamed({"s": "ts", "k": "tk", "fp": "b"}).hint("merge"), (F.col("s") == F.col("ts")) & (F.col("k") == F.col("tk")))
    quiet = quiet.filter((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (~F.col("own") | (F.col("a") < F.col("b")))).select("a", "b")

    # Busy keys: probes and table rows in blocks of about BLOCK, every block of one against every block of the other.
    rows_of = lambda df, n: df.join(busy.select("hs", "hk", F.col("probes").alias("np"), F.col("held").alias("nt")), on_busy).withColumn("mine", F.pmod(F.xxhash64("fp"), F.ceil(F.col(n) / BLOCK)))
    left = rows_of(asked.select("s", "k", "fp"), "np").select("s", "k", "fp", F.lit(True).alias("probe"), F.col("mine").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("nt") / BLOCK) - 1)).alias("j"))
    right = rows_of(table, "nt").select("s", "k", "fp", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("np") / BLOCK) - 1)).alias("i"), F.col("mine").alias("j"))

    def compare(block: pa.Table) -> pa.Table:
        fp, probe = block.column("fp").to_numpy(), block.column("probe").to_numpy()
        a, b = block_links(np.unique(fp[probe]), np.unique(fp[~probe]), distance)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    crowded = left.unionByName(right).groupBy("s", "k", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return quiet.unionByName(crowded).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node that it reaches.

    Large stars and small stars in turn (each node's larger neighbours are hooked to its smallest, then its
    smaller ones) until nothing changes: about the logarithm of the size of the largest component rounds.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def star(pairs: DataFrame, total: int) -> DataFrame:
        """Hook the neighbours ``v`` of each ``u`` to the smallest of them and ``u``."""
        least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("c"))
        return join_parts(pairs, least, "u", "c", total).drop("c")

    before, n = None, now.count()
    if not n:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(star(both, 2 * n).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large")
        starred = star(large, 2 * n)
        small = starred.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(starred.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        past, now = now, cut(small, "links")
        drop_table(past, large)
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before, n = mark, mark[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` for each row, and ``fp, n, component_id`` for each distinct fingerprint."""
    rows = cut(fingerprints(docs, doc_id, text, shingle), "simhash-fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = cut(components(links(classes.select("fp"), distance)), "simhash-components")
    # fingerprint -> smallest doc_id of its component, for fingerprints that have links
    named = found.join(classes.hint("merge"), F.col("node") == F.col("fp")).select("root", "node", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("c"))
    reached = join_parts(named, least, "root", "c", found.count()).select(F.col("node").alias("x"), "least")
    resolved = classes.join(reached.hint("merge"), F.col("fp") == F.col("x"), "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    return rows, cut(resolved, "simhash-resolved")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest doc_id that links reach, its own included. A null text has no words; texts
    without words have fingerprint zero and are linked like any other. A null doc_id takes part, but is
    no component's smallest unless it has no other (then null). Repeated rows are one class; an empty table
    gives an empty result; very long texts are read whole, in pieces; other columns play no part.
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    rows, resolved = _grouped(docs, doc_id, text, shingle, distance)
    return join_parts(rows, resolved, "fp", "n", rows.count()).select("doc_id", hexed, "component_id")
