"""Exact deduplication over an extendible-hash index kept in shared files.

Texts are equal when identical after lower-casing A-Z. Every row is an entry under a 64-bit key. A directory of
key prefixes doubles while a bucket is overfull; each bucket is a key range. Entries are counted by bucket and key; a key with one
entry is a chain of one. Keys with more are chained by the task that owns their bucket's part of the key range: the normalised texts
themselves are grouped, so equal bytes are one link of a chain and different bytes, whose keys collide, are two. Copies collapse in
each writing task before texts move, so a text that holds a third of all rows is one representative from each
task. Keys that occur once, most of them, move no text. The index has a row for each link, sorted by bucket and key in shared files,
and each entry is answered by its bucket, key and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_GONE, cut, join_parts, keep_judged, lower_ascii

#: Entries that a bucket may hold before it splits; bits that the directory may use beyond what even keys would need, and at all.
BUCKET_ENTRIES, SPARE_DEPTH, MAX_DEPTH = 200_000, 4, 20
#: Repeated keys, up to which they are sent to every task (some 30 MB); beyond that the texts are shuffled to them.
MOST_REPEATED = 500_000


def split_directory(cells: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Global depth and the directory: for each prefix of that many bits, the number of its bucket.

    ``cells`` counts entries by their first ``max_depth`` bits. Buckets start as one; an overfull bucket
    splits on its next bit, and when its depth equals the directory's the directory doubles. A bucket at
    ``max_depth`` stays as it is (its owner task spills). Bucket numbers ascend with the key range.
    """
    sums = [0] * (2 << max_depth)  # a binary trie of counts: node 1 is the root
    for cell, n in cells.items():
        node = (1 << max_depth) | cell
        while node:
            sums[node] += n
            node >>= 1
    leaves: list[tuple[int, int]] = []
    stack = [(1, 0)]
    while stack:
        node, depth = stack.pop()
        if sums[node] > capacity and depth < max_depth:
            stack += [(2 * node + 1, depth + 1), (2 * node, depth + 1)]
        else:
            leaves.append((node - (1 << depth), depth))
    size = max(d for _, d in leaves)
    directory: list[int] = []
    for bucket, (_, depth) in enumerate(leaves):  # leaves come in the order of their key ranges
        directory += [bucket] * (1 << (size - depth))
    return size, directory


def _norm(text: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def _keyed(norm: str) -> list[Column]:
    return [F.octet_length(norm).cast("long").alias("n"), F.xxhash64(norm).alias("h")]


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def entries_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, digest`` (SHA-256, hex), ``n`` (bytes) and ``h`` (64-bit key) of each row, as a table."""
    rows = docs.select(F.col(doc_id).alias("id"), _norm(text).alias("norm"))
    return cut(rows.select("id", F.sha2("norm", 256).alias("digest"), *_keyed("norm")), "exact-entries")


def directory_of(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> tuple[int, list[int]]:
    """The directory's depth and its buckets. The depth that it may reach grows with the number of entries."""
    most = min(MAX_DEPTH, SPARE_DEPTH + max(1, entries.count() // capacity).bit_length())
    counts = entries.groupBy(_prefix(F.col("h"), most).alias("cell")).agg(F.approx_count_distinct("h").alias("k"))
    return split_directory({r.cell: r.k for r in counts.collect()}, capacity, most)  # at most 2 ** most rows


def build_index(entries: DataFrame, texts: DataFrame, directory: tuple[int, list[int]], most_repeated: int = MOST_REPEATED) -> DataFrame:
    """The index of ``entries`` whose texts are ``texts`` (``id, norm``): ``bucket, h, digest, n, link, keep_id, group_size``.

    One row for each link of a chain. ``keep_id`` is the largest id; null loses to any other. Two links of one digest
    would be different bytes of one SHA-256 and raise an error.
    """
    bucket = bucket_of(directory)
    keys = cut(entries.groupBy(bucket.alias("bucket"), "h").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"), F.max("digest").alias("digest"), F.max("n").alias("n")), "exact-keys")
    alone = keys.filter("group_size = 1").select("bucket", "h", "digest", "n", F.lit(0).alias("link"), "keep_id", "group_size")
    repeated = keys.filter("group_size > 1").select(F.col("h").alias("repeated"))
    sent = F.broadcast if repeated.count() <= most_repeated else (lambda df: df.hint("merge"))
    met = texts.select("id", "norm", *_keyed("norm")).join(sent(repeated), F.col("h") == F.col("repeated"), "left_semi")
    # Grouping by the text itself compares bytes, in the writing task and then in the owner of the bucket's keys.
    links = met.groupBy(bucket.alias("bucket"), "h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = links.select("bucket", "h", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").cast("long").alias("n"), "keep_id", "group_size")
    chains = links.groupBy("bucket", "h").agg(F.sort_array(F.collect_list(F.struct("digest", "n", "keep_id", "group_size"))).alias("chain"))
    chained = chains.select("bucket", "h", F.posexplode("chain").alias("link", "e"), F.size(F.array_distinct("chain.digest")).alias("digests"), F.size("chain").alias("links"))
    checked = F.when(F.col("digests") == F.col("links"), F.col("e.digest")).otherwise(F.raise_error(F.lit("different texts of one SHA-256")))
    chained = chained.select("bucket", "h", checked.alias("digest"), F.col("e.n").alias("n"), "link", F.col("e.keep_id").alias("keep_id"), F.col("e.group_size").alias("group_size"))
    return cut(alone.unionByName(chained).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "link"), "exact-index")


def bucket_of(directory: tuple[int, list[int]]) -> Column:
    depth, buckets = directory
    return F.element_at(F.lit(buckets), _prefix(F.col("h"), depth) + 1)


def _answered(docs: DataFrame, doc_id: str, text: str, capacity: int) -> DataFrame:
    """``doc_id, digest, keep_id, group_size`` of each row."""
    entries = entries_of(docs, doc_id, text)
    directory = directory_of(entries, capacity)
    index = build_index(entries, docs.select(F.col(doc_id).alias("id"), _norm(text).alias("norm")), directory).drop("n", "link")
    met = join_parts(entries.select(F.col("id").alias("doc_id"), "h", "digest", bucket_of(directory).alias("bucket")), index, ["bucket", "h", "digest"], "group_size", entries.count())
    return met.select("doc_id", "digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty; empty texts equal
    one another. Very long texts are compared whole. Repeated rows (the same doc_id and text) count in ``group_size`` and are all
    marked kept if their doc_id is; ``drop_exact_copies`` keeps one of them. A null doc_id is smaller than any other.
    An empty table gives an empty result. Other columns, whatever their names, play no part.
    """
    met = _answered(docs, doc_id, text, capacity)
    return met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_ENTRIES, most_gone: int = MOST_GONE) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: of equal texts, one with the largest doc_id.

    Nulls, empty and very long texts, ties and an empty table as in ``exact_dedup``; of rows equal in doc_id and text one stays.
    """
    met = _answered(docs, doc_id, text, capacity).filter("group_size > 1")
    judged = met.groupBy("doc_id", "digest").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("times"))
    judged = judged.select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), "times")
    return keep_judged(docs, doc_id, F.sha2(_norm(text), 256), judged, most_gone)
