"""Suffix-array deduplication, built blockwise with a difference cover.

To remove are the bytes of every string of ``length`` bytes that starts in two places or more. Only ties
of that length between suffixes matter, so a suffix is named by its first bytes, and equal names are found
by sorting one bucket of names at a time: a bucket is a range of leading bits and its size is bounded, so
memory is too. The first round's names are sums of powers, cheap to have for every sample; unequal names are unequal strings, so
no repeat is lost, and what ties by chance leaves in the rounds after. These decide, and their names are XXH3 hashes of the bytes
themselves with 112 bits: at 100 TB two different strings tie with a probability of about 1e-6.

1. Cover samples. Positions whose remainders by ``v`` lie in a perfect difference cover are sampled: two
   suffixes of any remainders have, fewer than ``v`` bytes on, samples at the same distance. Each sample is
   ranked by its first ``length - v + 1`` bytes. A suffix without a tied sample within ``v`` bytes has no twin.
2. Long ties. A tied sample is ranked again by its surroundings, from ``v - 1`` bytes before it to ``length``
   after. Where these tie, all ``v`` suffixes before the sample tie, and none of them is looked at singly.
3. What is left, and one representative of each long tie, is sorted suffix by suffix.

Documents lie in compressed chunks in tables of the shared folder. A chunk sends each of its names to a bucket
once, so a passage that a third of all documents hold is an entry for each chunk; a bucket answers
with bits. Documents without a tied sample leave after the first round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table

LENGTH = 200
#: Perfect difference covers by their period; each difference is met once.
COVERS: dict[int, tuple[int, ...]] = {
    1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
}
#: Bytes of text in a chunk; positions named at once; names in a bucket, about; bits of a sample's rank past those that count them.
CHUNK, SEGMENT, BUCKET_NAMES, SPARE_BITS = 4 << 20, 1 << 18, 2_000_000, 10
#: Buckets of a task, about.
BUCKETS_A_TASK = 4
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def period_for(length: int) -> int:
    """The largest period of which two fit into ``length``: samples are then ranked by half of it or more."""
    return max(v for v in COVERS if 2 * v <= length + 1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    letters = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    return np.cumprod(up), np.cumprod(down), letters


def names(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` bytes at ``starts`` (ascending), a segment at a time."""
    out = np.empty(len(starts), np.uint64)
    up, down, letters = _powers(SEGMENT + length)
    bounds = np.searchsorted(starts, np.arange(0, len(text) + SEGMENT, SEGMENT))
    for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if i == j:
            continue
        part = letters[text[k * SEGMENT : (k + 1) * SEGMENT + length]]
        part *= up[: len(part)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        at = starts[i:j] - k * SEGMENT
        out[i:j] = (sums[at + length] - sums[at]) * down[at]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(32)
    return out


#: A name as two numbers, by which it sorts, and the bits of the second that are kept: 112 in all.
STRONG, KEPT = np.dtype([("hi", np.uint64), ("lo", np.uint64)]), np.uint64((1 << 48) - 1)


def strong_names(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH3 hashes (112 bits) of the strings of ``length`` bytes at ``starts``."""
    import xxhash

    raw, digest = memoryview(np.ascontiguousarray(text)), xxhash.xxh3_128_digest
    out = np.frombuffer(b"".join([digest(raw[a : a + length]) for a in starts.tolist()]), STRONG).copy()
    out["lo"] &= KEPT
    return out


def sorted_order(found: np.ndarray) -> np.ndarray:
    """The order of names; equal ones stay in theirs."""
    return np.argsort(found, kind="stable") if found.dtype != STRONG else np.lexsort((found["lo"], found["hi"]))


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names in order, the first place of each, the number of each name, and how often each occurs."""
    order = sorted_order(found)
    ranked = found[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)]
    place = np.empty(len(found), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ranked[starts], order[starts], place, np.diff(np.r_[starts, len(ranked)])


def packed_names(ranked: np.ndarray) -> bytes:
    """Sorted names compressed: differences of what sorts them, then the rest as it is."""
    if ranked.dtype != STRONG:
        return packed(np.diff(ranked, prepend=np.uint64(0)))
    return packed(np.r_[np.diff(ranked["hi"], prepend=np.uint64(0)), ranked["lo"]])


def unpacked_names(raw: bytes, strong: bool) -> np.ndarray:
    values = unpacked(raw)
    if not strong:
        return np.cumsum(values, dtype=np.uint64)
    out = np.empty(len(values) // 2, STRONG)
    out["hi"], out["lo"] = np.cumsum(values[: len(out)], dtype=np.uint64), values[len(out) :]
    return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers compressed, byte plane by byte plane."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def squeezed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueezed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the intervals, ends excluded; both bounds ascend."""
    step = np.zeros(n + 1, np.int8)
    if len(begins):
        apart = begins[1:] > ends[:-1]
        step[begins[np.concatenate([[True], apart])]] = 1
        step[ends[np.concatenate([apart, [True]])]] = -1
    return np.cumsum(step[:n], dtype=np.int8).astype(bool)


class Chunk:
    """Texts end to end (``text``), the ends of the documents (``ends``), and the rounds' places in them."""

    def __init__(self, raw: bytes, ends: np.ndarray, length: int):
        self.text, self.ends, self.length, self.v = np.frombuffer(raw, np.uint8), ends, length, period_for(length)
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def samples(self) -> np.ndarray:
        sizes = self.ends - self.begins
        most = int(sizes.max(initial=0))
        cover = (np.arange(0, most + self.v, self.v)[:, None] + np.array(sorted(COVERS[self.v]))).reshape(-1)
        counts = np.searchsorted(cover, sizes - (self.length - self.v + 1), "right")  # a sample's string ends inside its document
        counts[sizes < self.length] = 0
        return np.concatenate([np.empty(0, np.int64), *[cover[:n] + b for n, b in zip(counts.tolist(), self.begins.tolist(), strict=True) if n]])

    def sample_names(self, at: np.ndarray) -> np.ndarray:
        return names(self.text, at, self.length - self.v + 1)

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the documents that hold the places ``at``."""
        doc = np.searchsorted(self.ends, at, "right")
        return self.begins[doc], self.ends[doc]

    def surrounded(self, at: np.ndarray) -> np.ndarray:
        """Those samples whose whole surroundings lie in their documents."""
        begin, end = self.bounds(at)
        return at[(at - self.v + 1 >= begin) & (at + self.length <= end)]

    def surrounding_names(self, at: np.ndarray) -> np.ndarray:
        return strong_names(self.text, at - self.v + 1, self.v + self.length - 1)

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        """Which places are suffixes that a sample of ``at`` stands for."""
        begin, end = self.bounds(at)
        a, b = np.maximum(at - self.v + 1, begin), np.minimum(at, end - self.length) + 1
        return covered(len(self.text), a[a < b], b[a < b])


def to_buckets(found: np.ndarray, bits: int, bucket_bits: int) -> list[tuple[int, int, bytes, bytes]]:
    """(bucket, names, their differences packed, bits of those met twice) for the sorted distinct names of a chunk."""
    kept, _, _, times = distinct(found)
    leading = kept["hi"] if kept.dtype == STRONG else kept
    edges = np.searchsorted(leading >> np.uint64(bits - bucket_bits), np.arange(1 << bucket_bits)) if bucket_bits else np.array([0])
    edges = [*edges.tolist(), len(kept)]
    return [(b, j - i, packed_names(kept[i:j]), squeezed(np.packbits(times[i:j] > 1).tobytes())) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]


BUCKETED = "bucket int, chunk bigint, n bigint, names binary, twice binary"


def bucket_ties(entries: list[tuple[int, int, bytes, bytes]], strong: bool) -> list[tuple[int, int, bytes, bytes]]:
    """Sort one bucket of (chunk, n, names, twice): for each chunk, bits of its names that tie, and of those it represents."""
    entries = sorted(entries, key=lambda e: e[0])
    sizes = [n for _, n, _, _ in entries]
    found = np.concatenate([unpacked_names(raw, strong) for _, _, raw, _ in entries])
    twice = np.concatenate([np.unpackbits(np.frombuffer(unsqueezed(t), np.uint8), count=n) for _, n, _, t in entries]).astype(bool)
    order = sorted_order(found)  # equal names stay in the order of their chunks
    ranked = found[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    run = np.cumsum(first) - 1
    tied_run = (np.bincount(run) > 1) | (np.bincount(run, twice[order]) > 0)
    tied, leads = np.empty(len(found), bool), np.empty(len(found), bool)
    tied[order], leads[order] = tied_run[run], first & tied_run[run]
    cuts = np.cumsum([0, *sizes]).tolist()
    return [(e[0], e[1], squeezed(np.packbits(tied[a:b]).tobytes()), squeezed(np.packbits(leads[a:b]).tobytes())) for e, a, b in zip(entries, cuts, cuts[1:], strict=False)]


def answers(found: np.ndarray, replies: list[tuple[int, int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each name of a chunk whether it ties, and whether it is the one place that represents its tie."""
    _, first, place, _ = distinct(found)
    replies = sorted(replies, key=lambda r: r[0])
    bits = [np.concatenate([np.empty(0, np.uint8), *[np.unpackbits(np.frombuffer(unsqueezed(r[k]), np.uint8), count=r[1]) for r in replies]]).astype(bool) for k in (2, 3)]
    leads = np.zeros(len(found), bool)
    leads[first[bits[1]]] = True
    return bits[0][place], leads


def _chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` as rows of about CHUNK bytes: ``chunk, ids, ends, body``, all compressed."""
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, count = TaskContext.get().partitionId() << 32, 0
        ids, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in held])
            row = {"chunk": place + count, "ids": ids, "ends": ends.tolist(), "body": squeezed(b"".join(held))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("ids", pa.list_(id_type)), ("ends", pa.list_(pa.int64())), ("body", pa.binary())]))

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                held.append(t.as_py())
                size += len(held[-1])
                if size >= CHUNK:
                    yield out()
                    ids, held, size, count = [], [], 0, count + 1
        if ids:
            yield out()

    return rows.mapInArrow(work, f"chunk bigint, ids array<{kind}>, ends array<bigint>, body binary")


def _ties(chunks: DataFrame, names_of: Callable[[Chunk, dict], np.ndarray], length: int, bits: int, bucket_bits: int, name: str, strong: bool = True) -> DataFrame:
    """The table ``chunk, bucket, n, tied, leads`` of the buckets' answers. Partitions grow with the buckets: a task has a few at most."""
    import pyarrow as pa

    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bucket_bits) // BUCKETS_A_TASK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = names_of(Chunk(unsqueezed(row["body"]), np.array(row["ends"], np.int64), length), row)
                if len(found):
                    cut_off = found if found.dtype == STRONG else found >> np.uint64(64 - bits)
                    b, n, keys, twice = zip(*to_buckets(cut_off, bits, bucket_bits), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([row["chunk"]] * len(b), pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(twice, pa.binary())], ["bucket", "chunk", "n", "names", "twice"])

    def sort(bucket: pa.Table) -> pa.Table:
        got = bucket_ties(list(zip(*[bucket.column(c).to_pylist() for c in ("chunk", "n", "names", "twice")], strict=True)), strong)
        chunk, n, tied, leads = zip(*got, strict=True)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([bucket.column("bucket")[0].as_py()] * len(chunk), pa.int32()), "n": pa.array(n, pa.int64()), "tied": pa.array(tied, pa.binary()), "leads": pa.array(leads, pa.binary())})

    sent = chunks.mapInArrow(send, BUCKETED)
    return cut(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort, "chunk bigint, bucket int, n bigint, tied binary, leads binary"), f"suffix-{name}")


def _answered(chunks: DataFrame, ties: DataFrame, work: Callable, name: str, kind: str) -> DataFrame:
    """``chunks`` met with the answers to them: ``work(row, replies)`` gives the rows of the next table."""
    import pyarrow as pa

    state = [c for c in chunks.columns if c != "chunk"]
    asked = chunks.select("chunk", *state, *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("n", "bigint"), ("tied", "binary"), ("leads", "binary"))])
    replies = ties.select("chunk", *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in state], "bucket", "n", "tied", "leads")

    def meet(group: pa.Table) -> pa.Table:
        own = pa.compute.is_null(group.column("bucket"))
        row = group.filter(own).slice(0, 1).to_pylist()[0]
        got = group.filter(pa.compute.invert(own))
        out = work(row, list(zip(*[got.column(c).to_pylist() for c in ("bucket", "n", "tied", "leads")], strict=True)))
        id_type = group.schema.field("ids").type
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("done", pa.bool_()), ("ids", id_type), ("ends", pa.list_(pa.int64())), ("body", pa.binary()), ("a", pa.binary()), ("b", pa.binary())]))

    return cut(asked.unionByName(replies).groupBy("chunk").applyInArrow(meet, f"chunk bigint, done boolean, ids array<{kind}>, ends array<bigint>, body binary, a binary, b binary"), f"suffix-{name}")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans`` (array of begin and end, removed bytes), ``kept`` (binary).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same document
    or another; matches never cross documents and are judged on the input. What is kept may begin or end
    inside a character. A null text is empty; an empty or short text loses nothing; repeated rows are
    documents of their own and so lose everything if long enough; a null doc_id is carried along; an empty
    table gives an empty result; other columns play no part. Very long texts are a chunk of their own. Two different strings are
    taken for equal only where 112-bit hashes of their bytes collide.
    """
    import pyarrow as pa

    kind = docs.schema[doc_id].dataType.simpleString()
    chunks = cut(_chunks(docs, doc_id, text), "suffix-chunks")
    total = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    v = period_for(length)
    bucket_bits = lambda n: max(6, int(n // BUCKET_NAMES).bit_length())
    n_samples = total * len(COVERS[v]) // v + 1
    bits = min(64, max(32, n_samples.bit_length() + SPARE_BITS))
    of = lambda row: Chunk(unsqueezed(row["body"]), np.array(row["ends"], np.int64), length)

    def part(row: dict, chunk: Chunk, docs_kept: np.ndarray) -> dict:
        sizes = (chunk.ends - chunk.begins)[docs_kept]
        body = chunk.text[np.repeat(docs_kept, chunk.ends - chunk.begins)].tobytes()
        return {"chunk": row["chunk"], "ids": [row["ids"][i] for i in np.flatnonzero(docs_kept)], "ends": np.cumsum(sizes).tolist(), "body": squeezed(body)}

    def first(row: dict, replies: list) -> list[dict]:
        chunk = of(row)
        at = chunk.samples()
        at = at[answers(chunk.sample_names(at) >> np.uint64(64 - bits), replies)[0]] if len(at) else at
        doc = np.searchsorted(chunk.ends, at, "right")
        held = np.zeros(len(chunk.ends), bool)
        held[doc] = True
        lost = np.concatenate([[0], np.cumsum(np.where(held, 0, chunk.ends - chunk.begins))])  # bytes of documents that leave
        out = [part(row, chunk, held) | {"done": False, "a": packed(np.diff(at - lost[doc], prepend=0)), "b": b""}] if held.any() else []
        return out + ([part(row, chunk, ~held) | {"done": True, "a": b"", "b": b""}] if not held.all() else [])

    def second(row: dict, replies: list) -> list[dict]:
        chunk, at = of(row), unpacked(row["a"]).astype(np.int64).cumsum()
        whole = chunk.surrounded(at)
        tied, leads = answers(chunk.surrounding_names(whole), replies) if len(whole) else (np.empty(0, bool),) * 2
        long = chunk.suffixes(whole[tied])
        left = (chunk.suffixes(at) & ~long) | chunk.suffixes(whole[leads])
        return [{k: row[k] for k in ("chunk", "ids", "ends", "body")} | {"done": False, "a": squeezed(np.packbits(long).tobytes()), "b": squeezed(np.packbits(left).tobytes())}]

    mask = lambda raw, chunk: np.unpackbits(np.frombuffer(unsqueezed(raw), np.uint8), count=len(chunk.text)).astype(bool)

    def third(row: dict, replies: list) -> list[dict]:
        chunk = of(row)
        starts, at = mask(row["a"], chunk), np.flatnonzero(mask(row["b"], chunk))
        if len(at):
            starts[at[answers(strong_names(chunk.text, at, length), replies)[0]]] = True
        at = np.flatnonzero(starts)
        return [{k: row[k] for k in ("chunk", "ids", "ends", "body")} | {"done": True, "a": squeezed(np.packbits(covered(len(chunk.text), at, at + length)).tobytes()), "b": b""}]

    ranked = _ties(chunks, lambda c, _: c.sample_names(c.samples()), length, bits, bucket_bits(n_samples), "ranks", strong=False)
    now = _answered(chunks, ranked, first, "tied", kind)
    drop_table(chunks, ranked)
    done, now1 = now.filter("done"), now.filter("NOT done").drop("done")
    ties = _ties(now1, lambda c, row: c.surrounding_names(c.surrounded(unpacked(row["a"]).astype(np.int64).cumsum())), length, 64, bucket_bits(n_samples // 4), "long")
    looked = _answered(now1, ties, second, "left", kind)
    drop_table(ties)
    now2 = looked.drop("done")
    ties = _ties(now2, lambda c, row: strong_names(c.text, np.flatnonzero(mask(row["b"], c)), length), length, 64, bucket_bits(total // 8), "suffixes")
    judged = _answered(now2, ties, third, "judged", kind)
    drop_table(looked, ties)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                chunk = of(row)
                gone = mask(row["a"], chunk) if row["a"] else np.zeros(len(chunk.text), bool)
                for at in range(0, len(chunk.ends), 256):
                    spans, kept = [], []
                    for a, b in zip(chunk.begins[at : at + 256].tolist(), chunk.ends[at : at + 256].tolist(), strict=True):
                        edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).tolist()
                        spans.append([{"begin": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                        kept.append(chunk.text[a:b][~gone[a:b]].tobytes() if edges else chunk.text[a:b].tobytes())
                    sizes = chunk.ends[at : at + 256] - chunk.begins[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"][at : at + 256], batch.schema.field("ids").type.value_type), pa.array(sizes), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = f"doc_id {kind}, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"
    return done.select("ids", "ends", "body", "a").unionByName(judged.select("ids", "ends", "body", "a")).mapInArrow(read, out)


def repeat_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``remove_repeats``."""
    found = remove_repeats(docs, doc_id, text, length)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
