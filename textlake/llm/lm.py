"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Token counts cover all training documents. The model predicts a token from the two before it: the bilinear
score of context and target vectors plus a bias. Every word has vectors: the OWN most frequent ones their own, all others
those of a bucket by their CRC-32, inside which they have the shares of their counts. Contexts have coarser rows than targets,
so that the normaliser of every pair of contexts, over all targets, is one matrix product: as scores are bilinear, the sum
over targets of ``exp(s1 + s2)`` is a product of two tables. A token's normalised log-probability is then looked up.

Texts are tokenised twice, to count and to encode. Training is synchronous: in each round a learner takes about LEARNER tokens of
documents that a digest of id and text deals to it, so a model depends neither on the layout of files nor on tasks; a row's
moves are averaged with the learner's occurrences of the row for weights, summed in the order of the learners. All training
documents are read, and learners grow with them. Counts of rare tokens are joined, never collected.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words with rows of their own and buckets of all others; the same of contexts; vector length.
OWN, BUCKETS, CONTEXT_OWN, CONTEXT_BUCKETS, DIM = 30_000, 1024, 1792, 256, 16
#: Rounds of averaging, tokens of a learner in a round, tokens in a batch, noise draws of a token, rows for one that meets all draws, step.
ROUNDS, LEARNER, BATCH, NOISE, SHARED, STEP = 2, 2_000_000, 4096, 25, 256, 0.2
#: Words whose counts every task holds; the others' are joined.
FREQUENT = 40_000
#: Only tokens of this part of all words or more are looked at for that: there are no more than so many.
MOST_FREQUENT = 1_000_000
#: Rows of the model that learners send together, learners that are summed together.
SENT, SUMMED = 1024, 64
END = 0
COUNTED_AT_ONCE = 500_000


def tokens(text: str | None) -> list[bytes]:
    """Words, lower-cased A-Z; the end is not among them."""
    return (text or "").encode("utf-8").lower().split()


def is_training(doc_id: object) -> bool:
    """Whether crc32 of the id as text leaves another remainder than 1 by 5; a null id is like an empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def count_table(rows: DataFrame) -> DataFrame:
    """``token, c`` over all training documents of ``rows`` (``doc_id, text``), without the end."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if is_training(doc_id):
                    held.update(tokens(text))
                    if len(held) > COUNTED_AT_ONCE:
                        yield out()
        yield out()

    return rows.mapInArrow(work, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Rows(dict):
    """The row of each token: 0 the end, then words of their own, then buckets. Rows of other words are remembered up to a bound."""

    def __init__(self, own: list[bytes]):
        super().__init__((t, i + 1) for i, t in enumerate(own))
        self.first = len(own) + 1

    def __missing__(self, token: bytes) -> int:
        row = self.first + zlib.crc32(token) % BUCKETS
        if len(self) < self.first + COUNTED_AT_ONCE:
            self[token] = row
        return row


def context_rows(n_rows: int) -> np.ndarray:
    """The context's row for each row of a target."""
    at = np.arange(n_rows)
    return np.where(at < CONTEXT_OWN, at, CONTEXT_OWN + at % CONTEXT_BUCKETS).astype(np.uint16)


class Model:
    """``u1, u2`` (contexts one and two back), ``t`` and ``b`` (targets) in one matrix of DIM + 1 columns."""

    def __init__(self, unigram: np.ndarray):
        n, rng = len(unigram), np.random.default_rng(7)
        self.n_contexts, self.unigram = CONTEXT_OWN + CONTEXT_BUCKETS, unigram
        self.all = np.zeros((2 * self.n_contexts + n, DIM + 1), np.float32)
        self.all[:, :DIM] = rng.normal(0, 0.1, (len(self.all), DIM))
        self.t_all[:, DIM] = np.log(unigram)

    u1_all = property(lambda self: self.all[: self.n_contexts])
    u2_all = property(lambda self: self.all[self.n_contexts : 2 * self.n_contexts])
    t_all = property(lambda self: self.all[2 * self.n_contexts :])
    u1 = property(lambda self: self.u1_all[:, :DIM])
    u2 = property(lambda self: self.u2_all[:, :DIM])
    t = property(lambda self: self.t_all[:, :DIM])
    b = property(lambda self: self.t_all[:, DIM])

    def log_z(self) -> np.ndarray:
        """The log of the normaliser of each pair of contexts, in blocks of targets."""
        block = 4096
        top1 = np.full(self.n_contexts, -np.inf, np.float32)
        top2 = top1.copy()
        for at in range(0, len(self.t), block):
            t, b = self.t[at : at + block], self.b[at : at + block]
            top1, top2 = np.maximum(top1, (self.u1 @ t.T + b).max(1)), np.maximum(top2, (self.u2 @ t.T).max(1))
        z = np.zeros((self.n_contexts, self.n_contexts), np.float64)
        for at in range(0, len(self.t), block):
            t, b = self.t[at : at + block], self.b[at : at + block]
            z += np.exp(self.u1 @ t.T + b - top1[:, None]) @ np.exp(self.u2 @ t.T - top2[:, None]).T
        return (np.log(np.maximum(z, 1e-300)) + top1[:, None] + top2).astype(np.float32)


def contexts(rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts one and two back of each token of a text with its end; before the text stand ends."""
    c = of[rows]
    return np.r_[of[END], c[:-1]], np.r_[of[END], of[END], c[:-2]][: len(c)]


def _add(rows: np.ndarray, at: np.ndarray, moves: np.ndarray, squares: np.ndarray) -> None:
    """A step of each row by the sum of its slopes and its own past ones."""
    order = np.argsort(at, kind="stable")  # by radix, as rows have 16 bits
    ranked = at[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    g, which = np.add.reduceat(moves[order], starts, 0), ranked[starts]
    squares[which] += (g**2).mean(1)
    rows[which] -= STEP * g / np.sqrt(squares[which])[:, None]


def nce_pass(model: Model, stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One pass of NCE over (one back, two back, target): how rows moved, and how often each occurred.

    A token has NOISE draws from the unigram shares, for which a batch's draws stand, one for each of its tokens; the model's normaliser is taken as 1 and learned, as NCE allows.
    """
    m, n, rng = model.all.copy(), model.n_contexts, np.random.default_rng(11)
    u1, u2, t = m[:n], m[n : 2 * n], m[2 * n :]
    cdf, log_noise = np.cumsum(model.unigram), np.log(NOISE * model.unigram).astype(np.float32)
    squares, seen = np.ones(len(m), np.float32), np.zeros(len(m), np.int64)
    sigmoid = lambda x: 0.5 + 0.5 * np.tanh(0.5 * x)
    for c1, c2, w in stream:
        for part, at in ((c1, 0), (c2, n), (w, 2 * n)):
            seen[at : at + (n if at < 2 * n else len(t))] += np.bincount(part, minlength=n if at < 2 * n else len(t))
        for at in range(0, len(w), BATCH):
            x1, x2, y = c1[at : at + BATCH], c2[at : at + BATCH], w[at : at + BATCH]
            draws = np.minimum(np.searchsorted(cdf, rng.random(len(y)) * cdf[-1], "right"), len(cdf) - 1).astype(np.uint16)
            some, few = np.arange(rng.integers(SHARED) % len(y), len(y), SHARED), draws[:: SHARED // 2]
            q, tv = u1[x1] + u2[x2], t[y]
            q[:, DIM] = 1  # the column of biases
            right = sigmoid((q * tv).sum(1) - log_noise[y]) - 1
            # Noise as targets see it, all draws on a few rows; and as contexts do, all rows on a few draws.
            wrong = sigmoid(q[some] @ t[draws].T - log_noise[draws]) * np.float32(NOISE / len(some))
            pushed = sigmoid(q @ t[few].T - log_noise[few]) * np.float32(NOISE / len(few))
            dq = right[:, None] * tv + pushed @ t[few]
            dq[:, DIM] = 0
            _add(u1, x1, dq, squares[:n])
            _add(u2, x2, dq, squares[n : 2 * n])
            _add(t, np.r_[y, draws], np.r_[right[:, None] * q, wrong.T @ q[some]], squares[2 * n :])
    return m - model.all, seen


def train(encoded: DataFrame, n_tokens: int, model: Model, of: np.ndarray) -> Model:
    """The model after all rounds over the training documents of ``encoded`` (``trains, digest, ids``)."""
    import pyarrow as pa

    learners = max(1, -(-n_tokens // (ROUNDS * LEARNER)))
    rows = encoded.filter("trains").select("digest", "ids", F.pmod(F.shiftrightunsigned("digest", 40), F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.shiftrightunsigned("digest", 8), F.lit(learners)).cast("int").alias("learner"))
    kind = "block int, learner int, moved binary, weight binary"
    for r in range(ROUNDS):

        def learn(group: pa.Table) -> pa.Table:
            group = group.sort_by("digest")

            def stream() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                held, n = [], 0
                for ids in group.column("ids"):
                    w = np.frombuffer(ids.as_py(), np.uint16)
                    held.append((*contexts(w, of), w))
                    n += len(w)
                    if n > 1 << 17:
                        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                        held, n = [], 0
                if held:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

            moved, seen = nce_pass(model, stream())
            weight = (seen + 1).astype(np.float64)
            sums = moved * weight[:, None]
            cuts = range(0, len(moved), SENT)
            learner = group.column("learner")[0].as_py()
            return pa.table({"block": pa.array(range(len(cuts)), pa.int32()), "learner": pa.array([learner] * len(cuts), pa.int32()), "moved": pa.array([sums[a : a + SENT].tobytes() for a in cuts], pa.binary()), "weight": pa.array([weight[a : a + SENT].tobytes() for a in cuts], pa.binary())})

        def add(group: pa.Table) -> pa.Table:
            group = group.sort_by("learner")
            moved, weight = (sum((np.frombuffer(x.as_py(), np.float64) for x in group.column(c)), np.float64(0)) for c in ("moved", "weight"))
            return pa.table({"block": group.column("block").slice(0, 1), "learner": pa.array([group.column("learner")[0].as_py() // SUMMED], pa.int32()), "moved": pa.array([moved.tobytes()], pa.binary()), "weight": pa.array([weight.tobytes()], pa.binary())})

        sums, left = rows.filter(F.col("round") == r).groupBy("learner").applyInArrow(learn, kind), learners
        while left > 1:
            sums, left = sums.groupBy("block", F.floor(F.col("learner") / SUMMED).alias("g")).applyInArrow(add, kind), -(-left // SUMMED)
        for x in sums.toLocalIterator():  # as many rows as the model has blocks
            moved, weight = np.frombuffer(x.moved, np.float64).reshape(-1, DIM + 1), np.frombuffer(x.weight, np.float64)
            model.all[x.block * SENT : x.block * SENT + len(weight)] += (moved / weight[:, None]).astype(np.float32)
    return model


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` that of the
    smoothed unigram shares. A null text is empty: its end alone is scored. A null doc_id is like an empty text and
    trains. Without training documents all counts are 0 and the model stays as it starts. Very long texts are scored whole, in
    pieces. Repeated rows count and are scored each; an empty table gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = cut(count_table(rows), "lm-counts")
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    ends = rows.filter(trained).count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = words + ends, distinct + (ends > 0)
    often = [(bytes(r.token), r.c) for r in counts.filter(F.col("c") * MOST_FREQUENT >= words).orderBy(F.desc("c"), "token").limit(FREQUENT).collect()]
    own, own_c = [t for t, _ in often[:OWN]], np.array([c for _, c in often[:OWN]], float)
    sums, sizes = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy((F.crc32("token") % BUCKETS).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # a row for each bucket
        sums[r.k], sizes[r.k] = r.c, r.n
    held = np.array([zlib.crc32(t) % BUCKETS for t in own], np.int64)
    sums, sizes = sums - np.bincount(held, own_c, BUCKETS), sizes - np.bincount(held, minlength=BUCKETS)
    unigram = np.r_[ends + 1, own_c, sums + 1]
    unigram /= unigram.sum()
    log_share = np.r_[np.zeros(len(own) + 1), np.log10(sums + 0.5 * (sizes + 1))]  # what a word's log10(c + 0.5) loses inside its bucket
    log_own = np.log10(np.r_[ends, own_c] + 0.5)
    log_c = {t: float(np.log10(c + 0.5)) for t, c in often[OWN:]}
    of = context_rows(len(unigram))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Rows(own)
        rare_type = pa.list_(pa.struct([("t", pa.binary()), ("k", pa.int64())]))
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            out = []
            for text in batch.column("text").to_pylist():
                toks = tokens(text)
                ids = np.fromiter(map(at.__getitem__, toks), np.uint16, len(toks))
                mine = ids < at.first
                tally = Counter(toks[i] for i in np.flatnonzero(~mine).tolist())
                known, freq, inside, rare = int(mine.sum()) + int(ends > 0), float(log_own[ids[mine]].sum() + log_own[0]), 0.0, []
                for t, k in tally.items():
                    lc = log_c.get(t)
                    if lc is None:
                        rare.append({"t": t, "k": k})
                    else:
                        inside += k * lc
                        known += k
                out.append((len(toks) + 1, known, freq + inside, inside - float(log_share[ids].sum()), np.r_[ids, np.uint16(END)].tobytes(), rare))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)]], ["doc_id", "n_tokens", "known", "freq", "inside", "ids", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, known bigint, freq double, inside double, ids binary, rare array<struct<t: binary, k: bigint>>")
    digest = F.xxhash64(F.col("doc_id").cast("string"), "ids")
    encoded = cut(encoded.select("*", trained.alias("trains"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "lm-encoded")
    model = train(encoded, total, Model(unigram), of)
    log_z = model.log_z()  # 16 MB, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column("ids").to_pylist()]
            lp = np.zeros(len(ids))
            for first in range(0, len(ids), 64):
                some = ids[first : first + 64]
                w = np.concatenate(some)
                c1, c2 = (np.concatenate(x) for x in zip(*[contexts(x, of) for x in some], strict=True))
                doc = np.repeat(np.arange(len(some)), [len(x) for x in some])
                for at in range(0, len(w), 1 << 15):
                    a, b, y = (x[at : at + (1 << 15)] for x in (c1, c2, w))
                    s = np.einsum("ij,ij->i", model.u1[a] + model.u2[b], model.t[y]) + model.b[y] - log_z[a, b]
                    lp[first : first + len(some)] += np.bincount(doc[at : at + (1 << 15)], s, len(some))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "n_tokens", "known", "freq")] + [pa.array(lp / np.log(10) + batch.column("inside").to_numpy())], ["row", "doc_id", "n_tokens", "known", "freq", "lp"])

    scored = encoded.select("row", "doc_id", "n_tokens", "known", "freq", "inside", "ids").mapInArrow(score, f"row bigint, doc_id {kind}, n_tokens bigint, known bigint, freq double, lp double")
    asked = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.t").alias("t"), F.col("r.k").alias("k"))
    met = asked.join(counts, F.col("t") == F.col("token"), "left")
    sums_ = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known_rare")).withColumnRenamed("row", "r")
    all_ = scored.join(sums_, F.col("row") == F.col("r"), "left")
    base = F.col("freq") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (kinds + 1))))
    return all_.select(
        "doc_id",
        (~trained).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("lp") + F.coalesce("log_rare", F.lit(0.0))).alias("score"),
    )
