import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from frames import documents, empty, lower, prose, texts, words  # noqa: E402

from textlake.llm import lm, near, pieces, quality, simhash, suffix_dedup, token_counts, url_filter  # noqa: E402
from textlake.llm import exact_dedup as exact  # noqa: E402
from textlake.llm.exact_dedup import drop_exact_copies, exact_dedup, split_directory  # noqa: E402
from textlake.llm.mixing import mix, take_mix, targets  # noqa: E402
from textlake.llm.sharding import shard  # noqa: E402

P = pytest.importorskip("public_tokenizers")
EMPTY_OK = [
    quality.judge_quality, quality.keep_good, exact_dedup, drop_exact_copies, suffix_dedup.repeat_digest, lm.score_documents, mix, take_mix, simhash.simhash_groups,
    near.drop_near_copies, shard, lambda d: token_counts.token_counts(d, P.path(token_counts.MODEL)), lambda d: pieces.encode_documents(d, P.path(pieces.MODEL)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.mark.parametrize("operator", EMPTY_OK)
def test_empty_tables_give_empty_results(spark, operator):
    assert operator(empty(spark)).collect() == []


def by_row(df, key="doc_id"):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=repr)


# ---- 1
def brute_features(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in (t or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_posterior(docs):
    got = quality.judge_quality(docs).collect()
    want = Counter((i, *brute_features(t)) for i, t, _ in texts())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert Counter(r.doc_id for r in quality.keep_good(docs).collect()) == kept


def test_em_finds_planted_accuracies():
    """Independent rules of stated accuracies: the fit estimates them, and a vote counts by them."""
    rng, n = np.random.default_rng(8), 20_000
    accuracy, speaks = (0.95, 0.9, 0.75, 0.6, 0.55), 0.8
    good = rng.random(n) < 0.6
    votes = [np.where(rng.random(n) < speaks, np.where((rng.random(n) < a) == good, 1, -1), 0) for a in accuracy]
    share, rate = quality.fit(Counter(zip(*[v.tolist() for v in votes], strict=True)))
    assert share == pytest.approx(0.6, abs=0.05)
    for j, a in enumerate(accuracy):
        assert rate[1, j, 1] == pytest.approx(speaks * a, abs=0.05) and rate[0, j, -1] == pytest.approx(speaks * a, abs=0.05)
    # One bad vote of a weak rule does not outweigh two good ones of strong rules: not all must pass. Nor do weak ones outweigh a strong one.
    assert quality.posterior((1, 1, 0, -1, -1), share, rate) > 0.9 > 0.1 > quality.posterior((-1, -1, 0, 1, 1), share, rate)


def test_verdicts_are_not_that_all_rules_pass(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = quality.judge_quality(rows).filter("NOT base_failed").select("doc_id", "kept")
    voted = rows.select(F.col("doc_id").alias("d"), quality.features(F.col("text")).alias("f")).select("d", "f.*")
    passed = voted.select("d", F.forall(F.array(*quality._votes()), lambda v: v >= 0).alias("passed"))
    table = {(r.kept, r.passed): r["count"] for r in said.join(passed, F.col("doc_id") == F.col("d")).groupBy("kept", "passed").count().collect()}
    assert table[True, True] > 0 and table.get((True, False), 0) > 0


# ---- 2
def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = P.path(token_counts.MODEL)
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), count(t), count(t) > 512) for i, t, _ in texts())
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect()) == want
    hard = ["'ll 're'x  \n\n a 12 ab12", "   ", "don'T", "\u00a0\u2003x", "<|endoftext|><|endoftext|>", "a" * 5000, "١٢ ½ ²", "é" * 300, "x\r\n\ty", "'", "''s", " 's", "日本語 テキスト"]
    assert token_counts.count_tokens(hard, path) == [count(t) for t in hard]


def test_chunk_maps_compose_to_a_sequential_run():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 15, (50, 16)).astype(np.uint8)
    go, _ = token_counts.pretoken_machine()
    state, entries = token_counts.START, []
    for row in classes:
        entries.append(state)
        for c in row:
            state = int(go[int(c) * 13 + state])
    assert token_counts.chunk_entries(classes).tolist() == entries


# ---- 3
def test_exact_dedup_equals_grouping(docs):
    groups = defaultdict(list)
    for i, t, _ in texts():
        groups[lower(t)].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in texts())
    for capacity in (1, 200_000):  # the directory doubles as often as it can, or never
        assert Counter(tuple(r) for r in exact_dedup(docs, capacity=capacity).collect()) == want
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, lower(r.text)) for r in kept.collect()) == Counter((keep[k], k) for k in groups)


def test_directory_splits_only_what_is_overfull():
    depth, directory = split_directory({0: 5, 1: 5, 15: 1}, 6, 4)
    assert depth == 4 and directory[0] != directory[1] and directory[15] == directory[8] and directory == sorted(directory)
    assert split_directory({}, 6, 4) == (0, [0])


def test_index_chains_texts_whose_keys_collide(docs, monkeypatch):
    """With three keys for all texts, chains are long and only their bytes tell texts apart."""
    monkeypatch.setattr(exact, "_keyed", lambda norm: [F.octet_length(norm).cast("long").alias("n"), (F.octet_length(norm) % 3).cast("long").alias("h")])
    want = Counter(lower(t) for _, t, _ in texts())
    for capacity, most in ((1, 500_000), (200_000, 0)):
        monkeypatch.setattr(exact, "MOST_REPEATED", most)
        got = exact_dedup(docs, capacity=capacity).collect()
        assert Counter(r.text_sha256 for r in got) == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in want.items()}
        assert all(r.group_size == n for r in got for t, n in want.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
    entries = exact.entries_of(docs)
    index = exact.build_index(entries, docs.select(F.col("doc_id").alias("id"), exact._norm("text").alias("norm")), exact.directory_of(entries, 1), most_repeated=0)
    rows = index.collect()
    assert Counter(r.digest for r in rows).most_common(1)[0][1] == 1 and len(rows) == len(want)
    assert {(r.h, r.link) for r in rows} == {(h, k) for h in range(3) for k in range(sum(r.h == h for r in rows))}


def test_a_directory_that_points_elsewhere_loses_rows(docs):
    """The index is asked through the directory: entries are found in the bucket that it names."""
    entries = exact.entries_of(docs)
    index = exact.build_index(entries, docs.select(F.col("doc_id").alias("id"), exact._norm("text").alias("norm")), exact.directory_of(entries, 1))
    depth, buckets = exact.directory_of(entries, 1)
    assert depth > 0 and index.select("bucket").distinct().count() > 1
    asked = lambda d: entries.select("h", "digest", exact.bucket_of(d).alias("bucket")).join(index, ["bucket", "h", "digest"]).count()
    assert asked((depth, buckets)) == entries.count() and asked((depth, [x + 1 for x in buckets])) == 0


# ---- 4
def brute_repeats(rows, length):
    seen = Counter(t[k : k + length] for t in rows for k in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out.append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [5, 30, 200])
def test_suffix_dedup_equals_brute_force(spark, docs, length):
    rows = texts()
    passage = prose(50, 60)
    more = rows + [(40, prose(51, 30) + passage + prose(52, 9), "s"), (41, prose(53, 7) + passage, "s"), (42, passage[:199], "s"), (43, passage[3:203] + "é" * 150, "s"), (44, "ab" * 300, "s")]
    more = [(i, t and t[:3000], s) for i, t, s in more]
    want = Counter((i, *b) for (i, _, _), b in zip(more, brute_repeats([(t or "").encode() for _, t, _ in more], length), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.repeat_digest(documents(spark, more).repartition(3), length=length).collect()) == want


def test_covers_meet_every_difference():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


# ---- 5
URLS = [(1, "http://Example.ORG/es/x?q=1"), (2, "https://a.example.org/en/1/b#c"), (3, "http://example.org/en/2"), (4, "http://x.com/de/p"), (5, "http://x.com/fr"), (6, None), (7, "no scheme"), (8, "http://x.com"), (9, "http://notorg/"), (10, ""), (None, "http://q.net/a/b?x"), (1, "http://Example.ORG/es/x?q=1"), (11, "x://y.com/fr/1://z")]


def brute_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    host, path = lower(rest[:cut]), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r, _ in url_filter.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in URLS], "page_id bigint, url string, host string, rule string")
    got = url_filter.filter_urls(pages, url_filter.labelled_by_rules(pages)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_url(u)) for i, u in URLS)
    said = dict(url_filter.RULES)
    assert all(r.verdict == (said[r.rule] if r.rule else "allow" if r.probability >= 0.5 else "block") for r in got)
    assert url_filter.filter_urls(pages.limit(0), []).collect() == []


def test_url_classifier_on_held_out_urls():
    rows = [(f"{w}{k}.{'good' if k % 2 else 'casino'}.net", f"/{w}/{k}", k % 2) for k in range(200) for w in ("shop", "news")]
    train, held = rows[:300], rows[300:]
    w, bias = url_filter.train([(h, p) for h, p, _ in train], [y for _, _, y in train])
    said = url_filter.probability([(h, p) for h, p, _ in held], w, bias) >= 0.5
    assert np.mean(said == np.array([y for _, _, y in held])) > 0.95


# ---- 6
def test_lm_base_score_and_counts(docs):
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    end = object()
    counts = Counter(x for i, t, _ in texts() if trains(i) for x in (*words(lower(t)), end))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in texts():
        tokens = [*words(lower(t)), end]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        want[i, not trains(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(base, 5)] += 1
    got = lm.score_documents(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm, "CONTEXT_OWN", 30)
    monkeypatch.setattr(lm, "CONTEXT_BUCKETS", 4)
    model, of = lm.Model(np.full(40, 1 / 40)), lm.context_rows(40)
    assert of.max() == 33
    rng = np.random.default_rng(1)
    moved, seen = lm.nce_pass(model, iter([(of[rng.integers(0, 40, 90_000)], of[rng.integers(0, 40, 90_000)], rng.integers(0, 5, 90_000))]))
    model.all += moved
    assert seen.sum() == 3 * 90_000
    log_z = model.log_z()
    for a, b in ((3, 7), (33, 0)):
        p = np.exp((model.u1[a] + model.u2[b]) @ model.t.T + model.b - log_z[a, b])
        assert p.sum() == pytest.approx(1, abs=1e-4) and p[:5].sum() > 0.5


def test_lm_scores_are_those_of_the_model_and_sum_to_one(spark, monkeypatch):
    """Brute force: one-word texts over all known words and one unknown share out no more than 1, and the end takes the rest."""
    rows = [(k, f"{prose(50 + k, 40)}", "s") for k in range(60)]
    vocabulary = sorted({w for _, t, _ in rows for w in t.split()})
    monkeypatch.setattr(lm, "OWN", 20)
    monkeypatch.setattr(lm, "FREQUENT", 30)
    probes = [(1000 + k, w, "s") for k, w in enumerate(vocabulary)]
    trained = {t for i, t, _ in rows if lm.is_training(i)}
    known = Counter(w for t in trained for w in t.split())
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, rows + [(i, w, s) for i, w, s in probes if not lm.is_training(i)])).collect()}
    assert all(math.isfinite(r.score) for r in got.values()) and len(known) > 100
    some = [10 ** got[i].score for i, w, _ in probes if i in got]
    assert 0 < sum(some) < 1


def test_lm_does_not_follow_the_layout_of_files(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER", 20_000)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gain = []
    for parts in (4, 64):
        got = lm.score_documents(rows.repartition(parts)).select("doc_id", "score").collect()
        gain.append(sorted((r.doc_id, round(r.score, 3)) for r in got))
    assert gain[0] == gain[1]


# ---- 7
def test_targets_share_out_the_excess(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 400}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weight, left, budget, want = {"a": 3, "b": 1, "c": 2, None: 3}, set(sizes), 1.5 * 1510, {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * sizes[s]}
        want |= {s: 2 * sizes[s] if s in full else level * weight[s] for s in full or left}
        budget -= sum(2 * sizes[s] for s in full)
        left = left - full if full else set()
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(docs):
    got = mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in texts())
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    source = {i: s for i, _, s in texts()}
    taken, goal = Counter(), {}
    for r in got:
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
            goal[source[r.doc_id]] = r.target
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - goal[s]) <= 2 * longest for s in goal)
    again = mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    times = Counter()
    for r in got:
        times[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    picked = take_mix(docs)
    assert picked.columns == docs.columns and Counter(r.doc_id for r in picked.collect()) == +times


# ---- 8
def test_encoding_decodes_to_the_text(docs):
    got = pieces.encode_documents(docs, P.path(pieces.MODEL))
    assert all(r.round_trip for r in got.collect()) and got.count() == len(texts())
    back = Counter(tuple(r) for r in pieces.decode_documents(got, P.path(pieces.MODEL)).collect())
    assert back == Counter((i, t or "") for i, t, _ in texts())


def test_ids_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path(pieces.MODEL))
    odd = ["the", "hello world", "\n\nthe\n the  end \n", "  two  spaces ", "a▁b", "</s> <unk> <0x41>", "漢字🙂é\ttab", "\n", " ", "ﬁ ①\r\n"]
    rows = texts() + [(100 + k, t, None) for k, t in enumerate(odd)]
    got = pieces.encode_documents(documents(spark, rows).repartition(3), P.path(pieces.MODEL)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t, _ in rows)
    assert all(r.score <= r.nbest_scores[0] + 1e-6 for r in got)


def test_nbest_equals_all_segmentations():
    model = pieces.pieces(P.path(pieces.MODEL))

    def every(word):
        if not word:
            return [((), 0.0)]
        out = []
        for j in range(1, len(word) + 1):
            s = model.scores.get(word[:j], model.unknown if j == 1 else None)
            if s is not None:
                out += [((*model.ids_of(word[:j]), *ids), s + rest) for ids, rest in every(word[j:])]
        return out

    for text in ("hello", "an edge", "the  theme", "é漢x", "a\nb", "1,2."):
        want = sorted((-s for _, s in every(model.normalise(text))))[:4]
        got = model.encode_nbest(text, 4)
        assert [-s for _, s in got] == pytest.approx(want) and all(model.decode(ids) == text for ids, _ in got)
        assert len({tuple(ids) for ids, _ in got}) == len(got)
        ids, ends, scores, trips = model.encode_many([text.encode()], 4)
        assert ids.tolist() == got[0][0] and scores[0] == pytest.approx([s for _, s in got]) and trips == [True] and ends.tolist() == [len(ids)]


# ---- 9
def brute_fingerprint(t, k=4):
    import xxhash

    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_groups_equal_brute_force(docs):
    rows = texts()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps)
    least = {k: min((i for (i, _, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in label}
    want = Counter((i, f"{f:016x}", least[k]) for (i, _, _), f, k in zip(rows, fps, label, strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == want


def brute_wide(text: str | None) -> int:
    """The 1,024 bits of a text's fingerprint, from its definition."""
    w = [x.encode() for x in words(lower(text))]
    grams = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    mask, bits = (1 << 64) - 1, [0] * 1024
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for word in range(16):
            x = (h + word * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & mask
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
            for b in range(64):
                bits[64 * word + b] += (x >> b) & 1
    return sum(1 << i for i, n in enumerate(bits) if 2 * n > len(grams))


def test_near_copies_equal_brute_force(docs):
    rows = texts()
    label = brute_components([brute_wide(t) for _, t, _ in rows], near.DISTANCE)
    least = {k: min((i for (i, _, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in label}
    stay = near.drop_near_copies(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter(least.values())
    assert Counter(tuple(r) for r in near.drop_near_copies(docs, most_gone=0).collect()) == Counter(tuple(r) for r in stay.collect())


def test_near_copies_without_ids_of_their_own(spark):
    rows = [(i, prose(700 + k, 90), "src0") for k, i in enumerate([None, None, None, 5, 5, 5, 6])]
    linked = [(None, rows[6][1], "src1"), (5, rows[3][1].upper(), "src1"), (None, rows[0][1], "src1")]
    stay = near.drop_near_copies(documents(spark, rows + linked).repartition(3)).collect()
    assert Counter((r.doc_id, lower(r.text)) for r in stay) == Counter((i, t) for i, t, _ in rows)


def edited(text: str, seed: int, share: float) -> str:
    """``text`` with so many of its words changed that its five-word shingles have about the similarity ``share``."""
    rng, w = random.Random(seed), text.split()
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    own = grams(w)
    for at in rng.sample(range(len(w)), len(w)):
        new = [*w[:at], f"new{rng.random()}", *w[at + 1 :]]
        if len(own & grams(new)) / len(own | grams(new)) < share:
            break
        w = new
    return " ".join(w)


@pytest.mark.parametrize("share,least", [(0.8, 0.75), (0.85, 0.9), (0.9, 0.97)])
def test_near_copies_of_a_stated_similarity_are_found(spark, share, least):
    rows = [(k, prose(9000 + k, 120 + 3 * k), "src0") for k in range(100)]
    copies = [(1000 + k, edited(t, k, share), "src1") for k, t, _ in rows]
    kept = {r.doc_id for r in near.drop_near_copies(documents(spark, rows + copies)).select("doc_id").collect()}
    assert {k for k, _, _ in rows} <= kept  # what is not a copy stays
    assert sum(k + 1000 not in kept for k in range(100)) >= 100 * least


@pytest.mark.parametrize("short,block", [(2, 4), (8, 1024)])
def test_crowded_keys_lose_no_link(spark, monkeypatch, short, block):
    """Long runs, far members and blocks: components equal those of all pairs that share a key."""
    monkeypatch.setattr(near, "SHORT", short)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (4, 16))
    fps = np.array([base[k % 4] ^ np.array([sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 11), False)) for _ in range(16)]) for k in range(60)])
    keys = [[1 + k % 2, 100 + k % 3] for k in range(60)]
    df = spark.createDataFrame([(k, *map(int, f), ks) for k, (f, ks) in enumerate(zip(fps, keys, strict=True))], f"fid bigint, {', '.join(f'{f} bigint' for f in near.FP)}, keys array<int>")
    near_pairs = [(i, j) for i in range(60) for j in range(i) if set(keys[i]) & set(keys[j]) and sum((int(a) ^ int(b)).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= near.DISTANCE]
    label = list(range(60))
    for i, j in near_pairs:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    root = {r.node: r.root for r in simhash.components(near.wide_links(df)).collect()}
    assert [root.get(k, k) for k in range(60)] == label and 1 < len(set(label)) < 60


def test_links_of_random_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([centres, *[centres ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in (1, 2, 3, 4, 5, 6)]]))
    want, wide = (brute_components([int(x) for x in fps], d) for d in (4, 5))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    for most in (4096, 0):  # 0: every key takes the way of the crowded ones
        monkeypatch.setattr(simhash, "MOST_PAIRS", most)
        root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        got = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))
    root = {r.node: r.root for r in simhash.components(simhash.links(df, 5)).collect()}
    got = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert all((got[i] == got[j]) == (wide[i] == wide[j]) for i in range(len(fps)) for j in range(i))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


# ---- 10
def test_shards_are_near_equal_and_gapless(docs):
    got = shard(docs, shards=5).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in texts())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(5))
    longest = max(r["size"] for r in got)
    assert all(abs(sizes[k] - sum(sizes.values()) / 5) <= longest for k in range(5))
