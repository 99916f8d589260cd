import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from frames import empty  # noqa: E402
from oracle import SMALL, connect, same  # noqa: E402

import corpus_pipeline  # noqa: E402
from textlake.llm import near, queries  # noqa: E402
from textlake.llm.common import cut  # noqa: E402
from textlake.llm.exact_dedup import exact_dedup  # noqa: E402
from textlake.llm.mixing import mix  # noqa: E402
from textlake.llm.quality import judge_quality  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], connect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_for_each_row(spark, name):
    rows = spark.read.parquet(f"{SMALL}/{'pages' if name.startswith('op5') else 'documents'}.parquet")
    assert queries.QUERIES[name](spark, SMALL).count() == rows.count()


def test_language_model_beats_unigrams_on_held_out_documents(spark):
    held = queries.QUERIES["op6_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert held.s > held.b + 0.1


def near_copies_kept(docs):
    """The smallest id of each group of fingerprints within the distance, by comparing all pairs."""
    rows = docs.select("doc_id", "text").collect()
    fps = np.array([np.packbits(near.votes(r.text) > 0, bitorder="little").view(np.uint64) for r in rows])
    least = [r.doc_id for r in rows]
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]).sum(1) <= near.DISTANCE):
            a, b = least[i], least[j]
            least = [min(a, b) if x in (a, b) else x for x in least]
    return Counter(set(least))


def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    said = [
        lambda d: ids(judge_quality(d).filter("kept")),
        lambda d: ids(exact_dedup(d).filter("kept")),
        near_copies_kept,
        lambda d: Counter({r.doc_id: r.taken // r["size"] for r in mix(d).collect() if r.taken}),
        ids,
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES, said, strict=True):
        out = cut(stage(spark, docs, SMALL))
        assert ids(out) == want(docs)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
            docs = out
    last = corpus_pipeline.run(spark, SMALL)
    assert ids(last) == ids(docs) and last.filter("NOT round_trip").isEmpty()


def test_pipeline_of_nothing(spark):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL))
        assert docs.isEmpty()
        if "text" not in docs.columns:
            break
