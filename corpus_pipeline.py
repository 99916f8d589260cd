"""The corpus pipeline: raw documents to weighted, deduplicated token ids.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns ids.
SimHash and SentencePiece cannot be said in SQL, so ``ORACLE_SQL`` is None; tests hold the rows against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textlake.llm.common import cut, table
from textlake.llm.exact_dedup import drop_exact_copies
from textlake.llm.mixing import take_mix
from textlake.llm.near import drop_near_copies
from textlake.llm.pieces import MODEL, encode_documents
from textlake.llm.quality import keep_good

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, score, nbest_scores, round_trip`` of each text."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mix),
    ("sentencepiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "pipeline")
    return docs
