"""One object for an index and all that is done to it: adding, searching, updating, deleting, storing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import Similarity
from ..plans.parser import QueryParser
from ..sources.index import SearchIndex
from .query import Query
from .search import Searcher, TopDocs


class Index:
    """An index that changes. Every change makes a new ``SearchIndex``, so readers of an older one are not disturbed.

    With ``key``, columns that name a document, adding one that has the key of another replaces it. Plans grow with every change
    until ``flush`` or ``optimize`` writes the tables.
    """

    def __init__(self, index: SearchIndex, key: Sequence[str] = (), parser: QueryParser | None = None, similarity: Similarity | None = None):
        self.index, self.key, self.similarity = index, list(key), similarity or Similarity()
        whole = tuple(index.tokenized_fields)
        self.parser = parser or QueryParser(whole or tuple(index.fields), tuple(index.fields), whole)

    @property
    def searcher(self) -> Searcher:
        return Searcher(self.index, self.similarity, self.parser)

    # ---- reading
    def size(self) -> int:
        return self.index.num_docs()

    def __len__(self) -> int:
        return self.size()

    def __getitem__(self, which: int | slice) -> dict | None | DataFrame:
        """A document by id, or those of a range of ids."""
        return self.index.documents(which.start or 0, which.stop) if isinstance(which, slice) else self.index.document(which)

    def search(self, q: Query | str, **options) -> TopDocs:
        return self.searcher.search(q, **options)

    def scan(self, q: Query | str, **options) -> DataFrame:
        return self.searcher.scan(q, **options)

    def explain(self, q: Query | str, doc_id: int):
        return self.searcher.explain(q, doc_id)

    def highlight(self, q: Query | str, field: str, hits: DataFrame, **options) -> DataFrame:
        return self.searcher.highlight(q, field, hits, **options)

    def doc_freq(self, field: str, term: str) -> int:
        return self.index.doc_freq(field, term)

    def term_vector(self, doc_id: int, field: str) -> DataFrame:
        return self.index.term_vectors(field, doc_id)

    # ---- changing
    def add(self, rows: DataFrame) -> Index:
        """Add documents (``doc_id`` and fields)."""
        self.index = self.index.upsert(rows, self.key) if self.key else self.index.add(rows)
        return self

    def _ids(self, which: int | str | Query | Iterable[int] | DataFrame) -> DataFrame:
        if isinstance(which, DataFrame):
            return which.select("doc_id")
        if isinstance(which, (str, Query)):
            return self.searcher.matches(which).select("doc_id")
        wanted = [which] if isinstance(which, int) else list(which)
        return self.index.docs.filter(F.col("doc_id").isin(wanted)).select("doc_id")

    def delete(self, which: int | str | Query | Iterable[int] | DataFrame) -> Index:
        """Delete documents by id, by ids, or all that a query finds."""
        self.index = self.index.delete(self._ids(which))
        return self

    def update(self, which: int | str | Query | Iterable[int] | DataFrame, **columns: Column) -> Index:
        """Give new values to stored fields of documents; they are indexed anew, under ids after all others in the order of the old.

        All fields are taken from the stored columns, so fields that are not stored are lost.
        """
        ids = self._ids(which)
        old = self.index.live().join(ids, "doc_id", "left_semi")
        top = self.index.docs.agg(F.max("doc_id")).first()[0] or 0
        # Numbered by a shift of the old id, which needs no order over all rows.
        new = old.withColumns(columns).withColumn("doc_id", F.col("doc_id") + top + 1)
        self.index = self.index.delete(ids).merge(_built(self.index, new))
        return self

    def batch_update(self, rows: DataFrame, key: Sequence[str]) -> Index:
        """Replace the documents that have the keys of ``rows`` by them; of rows of one key the last counts."""
        last = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("doc_id")))).filter("_n = 1").drop("_n")
        self.index = self.index.delete(self.index.docs.join(last.select(*key), list(key), "left_semi")).add(last)
        return self

    # ---- storing
    def flush(self, path: str) -> Index:
        """Write all tables and go on with what was written."""
        self.index = self.index.save(path)
        return self

    def optimize(self, path: str) -> Index:
        """Drop deleted documents for good and write all tables, sorted as one."""
        self.index = self.index.compact().save(path)
        return self


def _built(index: SearchIndex, rows: DataFrame) -> SearchIndex:
    from ..sources.index import build

    return build(rows, index.spec, index.analyzer)
