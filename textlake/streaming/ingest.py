"""Incremental indexing: each micro-batch of documents becomes a segment, and a reader sees the union of finished ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import PerField
from ..sources.index import TABLES, IndexSpec, SearchIndex, build


@dataclass(frozen=True)
class SegmentedIndex:
    """An index under ``path``: every table has a column ``segment``; a batch written twice replaces itself."""

    path: str
    spec: IndexSpec
    analyzer: PerField

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        segment = build(rows, self.spec, self.analyzer, scratch=f"{self.path}/inverted/segment={batch}")
        for name in TABLES:
            if name != "deletes":
                table = getattr(segment, name)
                if name == "postings":  # a segment is sorted like an index
                    table = segment.sorted_postings()
                elif name == "terms":
                    table = table.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
                table.write.mode("overwrite").parquet(f"{self.path}/{name}/segment={batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Index a streaming DataFrame until it is stopped."""
        return stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def open(self, spark: SparkSession) -> SearchIndex:
        """The index as it is now."""
        read = {name: spark.read.parquet(f"{self.path}/{name}").drop("segment") for name in ("docs", "postings", "terms", "lengths")}
        terms = read["terms"].groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return SearchIndex(self.spec, self.analyzer, read["docs"], read["postings"], terms, read["lengths"], read["docs"].select("doc_id").limit(0))
