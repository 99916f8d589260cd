"""The index: an inverted index as tables, built from a DataFrame, stored as Parquet, and maintained.

Tables: ``docs`` (doc_id, stored columns), ``postings`` (field, term, doc_id, tf, positions, norm), ``terms``
(field, term, df, cf), ``lengths`` (doc_id, field, len, norm) and ``deletes`` (doc_id). Postings carry their document's norm, so
scoring joins nothing. They are written by field and sorted by term: a query's terms are found by the
statistics of row groups. What is shuffled and sorted for that are blocks of a term's documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.analysis import LETTERS, MOST_BYTES, UNTOKENIZED, Analyzer, PerField, letters, lower
from ..functions.scoring import Similarity, decoded_norm
from . import invert

#: Bytes of blocks, as stored, that a task sorts when an index is saved.
PART_BYTES = 32 << 20
TABLES = ("docs", "postings", "terms", "lengths", "deletes")


@dataclass(frozen=True)
class FieldSpec:
    """How a field is kept: stored, indexed, tokenized, with norms, and its boost."""

    store: bool = True
    index: bool = True
    tokenized: bool = True
    norms: bool = True
    boost: float = 1.0

    def __post_init__(self):
        if self.boost < 0:
            raise ValueError("a boost is not negative")


@dataclass(frozen=True)
class IndexSpec:
    fields: Mapping[str, FieldSpec]
    default: FieldSpec = FieldSpec()
    #: Tokens of a value that are indexed at most, one more than this; None for all.
    max_field_length: int | None = None

    def of(self, name: str) -> FieldSpec:
        return self.fields.get(name, self.default)

    def to_json(self) -> str:
        return json.dumps({"fields": {k: asdict(v) for k, v in self.fields.items()}, "default": asdict(self.default), "max_field_length": self.max_field_length})

    @staticmethod
    def from_json(s: str) -> IndexSpec:
        d = json.loads(s)
        return IndexSpec({k: FieldSpec(**v) for k, v in d["fields"].items()}, FieldSpec(**d["default"]), d["max_field_length"])


@dataclass(frozen=True)
class SearchIndex:
    """Tables of an index. Methods return new indexes; nothing is changed in place."""

    spec: IndexSpec
    analyzer: PerField
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    deletes: DataFrame
    #: What the postings are made from, and the documents' terms made without them, while both are those of ``postings``.
    blocks: DataFrame | None = None
    vectors: DataFrame | None = None

    # ---- reading
    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def fields(self) -> list[str]:
        return [f for f in self.docs.columns if f != "doc_id"]

    @property
    def tokenized_fields(self) -> list[str]:
        return [f for f in self.fields if self.spec.of(f).index and self.spec.of(f).tokenized]

    @cached_property
    def _size(self) -> int:
        return self.docs.count()

    def max_doc(self) -> int:
        """Documents, deleted ones too, until the index is compacted. Counted once for each index."""
        return self._size

    def live(self) -> DataFrame:
        return self.docs.join(self.deletes, "doc_id", "left_anti")

    def num_docs(self) -> int:
        return self.live().count()

    def has_deletions(self) -> bool:
        return not self.deletes.isEmpty()

    def is_deleted(self, doc_id: int) -> bool:
        return not self.deletes.filter(F.col("doc_id") == doc_id).isEmpty()

    def document(self, doc_id: int) -> dict | None:
        """The stored fields of one live document."""
        r = self.live().filter(F.col("doc_id") == doc_id).first()
        return r.asDict() if r else None

    def documents(self, start: int, stop: int | None = None) -> DataFrame:
        """The live documents from ``start`` on, up to ``stop``, which is left out."""
        some = F.col("doc_id") >= start if stop is None else (F.col("doc_id") >= start) & (F.col("doc_id") < stop)
        return self.live().filter(some)

    def term_enum(self, field: str, start: str = "") -> DataFrame:
        """The dictionary of a field from ``start`` on: term, df, cf in order."""
        return self.terms.filter((F.col("field") == field) & (F.col("term") >= start)).select("term", "df", "cf").orderBy("term")

    def term_docs(self, field: str, term: str, start: int | None = None) -> DataFrame:
        """doc_id, tf, positions of a term in live documents, from doc ``start`` on."""
        found = self.postings.filter((F.col("field") == field) & (F.col("term") == term))
        found = found if start is None else found.filter(F.col("doc_id") >= start)
        return found.join(self.deletes, "doc_id", "left_anti").select("doc_id", "tf", "positions")

    def doc_freq(self, field: str, term: str) -> int:
        r = self.terms.filter((F.col("field") == field) & (F.col("term") == term)).select("df").first()
        return r.df if r else 0

    def term_count(self, field: str) -> int:
        return self.terms.filter(F.col("field") == field).count()

    def term_vectors(self, field: str | None = None, doc_id: int | None = None) -> DataFrame:
        """doc_id, field, terms (array of term, freq, positions, in order of terms), of all documents or one."""
        if doc_id is None and self.vectors is not None:
            return self.vectors if field is None else self.vectors.filter(F.col("field") == field)
        found = self.postings if field is None else self.postings.filter(F.col("field") == field)
        found = found if doc_id is None else found.filter(F.col("doc_id") == doc_id)
        one = F.struct("term", F.col("tf").alias("freq"), "positions")
        return found.groupBy("doc_id", "field").agg(F.sort_array(F.collect_list(one)).alias("terms"))

    # ---- maintaining
    def delete(self, ids: DataFrame) -> SearchIndex:
        """Mark documents (``doc_id``) as deleted; frequencies count them until ``compact``."""
        gone = self.deletes.select("doc_id").union(ids.select("doc_id").join(self.docs, "doc_id", "left_semi")).distinct()
        return replace(self, deletes=gone)

    def delete_terms(self, field: str, *terms: str) -> SearchIndex:
        return self.delete(self.postings.filter((F.col("field") == field) & F.col("term").isin(list(terms))).select("doc_id"))

    def undelete_all(self) -> SearchIndex:
        return replace(self, deletes=self.deletes.limit(0))

    def add(self, rows: DataFrame) -> SearchIndex:
        """Append documents whose ``doc_id`` is new."""
        return self.merge(build(rows, self.spec, self.analyzer))

    def upsert(self, rows: DataFrame, key: list[str]) -> SearchIndex:
        """Append documents; earlier ones with the same values of ``key`` are deleted, and of ``rows`` the last wins."""
        last = W.partitionBy(*key).orderBy(F.col("doc_id").desc())
        new = rows.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
        return self.delete(self.docs.join(new.select(*key), key, "left_semi")).add(new)

    def merge(self, *others: SearchIndex) -> SearchIndex:
        """The union of indexes whose ids differ; frequencies add up."""
        every = (self, *others)
        union = lambda name: _union([getattr(x, name) for x in every])
        terms = union("terms").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return replace(self, blocks=None, vectors=None, docs=union("docs"), postings=union("postings"), terms=terms, lengths=union("lengths"), deletes=union("deletes"))

    def compact(self) -> SearchIndex:
        """Drop deleted documents for good and count frequencies anew."""
        alive = lambda df: df.join(self.deletes, "doc_id", "left_anti")
        postings = alive(self.postings)
        return replace(self, blocks=None, vectors=None, docs=alive(self.docs), postings=postings, terms=_dictionary(postings), lengths=alive(self.lengths), deletes=self.deletes.limit(0))

    def set_boost(self, field: str, factor: Column) -> SearchIndex:
        """Multiply a field's norms by ``factor``, a column over docs; they pass through their bytes again."""
        return self._renormed(field, factor, lambda norm, f: norm * f)

    def set_norm(self, field: str, value: Column) -> SearchIndex:
        """Overwrite a field's norms by ``value``, a column over docs, as it comes back from its byte; null leaves them."""
        return self._renormed(field, value, lambda norm, v: v)

    def _renormed(self, field: str, by: Column, change: Callable[[Column, Column], Column]) -> SearchIndex:
        some = self.docs.select("doc_id", F.lit(field).alias("field"), by.cast("double").alias("_f"))
        new = F.when(F.col("_f").isNull(), F.col("norm")).otherwise(decoded_norm(change(F.col("norm"), F.col("_f"))))
        renorm = lambda df: df.join(some, ["doc_id", "field"], "left").withColumn("norm", new).drop("_f")
        return replace(self, blocks=None, postings=renorm(self.postings), lengths=renorm(self.lengths))

    # ---- storing
    def save(self, path: str) -> SearchIndex:
        """Write all tables under ``path`` and return the stored index."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.sorted_postings().write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
        for name in ("lengths", "deletes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spec = self.spark.createDataFrame([(self.spec.to_json(),)], "spec string")
        spec.coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        return replace(load(self.spark, path, self.analyzer), vectors=self.vectors)

    def sorted_postings(self) -> DataFrame:
        """Postings by field and term; of blocks, which are fewer rows, where there are some: a block's documents stay together."""
        rows = self.postings.withColumn("first", F.col("doc_id")) if self.blocks is None else self.blocks.select("field", "term", "first", "entries")
        # Said outright, so that few bytes are still sorted by all cores and a task's memory does not grow with the index.
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_read(rows) // PART_BYTES))
        dealt = rows.repartitionByRange(parts, "field", "term", "first").sortWithinPartitions("field", "term", "first")
        return dealt.drop("first") if self.blocks is None else _posted(dealt)


def load(spark: SparkSession, path: str, analyzer: PerField) -> SearchIndex:
    spec = IndexSpec.from_json(spark.read.text(f"{path}/spec").first()[0])
    return SearchIndex(spec, analyzer, *[spark.read.parquet(f"{path}/{t}") for t in TABLES])


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files that a frame is made from; 0 where Spark does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def inverted_fields(docs: DataFrame, spec: IndexSpec, analyzer: PerField, similarity: Similarity) -> DataFrame:
    """Blocks of every indexed field: field, term, df, cf, first (doc_id), entries (doc_id, norm, positions), lens (doc_id, len, norm).

    A term has a row for some of its documents in a batch; lengths lie in rows of their own, without a term, or with whole values."""
    frames = []
    for name, norm, tokens in _analyzed(docs, spec, analyzer, similarity):
        ident, words = docs.schema["doc_id"].dataType.simpleString(), _letters(docs, name, spec, analyzer, similarity)
        if words is None and tokens is None:
            found = _whole_values(docs, name, norm)
        else:
            kinds = f"term string, df bigint, cf bigint, first {ident}, entries array<struct<doc_id:{ident},norm:double,positions:array<int>>>, lens array<struct<doc_id:{ident},len:bigint,norm:double>>"
            rows = docs.select("doc_id", F.col(name).alias("text")) if words else docs.select("doc_id", _boost(docs), tokens.alias("tokens")).select("doc_id", norm.alias("norm"), "tokens")
            found = rows.mapInArrow(invert.blocks(words), kinds)
        frames.append(found.select(F.lit(name).alias("field"), "*"))
    return _union(frames)


def vectors_of(docs: DataFrame, spec: IndexSpec, analyzer: PerField, similarity: Similarity) -> DataFrame:
    """doc_id, field, terms (term, freq, positions, in order of terms), each made in its document's task: nothing is shuffled."""
    frames, ident = [], docs.schema["doc_id"].dataType.simpleString()
    for name, _, tokens in _analyzed(docs, spec, analyzer, similarity):
        words = _letters(docs, name, spec, analyzer, similarity)
        rows = F.col(name).alias("text") if words else (UNTOKENIZED(F.col(name)) if tokens is None else tokens).alias("tokens")
        found = docs.select("doc_id", rows).mapInArrow(invert.vectors(words), f"doc_id {ident}, terms array<struct<term:string,freq:bigint,positions:array<int>>>")
        frames.append(found.select("doc_id", F.lit(name).alias("field"), "terms"))
    return _union(frames)


def _letters(docs: DataFrame, name: str, spec: IndexSpec, analyzer: PerField, similarity: Similarity) -> invert.Letters | None:
    """How words of letters are found in whole texts without making their tokens first; None where something else is asked."""
    how, own = spec.of(name), analyzer.of(name)
    usual = type(similarity).length_norm is Similarity.length_norm and "doc_boost" not in docs.columns and spec.max_field_length is None
    if usual and how.tokenized and docs.schema[name].dataType.simpleString() == "string" and own.tokenizer is letters and own.filters in ((), (lower,)):
        return invert.Letters.of(docs.sparkSession._jvm, bool(own.filters), how.boost if how.norms else None)
    return None


def _boost(docs: DataFrame) -> Column:
    return (F.col("doc_boost").cast("double") if "doc_boost" in docs.columns else F.lit(1.0)).alias("boost")


def _analyzed(docs: DataFrame, spec: IndexSpec, analyzer: PerField, similarity: Similarity) -> list[tuple[str, Column, Column | None]]:
    """name, norm (of boost and tokens) and tokens of every indexed field; of values that are one token, no tokens. An array column has values, and positions go on across them."""
    out = []
    for name in [c for c in docs.columns if c not in ("doc_id", "doc_boost")]:
        how = spec.of(name)
        if not how.index:
            continue
        own: Analyzer = analyzer.of(name) if how.tokenized else UNTOKENIZED
        several = docs.schema[name].dataType.simpleString().startswith("array")
        if several:
            last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["pos"] + 1, F.lit(0))
            shift = lambda acc, t: F.concat(acc, F.transform(t, lambda x: F.struct(x["term"].alias("term"), (x["pos"] + last(acc)).alias("pos"))))
            start = F.array().cast("array<struct<term:string,pos:int>>")
            tokens = F.aggregate(F.transform(F.col(name), lambda v: own(v)), start, shift)
        else:
            tokens = own(F.col(name))
        if spec.max_field_length is not None:
            tokens = F.slice(tokens, 1, spec.max_field_length + 1)
        whole = own is UNTOKENIZED and not several and spec.max_field_length is None
        many = F.lit(1) if whole else F.greatest(F.size("tokens"), F.lit(1))  # one token or none: the norm is a constant
        norm = decoded_norm(similarity.length_norm(many) * F.lit(how.boost) * F.col("boost")) if how.norms else F.lit(0.0)
        out.append((name, norm, None if whole else tokens))
    return out


def _whole_values(docs: DataFrame, name: str, norm: Column) -> DataFrame:
    """The blocks of values that are one token, or none if null: nothing to sort or group, so it stays in generated code."""
    term = F.substring(F.col(name).cast("string"), 1, MOST_BYTES)
    one = docs.select("doc_id", _boost(docs), term.alias("term")).filter("term IS NOT NULL").select("doc_id", "term", norm.alias("norm"))
    entry = F.struct("doc_id", "norm", F.array(F.lit(0)).alias("positions"))
    length = F.struct("doc_id", F.lit(1).cast("bigint").alias("len"), "norm")
    return one.select("term", F.lit(1).cast("bigint").alias("df"), F.lit(1).cast("bigint").alias("cf"), F.col("doc_id").alias("first"), F.array(entry).alias("entries"), F.array(length).alias("lens"))


def _posted(blocks: DataFrame) -> DataFrame:
    """The postings of blocks, in the order of blocks."""
    each = blocks.select("field", "term", F.explode("entries").alias("e"))
    return each.select("field", "term", "e.doc_id", F.size("e.positions").cast("long").alias("tf"), "e.positions", "e.norm")


def build(docs: DataFrame, spec: IndexSpec | None = None, analyzer: PerField | None = None, similarity: Similarity | None = None, scratch: str | None = None) -> SearchIndex:
    """Index ``docs``: ``doc_id``, an optional ``doc_boost``, and fields.

    Tokens are sorted and grouped in blocks of documents of a task, so making postings moves nothing. With ``scratch``,
    a folder, the blocks are written there, and all tables derive from what was written instead
    of analysing the texts once for each table.
    """
    spec, analyzer, similarity = spec or IndexSpec({}), analyzer or PerField(LETTERS), similarity or Similarity()
    blocks = inverted_fields(docs, spec, analyzer, similarity)
    if scratch is not None:
        blocks.write.mode("overwrite").parquet(scratch)
        blocks = docs.sparkSession.read.parquet(scratch)
    lengths = blocks.filter("lens IS NOT NULL").select("field", F.explode("lens").alias("x")).select("x.doc_id", "field", "x.len", "x.norm")
    blocks = blocks.filter("term IS NOT NULL")
    terms = blocks.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    stored = docs.select("doc_id", *[c for c in docs.columns if c not in ("doc_id", "doc_boost") and spec.of(c).store])
    vectors = vectors_of(docs, spec, analyzer, similarity)
    return SearchIndex(spec, analyzer, stored, _posted(blocks), terms, lengths, docs.select("doc_id").limit(0), blocks, vectors)


def from_records(spark: SparkSession, records: list, schema: str | None = None, input_field: str = "content") -> DataFrame:
    """Documents from dicts, strings or lists; the latter become the field ``input_field``. Ids count from 0."""
    rows = [{"doc_id": i} | (r if isinstance(r, Mapping) else {input_field: r}) for i, r in enumerate(records)]
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {"doc_id": "bigint"} | {n: "array<string>" if any(isinstance(r.get(n), list) for r in rows) else "string" for n in names if n != "doc_id"}
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema or ", ".join(f"`{n}` {kinds[n]}" for n in names))
