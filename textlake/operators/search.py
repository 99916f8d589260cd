"""Searching: ranked, sorted and paged hits, scans, explanations, highlights, and several indexes as one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.scoring import Similarity
from ..plans.parser import QueryParser
from ..sources.index import SearchIndex
from .compile import Compiler, term_range
from .query import MUST_NOT, Boolean, Filtered, MultiTerm, Phrase, Query, Range, SortField, Span, Term

RELEVANCE, INDEX_ORDER = (SortField("score"),), (SortField("doc_id"),)


def parse_sort(text: str) -> tuple[SortField, ...]:
    """``"rating DESC, author"``; SCORE and DOC_ID are the ranking and the order of documents."""
    out = []
    for part in text.split(","):
        name, *how = part.split()
        out.append(SortField({"SCORE": "score", "DOC_ID": "doc_id"}.get(name, name), reverse=how[:1] == ["DESC"]))
    return tuple(out)


@dataclass(frozen=True)
class TopDocs:
    """``hits`` (doc_id, score) is the page; ``matches`` is all of it, from which totals come when asked for."""

    hits: DataFrame
    matches: DataFrame

    def total_hits(self) -> int:
        return self.matches.count()

    def max_score(self) -> float:
        return self.matches.agg(F.max("score")).first()[0] or 0.0

    def to_json(self) -> DataFrame:
        return self.hits.select(F.to_json(F.struct("*")).alias("json"))

    def rescaled(self) -> DataFrame:
        """The page with scores divided by the largest of all if that is over 1."""
        top = self.matches.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
        return self.hits.crossJoin(F.broadcast(top)).select("doc_id", (F.col("score") / F.col("top")).alias("score"))  # one row


@dataclass(frozen=True)
class Explanation:
    value: float
    description: str
    details: tuple[Explanation, ...] = ()

    def __str__(self) -> str:
        return self._lines(0)

    def _lines(self, depth: int) -> str:
        return "  " * depth + f"{self.value:.6g} = {self.description}\n" + "".join(d._lines(depth + 1) for d in self.details)

    def to_html(self) -> str:
        return f"<ul><li>{self.value:.6g} = {self.description}{''.join(d.to_html() for d in self.details)}</li></ul>"


@dataclass(frozen=True)
class Searcher:
    index: SearchIndex
    similarity: Similarity = Similarity()
    parser: QueryParser = field(default_factory=QueryParser)

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.index, self.similarity)

    def query(self, q: Query | str) -> Query:
        return self.parser.parse(q) if isinstance(q, str) else q

    def matches(self, q: Query | str, filter: DataFrame | Query | None = None, factor: Column | None = None) -> DataFrame:  # noqa: A002
        """``doc_id, score`` of all hits.

        ``filter`` keeps hits that it has too. ``factor`` is a column over the stored columns and ``score``: a boolean
        keeps or drops, a number up to 1 multiplies the score (0 drops); other numbers count as 1.
        """
        found = self.compiler.hits(self.query(q))
        if filter is not None:
            found = found.join(self.compiler.ids(filter), "doc_id", "left_semi")
        if factor is not None:
            both = found.join(self.index.docs, "doc_id").select("doc_id", "score", factor.alias("_f"))
            if both.schema["_f"].dataType.simpleString() == "boolean":
                return both.filter("_f").select("doc_id", "score")
            by = F.when(F.col("_f").between(0, 1), F.col("_f")).otherwise(F.lit(1.0))
            found = both.filter(F.col("_f").isNotNull() & (F.col("_f") != 0)).select("doc_id", (F.col("score") * by).alias("score"))
        return found

    def search(self, q: Query | str, offset: int = 0, limit: int | None = 10, sort: Sequence[SortField] | str = RELEVANCE, filter=None, factor: Column | None = None) -> TopDocs:  # noqa: A002
        """A page of hits, best first; ties in order of documents. ``limit`` None is all."""
        if offset < 0 or (limit is not None and limit <= 0):
            raise ValueError("an offset is not negative, and a limit is positive")
        found = self.matches(q, filter, factor)
        page = self._sorted(found, parse_sort(sort) if isinstance(sort, str) else tuple(sort))
        page = page.offset(offset) if offset else page
        return TopDocs(page.limit(limit) if limit is not None else page, found)

    def _sorted(self, found: DataFrame, sort: Sequence[SortField]) -> DataFrame:
        columns = [s.name for s in sort if s.name not in ("score", "doc_id")]
        if columns:
            found = found.join(self.index.docs.select("doc_id", *dict.fromkeys(columns)), "doc_id")
        keys = []
        for s in sort:
            if s.name == "score":
                keys.append(F.col("score").asc() if s.reverse else F.col("score").desc())
            elif s.name == "doc_id":
                keys.append(F.col("doc_id").desc() if s.reverse else F.col("doc_id").asc())
            else:
                keys.append(self._key(s))
        return found.orderBy(*keys, F.col("doc_id").asc()).select("doc_id", "score")

    def _key(self, s: SortField) -> Column:
        kind = self.sort_kind(s.name) if s.kind == "auto" else s.kind
        value = F.col(s.name)
        if self.index.docs.schema[s.name].dataType.simpleString().startswith("array"):
            value = F.array_max(value)  # of several values the largest counts
        text = value.cast("string")
        if kind == "integer":
            key = F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
        elif kind == "float":
            key = F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))
        elif kind == "byte":
            return text.desc_nulls_last() if s.reverse else text.asc_nulls_first()
        elif kind == "string":
            return text.desc_nulls_first() if s.reverse else text.asc_nulls_last()
        else:
            raise ValueError(f"no way to sort by {kind}")
        return key.desc() if s.reverse else key.asc()

    def sort_kind(self, name: str) -> str:
        """What ``auto`` is for a column: by its type, or for strings by the first of them."""
        kind = self.index.docs.schema[name].dataType.simpleString()
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return "integer"
        if kind in ("float", "double") or kind.startswith("decimal"):
            return "float"
        first = self.index.docs.agg(F.min(F.col(name).cast("string"))).first()[0]
        if first is None:
            raise ValueError(f"{name} has no values to sort by")
        if regex.fullmatch(r"\s*[+-]?\d+\s*", first):
            return "integer"
        return "float" if regex.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", first) else "string"

    def scan(self, q: Query | str, start_doc: int = 0, limit: int | None = 50) -> DataFrame:
        """``doc_id`` of hits from ``start_doc`` on, in order of documents, unscored."""
        found = self.compiler.hits(self.query(q)).filter(F.col("doc_id") >= start_doc).select("doc_id").orderBy("doc_id")
        return found.limit(limit) if limit is not None else found

    def documents(self, hits: DataFrame) -> DataFrame:
        """Stored columns of hits."""
        return hits.join(self.index.docs, "doc_id")

    # ---- explaining
    def explain(self, q: Query | str, doc_id: int) -> Explanation:
        """How the score of one document comes about; only its own postings are read."""
        own = F.col("doc_id") == doc_id
        ix = self.index
        one = replace(ix, docs=ix.docs.filter(own), postings=ix.postings.filter(own), lengths=ix.lengths.filter(own), deletes=ix.deletes.filter(own))
        compiler = self.compiler
        new = compiler.rewrite(self.query(q))
        df, n = compiler.statistics(new)
        factor = self.similarity.query_norm(compiler.squares(new, df, n))
        local = Compiler(one, self.similarity)
        return self._explained(local, new, factor, df, n)

    def _explained(self, c: Compiler, q: Query, factor: float, df: dict, n: int) -> Explanation:
        row = c._plan(q, factor, df, n).first()
        value = row.score if row else 0.0
        if isinstance(q, Boolean):
            parts = tuple(self._explained(c, sub, factor * q.boost, df, n) for o, sub in q.clauses if o != MUST_NOT)
            hit = sum(p.value > 0 for p in parts)
            return Explanation(value, "sum of clauses" + (f" times coord({hit}/{len(parts)})" if q.coord else ""), parts)
        if isinstance(q, Filtered):
            return Explanation(value, "filtered", (self._explained(c, q.query, factor, df, n),))
        if isinstance(q, (Term, MultiTerm, Phrase, Span)):
            idf = c.idf(q, df, n)
            weight = Explanation(idf * q.boost * factor, "query weight", (Explanation(idf, "idf"), Explanation(q.boost, "boost"), Explanation(factor, "query norm and boosts above")))
            return Explanation(value, f"weight({q})", (weight, Explanation(value / (idf * idf * q.boost * factor) if idf and factor else 0.0, "tf times idf times field norm, over idf")))
        return Explanation(value, f"constant({q})")

    # ---- highlighting
    def match_positions(self, q: Query | str, field_: str) -> DataFrame:
        """``doc_id, positions`` of the tokens that a query's terms, or spans and phrases, match in a field."""
        compiler, q = self.compiler, self.query(q)
        frames = self._positions(compiler, compiler.rewrite(q), field_) + self._range_positions(q, field_)
        if not frames:
            return self.index.docs.select("doc_id", F.array().cast("array<int>").alias("positions")).limit(0)
        every = frames[0]
        for f in frames[1:]:
            every = every.union(f)
        return every.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))

    def _range_positions(self, q: Query, field_: str) -> list[DataFrame]:
        """Positions of the terms that a query's ranges span, which rewriting turns into documents."""
        match q:
            case Boolean():
                return [f for o, sub in q.clauses if o != MUST_NOT for f in self._range_positions(sub, field_)]
            case Filtered():
                return self._range_positions(q.query, field_)
            case Range() if q.field == field_:
                rows = self.index.postings.filter((F.col("field") == field_) & term_range(q, F.col("term")))
                return [rows.select("doc_id", F.explode("positions").alias("pos"))]
        return []

    def _positions(self, c: Compiler, q: Query, field_: str) -> list[DataFrame]:
        match q:
            case Boolean():
                return [f for o, sub in q.clauses if o != MUST_NOT for f in self._positions(c, sub, field_)]
            case Filtered():
                return self._positions(c, q.query, field_)
            case Phrase() if q.field == field_:
                if q.slop:
                    return [c.loose_places(q)]
                offsets = [p - q.slots[0][0] for p, _ in q.slots]
                moved = lambda by: lambda b: b + F.lit(by)
                places = F.concat(*[F.transform("begins", moved(shift)) for shift in offsets])
                return [c.exact_begins(q).select("doc_id", F.explode(F.array_distinct(places)).alias("pos"))]
            case Span() if q.span_field == field_:
                terms = sorted(t for _, t in c.terms_of(q))
                rows = self.index.postings.filter((F.col("field") == field_) & F.col("term").isin(terms)).select(F.col("doc_id").alias("d"), F.explode("positions").alias("pos"))
                spans = c.spans(q).select("doc_id", "start", "end")
                return [rows.join(spans, (F.col("d") == F.col("doc_id")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left_semi").select(F.col("d").alias("doc_id"), "pos")]
            case Term() | MultiTerm() if q.field == field_:
                rows = self.index.postings.filter((F.col("field") == field_) & F.col("term").isin(sorted(t for _, t in c.terms_of(q))))
                return [rows.select("doc_id", F.explode("positions").alias("pos"))]
        return []

    def highlight(self, q: Query | str, field_: str, hits: DataFrame, excerpt_length: int = 150, num_excerpts: int = 2, pre_tag: str = "<b>", post_tag: str = "</b>", ellipsis: str = "...") -> DataFrame:
        """``doc_id, excerpts`` (array of strings) of ``hits``, a page of documents."""
        pattern = self.index.analyzer.of(field_).find

        def show(texts: pd.Series, positions: pd.Series) -> pd.Series:
            return pd.Series([excerpts(t or "", list(p), pattern, excerpt_length, num_excerpts, pre_tag, post_tag, ellipsis) for t, p in zip(texts, positions, strict=True)])

        several = self.index.docs.schema[field_].dataType.simpleString().startswith("array")
        text = F.array_join(field_, " ") if several else F.col(field_).cast("string")  # the values of an array follow one another
        own = self.index.postings.join(hits.select("doc_id"), "doc_id", "left_semi")  # positions of the page only
        positions = replace(self, index=replace(self.index, postings=own)).match_positions(q, field_)
        rows = hits.select("doc_id").join(self.index.docs.select("doc_id", text.alias("text")), "doc_id").join(positions, "doc_id")
        return rows.select("doc_id", F.pandas_udf(show, ArrayType(StringType()))("text", "positions").alias("excerpts"))


def excerpts(text: str, positions: list[int], pattern: str, length: int, most: int, pre: str, post: str, ellipsis: str) -> list[str]:
    """The best excerpts of a text, its matched tokens marked; neighbours are marked together.

    A short text is one excerpt. Else windows that begin at a match and hold the most matches are
    taken one after another; overlapping ones are joined.
    """
    places = [m.span() for m in regex.finditer(pattern, text)]
    marks = [places[p] for p in positions if p < len(places)]
    if not marks:
        return []
    runs: list[list[int]] = []
    for k, p in enumerate(p for p in positions if p < len(places)):
        if k and p == last + 1:  # noqa: F821
            runs[-1][1] = places[p][1]
        else:
            runs.append(list(places[p]))
        last = p  # noqa: F841
    if len(text) <= length * most:
        windows = [(0, len(text))]
    else:
        left, windows = list(marks), []
        for _ in range(most):
            if not left:
                break
            begin = max((a for a, _ in left), key=lambda a: (sum(a <= x and y <= a + length for x, y in left), -a))
            inside = [m for m in left if begin <= m[0] and m[1] <= begin + length] or [m for m in left if m[0] == begin]
            used = max(m[1] for m in inside) - begin
            start = max(0, begin - (length - used) // 2)
            windows.append((start, max(start + length, begin + used)))
            left = [m for m in left if m not in inside]
        windows = [(min([a for a, b in places if b > w[0]], default=0), max([b for _, b in places if b <= max(w[1], 1)], default=len(text))) for w in windows]
        windows.sort()
        joined = [windows[0]]
        for w in windows[1:]:
            joined[-1:] = [(joined[-1][0], max(w[1], joined[-1][1]))] if w[0] <= joined[-1][1] else [joined[-1], w]
        windows = joined
    out = []
    for a, b in windows:
        s, at = "", a
        for x, y in runs:
            if a <= x and y <= b:
                s += text[at:x] + pre + text[x:y] + post
                at = y
        out.append((ellipsis if a > 0 else "") + s + text[at:b] + (ellipsis if b < len(text) else ""))
    return out


def multi_index(*indexes: SearchIndex, start: int = 0) -> SearchIndex:
    """Several indexes as one: ids are shifted so that they follow one another, and frequencies are global."""
    out, shift = None, start
    for ix in indexes:
        moved = lambda df, by=shift: df.withColumn("doc_id", F.col("doc_id") + by)
        own = replace(ix, docs=moved(ix.docs), postings=moved(ix.postings), lengths=moved(ix.lengths), deletes=moved(ix.deletes))
        shift += (ix.docs.agg(F.max("doc_id")).first()[0] or 0) + 1
        out = own if out is None else out.merge(own)
    return out
