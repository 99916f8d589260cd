"""From queries to plans: rewriting against the dictionary, weights, and one DataFrame (doc_id, score)."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Similarity
from ..sources.index import SearchIndex
from . import kernels
from .query import (
    MUST, MUST_NOT, SHOULD, Boolean, ConstantScore, Filtered, Fuzzy, MatchAll, MultiTerm, Phrase, Prefix, Query, Range, Span,
    SpanFirst, SpanNear, SpanNot, SpanOr, SpanPrefix, SpanTerm, Term, Wildcard, bounded_terms,
)

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def wildcard_regexp(pattern: str) -> str:
    """``*`` is any run, ``?`` any one character."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def term_range(q: Range, term: Column) -> Column:
    """Whether a term lies in a range, as strings or, for typed ranges with numbers for bounds, as numbers."""
    bounds = [b for b in (q.lower, q.upper) if b is not None]
    lower, upper, value, fits = q.lower, q.upper, term, F.lit(True)
    if q.typed and all(re.match(NUMBER, b) for b in bounds):
        fits, value = F.regexp_like(term, F.lit(NUMBER)), F.expr("1.0D") * term.try_cast("double")
        lower, upper = (None if b is None else float(b) for b in (lower, upper))
    if lower is not None:
        fits = fits & (value >= F.lit(lower) if q.include_lower else value > F.lit(lower))
    if upper is not None:
        fits = fits & (value <= F.lit(upper) if q.include_upper else value < F.lit(upper))
    return fits


@dataclass(frozen=True)
class Compiler:
    index: SearchIndex
    similarity: Similarity = Similarity()

    # ---- rewriting
    def _dictionary(self, field: str) -> DataFrame:
        return self.index.terms.filter(F.col("field") == field)

    def _first_terms(self, field: str, fits: Column, most: int) -> list[str]:
        """The first ``most`` terms of the dictionary that fit."""
        return [r.term for r in self._dictionary(field).filter(fits).select("term").orderBy("term").limit(most).collect()]

    def similar_terms(self, q: Fuzzy) -> DataFrame:
        """term, similarity of what a fuzzy query finds in the dictionary."""
        head, rest = q.term[: q.prefix_length], q.term[q.prefix_length :]
        tail = F.substr(F.col("term"), F.lit(len(head) + 1))
        shorter = F.least(F.length(tail), F.lit(len(rest))) + len(head)
        most = F.floor((1 - q.min_similarity) * shorter).cast("int")
        near = F.startswith(F.col("term"), F.lit(head)) & (F.abs(F.length(tail) - len(rest)) <= most)
        found = self._dictionary(q.field).filter(near).withColumn("similarity", 1 - F.levenshtein(tail, F.lit(rest)) / shorter)
        return found.filter(F.col("similarity") > q.min_similarity).select("term", "similarity")

    def rewrite(self, q: Query) -> Query:
        """Until nothing changes: only terms, phrases, booleans, constant scores and spans are left."""
        while (new := self._rewrite(q)) != q:
            q = new
        return q

    def _rewrite(self, q: Query) -> Query:
        match q:
            case Prefix():
                found = self._first_terms(q.field, F.startswith(F.col("term"), F.lit(q.prefix)), q.max_terms)
                return MultiTerm(q.field, tuple((t, 1.0) for t in found), q.boost)
            case Wildcard():
                head = re.match(r"[^*?]*", q.pattern).group()
                if head == q.pattern:
                    return Term(q.field, q.pattern, q.boost)
                fits = F.startswith(F.col("term"), F.lit(head)) & F.regexp_like(F.col("term"), F.lit(wildcard_regexp(q.pattern)))
                return MultiTerm(q.field, tuple((t, 1.0) for t in self._first_terms(q.field, fits, q.max_terms)))
            case Fuzzy():
                if q.prefix_length >= len(q.term):
                    return Term(q.field, q.term)
                # Only terms more similar than the last that is kept, and the first of those as similar, can be kept.
                best = self.similar_terms(q).orderBy(F.desc("similarity"), "term").limit(2 * q.max_terms).collect()
                return MultiTerm(q.field, bounded_terms(sorted((r.term, r.similarity) for r in best), q.max_terms))
            case Range():
                return ConstantScore(self.range_docs(q))
            case Phrase() if len(q.slots) == 1:
                words = q.slots[0][1]
                return Term(q.field, words[0], q.boost) if len(words) == 1 else MultiTerm(q.field, tuple(sorted((w, 1.0) for w in words)), q.boost)
            case SpanPrefix():
                found = self._first_terms(q.field, F.startswith(F.col("term"), F.lit(q.prefix)), q.max_terms)
                return SpanTerm(q.field, tuple(found), q.boost)
            case SpanFirst():
                return replace(q, match=self._rewrite(q.match))
            case SpanNot():
                return replace(q, include=self._rewrite(q.include), exclude=self._rewrite(q.exclude))
            case SpanOr() | SpanNear():
                if len(q.clauses) == 1:
                    return q.clauses[0].boosted(q.clauses[0].boost * q.boost)
                return replace(q, clauses=tuple(self._rewrite(c) for c in q.clauses))
            case Filtered():
                return replace(q, query=self._rewrite(q.query))
            case Boolean(clauses=((occur, only),)) if occur != MUST_NOT:
                return only.boosted(only.boost * q.boost)
            case Boolean() if q.clauses:
                clauses = tuple((o, self._rewrite(c)) for o, c in q.clauses)
                if all(o == MUST_NOT for o, _ in clauses):
                    clauses += ((MUST, MatchAll()),)
                return replace(q, clauses=clauses)
        return q

    def range_docs(self, q: Range) -> DataFrame:
        return self.index.postings.filter((F.col("field") == q.field) & term_range(q, F.col("term"))).select("doc_id").distinct()

    def ids(self, filter_: DataFrame | Query) -> DataFrame:
        return self.hits(filter_).select("doc_id") if isinstance(filter_, Query) else filter_.select("doc_id").distinct()

    # ---- weights
    @staticmethod
    def terms_of(q: Query) -> set[tuple[str, str]]:
        """(field, term) pairs of a rewritten query."""
        match q:
            case Term():
                return {(q.field, q.term)}
            case MultiTerm():
                return {(q.field, t) for t, _ in q.terms}
            case Phrase():
                return {(q.field, t) for _, words in q.slots for t in words}
            case SpanTerm():
                return {(q.field, t) for t in q.terms}
            case SpanNot():
                return Compiler.terms_of(q.include)
            case Span():
                return set().union(*[Compiler.terms_of(c) for c in q.parts()])
            case Boolean():
                return set().union(*[Compiler.terms_of(c) for _, c in q.clauses]) if q.clauses else set()
            case Filtered():
                return Compiler.terms_of(q.query)
        return set()

    def statistics(self, q: Query) -> tuple[dict[tuple[str, str], int], int]:
        """Document frequencies of a query's terms, as many rows as it has terms, and the number of documents."""
        wanted = self.terms_of(q)
        if not wanted:
            return {}, self.index.max_doc()
        some = F.lit(False)
        for field in sorted({f for f, _ in wanted}):
            some = some | ((F.col("field") == field) & F.col("term").isin(sorted(t for f, t in wanted if f == field)))
        return {(r.field, r.term): r.df for r in self.index.terms.filter(some).select("field", "term", "df").collect()}, self.index.max_doc()

    def idf(self, q: Query, df: dict, n: int) -> float:
        of = lambda f, t: self.similarity.idf(df.get((f, t), 0), n)
        match q:
            case Term():
                return of(q.field, q.term)
            case MultiTerm():
                return self.similarity.idf(sum(df.get((q.field, t), 0) for t, _ in q.terms), n)
            case Phrase():
                return sum(of(q.field, t) for _, words in q.slots for t in words)
            case Span():
                return sum(of(f, t) for f, t in sorted(self.terms_of(q)))
        return 1.0

    def squares(self, q: Query, df: dict, n: int) -> float:
        match q:
            case Boolean():
                return q.boost**2 * sum(self.squares(c, df, n) for o, c in q.clauses if o != MUST_NOT)
            case Filtered():
                return self.squares(q.query, df, n)
        return (self.idf(q, df, n) * q.boost) ** 2

    # ---- plans
    def hits(self, q: Query) -> DataFrame:
        """``doc_id, score`` of every live document that matches."""
        q = self.rewrite(q)
        df, n = self.statistics(q)
        found = self._plan(q, self.similarity.query_norm(self.squares(q, df, n)), df, n)
        return found.join(self.index.deletes, "doc_id", "left_anti")

    def _scored(self, rows: DataFrame, q: Query, factor: float, df: dict, n: int) -> DataFrame:
        """Rows of doc_id, freq, norm as hits of a leaf."""
        idf = self.idf(q, df, n)
        return rows.select("doc_id", (self.similarity.tf(F.col("freq")) * F.lit(idf * idf * q.boost * factor) * F.col("norm")).alias("score"))

    def _plan(self, q: Query, factor: float, df: dict, n: int) -> DataFrame:
        posted = self.index.postings
        match q:
            case Term():
                return self._scored(posted.filter((F.col("field") == q.field) & (F.col("term") == q.term)).select("doc_id", F.col("tf").alias("freq"), "norm"), q, factor, df, n)
            case MultiTerm():
                if not q.terms:
                    return self._none()
                boost = F.element_at(F.create_map(*[F.lit(x) for t in q.terms for x in (t[0], float(t[1]))]), F.col("term"))
                rows = posted.filter((F.col("field") == q.field) & F.col("term").isin([t for t, _ in q.terms]))
                sums = rows.groupBy("doc_id").agg(F.sum(self.similarity.tf(F.col("tf")) * boost).alias("s"), F.first("norm").alias("norm"))
                idf = self.idf(q, df, n)
                return sums.select("doc_id", (F.col("s") * F.lit(idf * idf * q.boost * factor) * F.col("norm")).alias("score"))
            case Phrase():
                return self._scored(self._phrase(q), q, factor, df, n) if q.slots else self._none()
            case Span():
                spans = self.spans(q)
                freq = F.sum(self.similarity.sloppy(F.col("end") - F.col("start")))
                return self._scored(spans.groupBy("doc_id").agg(freq.alias("freq"), F.first("norm").alias("norm")), q, factor, df, n)
            case MatchAll():
                return self.index.docs.select("doc_id", F.lit(q.boost * factor).alias("score"))
            case ConstantScore():
                return self.ids(q.filter).select("doc_id", F.lit(q.boost * factor).alias("score"))
            case Filtered():
                return self._plan(q.query, factor, df, n).join(self.ids(q.filter), "doc_id", "left_semi")
            case Boolean():
                return self._boolean(q, factor, df, n)
        raise TypeError(f"no plan for {type(q).__name__}")

    def _none(self) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)

    def _boolean(self, q: Boolean, factor: float, df: dict, n: int) -> DataFrame:
        """All clauses together in one aggregate by document; clauses that are terms share one scan."""
        if not q.clauses:
            return self._none()
        factor *= q.boost
        code = {MUST: 0, SHOULD: 1, MUST_NOT: 2}
        frames, terms = [], {}
        for occur, c in q.clauses:
            if isinstance(c, Term):
                weight = self.idf(c, df, n) ** 2 * c.boost * factor
                terms.setdefault(c.field, {}).setdefault(c.term, []).append((code[occur], weight))
            else:
                frames.append(self._plan(c, factor, df, n).select("doc_id", "score", F.lit(code[occur]).alias("occur")))
        for field, wanted in terms.items():
            asked = F.lit(None)
            for t, uses in wanted.items():
                asked = F.when(F.col("term") == t, F.array(*[F.struct(F.lit(o).alias("occur"), F.lit(w).alias("w")) for o, w in uses])).otherwise(asked)
            rows = self.index.postings.filter((F.col("field") == field) & F.col("term").isin(list(wanted)))
            each = rows.select("doc_id", "tf", "norm", F.explode(asked).alias("use"))
            frames.append(each.select("doc_id", (self.similarity.tf(F.col("tf")) * F.col("use.w") * F.col("norm")).alias("score"), F.col("use.occur").alias("occur")))
        every = frames[0]
        for f in frames[1:]:
            every = every.union(f)
        is_ = lambda o: F.col("occur") == code[o]
        met = every.groupBy("doc_id").agg(
            F.sum(F.when(~is_(MUST_NOT), F.col("score"))).alias("score"),
            F.count_if(is_(MUST)).alias("required"),
            F.count_if(~is_(MUST_NOT)).alias("matched"),
            F.count_if(is_(MUST_NOT)).alias("excluded"),
        )
        required, counted = sum(o == MUST for o, _ in q.clauses), sum(o != MUST_NOT for o, _ in q.clauses)
        kept = met.filter((F.col("required") == required) & (F.col("matched") > 0) & (F.col("excluded") == 0))
        score = F.col("score") * self.similarity.coord(F.col("matched"), counted) if q.coord else F.col("score")
        return kept.select("doc_id", score.alias("score"))

    def slots(self, q: Phrase) -> DataFrame:
        """doc_id, norm, lists (an array of positions for each slot) of the documents that have all slots of a phrase; a posting is one row, its positions stay together."""
        rows = self.index.postings.filter((F.col("field") == q.field) & F.col("term").isin(sorted({t for _, words in q.slots for t in words})))
        found = rows.groupBy("doc_id").agg(F.first("norm").alias("norm"), F.collect_list(F.struct("term", "positions")).alias("found"))
        of = lambda words: F.flatten(F.filter("found", lambda x: x["term"].isin(sorted(set(words))))["positions"])
        lists = F.array(*[of(words) for _, words in q.slots])
        return found.select("doc_id", "norm", lists.alias("lists")).filter(F.forall("lists", lambda x: F.size(x) > 0))

    def exact_begins(self, q: Phrase) -> DataFrame:
        """doc_id, norm, begins (where an exact phrase begins) of documents that have it."""
        offsets = [p - q.slots[0][0] for p, _ in q.slots]
        moved = lambda by: lambda p: p - F.lit(by)
        begins = F.array_distinct(F.element_at("lists", 1))
        for k, shift in enumerate(offsets[1:], 2):
            begins = F.array_intersect(begins, F.transform(F.element_at("lists", k), moved(shift)))
        return self.slots(q).select("doc_id", "norm", begins.alias("begins")).filter(F.size("begins") > 0)

    def _phrase(self, q: Phrase) -> DataFrame:
        """doc_id, freq, norm of a phrase."""
        if q.slop == 0:
            return self.exact_begins(q).select("doc_id", F.size("begins").cast("long").alias("freq"), "norm")
        freq = kernels.sloppy_freq(F.col("lists"), *self._loose(q), self.similarity.sloppy)
        return self._gathered(q).select("doc_id", "norm", freq.alias("freq")).filter("freq > 0")

    @staticmethod
    def _loose(q: Phrase) -> tuple[list[int], int, bool]:
        """Offsets, slop and whether a word is repeated, of a loose phrase."""
        words = [w for _, ws in q.slots for w in ws]
        return [p - q.slots[0][0] for p, _ in q.slots], q.slop, len(set(words)) < len(words)

    def loose_places(self, q: Phrase) -> DataFrame:
        """doc_id, pos of the tokens that lie in the windows of a loose phrase and fill a slot of it."""
        offsets, slop, repeats = self._loose(q)
        met = self._gathered(q).select("doc_id", "lists", kernels.sloppy_windows(F.col("lists"), offsets, slop, repeats).alias("windows"))
        inside = lambda shift: lambda p: F.exists("windows", lambda w: (p - shift >= w["left"]) & (p - shift <= w["right"]))
        places = F.concat(*[F.filter(F.element_at("lists", k + 1), inside(shift)) for k, shift in enumerate(offsets)])
        return met.select("doc_id", F.explode(F.array_distinct(places).cast("array<int>")).alias("pos"))

    def _gathered(self, q: Phrase) -> DataFrame:
        """doc_id, norm, lists (the sorted positions of each slot) of documents that have all slots of a phrase."""
        return self.slots(q).withColumn("lists", F.transform("lists", lambda x: F.sort_array(x.cast("array<bigint>"))))

    def spans(self, q: Span) -> DataFrame:
        """``doc_id, norm, start, end`` of a span query."""
        match q:
            case SpanTerm():
                rows = self.index.postings.filter((F.col("field") == q.field) & F.col("term").isin(list(q.terms)))
                if len(q.terms) > 1:  # tokens at one place are one span
                    rows = rows.groupBy("doc_id").agg(F.first("norm").alias("norm"), F.collect_list("positions").alias("lists")).withColumn("positions", F.array_distinct(F.flatten("lists")))
                each = rows.select("doc_id", "norm", F.explode("positions").alias("start"))
                return each.withColumn("end", F.col("start") + 1)
            case SpanFirst():
                return self.spans(q.match).filter(F.col("end") <= q.end)
            case SpanOr():
                out = self.spans(q.clauses[0])
                for c in q.clauses[1:]:
                    out = out.union(self.spans(c))
                return out
            case SpanNot():
                exclude = self.spans(q.exclude).select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
                return self.spans(q.include).join(exclude, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
            case SpanNear():
                return self._near(q)
        raise TypeError(f"no spans for {type(q).__name__}")

    def _near(self, q: SpanNear) -> DataFrame:
        """One row for each document, with the spans of each clause in order, goes through a kernel."""
        q.span_field  # noqa: B018  raises where fields differ
        frames = [self.spans(c).select("doc_id", "norm", F.lit(k).alias("k"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("span")) for k, c in enumerate(q.clauses)]
        every = frames[0]
        for f in frames[1:]:
            every = every.union(f)
        many = len(q.clauses)
        gathered = [F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("span")))) for k in range(many)]
        docs = every.groupBy("doc_id").agg(F.first("norm").alias("norm"), F.array(*gathered).alias("lists")).filter(F.forall("lists", lambda x: F.size(x) > 0))
        found = (kernels.near_ordered if q.in_order else kernels.near_unordered)(F.col("lists"), many, q.slop)
        return docs.select("doc_id", "norm", F.explode(found).alias("span")).select("doc_id", "norm", "span.start", "span.end")
