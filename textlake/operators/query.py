"""Queries as values: frozen dataclasses that print, compare and hash by structure."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
_MARK = {MUST: "+", SHOULD: "", MUST_NOT: "-"}
MAX_TERMS, MIN_SIMILARITY, MAX_CLAUSES = 256, 0.5, 1024


def _boosted(s: str, boost: float) -> str:
    return s if boost == 1.0 else f"{s}^{float(boost):g}" + (".0" if float(boost) == int(boost) and abs(boost) < 1e6 else "")


def _scoped(field_: str, s: str, default: str) -> str:
    return s if field_ == default else f"{field_}:{s}"


@dataclass(frozen=True)
class Query:
    def boosted(self, boost: float) -> Query:
        return replace(self, boost=boost)

    def show(self, default: str = "") -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.show()


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str
    boost: float = 1.0

    def show(self, default=""):
        return _boosted(_scoped(self.field, self.term, default), self.boost)


@dataclass(frozen=True)
class MultiTerm(Query):
    """Documents with any of the terms, (term, boost) pairs; scored as one term of summed frequency."""

    field: str
    terms: tuple[tuple[str, float], ...]
    boost: float = 1.0

    def show(self, default=""):
        return _boosted(_scoped(self.field, '"' + "|".join(t if b == 1 else f"{t}^{b:g}" for t, b in self.terms) + '"', default), self.boost)


def bounded_terms(found: list[tuple[str, float]], most: int = MAX_TERMS, min_boost: float = 0.0) -> tuple[tuple[str, float], ...]:
    """The terms that a bounded multi-term query keeps when ``found`` are added in turn.

    Once it is full, a term of no more than the lowest boost is turned away; a better one takes the place of
    the lowest by boost and then by term.
    """
    import heapq

    heap: list[tuple[float, str]] = []
    for t, b in found:
        if b <= min_boost:
            continue
        if len(heap) < most:
            heapq.heappush(heap, (b, t))
        elif b > heap[0][0]:
            heapq.heapreplace(heap, (b, t))
    return tuple(sorted(((t, b) for b, t in heap)))


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[tuple[str, Query], ...] = ()
    coord: bool = True
    boost: float = 1.0

    def __post_init__(self):
        if len(self.clauses) > MAX_CLAUSES:
            raise ValueError(f"more than {MAX_CLAUSES} clauses")
        if any(o not in _MARK for o, _ in self.clauses):
            raise ValueError("a clause is must, should or must_not")

    def add(self, query: Query, occur: str = SHOULD) -> Boolean:
        return replace(self, clauses=(*self.clauses, (occur, query)))

    def show(self, default=""):
        parts = [_MARK[o] + (f"({q.show(default)})" if isinstance(q, Boolean) and (q.boost == 1.0) else q.show(default)) for o, q in self.clauses]
        s = " ".join(parts)
        return _boosted(f"({s})", self.boost) if self.boost != 1.0 else s


@dataclass(frozen=True)
class Phrase(Query):
    """Slots of (position, alternatives); ``slop`` is the room for moves."""

    field: str
    slots: tuple[tuple[int, tuple[str, ...]], ...]
    slop: int = 0
    boost: float = 1.0

    @staticmethod
    def of(field_: str, *words: str | tuple[str, ...], slop: int = 0) -> Phrase:
        return Phrase(field_, tuple((i, (w,) if isinstance(w, str) else tuple(w)) for i, w in enumerate(words)), slop)

    def show(self, default=""):
        out, at = [], self.slots[0][0] if self.slots else 0
        for pos, words in self.slots:
            out += ["<>"] * (pos - at)
            out.append("|".join(words))
            at = pos + 1
        s = '"' + " ".join(out) + '"' + (f"~{self.slop}" if self.slop else "")
        return _boosted(_scoped(self.field, s, default), self.boost)


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str
    max_terms: int = MAX_TERMS
    boost: float = 1.0

    def show(self, default=""):
        return _boosted(_scoped(self.field, self.prefix + "*", default), self.boost)


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    pattern: str
    max_terms: int = MAX_TERMS
    boost: float = 1.0

    def show(self, default=""):
        return _boosted(_scoped(self.field, self.pattern, default), self.boost)


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within an edit distance; 0 for ``min_similarity`` or ``max_terms`` means their default."""

    field: str
    term: str
    min_similarity: float = MIN_SIMILARITY
    prefix_length: int = 0
    max_terms: int = MAX_TERMS
    boost: float = 1.0

    def __post_init__(self):
        if not 0 <= self.min_similarity < 1:
            raise ValueError("the similarity is from 0 up to 1")
        object.__setattr__(self, "min_similarity", self.min_similarity or MIN_SIMILARITY)
        object.__setattr__(self, "max_terms", self.max_terms or MAX_TERMS)

    def show(self, default=""):
        s = "" if self.min_similarity == MIN_SIMILARITY else f"{self.min_similarity:g}"
        return _boosted(_scoped(self.field, f"{self.term}~{s}", default), self.boost)


@dataclass(frozen=True)
class Range(Query):
    """Terms between bounds; a bound of None is open. ``typed`` compares numbers where both given bounds are numbers."""

    field: str
    lower: str | None = None
    upper: str | None = None
    include_lower: bool = True
    include_upper: bool = True
    typed: bool = False
    boost: float = 1.0

    def __post_init__(self):
        if self.lower is None and self.upper is None:
            raise ValueError("a range has a bound")
        if not self.typed and None not in (self.lower, self.upper) and self.lower > self.upper:
            raise ValueError("the lower bound is above the upper one")

    def show(self, default=""):
        low = "<" if self.lower is None else ("[" if self.include_lower else "{") + self.lower
        high = ">" if self.upper is None else self.upper + ("]" if self.include_upper else "}")
        s = low + high if None in (self.lower, self.upper) else f"{low} {high}"
        return _boosted(_scoped(self.field, s, default), self.boost)


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0

    def show(self, default=""):
        return _boosted("*", self.boost)


@dataclass(frozen=True)
class ConstantScore(Query):
    """Documents of a filter (a DataFrame of doc_id, or a query), all with one score."""

    filter: DataFrame | Query
    boost: float = 1.0

    def show(self, default=""):
        return _boosted(f"ConstantScore({self.filter if isinstance(self.filter, Query) else 'filter'})", self.boost)


@dataclass(frozen=True)
class Filtered(Query):
    """Hits of a query that a filter has too; scores are the query's, and so is the boost."""

    query: Query
    filter: DataFrame | Query
    boost: float = 1.0

    def show(self, default=""):
        return f"Filtered({self.query.show(default)})"


@dataclass(frozen=True)
class Span(Query):
    """Queries of token ranges."""

    @property
    def span_field(self) -> str:
        fields = {c.span_field for c in self.parts()}
        if len(fields) != 1:
            raise ValueError("all clauses of a span query have one field")
        return fields.pop()

    def parts(self) -> tuple[Span, ...]:
        return ()


def _spans_only(parts) -> None:
    if not parts or not all(isinstance(p, Span) for p in parts):
        raise ValueError("span queries have span clauses")


@dataclass(frozen=True)
class SpanTerm(Span):
    """Occurrences of any of the terms."""

    field: str
    terms: tuple[str, ...]
    boost: float = 1.0

    @staticmethod
    def of(field_: str, *terms: str) -> SpanTerm:
        return SpanTerm(field_, tuple(terms))

    @property
    def span_field(self):
        return self.field

    def show(self, default=""):
        return f"span_terms({self.field}:{','.join(self.terms)})"


@dataclass(frozen=True)
class SpanPrefix(Span):
    field: str
    prefix: str
    max_terms: int = MAX_TERMS
    boost: float = 1.0

    @property
    def span_field(self):
        return self.field

    def show(self, default=""):
        return f"span_prefix({self.field}:{self.prefix}*)"


@dataclass(frozen=True)
class SpanFirst(Span):
    match: Span
    end: int
    boost: float = 1.0

    def __post_init__(self):
        _spans_only([self.match])

    def parts(self):
        return (self.match,)

    def show(self, default=""):
        return f"span_first({self.match.show(default)},{self.end})"


@dataclass(frozen=True)
class SpanOr(Span):
    clauses: tuple[Span, ...]
    boost: float = 1.0

    def __post_init__(self):
        _spans_only(self.clauses)

    def parts(self):
        return self.clauses

    def show(self, default=""):
        return f"span_or[{','.join(c.show(default) for c in self.clauses)}]"


@dataclass(frozen=True)
class SpanNear(Span):
    clauses: tuple[Span, ...]
    slop: int = 0
    in_order: bool = False
    boost: float = 1.0

    def __post_init__(self):
        _spans_only(self.clauses)

    def parts(self):
        return self.clauses

    def show(self, default=""):
        return f"span_near[{','.join(c.show(default) for c in self.clauses)}]"


@dataclass(frozen=True)
class SpanNot(Span):
    include: Span
    exclude: Span
    boost: float = 1.0

    def __post_init__(self):
        _spans_only([self.include, self.exclude])

    def parts(self):
        return self.include, self.exclude

    def show(self, default=""):
        return f"span_not(inc:<{self.include.show(default)}>, exc:<{self.exclude.show(default)}>)"


@dataclass(frozen=True)
class SortField:
    """``score``, ``doc_id`` or a stored column, read as ``auto``, ``integer``, ``float``, ``string`` or ``byte``."""

    name: str
    kind: str = "auto"
    reverse: bool = False
    _: tuple = field(default=(), repr=False)


def combine(queries: list[Query]) -> Query:
    """One query for several: duplicates go, and booleans of only optional clauses without coordination are laid flat."""
    flat: list[Query] = []
    for q in queries:
        loose = isinstance(q, Boolean) and not q.coord and all(o == SHOULD for o, _ in q.clauses)
        flat += [c for _, c in q.clauses] if loose else [q]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else Boolean(tuple((SHOULD, q) for q in flat), coord=False)
