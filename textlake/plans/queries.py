"""A query for each operator over the given tables, and its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import analysis as A
from ..functions import lex, stopwords
from ..functions.scoring import NORM_VALUES
from ..operators.facade import Index
from ..operators.query import (
    MUST, MUST_NOT, SHOULD, Boolean, ConstantScore, Filtered, Fuzzy, MatchAll, MultiTerm, Phrase, Prefix, Query, Range, SortField,
    SpanFirst, SpanNear, SpanNot, SpanOr, SpanPrefix, SpanTerm, Term, Wildcard,
)
from ..operators.search import Searcher, multi_index
from ..sources.index import FieldSpec, IndexSpec, SearchIndex, build
from ..sources.shared import shared_folder, stored_index
from .parser import QueryParser

T = "text"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> SearchIndex:
    """The index of ``documents``: text by letters in lower case, lang and source as they are."""
    plain = FieldSpec(tokenized=False)
    spec = IndexSpec({"lang": plain, "source": plain, "n_chars": FieldSpec(index=False)})
    return stored_index(spark, d, "documents", lambda scratch: build(table(spark, d, "documents"), spec, A.PerField(A.LETTERS), scratch=scratch))


def orders(spark: SparkSession, d: str) -> SearchIndex:
    """The index of ``orders``: date, price and priority as untokenized strings."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), lex.date_lex(F.col("o_orderdate")).alias("day"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    plain = FieldSpec(tokenized=False)
    spec = IndexSpec({c: plain for c in ("day", "price", "priority", "customer")})
    return stored_index(spark, d, "orders", lambda scratch: build(rows, spec, A.PerField(A.UNTOKENIZED), scratch=scratch))


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def all_hits(spark: SparkSession, d: str, q: Query | str, **options) -> DataFrame:
    return rounded(Searcher(documents(spark, d), parser=QueryParser((T,), ("lang", "source"), (T,))).matches(q, **options))


# ---- the SQL side of the model
NORMS = "[" + ", ".join(repr(v) for v in NORM_VALUES if 1e-4 < v <= 1.0) + "]"


def base(text: str = "text", rows: str = "documents", ident: str = "doc_id") -> str:
    return f"""
    tok AS MATERIALIZED (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (
        SELECT {ident} AS doc_id, list_transform(regexp_extract_all(coalesce({text}, ''), '\\p{{L}}+'), lambda x: lower(x)) AS t FROM {rows})),
    post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    norm AS MATERIALIZED (SELECT doc_id, count(*) AS len, list_max(list_filter({NORMS}, lambda v: v <= 1 / sqrt(count(*)))) AS norm FROM tok GROUP BY 1),
    df AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1),
    total AS (SELECT count(*) AS n FROM {rows})"""


def bool_sql(clauses: list[tuple[str, str]], coord: bool = True, tail: str = "", extra: str = "") -> str:
    """Hits of a boolean of terms, (occur, term) pairs."""
    required, counted = sum(o == MUST for o, _ in clauses), sum(o != MUST_NOT for o, _ in clauses)
    values = ", ".join(f"('{o}', '{t}')" for o, t in clauses)
    by = f"* m / {float(counted)}" if coord else ""
    return f"""WITH {base()}, {extra}
    w AS (SELECT occur, c.term, ln(n / (coalesce(df, 0) + 1.0)) + 1 AS idf FROM (VALUES {values}) c(occur, term) LEFT JOIN df ON df.term = c.term, total),
    q AS (SELECT 1 / sqrt(sum(idf * idf)) AS qn FROM w WHERE occur <> 'must_not'),
    h AS (SELECT doc_id, sum(CASE WHEN occur <> 'must_not' THEN sqrt(tf) * idf * idf * qn * norm END) AS s, count_if(occur = 'must') AS r,
                 count_if(occur <> 'must_not') AS m, count_if(occur = 'must_not') AS x
          FROM post JOIN w USING (term) JOIN norm USING (doc_id), q GROUP BY 1)
    SELECT doc_id, round(s {by}, 6) AS score FROM h WHERE r = {required} AND m > 0 AND x = 0 {tail}"""


def leaf_sql(freq: str, idf_terms: list[str] | str, extra: str = "") -> str:
    """Hits of one leaf: ``freq`` is a query of doc_id, freq; idf sums over terms (a list, or a query of term)."""
    wanted = f"(VALUES {', '.join(f'({t!r})' for t in idf_terms)}) v(term)" if isinstance(idf_terms, list) else f"({idf_terms}) v"
    return f"""WITH {base()}, {extra}
    i AS (SELECT sum(ln(n / (coalesce(df, 0) + 1.0)) + 1) AS idf FROM {wanted} LEFT JOIN df ON df.term = v.term, total),
    f AS ({freq})
    SELECT doc_id, round(sqrt(freq) * abs(idf) * norm, 6) AS score FROM f JOIN norm USING (doc_id), i"""


def multi_sql(terms: str) -> str:
    """Hits of a multi-term; ``terms`` is a query of term, b."""
    return f"""WITH {base()}, x AS MATERIALIZED ({terms}),
    i AS (SELECT ln(n / (coalesce((SELECT sum(df) FROM df JOIN x ON df.term = x.term), 0) + 1.0)) + 1 AS idf FROM total)
    SELECT doc_id, round(sum(sqrt(tf) * b) * abs(idf) * any_value(norm), 6) AS score FROM post JOIN x USING (term) JOIN norm USING (doc_id), i GROUP BY doc_id, idf"""


# ---- dictionary and postings
@query("term_dictionary", f"WITH {base()} SELECT term, df, cf FROM df")
def _(spark, d):
    return documents(spark, d).term_enum(T)


@query("terms_from", f"WITH {base()} SELECT term, df, cf FROM df WHERE term >= 'the'")
def _(spark, d):
    return documents(spark, d).term_enum(T, "the")


@query("term_docs", f"WITH {base()} SELECT doc_id, count(*) AS tf, string_agg(pos, ' ' ORDER BY pos) AS positions FROM tok WHERE term = 'the' GROUP BY 1")
def _(spark, d):
    return documents(spark, d).term_docs(T, "the").select("doc_id", "tf", F.array_join("positions", " ").alias("positions"))


@query("term_docs_from", f"WITH {base()} SELECT doc_id, tf FROM post WHERE term = 'the' AND doc_id >= 100")
def _(spark, d):
    return documents(spark, d).term_docs(T, "the", 100).select("doc_id", "tf")


@query("field_norms", f"WITH {base()} SELECT doc_id, len, norm FROM norm")
def _(spark, d):
    return documents(spark, d).lengths.filter(F.col("field") == T).select("doc_id", "len", "norm")


@query("term_vectors", f"WITH {base()} SELECT doc_id, md5(string_agg(term || ':' || tf, ' ' ORDER BY term)) AS vector, count(*) AS n_terms FROM post GROUP BY 1")
def _(spark, d):
    ix = build(table(spark, d, "documents").select("doc_id", T), IndexSpec({}), A.PerField(A.LETTERS))  # vectors need no stored postings
    v = ix.term_vectors(T)
    one = F.transform("terms", lambda t: F.concat(t["term"], F.lit(":"), t["freq"].cast("string")))
    return v.select("doc_id", F.md5(F.array_join(one, " ").cast("binary")).alias("vector"), F.size("terms").cast("long").alias("n_terms"))


@query("index_counts", f"WITH {base()} SELECT (SELECT n FROM total) AS max_doc, count(*) AS term_count, max(df) AS top_df FROM df")
def _(spark, d):
    ix = documents(spark, d)
    return ix.terms.filter(F.col("field") == T).agg(F.count(F.lit(1)).alias("term_count"), F.max("df").alias("top_df")).crossJoin(ix.docs.agg(F.count(F.lit(1)).alias("max_doc")))  # one row each


# ---- terms and booleans
@query("term_scored", bool_sql([(SHOULD, "the")]))
def _(spark, d):
    return all_hits(spark, d, Term(T, "the"))


@query("term_topk", bool_sql([(SHOULD, "the")], tail="ORDER BY s DESC, doc_id LIMIT 10"))
def _(spark, d):
    return rounded(Searcher(documents(spark, d)).search(Term(T, "the")).hits)


@query("page_two", bool_sql([(SHOULD, "the")], tail="ORDER BY s DESC, doc_id LIMIT 10 OFFSET 10"))
def _(spark, d):
    return rounded(Searcher(documents(spark, d)).search(Term(T, "the"), offset=10, limit=10).hits)


def _bool(*clauses: tuple[str, str], coord: bool = True) -> Boolean:
    return Boolean(tuple((o, Term(T, t)) for o, t in clauses), coord)


for _name, _clauses, _coord in (
    ("bool_must", [(MUST, "the"), (MUST, "of")], True),
    ("bool_should", [(SHOULD, "the"), (SHOULD, "der"), (SHOULD, "le")], True),
    ("bool_no_coord", [(SHOULD, "the"), (SHOULD, "of")], False),
    ("bool_must_should", [(MUST, "the"), (SHOULD, "with"), (SHOULD, "by")], True),
    ("bool_must_not", [(SHOULD, "the"), (MUST_NOT, "by")], True),
):
    query(_name, bool_sql(_clauses, _coord))(lambda spark, d, q=_bool(*_clauses, coord=_coord): all_hits(spark, d, q))

NESTED = f"""WITH {base()},
    w AS (SELECT term, ln(n / (df + 1.0)) + 1 AS idf FROM df, total WHERE term IN ('the', 'of', 'by')),
    q AS (SELECT 1 / sqrt(sum(CASE WHEN term = 'the' THEN 1 ELSE 4 END * idf * idf)) AS qn FROM w),
    s AS (SELECT doc_id, term, sqrt(tf) * idf * idf * qn * norm AS s FROM post JOIN w USING (term) JOIN norm USING (doc_id), q),
    inner_ AS (SELECT doc_id, sum(s) * 2 * count(*) / 2.0 AS s FROM s WHERE term IN ('of', 'by') GROUP BY 1),
    no AS (SELECT DISTINCT doc_id FROM tok WHERE term = 'with')
    SELECT a.doc_id, round(a.s + b.s, 6) AS score FROM s a JOIN inner_ b USING (doc_id) WHERE a.term = 'the' AND a.doc_id NOT IN (SELECT doc_id FROM no)"""


@query("bool_nested", NESTED)
def _(spark, d):
    inner = _bool((SHOULD, "of"), (SHOULD, "by")).boosted(2.0)
    return all_hits(spark, d, Boolean(((MUST, Term(T, "the")), (MUST, inner), (MUST_NOT, Term(T, "with")))))


@query("query_string", NESTED)
def _(spark, d):
    return all_hits(spark, d, "+the +(of by)^2 -with")


@query("pure_negative", f"WITH {base()} SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'the')")
def _(spark, d):
    return all_hits(spark, d, _bool((MUST_NOT, "the")))


@query("match_all", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
def _(spark, d):
    return all_hits(spark, d, MatchAll())


@query("constant_score", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE source = 'src1'")
def _(spark, d):
    return all_hits(spark, d, ConstantScore(Term("source", "src1")))


@query("filtered_query", bool_sql([(SHOULD, "the")], tail="AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1')"))
def _(spark, d):
    return all_hits(spark, d, Filtered(Term(T, "the"), Term("source", "src1")))


# ---- expansions
@query("multi_term", multi_sql("SELECT * FROM (VALUES ('the', 1.0), ('of', 0.5)) t(term, b)"))
def _(spark, d):
    return all_hits(spark, d, MultiTerm(T, (("the", 1.0), ("of", 0.5))))


@query("prefix", multi_sql("SELECT term, 1.0 AS b FROM df WHERE starts_with(term, 'th') ORDER BY term LIMIT 256"))
def _(spark, d):
    return all_hits(spark, d, Prefix(T, "th"))


@query("wildcard", multi_sql("SELECT term, 1.0 AS b FROM df WHERE regexp_full_match(term, 't.e.*n') ORDER BY term LIMIT 256"))
def _(spark, d):
    return all_hits(spark, d, Wildcard(T, "t?e*n"))


@query("fuzzy", multi_sql("SELECT term, 1 - levenshtein(term, 'thering') / least(length(term), 7)::DOUBLE AS b FROM df WHERE abs(length(term) - 7) <= 7 AND 1 - levenshtein(term, 'thering') / least(length(term), 7)::DOUBLE > 0.7"))
def _(spark, d):
    return all_hits(spark, d, Fuzzy(T, "thering", 0.7, max_terms=100_000))


@query("fuzzy_prefix", multi_sql("SELECT term, 1 - levenshtein(term[3:], 'ering') / (2 + least(length(term) - 2, 5))::DOUBLE AS b FROM df WHERE starts_with(term, 'th') AND 1 - levenshtein(term[3:], 'ering') / (2 + least(length(term) - 2, 5))::DOUBLE > 0.6"))
def _(spark, d):
    return all_hits(spark, d, Fuzzy(T, "thering", 0.6, 2, max_terms=100_000))


def order_hits(spark, d, q) -> DataFrame:
    return rounded(Searcher(orders(spark, d)).matches(q))


@query("range_string", "SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1995-07-01'")
def _(spark, d):
    return order_hits(spark, d, Range("day", "1995-01-01", "1995-07-01", True, False))


@query("range_open", "SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1997-06-30'")
def _(spark, d):
    return order_hits(spark, d, Range("day", lower="1997-06-30", include_lower=False))


@query("range_typed", "SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice BETWEEN 9000.5 AND 120000")
def _(spark, d):
    return order_hits(spark, d, Range("price", "9000.5", "120000", typed=True))


# ---- phrases
@query("phrase_exact", leaf_sql("SELECT a.doc_id, count(*) AS freq FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1", ["of", "the"]))
def _(spark, d):
    return all_hits(spark, d, Phrase.of(T, "of", "the"))


@query("phrase_gap", leaf_sql("SELECT a.doc_id, count(*) AS freq FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1", ["of", "the"]))
def _(spark, d):
    return all_hits(spark, d, '"of <> the"')


@query("multi_phrase", leaf_sql("SELECT doc_id, count(*) AS freq FROM (SELECT DISTINCT a.doc_id, a.pos FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term IN ('of', 'by') AND b.term IN ('the', 'and')) GROUP BY 1", ["of", "by", "the", "and"]))
def _(spark, d):
    return all_hits(spark, d, Phrase.of(T, ("of", "by"), ("the", "and")))


@query("phrase_sloppy", f"WITH {base()} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id WHERE a.term = 'of' AND b.term = 'the' AND abs(b.pos - 1 - a.pos) <= 2")
def _(spark, d):
    return all_hits(spark, d, Phrase.of(T, "of", "the", slop=2)).select("doc_id")


def sloppy_sql(terms: list[str], slop: int) -> str:
    """``doc_id, freq`` of a loose phrase of different words, from its definition: each position is met with the next of every other slot."""
    slots, over = range(len(terms)), "(PARTITION BY doc_id ORDER BY b, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    nexts = ", ".join(f"min(b) FILTER (k = {j}) OVER {over} AS n{j}" for j in slots)
    cases = " UNION ALL ".join(
        f"SELECT doc_id, greatest({o}) - b AS width FROM m WHERE k = {k} AND {' AND '.join(f'{x} IS NOT NULL' for x in o.split(', '))} AND (n{k} IS NULL OR n{k} > least({o}))"
        for k in slots
        for o in [", ".join(f"n{j}" for j in slots if j != k)]
    )
    values = ", ".join(f"('{t}', {k})" for k, t in enumerate(terms))
    return f"""SELECT doc_id, sum(1.0::DOUBLE / (width + 1)) AS freq FROM (
        WITH p AS (SELECT doc_id, k, pos - k AS b FROM tok JOIN (VALUES {values}) v(term, k) USING (term)), m AS (SELECT *, {nexts} FROM p)
        {cases}) WHERE width <= {slop} GROUP BY 1"""


@query("phrase_sloppy_scored", leaf_sql(sloppy_sql(["of", "the", "and"], 4), ["of", "the", "and"]))
def _(spark, d):
    return all_hits(spark, d, Phrase.of(T, "of", "the", "and", slop=4))


# ---- spans
def span_sql(spans: str, terms: list[str] | str) -> str:
    """Hits of a span query; ``spans`` is a query of doc_id, s, e."""
    return leaf_sql(f"SELECT doc_id, sum(1.0::DOUBLE / (e - s + 1)) AS freq FROM ({spans}) GROUP BY 1", terms)


OF, THE = SpanTerm.of(T, "of"), SpanTerm.of(T, "the")
_of_the = "SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE term IN ('of', 'the')"


@query("span_term", span_sql("SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE term = 'the'", ["the"]))
def _(spark, d):
    return all_hits(spark, d, THE)


@query("span_multi_term", span_sql(_of_the, ["of", "the"]))
def _(spark, d):
    return all_hits(spark, d, SpanTerm.of(T, "of", "the"))


@query("span_prefix", span_sql("SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE term IN (SELECT term FROM df WHERE starts_with(term, 'the') ORDER BY term LIMIT 256)", "SELECT term FROM df WHERE starts_with(term, 'the') ORDER BY term LIMIT 256"))
def _(spark, d):
    return all_hits(spark, d, SpanPrefix(T, "the"))


@query("span_first", span_sql("SELECT doc_id, pos AS s, pos + 1 AS e FROM tok WHERE term = 'the' AND pos + 1 <= 5", ["the"]))
def _(spark, d):
    return all_hits(spark, d, SpanFirst(THE, 5))


@query("span_or", span_sql(_of_the, ["of", "the"]))
def _(spark, d):
    return all_hits(spark, d, SpanOr((OF, THE)))


@query("span_not", span_sql("SELECT doc_id, pos AS s, pos + 1 AS e FROM tok a WHERE term = 'the' AND NOT EXISTS (SELECT 1 FROM tok b WHERE b.doc_id = a.doc_id AND b.term IN ('the') AND b.pos < 5 AND b.pos = a.pos)", ["the"]))
def _(spark, d):
    return all_hits(spark, d, SpanNot(THE, SpanFirst(THE, 5)))


@query("span_near_ordered", f"WITH {base()} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id WHERE a.term = 'of' AND b.term = 'the' AND b.pos > a.pos AND b.pos - a.pos - 1 <= 1")
def _(spark, d):
    return all_hits(spark, d, SpanNear((OF, THE), 1, True)).select("doc_id")


@query("span_near_unordered", f"WITH {base()} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id WHERE a.term = 'of' AND b.term = 'the' AND abs(b.pos - a.pos) - 1 <= 1")
def _(spark, d):
    return all_hits(spark, d, SpanNear((OF, THE), 1, False)).select("doc_id")


def near_sql(ordered: bool, slop: int) -> str:
    """``doc_id, s, e`` of ``of`` near ``the``: each span and the next one of the other word, after it or, in order, not before it."""
    ends = "SELECT doc_id, k, pos, min(pos) FILTER (k = 0) OVER w AS n0, min(pos) FILTER (k = 1) OVER w AS n1 FROM (SELECT doc_id, pos, (term = 'the')::INT AS k FROM tok WHERE term IN ('of', 'the')) WINDOW w AS (PARTITION BY doc_id ORDER BY pos, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    one = lambda k, n: f"SELECT doc_id, pos AS s, {n} + 1 AS e FROM ({ends}) WHERE k = {k} AND {n} - pos - 1 <= {slop}"
    return one(0, "n1") if ordered else f"{one(0, 'n1')} UNION ALL {one(1, 'n0')}"


@query("span_near_ordered_scored", span_sql(near_sql(True, 3), ["of", "the"]))
def _(spark, d):
    return all_hits(spark, d, SpanNear((OF, THE), 3, True))


@query("span_near_unordered_scored", span_sql(near_sql(False, 3), ["of", "the"]))
def _(spark, d):
    return all_hits(spark, d, SpanNear((OF, THE), 3, False))


# ---- filters and factors
@query("filter_query", bool_sql([(SHOULD, "the")], tail="AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def _(spark, d):
    return all_hits(spark, d, Term(T, "the"), filter=Term("lang", "en"))


@query("filter_range", bool_sql([(SHOULD, "the")], tail="AND doc_id IN (SELECT doc_id FROM documents WHERE source >= 'src1' AND source <= 'src3')"))
def _(spark, d):
    return all_hits(spark, d, Term(T, "the"), filter=Range("source", "src1", "src3"))


@query("filter_frame", bool_sql([(SHOULD, "the")], tail="AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def _(spark, d):
    return all_hits(spark, d, Term(T, "the"), filter=table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("filter_proc_keep", bool_sql([(SHOULD, "the")], tail="AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)"))
def _(spark, d):
    return all_hits(spark, d, Term(T, "the"), factor=F.col("n_chars") > 1000)


@query("filter_proc_decay", f"SELECT h.doc_id, round(h.s * power(0.5, n_chars / 5000.0), 6) AS score FROM ({bool_sql([(SHOULD, 'the')]).replace('round(s * m / 1.0, 6) AS score', 's')}) h JOIN documents USING (doc_id)")
def _(spark, d):
    return all_hits(spark, d, Term(T, "the"), factor=F.pow(F.lit(0.5), F.col("n_chars") / 5000.0))


# ---- order
def _sorted(name: str, order: str, sort, words=(SHOULD, "the")) -> None:
    sql = bool_sql([words], extra="docs AS (SELECT * FROM documents),").replace("SELECT doc_id, round(s * m / 1.0, 6) AS score FROM h WHERE", "SELECT h.doc_id, round(s, 6) AS score FROM h JOIN docs ON h.doc_id = docs.doc_id WHERE")
    query(name, f"{sql} ORDER BY {order} LIMIT 20")(lambda spark, d: rounded(Searcher(documents(spark, d)).search(Term(T, "the"), limit=20, sort=sort).hits))


_sorted("sort_string", "source ASC NULLS LAST, h.doc_id", (SortField("source", "string"),))
_sorted("sort_string_reverse", "source DESC NULLS FIRST, h.doc_id", (SortField("source", "string", True),))
_sorted("sort_byte", "source ASC NULLS FIRST, h.doc_id", (SortField("source", "byte"),))
_sorted("sort_integer", "coalesce(n_chars, 0) ASC, h.doc_id", (SortField("n_chars", "integer"),))
_sorted("sort_auto", "coalesce(n_chars, 0) DESC, h.doc_id", (SortField("n_chars", reverse=True),))
_sorted("sort_text", "lang DESC NULLS FIRST, source ASC NULLS LAST, h.doc_id", "lang DESC, source")
_sorted("sort_score_reverse", "s ASC, h.doc_id", (SortField("score", reverse=True),))
_sorted("sort_doc", "h.doc_id DESC", (SortField("doc_id", reverse=True),))


@query("sort_float", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return Searcher(orders(spark, d)).search(Term("priority", "1-URGENT"), limit=25, sort=(SortField("price", "float", True),)).hits.select("doc_id")


@query("scan_from", f"WITH {base()} SELECT doc_id FROM post WHERE term = 'the' AND doc_id >= 50 ORDER BY doc_id LIMIT 50")
def _(spark, d):
    return Searcher(documents(spark, d)).scan(Term(T, "the"), 50)


@query("search_each", f"WITH h AS ({bool_sql([(SHOULD, 'the')]).replace('round(s * m / 1.0, 6) AS score', 's')}) SELECT doc_id, round(s / greatest((SELECT max(s) FROM h), 1.0), 6) AS score FROM h ORDER BY s DESC, doc_id LIMIT 10")
def _(spark, d):
    return rounded(Searcher(documents(spark, d)).search(Term(T, "the")).rescaled())


@query("top_docs_totals", f"SELECT count(*) AS total_hits, max(score) AS max_score FROM ({bool_sql([(SHOULD, 'the')])})")
def _(spark, d):
    return all_hits(spark, d, Term(T, "the")).agg(F.count(F.lit(1)).alias("total_hits"), F.max("score").alias("max_score"))


@query("group_hits", f"WITH h AS ({bool_sql([(SHOULD, 'the')]).replace('round(s * m / 1.0, 6) AS score', 's')}), g AS (SELECT source, count(*) AS hits, sum(s) AS s FROM h JOIN documents USING (doc_id) GROUP BY 1) SELECT source, hits, round(s / (SELECT max(s) FROM g), 6) AS share FROM g")
def _(spark, d):
    s = Searcher(documents(spark, d))
    g = s.documents(s.matches(Term(T, "the"))).groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("s"))
    return g.crossJoin(F.broadcast(g.agg(F.max("s").alias("top")))).select("source", "hits", F.round(F.col("s") / F.col("top"), 6).alias("share"))  # one row


# ---- sets, several indexes, maintenance
@query("set_operations", f"WITH {base()}, a AS (SELECT doc_id FROM post WHERE term = 'the'), b AS (SELECT doc_id FROM post WHERE term = 'by') SELECT 'and' AS op, doc_id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'or', doc_id FROM (FROM a UNION FROM b) UNION ALL SELECT 'xor', doc_id FROM ((FROM a UNION FROM b) EXCEPT (FROM a INTERSECT FROM b)) UNION ALL SELECT 'not', doc_id FROM documents WHERE doc_id NOT IN (FROM a)")
def _(spark, d):
    from ..operators.sets import and_, not_, or_, xor

    ix = documents(spark, d)
    a, b = (ix.term_docs(T, t).select("doc_id") for t in ("the", "by"))
    frames = [("and", and_(a, b)), ("or", or_(a, b)), ("xor", xor(a, b)), ("not", not_(a, ix.docs))]
    out = None
    for name, f in frames:
        f = f.select(F.lit(name).alias("op"), "doc_id")
        out = f if out is None else out.union(f)
    return out


@query("multi_index_idf", bool_sql([(SHOULD, "the"), (SHOULD, "of")]))
def _(spark, d):
    docs, spec = table(spark, d, "documents").select("doc_id", T), IndexSpec({})
    folder = f"{shared_folder(spark)}/textlake/halves-{uuid.uuid4().hex}"
    parts = [build(docs.filter(f"doc_id % 2 = {k}"), spec, scratch=f"{folder}/{k}") for k in (0, 1)]  # texts are analysed once, not once for each table
    return rounded(Searcher(parts[0].merge(parts[1])).matches(_bool((SHOULD, "the"), (SHOULD, "of"))))


@query("multi_index_shifted", "SELECT doc_id, source FROM (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents), source FROM documents) WHERE source = 'src1'")
def _(spark, d):
    ix = documents(spark, d)
    both = multi_index(ix, ix)
    return Searcher(both).documents(Searcher(both).scan(Term("source", "src1"), limit=None)).select("doc_id", "source")


@query("delete_then_search", bool_sql([(SHOULD, "the")], tail="AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src2')"))
def _(spark, d):
    return rounded(Searcher(documents(spark, d).delete_terms("source", "src2")).matches(Term(T, "the")))


@query("compacted_search", bool_sql([(SHOULD, "the")]).replace("FROM documents", "FROM (FROM documents WHERE source IS DISTINCT FROM 'src2')"))
def _(spark, d):
    return rounded(Searcher(documents(spark, d).delete_terms("source", "src2").compact()).matches(Term(T, "the")))


@query("key_upsert", "SELECT user_id, event_type, doc_id FROM (SELECT user_id, event_type, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("user_id"), "event_type")
    spec = IndexSpec({"user_id": FieldSpec(tokenized=False), "event_type": FieldSpec(tokenized=False)})
    half = rows.agg((F.max("doc_id") / 2).cast("long")).first()[0] or 0
    ix = build(rows.limit(0), spec).upsert(rows.filter(F.col("doc_id") <= half), ["user_id"]).upsert(rows.filter(F.col("doc_id") > half), ["user_id"])
    return ix.live().select(F.col("user_id").cast("long").alias("user_id"), "event_type", "doc_id")


CUSTOMERS = "SELECT c_custkey AS doc_id, c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer"


def customers(spark: SparkSession, d: str) -> Index:
    """An index of customers that changes: name, market segment and nation as they are."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    spec = IndexSpec({c: FieldSpec(tokenized=False) for c in ("name", "segment", "nation")})
    return Index(build(rows, spec, A.PerField(A.UNTOKENIZED)))


@query("update_by_query", f"WITH c AS ({CUSTOMERS}) SELECT CASE WHEN segment = 'BUILDING' THEN doc_id + 1 + (SELECT max(doc_id) FROM c) ELSE doc_id END AS doc_id, name, CASE WHEN segment = 'BUILDING' THEN 'HOUSES' ELSE segment END AS segment, nation FROM c")
def _(spark, d):
    return customers(spark, d).update(Term("segment", "BUILDING"), segment=F.lit("HOUSES")).index.live()


@query("search_after_update", f"SELECT doc_id + 1 + (SELECT max(c_custkey) FROM customer) AS doc_id FROM ({CUSTOMERS}) WHERE segment = 'BUILDING' AND nation = '7'")
def _(spark, d):
    ix = customers(spark, d).update(Term("segment", "BUILDING"), segment=F.lit("HOUSES"))
    return ix.search(Boolean(((MUST, Term("segment", "HOUSES")), (MUST, Term("nation", "7")))), limit=None).hits.select("doc_id")


@query("delete_by_query", f"SELECT * FROM ({CUSTOMERS}) WHERE NOT (segment = 'BUILDING' OR nation = '3')")
def _(spark, d):
    return customers(spark, d).delete("segment:BUILDING OR nation:3").index.live()


@query("composite_key", "SELECT event_type, user_id, doc_id FROM (SELECT user_id, event_type, event_id AS doc_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("user_id"), "event_type")
    half = rows.agg((F.max("doc_id") / 2).cast("long")).first()[0] or 0
    plain = IndexSpec({"user_id": FieldSpec(tokenized=False), "event_type": FieldSpec(tokenized=False)})
    ix = Index(build(rows.limit(0), plain), key=("user_id", "event_type")).add(rows.filter(F.col("doc_id") <= half)).add(rows.filter(F.col("doc_id") > half))
    return ix.index.live().select("event_type", F.col("user_id").cast("long").alias("user_id"), "doc_id")


@query("batch_update", f"SELECT doc_id + CASE WHEN nation = '7' THEN 1000000 ELSE 0 END AS doc_id, name, CASE WHEN nation = '7' THEN 'MOVED' ELSE segment END AS segment, nation FROM ({CUSTOMERS})")
def _(spark, d):
    ix = customers(spark, d)
    new = ix.index.docs.filter("nation = '7'").withColumns({"segment": F.lit("MOVED"), "doc_id": F.col("doc_id") + 1000000})
    return ix.batch_update(new, ["name"]).index.live()


@query("documents_by_range", f"SELECT * FROM ({CUSTOMERS}) WHERE doc_id >= 20 AND doc_id < 60 AND segment <> 'BUILDING'")
def _(spark, d):
    return customers(spark, d).delete(Term("segment", "BUILDING"))[20:60]


@query("term_vector_of_one", f"WITH {base()} SELECT term, tf AS freq, string_agg(pos, ' ' ORDER BY pos) AS positions FROM tok JOIN post USING (doc_id, term) WHERE doc_id = 7 GROUP BY ALL")
def _(spark, d):
    one = documents(spark, d).term_vectors(T, 7).select(F.explode("terms").alias("t"))
    return one.select("t.term", "t.freq", F.array_join("t.positions", " ").alias("positions"))


# ---- analysis
def _tokens(name: str, analyzer, sql: str | None, rows=lambda spark, d: table(spark, d, "documents").select("doc_id", F.col(T))) -> None:
    def run(spark, d):
        t = rows(spark, d)
        return t.select("doc_id", F.explode(analyzer(F.col(t.columns[1]))).alias("t")).groupBy("t.term").agg(F.count(F.lit(1)).alias("n"), F.sum("t.pos").alias("places"))

    query(name, sql and f"WITH t AS ({sql}) SELECT term, count(*) AS n, sum(pos)::BIGINT AS places FROM t GROUP BY 1")(run)


def split_sql(pattern: str, change: str = "x", rows: str = "documents", text: str = "text") -> str:
    return f"SELECT unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT list_transform(regexp_extract_all(coalesce({text}, ''), '{pattern}'), lambda x: {change}) AS t FROM {rows})"


_stop = ", ".join(f"'{w}'" for w in stopwords.ENGLISH)
_tokens("letter_tokens", A.LETTERS, split_sql(r"\p{L}+", "lower(x)"))
_tokens("ascii_letter_tokens", A.Analyzer(A.ascii_letters), split_sql("[A-Za-z]+"))
_tokens("whitespace_tokens", A.WHITESPACE, split_sql(A.NO_SPACE, "x[:255]"))
_tokens("ascii_whitespace_tokens", A.Analyzer(A.ascii_whitespace), split_sql(r"[^\t\n\x0B\f\r ]+", "x[:255]"))


@query(
    "token_offsets",
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}+') AS m, regexp_split_to_array(text, '\\p{L}+') AS gaps FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(m) AS term, generate_subscripts(m, 1) AS i, gaps FROM t),
    p AS (SELECT doc_id, term, i, sum(length(gaps[i])) OVER (PARTITION BY doc_id ORDER BY i)
                 + coalesce(sum(length(term)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
    SELECT doc_id, lower(term) AS term, count(*) AS n, sum(s)::BIGINT AS starts, sum(s + length(term))::BIGINT AS ends FROM p GROUP BY ALL""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # texts move instead of their tokens
    tokens = docs.select("doc_id", F.explode(A.token_stream(F.col(T), A.LETTERS)).alias("t"))
    return tokens.groupBy("doc_id", "t.term").agg(F.count(F.lit(1)).alias("n"), F.sum("t.start").alias("starts"), F.sum("t.end").alias("ends"))


_tokens("regexp_tokens", A.regexp_analyzer("[a-z]+[0-9]*"), split_sql("[a-z]+[0-9]*", "lower(x)", "pages", "url"), lambda spark, d: table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"))
_tokens("stop_filter", A.STOPPED, f"SELECT * FROM ({split_sql(chr(92) + 'p{L}+', 'lower(x)')}) WHERE term NOT IN ({_stop})")
_tokens("mapping_filter", A.Analyzer(A.letters, (A.lower, A.mapping({"é": "e", "è": "e", "ê": "e", "ä": "a", "ö": "o", "ü": "u", "ç": "c"}))), split_sql(r"\p{L}+", "translate(lower(x), 'éèêäöüç', 'eeeaouc')"))
_tokens("mapping_strings", A.Analyzer(A.letters, (A.lower, A.mapping({"th": "z", "ing": "in"}))), split_sql(r"\p{L}+", "replace(replace(lower(x), 'ing', 'in'), 'th', 'z')"))
_tokens("untokenized", A.UNTOKENIZED, "SELECT source AS term, 0 AS pos FROM documents WHERE source IS NOT NULL", lambda spark, d: table(spark, d, "documents").select("doc_id", "source"))
_tokens("standard_tokens", A.STANDARD, None)
_tokens("english_stems", A.ENGLISH, None)


@query("hyphen_filter", "SELECT * FROM (VALUES ('email', 0), ('e', 0), ('mail', 1), ('server', 2), ('upto', 3), ('up', 3), ('to', 4), ('date', 5)) t(term, pos)")
def _(spark, d):
    t = A.Analyzer(A.whitespace, (A.hyphens,))
    return spark.range(1).select(F.explode(t(F.lit("e-mail server up-to date"))).alias("t")).select("t.term", "t.pos")


@query("per_field", "SELECT lang AS field, count(DISTINCT term) AS terms FROM (SELECT 'lang' AS lang, lang AS term FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE term IS NOT NULL GROUP BY 1")
def _(spark, d):
    return documents(spark, d).terms.filter(F.col("field") != T).groupBy("field").agg(F.count(F.lit(1)).alias("terms"))


# ---- encodings
@query("lex_int", "SELECT o_orderkey, CASE WHEN v >= 0 THEN lpad(length(v::VARCHAR)::VARCHAR, 4, '0') || v ELSE '-' || (10000 - length((-v)::VARCHAR)) || lpad((power(10, length((-v)::VARCHAR))::BIGINT + v)::VARCHAR, length((-v)::VARCHAR)::INTEGER, '0') END AS lex, v AS back FROM (SELECT o_orderkey, (o_custkey - 700)::BIGINT AS v FROM orders)")
def _(spark, d):
    v = table(spark, d, "orders").select("o_orderkey", lex.int_lex((F.col("o_custkey") - 700).cast("bigint")).alias("lex"))
    return v.select("o_orderkey", "lex", lex.lex_int(F.col("lex")).alias("back"))


@query("lex_pad", "SELECT o_orderkey, lpad(o_custkey::VARCHAR, 10, ' ') AS padded FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", lex.int_pad(F.col("o_custkey")).alias("padded"))


@query("lex_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS second, date_trunc('month', o_orderdate)::DATE::VARCHAR AS back FROM orders")
def _(spark, d):
    v = table(spark, d, "orders").select("o_orderkey", lex.date_lex(F.col("o_orderdate"), "month").alias("month"), lex.date_lex(F.col("o_orderdate"), "second").alias("second"))
    return v.withColumn("back", lex.lex_date(F.col("month")).cast("string"))


# ---- presentation
@query("hits_json")
def _(spark, d):
    return Searcher(documents(spark, d)).search(Term(T, "the")).to_json()


@query("highlight")
def _(spark, d):
    s = Searcher(documents(spark, d))
    return s.highlight(Phrase.of(T, "of", "the"), T, s.search(Phrase.of(T, "of", "the")).hits)


@query("match_positions", f"WITH {base()} SELECT doc_id, string_agg(pos, ' ' ORDER BY pos) AS positions FROM tok WHERE term IN ('of', 'the') GROUP BY 1")
def _(spark, d):
    return Searcher(documents(spark, d)).match_positions(_bool((SHOULD, "of"), (SHOULD, "the")), T).select("doc_id", F.array_join("positions", " ").alias("positions"))


@query("explain")
def _(spark, d):
    s = Searcher(documents(spark, d))
    q = _bool((SHOULD, "of"), (SHOULD, "the"))
    top = s.search(q, limit=1).hits.first()
    told = s.explain(q, top.doc_id) if top else None
    return spark.createDataFrame([(top.doc_id, round(top.score, 6), round(told.value, 6), str(told))] if top else [], "doc_id bigint, score double, value double, told string")


@query("streamed_index", bool_sql([(SHOULD, "the")]))
def _(spark, d):
    from ..streaming.ingest import SegmentedIndex

    rows = table(spark, d, "documents").select("doc_id", T)
    folder = f"{shared_folder(spark)}/textlake/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/documents.parque[t]")  # a pattern: the table is a file or a folder
    ix = SegmentedIndex(f"{folder}/index", IndexSpec({}), A.PerField(A.LETTERS))
    ix.start(stream, f"{folder}/checkpoint").awaitTermination()
    return rounded(Searcher(ix.open(spark)).matches(Term(T, "the")))
