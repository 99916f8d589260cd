import itertools
import random

import pytest
from pyspark.sql import functions as F

from textlake.functions.analysis import LETTERS, STANDARD, WHITESPACE, PerField, standard_tokens
from textlake.functions.scoring import NORM_VALUES, Similarity, norm_code
from textlake.functions.stemming import porter
from textlake.operators import kernels
from textlake.operators.facade import Index
from textlake.operators.query import MUST, MUST_NOT, SHOULD, Boolean, Fuzzy, MatchAll, Phrase, Prefix, Range, SortField, SpanNear, SpanTerm, Term, bounded_terms, combine
from textlake.operators.search import Searcher, excerpts, parse_sort
from textlake.plans.parser import QueryParseError, QueryParser, clean
from textlake.sources.index import FieldSpec, IndexSpec, build, from_records, load

# Texts, queries and what they print are those that any engine of this query language has to agree on.
TEXTS = ["start finish one two", "start one finish two", "start one two finish", "finish start one two", "finish one start two", "one two three", None, ""]


@pytest.fixture(scope="module")
def index(spark):
    rows = from_records(spark, [{"text": t, "rank": str(k)} for k, t in enumerate(TEXTS)])
    return build(rows, IndexSpec({"rank": FieldSpec(tokenized=False)}), PerField(WHITESPACE))


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize("slop, ordered, want", [(0, True, [0]), (0, False, [0, 3]), (1, True, [0, 1]), (1, False, [0, 1, 3, 4]), (4, False, [0, 1, 2, 3, 4])])
def test_span_near(index, slop, ordered, want):
    q = SpanNear((SpanTerm.of("text", "start"), SpanTerm.of("text", "finish")), slop, ordered)
    assert ids(Searcher(index).matches(q)) == want


def test_phrases_and_ranges(index):
    s = Searcher(index)
    assert ids(s.matches(Phrase.of("text", "one", "two"))) == [0, 2, 3, 5]
    assert ids(s.matches(Phrase.of("text", "one", "two", slop=1))) == [0, 1, 2, 3, 4, 5]
    assert ids(s.matches(Range("rank", "2", "4", True, False))) == [2, 3]
    assert ids(s.matches(Range("rank", "1.5", "3", typed=True))) == [2, 3]
    assert ids(s.matches(Boolean(((MUST_NOT, Term("text", "start")),)))) == [5, 6, 7]
    assert ids(s.matches(Boolean())) == []
    assert ids(s.matches(Prefix("text", "no-such"))) == []
    assert ids(s.matches(Fuzzy("text", "starts", 0.7))) == [0, 1, 2, 3, 4]
    assert ids(s.matches(MatchAll())) == list(range(8))


def test_paging_and_sorting(index):
    s = Searcher(index)
    page = s.search(MatchAll(), offset=1, limit=3, sort=(SortField("rank", "integer", True),))
    assert [r.doc_id for r in page.hits.collect()] == [6, 5, 4] and page.total_hits() == 8
    assert [r.doc_id for r in s.search(MatchAll(), limit=None, sort="rank DESC").hits.collect()] == list(range(7, -1, -1))
    with pytest.raises(ValueError):
        s.search(MatchAll(), limit=0)
    with pytest.raises(ValueError):
        s.search(MatchAll(), offset=-1)
    assert parse_sort("rating DESC, SCORE") == (SortField("rating", reverse=True), SortField("score"))


def test_explanations_tell_the_score(index):
    s = Searcher(index)
    for q in (Term("text", "one"), Boolean(((MUST, Term("text", "one")), (SHOULD, Term("text", "start")))), Phrase.of("text", "one", "two")):
        for r in s.matches(q).collect():
            told = s.explain(q, r.doc_id)
            assert told.value == pytest.approx(r.score) and told.to_html()


def test_maintenance(spark, index):
    gone = index.delete_terms("text", "three")
    assert (gone.max_doc(), gone.num_docs(), gone.has_deletions()) == (8, 7, True)
    assert ids(Searcher(gone).matches(Term("text", "one"))) == [0, 1, 2, 3, 4] and gone.doc_freq("text", "one") == 6
    assert gone.compact().doc_freq("text", "one") == 5 and gone.undelete_all().num_docs() == 8
    new = index.upsert(spark.createDataFrame([(8, "fresh one", "3")], "doc_id bigint, text string, rank string"), ["rank"])
    assert ids(Searcher(new).matches(Term("rank", "3"))) == [8]


def test_stored_index_reads_back(index, tmp_path):
    stored = index.save(str(tmp_path / "ix"))
    again = load(index.spark, str(tmp_path / "ix"), index.analyzer)
    assert again.spec == index.spec and ids(Searcher(again).matches(Term("text", "one"))) == ids(Searcher(stored).matches(Term("text", "one")))


def test_values_of_an_array_follow_one_another(spark):
    rows = spark.createDataFrame([(0, ["a b", "c"]), (1, None)], "doc_id bigint, text array<string>")
    ix = build(rows, analyzer=PerField(LETTERS))
    assert ids(Searcher(ix).matches(Phrase.of("text", "b", "c"))) == [0]


def test_norms_round_down_to_their_bytes():
    assert all(norm_code(v) == b for b, v in enumerate(NORM_VALUES) if b > 0) and norm_code(0) == 0 and norm_code(1e-30) == 1
    assert NORM_VALUES == sorted(NORM_VALUES)


def test_bounded_terms_turn_away_and_evict():
    assert bounded_terms([("a", 0.5), ("b", 0.5), ("c", 0.5), ("d", 0.9)], 2) == (("b", 0.5), ("d", 0.9))


def test_combining_drops_duplicates():
    a, b = Term("f", "a"), Term("f", "b")
    assert combine([a, a]) == a
    assert combine([Boolean(((SHOULD, a), (SHOULD, b)), coord=False), b]).clauses == ((SHOULD, a), (SHOULD, b))


PARSER = QueryParser(("xx",), ("f1", "f2", "field"), ("xx", "f1", "f2"))


@pytest.mark.parametrize(
    "text, shown",
    [
        ("", ""), ("one AND two", "+one +two"), ("a b AND c", "a b +c"), ("one -two", "one -two"), ("f1|f2:x", "f1:x f2:x"), ('"one 22 two"', '"one <> two"~1'),
        ("x y^2.50", "x y^2.5"), ("[aaa bbb}", "[aaa bbb}"), (">=aaa", "[aaa>"), ("ab*", "ab*"), ("f1:*", "*"), ("asdf~0.2", "asdf~0.2"), ("x (y AND z)", "x (+y +z)"), ("-x", "-x +*"),
    ],
)
def test_parsing(text, shown):
    assert PARSER.parse(text).show("xx") == shown


def test_parse_errors():
    assert PARSER.parse("one ^ two").show("xx")
    with pytest.raises(QueryParseError):
        QueryParser(("xx",), handle_parse_errors=False).parse("[aaa")
    assert clean('a "b (c') == 'a "b \\(c"' and clean("a) (b") == "(a) (b)"


def test_standard_tokens():
    assert [t for t, _, _ in standard_tokens("The U.S.A. mails bob.x@ex.com; http://www.ex.com/ isn't Bob's AT&T e-mail, -3.14")] == ["The", "USA", "mails", "bob.x@ex.com", "www.ex.com", "isn't", "Bob", "AT&T", "e-mail", "-3.14"]


def test_standard_analyzer_places_parts(spark):
    got = spark.range(1).select(F.explode(STANDARD(F.lit("the e-mail was sent"))).alias("t")).select("t.*").collect()
    assert [(r.term, r.pos) for r in got] == [("email", 1), ("e", 1), ("mail", 2), ("sent", 4)]


def test_porter():
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop", "relational": "relat", "goodness": "good", "controlling": "control", "sky": "sky"}
    assert {w: porter(w) for w in words} == words


def windows(clauses):
    """(element, next of each other clause) over (place, clause) pairs in order: brute force over the merged list."""
    merged = sorted((x, k) for k, c in enumerate(clauses) for x in c)
    for i, (x, k) in enumerate(merged):
        yield x, k, [[y for y, j in merged[i + 1 :] if j == other] for other in range(len(clauses)) if other != k], [y for y, j in merged[i + 1 :] if j == k]


def brute_sloppy(slots, offsets, slop, repeats):
    found = 0.0
    for (left, token), _, others, own in windows([[(p - o, p) for p in s] for s, o in zip(slots, offsets, strict=True)]):
        taken, places = {token}, []
        for nexts in others:
            free = [(b, t) for b, t in nexts if not (repeats and t in taken)]
            places += free[:1]
            taken |= {t for _, t in free[:1]}
        if len(places) == len(others):
            ends = [b for b, _ in places]
            if max(ends) - left <= slop and not (own and own[0][0] <= min(ends)):
                found += 1 / (max(ends) - left + 1)
    return found


def positions(spark, rows, kernel):
    """The kernel's results for rows of lists, one by one in the order of the rows."""
    kind = "array<bigint>" if isinstance(rows[0][0][0], int) else "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, lists array<{kind}>")
    return [r.x for r in df.select("i", kernel(F.col("lists")).alias("x")).orderBy("i").collect()]


def test_near_kernels_find_what_search_of_all_choices_finds(spark):
    rng = random.Random(3)
    rows = [[sorted((p, p + rng.randint(1, 2)) for p in rng.sample(range(20), rng.randint(1, 4))) for _ in range(3)] for _ in range(200)]
    size = lambda c: sum(e - s for s, e in c)
    for slop in (0, 2, 5):
        unordered = positions(spark, rows, lambda x, n=slop: kernels.near_unordered(x, 3, n))
        ordered = positions(spark, rows, lambda x, n=slop: kernels.near_ordered(x, 3, n))
        for clauses, got, got_ordered in zip(rows, unordered, ordered, strict=True):
            want = []
            merged = sorted((s, k, e) for k, c in enumerate(clauses) for s, e in c)
            for i, (s, k, e) in enumerate(merged):
                nexts = [next(((a, b) for a, j, b in merged[i + 1 :] if j == other), None) for other in range(3) if other != k]
                if None not in nexts and max(e, *[b for _, b in nexts]) - s - size([(s, e), *nexts]) <= slop:
                    want.append((s, max(e, *[b for _, b in nexts])))
            assert sorted(map(tuple, got)) == sorted(want)
            chains = []
            for first in clauses[0]:
                chain = [first]
                for c in clauses[1:]:
                    chain += [min((x for x in c if x >= chain[-1]), default=None)] if chain[-1] else [None]
                if chain[-1] and chain[-1][1] - first[0] - size(chain) <= slop:
                    chains.append((first[0], chain[-1][1]))
            assert sorted(map(tuple, got_ordered)) == sorted(chains)


@pytest.mark.parametrize("offsets", [[0, 1], [0, 1, 2], [0, 2, 1], [0, 0, 3]])
def test_sloppy_kernel_sums_all_windows(spark, offsets):
    rng = random.Random(4)
    rows = [[sorted(rng.sample(range(25), rng.randint(1, 5))) for _ in offsets] for _ in range(150)]
    for slop in (1, 4):
        got = positions(spark, rows, lambda x, n=slop: kernels.sloppy_freq(x, offsets, n, False, lambda w: F.lit(1.0) / (w + 1)))
        assert got == pytest.approx([brute_sloppy(r, offsets, slop, False) for r in rows])
        for r, f in zip(rows, got, strict=True):  # some choice of positions is close where and only where there is a window
            closest = min(max(c) - min(c) for c in itertools.product(*[[p - o for p in s] for s, o in zip(r, offsets, strict=True)]))
            assert (f > 0) == (closest <= slop)


def test_sloppy_kernel_with_a_repeated_word(spark):
    rng = random.Random(6)
    rows = [[(s := sorted(rng.sample(range(20), rng.randint(1, 5)))), sorted(rng.sample(range(20), 3)), s] for _ in range(150)]
    got = positions(spark, rows, lambda x: kernels.sloppy_freq(x, [0, 1, 2], 4, True, lambda w: F.lit(1.0) / (w + 1)))
    assert got == pytest.approx([brute_sloppy(r, [0, 1, 2], 4, True) for r in rows])
    assert all(f == 0 for r, f in zip(rows, got, strict=True) if len(r[0]) == 1)  # one token cannot fill two slots


def test_own_sloppy_factor_changes_scores(index):
    class Flat(Similarity):
        def sloppy(self, distance):
            return F.lit(1.0)

    q = Phrase.of("text", "start", "one", slop=2)
    plain, flat = ({r.doc_id: r.score for r in Searcher(index, s).matches(q).collect()} for s in (Similarity(), Flat()))
    assert plain.keys() == flat.keys() and any(flat[d] > plain[d] for d in plain) and all(flat[d] >= plain[d] for d in plain)


def test_highlights_mark_what_matched(index, spark):
    places = lambda ix, q: {r.doc_id: r.positions for r in Searcher(ix).match_positions(q, "text").collect()}
    assert places(index, Phrase.of("text", "start", "finish", slop=1)) == {0: [0, 1], 1: [0, 2]}  # in 2 they are too far apart
    assert places(index, Range("text", "one", "start")) == {0: [0, 2], 1: [0, 1], 2: [0, 1], 3: [1, 2], 4: [1, 2], 5: [0]}
    rows = spark.createDataFrame([(0, ["one two", "three"])], "doc_id bigint, text array<string>")
    ix = Searcher(build(rows, analyzer=PerField(LETTERS)))
    assert [r.excerpts for r in ix.highlight(Term("text", "three"), "text", rows).collect()] == [["one two <b>three</b>"]]


def test_facade(spark):
    plain = FieldSpec(tokenized=False)
    row = lambda i, t, k: (i, t, k)
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    ix = Index(build(make([row(0, "one two", "a"), row(1, "two three", "b")]), IndexSpec({"key": plain}), PerField(LETTERS)), key=("key",))
    assert len(ix) == 2 and ix[1]["text"] == "two three" and ix[7] is None
    ix.add(make([row(2, "four", "b"), row(3, "five", "c")]))
    assert sorted(r.doc_id for r in ix[0:3].collect()) == [0, 2] and ix.index.is_deleted(1) and not ix.index.is_deleted(2)
    assert ids(ix.search("four").hits) == [2] and ids(ix.search("three").hits) == []
    ix.update("five", text=F.lit("six six"))
    assert ids(ix.search("six").hits) == [7] and ids(ix.search("five").hits) == [] and ix[7]["key"] == "c"
    ix.delete("key:a").delete([2])
    assert len(ix) == 1 and ix.index.max_doc() == 5
    assert [(t.term, t.freq) for r in ix.term_vector(7, "text").collect() for t in r.terms] == [("six", 2)]


def test_facade_on_disk(spark, tmp_path):
    ix = Index(build(from_records(spark, [{"text": t} for t in ("one two", "two", None)]), IndexSpec({}), PerField(LETTERS)))
    ix.delete("one").flush(f"{tmp_path}/a")
    assert len(ix) == 2 and ix.index.max_doc() == 3 and ix.doc_freq("text", "two") == 2
    ix.optimize(f"{tmp_path}/b")
    assert len(ix) == 2 and ix.index.max_doc() == 2 and ix.doc_freq("text", "two") == 1
    norms = {r.doc_id: r.norm for r in ix.index.set_norm("text", F.lit(0.5)).lengths.collect()}
    assert set(norms.values()) == {0.5}


def test_fuzzy_cap_keeps_what_adding_in_turn_keeps(spark):
    words = sorted({"".join(w) for w in itertools.product("ab", repeat=5)} | {"aaaa", "bbbb", "aaaaab"})
    ix = build(from_records(spark, [{"text": w} for w in words]), IndexSpec({}), PerField(LETTERS))
    for most in (1, 3, 7, 20):
        q = Fuzzy("text", "aaaaa", min_similarity=0.1, prefix_length=0, max_terms=most)
        c = Searcher(ix).compiler
        found = sorted((r.term, r.similarity) for r in c.similar_terms(q).collect())
        assert c.rewrite(q).terms == bounded_terms(found, most) and len(found) > 20


def test_excerpts():
    assert excerpts("one two three", [1], r"\p{L}+", 150, 2, "<b>", "</b>", "...") == ["one <b>two</b> three"]
    assert excerpts("one two three", [0, 1], r"\p{L}+", 150, 2, "<b>", "</b>", "...") == ["<b>one two</b> three"]
    long = "x " * 200 + "hit " + "y " * 200
    (got,) = excerpts(long, [200], r"\p{L}+", 40, 2, "[", "]", "..")
    assert got.startswith("..") and got.endswith("..") and "[hit]" in got and len(got) < 60
    assert excerpts("nothing", [], r"\p{L}+", 40, 2, "[", "]", "..") == []


def test_offsets_of_a_long_text_take_linear_time(spark):
    """200,000 tokens; adding to one array for each token, and looking for each from the start, took minutes."""
    import time

    from textlake.functions.analysis import offsets

    texts = spark.createDataFrame([(0, "word  é " * 100_000), (1, None), (2, ""), (3, "..a\U0001d4b3b..cé"), (4, "12")], "k int, t string")
    begun = time.monotonic()
    got = {r.k: r for r in texts.select("k", offsets(F.col("t"), r"\p{L}+").alias("o")).select("k", F.size("o").alias("n"), F.slice("o", F.greatest(F.size("o") - 1, F.lit(1)), 2).alias("last")).collect()}
    assert [got[k].n for k in range(5)] == [200_000, 0, 0, 2, 0]
    assert [tuple(x) for x in got[0].last] == [(799_992, 799_996), (799_998, 799_999)]
    assert [tuple(x) for x in got[3].last] == [(2, 5), (7, 9)]  # a character beyond U+FFFF counts once
    assert time.monotonic() - begun < 60


@pytest.mark.parametrize("pattern", [r"\p{L}+", "[a-z]*", "(?<=a)b|a*", r"([a-z])\1", "(?s).+"])
def test_offsets_are_those_of_the_matches(spark, pattern):
    import regex

    from textlake.functions.analysis import offsets

    texts = ["", " a b", "ab  cd é", "..x..", "xxx " + "yy " * 100, "a1b22 c", "12", "aabaa"]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", offsets(F.col("t"), pattern).alias("o")).collect()
    assert {r.k: [tuple(x) for x in r.o] for r in found} == {k: [m.span() for m in regex.finditer(pattern, t) if m.group()] for k, t in enumerate(texts)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_of_phrases_and_spans_stay_in_arrays(index):
    """Rows of single positions filled one task's memory; a phrase has a row for each posting."""
    s = Searcher(index)
    assert "explode(positions" not in plan_of(s.matches(Phrase.of("text", ("one", "two"), "two")))
    assert "explode(positions" not in plan_of(s.matches(Phrase.of("text", "one", "two", slop=2)))
    assert ids(s.matches(Phrase.of("text", ("start", "one"), ("finish", "two")))) == [0, 1, 2, 3, 4, 5]
    assert "collect_list(positions" in plan_of(s.matches(SpanTerm.of("text", "one", "two")))  # distinct places are found in the document's row


def test_highlights_read_positions_of_the_page_only(spark):
    s = Searcher(build(from_records(spark, [{"text": t} for t in TEXTS])))
    hits = s.search(Phrase.of("text", "one", "two"), limit=1).hits
    plan = plan_of(s.highlight(Phrase.of("text", "one", "two"), "text", hits))
    assert "LeftSemi" in plan and [list(r.excerpts) for r in s.highlight(Phrase.of("text", "one", "two"), "text", hits).collect()]


def test_whole_values_are_inverted_without_sorting(spark):
    rows = spark.createDataFrame([(1, "a b", 7), (2, None, None), (3, "", 0), (4, "x" * 300, 5)], "doc_id long, key string, n int")
    plain = FieldSpec(tokenized=False, boost=2.0)
    ix = build(rows, IndexSpec({"key": plain, "n": plain}))
    assert "array_sort" not in plan_of(ix.postings) and "sort_array" not in plan_of(ix.postings)
    slow = build(rows, IndexSpec({"key": plain, "n": plain}, max_field_length=9))
    for name in ("postings", "lengths", "terms"):
        assert sorted(map(str, getattr(ix, name).collect())) == sorted(map(str, getattr(slow, name).collect()))


def test_postings_have_more_parts_as_they_grow(spark, tmp_path, monkeypatch):
    """A task's sort is bounded by bytes, not by the session's number of partitions."""
    from textlake.sources import index as source

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    monkeypatch.setattr(source, "PART_BYTES", 100_000, raising=False)
    stored = build(rows, scratch=str(tmp_path / "inverted")).save(str(tmp_path / "index"))
    assert len(stored.postings.inputFiles()) > 4


def test_halves_of_an_index_analyse_texts_once(spark):
    from oracle import SMALL

    from textlake import catalog
    from textlake.plans import queries  # noqa: F401  fills the catalog

    assert "regexp_extract_all" not in plan_of(catalog.QUERIES["multi_index_idf"](spark, SMALL))


ODD = ["", None, "one two One", "é" * 300 + " Straße ΟΔΟΣ Σ İx", "a1b2\U0001F600c \U00010400\U00010428", "\n\t .", "x", "the " * 70, "日本語 one"]


def test_words_of_letters_are_inverted_as_built_in_functions_have_them(spark, tmp_path):
    """Blocks of whole arrays against tokens made by built-in functions, which a limit on fields asks for; 40 rows of a term fill more than a block."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 40)], "doc_id long, text string").coalesce(2)
    rows = rows.union(spark.sql("SELECT 1000L, concat('two ', CAST(X'C3286FE4' AS STRING), ' one')"))
    spec, slow = IndexSpec({"text": FieldSpec(boost=3.0)}), IndexSpec({"text": FieldSpec(boost=3.0)}, max_field_length=10**6)
    fast = build(rows, spec)
    assert "regexp_extract_all" not in plan_of(fast.postings) and "array_sort" not in plan_of(fast.postings)
    stored = build(rows, spec, scratch=str(tmp_path / "blocks")).save(str(tmp_path / "index"))
    for name in ("postings", "lengths", "terms", "docs"):
        want = sorted(map(str, getattr(build(rows, slow), name).collect()))
        assert sorted(map(str, getattr(fast, name).collect())) == want and sorted(map(str, getattr(stored, name).select(getattr(fast, name).columns).collect())) == want


def test_blocks_of_small_parts(spark, monkeypatch):
    """Parts of a batch split documents among blocks, not tokens of a document."""
    import pyarrow as pa

    from textlake.sources import invert

    letters = invert.Letters.of(spark._jvm, True, 1.0)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(ODD))), "text": pa.array(ODD, pa.string())})
    post = lambda: sorted((r["term"], e["doc_id"], e["norm"], e["positions"]) for b in invert.blocks(letters)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist() if r["term"] is not None for e in r["entries"])
    whole = post()
    monkeypatch.setattr(invert, "MOST_TOKENS", 2)
    assert post() == whole and ("one", 2, 0.5, [0, 2]) in whole


def test_term_vectors_shuffle_nothing(spark):
    from oracle import SMALL

    from textlake import catalog
    from textlake.plans import queries  # noqa: F401  fills the catalog

    assert "Exchange" not in plan_of(catalog.QUERIES["term_vectors"](spark, SMALL))
    ix = build(spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    both = ix.merge(build(spark.range(0).selectExpr("id AS doc_id", "'' AS text")))  # a merged index makes them from postings
    assert both.vectors is None and sorted(map(str, both.term_vectors().collect())) == sorted(map(str, ix.term_vectors().collect()))


def test_a_segment_is_made_of_blocks(spark, tmp_path, monkeypatch):
    """A stream's segment has as many parts as its bytes ask for, like an index that is saved."""
    from textlake.sources import index as source
    from textlake.streaming.ingest import SegmentedIndex

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    monkeypatch.setattr(source, "PART_BYTES", 100_000)
    ix = SegmentedIndex(str(tmp_path), IndexSpec({}), PerField(LETTERS))
    ix.write_batch(rows, 0)
    found = ix.open(spark).postings
    assert len(found.inputFiles()) > 4 and found.count() == build(rows).postings.count()


def test_strings_are_mapped_by_built_in_functions(spark):
    import re

    from textlake.functions import analysis as A

    words = ["thing", "singing", "abcab", "aab", "a.$", "\U0001F600aé", "", "th" * 200]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for table in ({"th": "z", "ing": "in"}, {"a": "b", "b": "aa"}, {"ab": "x", "bc": "y", "abc": "", "c": "ab"}, {".": "dot", "$": "éé"}, {"\U0001F600a": "q", "é": "a"}):
        out = rows.select("w", A.mapping(table)(F.array(F.struct(F.col("w").alias("term"), F.lit(0).alias("pos")))).alias("t"))
        assert "Python" not in plan_of(out)
        pattern = re.compile("|".join(re.escape(k) for k in sorted(table, key=len, reverse=True)))
        assert {r.w: r.t[0].term for r in out.collect()} == {w: pattern.sub(lambda m, table=table: table[m.group()], w)[:255] for w in words}


def test_standard_tokens_are_python_objects_only_in_chunks(monkeypatch):
    import pyarrow as pa

    from textlake.functions import analysis as A

    met = []
    monkeypatch.setattr(A, "standard_tokens", lambda t: standard_tokens(t)[: met.append(t)])
    monkeypatch.setattr(A, "CHUNK_CHARS", 10, raising=False)
    texts = ["isn't it", "", None, "a" * 50, "U.S.A. b@c.de", "x"]
    assert A._standard(pa.array(texts)).to_pylist() == [[w for w, _, _ in standard_tokens(t)] for t in texts] and met == texts
    assert A._standard(pa.array([], pa.string())).to_pylist() == []
