"""Text analysis: from a text column to an array of ``(term, pos)``.

Tokenizers yield terms in order; filters change terms and positions. All but the standard tokenizer
and stemming are built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import stopwords
from .stemming import porter

TOKENS = "array<struct<term:string,pos:int>>"
MOST_BYTES = 255


def _placed(terms: Column) -> Column:
    return F.transform(terms, lambda t, i: F.struct(F.when(F.length(t) > MOST_BYTES, F.substring(t, 1, MOST_BYTES)).otherwise(t).alias("term"), i.alias("pos")))


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def untokenized(text: Column) -> Column:
    """The whole value is one token; null has none."""
    return _placed(F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text.cast("string"))))


def regexp(pattern: str) -> Callable[[Column], Column]:
    """Tokens are the matches of ``pattern``."""
    return lambda text: _placed(F.filter(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0)), lambda t: t != ""))


#: White space as C libraries have it for Unicode, without spaces that do not break.
SPACES = r"\x09-\x0D\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"
NO_SPACE = f"[^{SPACES}]+"
whitespace, ascii_whitespace = regexp(NO_SPACE), regexp(r"[^\x09-\x0D\x20]+")
letters, ascii_letters = regexp(r"\p{L}+"), regexp("[A-Za-z]+")

#: The rules of the standard tokenizer; the longest match at a place wins, and of equal ones the first.
_WORD = r"[^\W_]"
_DOT_ATOM = r"[\w!#$%&'*+\-/=?^`{|}~]+(?:\.[\w!#$%&'*+\-/=?^`{|}~]+)*"
STANDARD_RULES: list[tuple[re.Pattern, Callable[[str], str]]] = [
    (re.compile(_DOT_ATOM + "@" + _DOT_ATOM), lambda s: s),
    (re.compile(f"{_WORD}+'[sS]"), lambda s: s[:-2]),
    (re.compile(f"{_WORD}+'"), lambda s: s[:-1]),
    (re.compile(r"[^\W\d_]+'[^\W\d_]+"), lambda s: s),
    (re.compile(f"{_WORD}+(?:[-_]{_WORD}+)*"), lambda s: s),
    (re.compile(f"{_WORD}+[&@]{_WORD}*"), lambda s: s),
    (re.compile(r"(?:https?|ftp|file):/+[\w-]+(?:\.\w[\w-]*)+(?::\d+)?/?"), lambda s: re.sub(r"^\w+:/+", "", s).rstrip("/")),
    (re.compile(rf"{_WORD}+:/+[\w.,/\-@:]+"), lambda s: s.rstrip("/")),
    (re.compile(rf"(?:{_WORD}(?:[^\W_]|-)*\.)+(?:com|edu|biz|gov|int|info|mil|net|org|[^\W\d_]{{2}})(?::\d+)?/?"), lambda s: s.rstrip("/")),
    (re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]"), lambda s: s.replace(".", "")),
    (re.compile(r"[-+]?\d+(?:\.\d+)?"), lambda s: s),
]
#: A word with white space before what could go on with it: no rule is longer. And white space.
_PLAIN, _GAP = re.compile(rf"{_WORD}+(?=[.!?]?(?:\s|$)|[,;()\"])"), re.compile(r"\s+")


def standard_tokens(text: str | None) -> list[tuple[str, int, int]]:
    """(term, begin, end) of each token of a text, begin and end in characters."""
    text, at, out = text or "", 0, []
    while at < len(text):
        if m := _GAP.match(text, at):
            at = m.end()
            continue
        if m := _PLAIN.match(text, at):
            out.append((m.group()[:MOST_BYTES], at, m.end()))
            at = m.end()
            continue
        best = None
        for rule, trim in STANDARD_RULES:
            m = rule.match(text, at)
            if m and m.end() > at and (best is None or m.end() > best[1]):
                best = (trim(m.group()), m.end())
        if best is None:
            at += 1
            continue
        if best[0]:
            out.append((best[0][:MOST_BYTES], at, best[1]))
        at = best[1]
    return out


#: Characters of texts whose tokens are Python objects at a time, if not of one text; those of others are in Arrow's buffers.
CHUNK_CHARS = 1 << 18


def _standard(text: pa.Array) -> pa.Array:
    upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(upto // CHUNK_CHARS)) + 1).tolist(), len(text)]
    kind, chunk = pa.list_(pa.string()), lambda a, b: [[x[0] for x in standard_tokens(t)] for t in text[a:b].to_pylist()]
    return pa.concat_arrays([pa.array(chunk(a, b), kind) for a, b in zip(cuts, cuts[1:], strict=False)])


def _porter(terms: pd.Series) -> pd.Series:
    known = lru_cache(maxsize=200_000)(porter)
    return terms.map(lambda ts: [known(t) for t in ts])


def _strings(f: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    return F.pandas_udf(f, ArrayType(StringType()))


def standard(text: Column) -> Column:
    """E-mail addresses, URLs, acronyms, compounds, contractions, companies and numbers are single tokens."""
    return _placed(F.arrow_udf(_standard, ArrayType(StringType()))(_text(text)))


def lower(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lower(t["term"]).alias("term"), t["pos"].alias("pos")))


def stop(words: Sequence[str]) -> Callable[[Column], Column]:
    """Drop words; the positions of the others keep the gaps."""
    listed = sorted(set(words))
    return lambda tokens: F.filter(tokens, lambda t: ~t["term"].isin(listed)) if listed else tokens


def mapping(table: dict[str, str]) -> Callable[[Column], Column]:
    """Replace strings in terms, the longest at each place: by built-ins, with ``replaced_strings`` where strings are longer than a character."""
    if all(len(k) == 1 and len(v) == 1 for k, v in table.items()):
        a, b = "".join(table), "".join(table.values())
        return lambda tokens: F.transform(tokens, lambda t: F.struct(F.translate(t["term"], a, b).alias("term"), t["pos"].alias("pos")))
    return lambda tokens: F.transform(tokens, lambda t: F.struct(F.substring(replaced_strings(t["term"], table), 1, MOST_BYTES).alias("term"), t["pos"].alias("pos")))


def replaced_strings(term: Column, table: dict[str, str]) -> Column:
    """``term`` with the strings of ``table`` replaced in one pass, the longest at each place."""
    keys = sorted(table, key=len, reverse=True)
    if _apart(keys, table):
        for k in keys:
            term = F.replace(term, F.lit(k), F.lit(table[k]))
        return term
    # Every character that begins no match is a match of its own, and stays.
    pattern = "(?s)" + "|".join([*(_quoted(k) for k in keys), "."])
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.regexp_extract_all(term, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(F.try_element_at(known, m), m)), "")


def _quoted(text: str) -> str:
    """A Java pattern of a text: its code points, so that nothing in it is a sign."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _apart(keys: list[str], table: dict[str, str]) -> bool:
    """Whether replacing ``keys`` one after another is the same as one pass: none meets another, nor what was put before it."""
    meets = lambda a, b: a in b or b in a or any(a.endswith(b[:n]) or b.endswith(a[:n]) for n in range(1, min(len(a), len(b))))
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    return all(keys) and not any(meets(a, b) or not table[a] or set(table[a]) & set(b) for a, b in pairs)


def _by_terms(f) -> Callable[[Column], Column]:
    def work(tokens: Column) -> Column:
        return F.transform(F.arrays_zip(f(tokens["term"]).alias("term"), tokens["pos"].alias("pos")), lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos")))

    return work


def hyphens(tokens: Column) -> Column:
    """A hyphenated word becomes the word without hyphens and, from the same position on, its parts."""

    compound = lambda t: F.regexp_like(t["term"], F.lit(r"^\p{L}+(-\p{L}+)+$"))

    def split(t: Column, shift: Column) -> Column:
        both = F.concat(F.array(F.translate(t["term"], "-", "")), F.split(t["term"], "-"))
        some = F.transform(both, lambda x, i: F.struct(x.alias("term"), (t["pos"] + shift + F.greatest(i - 1, F.lit(0))).alias("pos")))
        return F.when(compound(t), some).otherwise(F.array(F.struct(t["term"].alias("term"), (t["pos"] + shift).alias("pos"))))

    # Parts push what follows along: a token's shift is the number of hyphens in the compounds before it.
    def shifted(x: Column) -> Column:
        before = lambda t: F.aggregate(x["long"], F.lit(0), lambda n, c: n + F.when(c["pos"] < t["pos"], F.length(c["term"]) - F.length(F.translate(c["term"], "-", ""))).otherwise(0))
        return F.flatten(F.transform(x["all"], lambda t: split(t, before(t))))

    both = F.array(F.struct(tokens.alias("all"), F.filter(tokens, compound).alias("long")))  # no Python inside a lambda
    return F.element_at(F.transform(both, shifted), 1)


def stem(tokens: Column) -> Column:
    """English stems, by Porter's algorithm."""
    return _by_terms(_strings(_porter))(tokens)


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer and filters in order. ``find`` is the pattern of tokens, for what must know their places in the text."""

    tokenizer: Callable[[Column], Column]
    filters: tuple[Callable[[Column], Column], ...] = ()
    find: str = r"\p{L}+"

    def __call__(self, text: Column) -> Column:
        out = self.tokenizer(text)
        for f in self.filters:
            out = f(out)
        return out


#: Numbers that are added up at a time: appending to an array copies it, so a sum that runs over all of a text would take the square of its tokens.
BLOCK = 32


def running_sums(numbers: Column) -> Column:
    """For each number of an array of integers, the sum of those up to and with it: inside blocks, over blocks, then both."""

    def sums(xs: Column) -> Column:
        add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
        return F.aggregate(xs, F.array().cast("array<int>"), add)

    blocks = lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(xs, k, BLOCK))
    last = lambda own: F.transform(own, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))
    both = lambda own: F.array(F.struct(own.alias("own"), sums(last(own)).alias("upto")))
    joined = lambda b: F.flatten(F.transform(b["own"], lambda own, k: F.transform(own, lambda x: x + F.when(k > 0, F.get(b["upto"], k - 1)).otherwise(0))))
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  worked out once, not once for each block
    return let(numbers, lambda xs: let(F.transform(blocks(xs), sums), lambda own: F.element_at(F.transform(both(own), joined), 1)))


def offsets(text: Column, pattern: str) -> Column:
    """``start, end`` of each match of ``pattern``, in characters from 0, end excluded: sums of the lengths of gaps and matches.

    (A pattern that can match nothing counts a character beyond U+FFFF twice if it matches nothing inside it.)"""

    def found(x: Column) -> Column:
        # A match of no characters that begins the text has no gap before it.
        gap = lambda k: F.coalesce(F.length(F.get(x["gaps"], k + F.size(x["gaps"]) - F.size(x["matches"]) - 1)), F.lit(0))
        steps = F.transform(x["matches"], lambda m, k: gap(k) + F.length(m))
        places = lambda ends: F.zip_with(x["matches"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        each = F.element_at(F.transform(F.array(running_sums(steps)), places), 1)
        return F.filter(each, lambda p: p["start"] < p["end"])

    both = F.struct(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0)).alias("matches"), F.split(_text(text), pattern, -1).alias("gaps"))
    return F.element_at(F.transform(F.array(both), found), 1)


def token_stream(text: Column, analyzer: Analyzer) -> Column:
    """Tokens with their places in the text: ``term, start, end, pos``. For analyzers whose filters keep the positions of tokens."""
    both = F.array(F.struct(analyzer(text).alias("tokens"), offsets(text, analyzer.find).alias("places")))
    place = lambda x, t, name: F.get(x["places"], t["pos"])[name].alias(name)
    return F.element_at(F.transform(both, lambda x: F.transform(x["tokens"], lambda t: F.struct(t["term"].alias("term"), place(x, t, "start"), place(x, t, "end"), t["pos"].alias("pos")))), 1)


LETTERS = Analyzer(letters, (lower,))
WHITESPACE = Analyzer(whitespace, (), NO_SPACE)
UNTOKENIZED = Analyzer(untokenized, (), r"(?s).+")
STOPPED = Analyzer(letters, (lower, stop(stopwords.ENGLISH)))
STANDARD = Analyzer(standard, (lower, stop(stopwords.FULL_ENGLISH), hyphens))
ENGLISH = Analyzer(letters, (lower, stop(stopwords.ENGLISH), stem))


#: The tokens of a regular-expression analyzer that is given none.
WORD_PATTERN = r"\p{L}+"


def regexp_analyzer(pattern: str = WORD_PATTERN, lowercase: bool = True) -> Analyzer:
    return Analyzer(regexp(pattern), (lower,) if lowercase else (), pattern)


@dataclass(frozen=True)
class PerField:
    """An analyzer for each field, and one for all others."""

    default: Analyzer
    fields: dict[str, Analyzer] = field(default_factory=dict)

    def of(self, name: str) -> Analyzer:
        return self.fields.get(name, self.default)
