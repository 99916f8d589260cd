"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) on a document or abstains (0). Expectation-maximisation over the counts
of vote patterns estimates how each rule votes on good and on bad documents, and a
document's verdict is its posterior probability of being good, in place of having to pass every rule.

Patterns are counted over all documents; with R rules there are at most 3**R of them, so the fit has an
input of fixed size however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, cut, let

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules look at besides.
EVIDENCE = ("n_lines", "n_distinct", "n_function", "n_ends", "n_digits")
#: Common function words of four languages.
FUNCTION_WORDS = (
    "a and are for in is it of on that the to was with "
    "auf das dem den der des die ein eine im ist mit nicht und von zu "
    "au dans des du est et la le les pour que qui un une "
    "al como con del el en los las no para por se una y"
).split()
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Rules in SQL over the features and the evidence: when to vote good, when to vote bad; both false: abstain. No two look at the same count.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 100", "n_words < 60"),
    "word_length": ("2 * word_chars BETWEEN 6 * n_words AND 20 * n_words", "2 * word_chars < 4 * n_words OR word_chars > 14 * n_words"),
    "variety": ("10 * n_distinct >= 4 * n_words", "10 * n_distinct < 2 * n_words"),
    "function_words": ("100 * n_function >= 8 * n_words", "100 * n_function < 2 * n_words"),
    "sentences": ("n_ends * 60 >= n_words AND n_ends * 4 <= n_words", "n_ends * 200 < n_words OR n_ends * 2 > n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "lines": ("10 * n_dup_lines <= n_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "digits": ("20 * n_digits <= word_chars", "5 * n_digits > word_chars"),
}
#: Rounds of the fit; pseudo-counts of a bad, no and a good vote on good and on bad documents.
ROUNDS, PRIOR = 15, {1: (1.0, 5.0, 20.0), 0: (10.0, 10.0, 10.0)}


def repeated_words(w: Column) -> Column:
    """How many words of the array lie in a window of three words that occurs twice or more.

    Windows are told apart by 64-bit hashes, sorted with their places; all in the row, so nothing is moved.
    """
    n = F.size(w)
    zipped = F.arrays_zip(F.slice(w, F.lit(1), n - 2), F.slice(w, F.lit(2), n - 2), F.slice(w, F.lit(3), n - 2))
    placed = F.sort_array(F.transform(zipped, lambda s, i: F.struct(F.xxhash64(s).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"] == x["h"]
        return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()))

    covered = let(let(placed, repeated), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b))
    return F.when(n >= 3, covered).otherwise(F.lit(0))


def features(text: Column) -> Column:
    """A struct of the features of a text and the evidence; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    return let(
        text,
        lambda t: let(
            F.filter(F.split(t, SPACE_RE), lambda w: w != ""),
            lambda w: let(
                F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))),
                lambda lines: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    repeated_words(w).cast("long").alias("n_repeat_words"),
                    F.size(lines).cast("long").alias("n_lines"),
                    F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                    F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
                    (F.length(t) - F.length(F.translate(t, ".!?", ""))).cast("long").alias("n_ends"),
                    (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long").alias("n_digits"),
                ),
            ),
        ),
    )


Rates = dict[tuple[int, int, int], float]


def fit(patterns: dict[tuple[int, ...], int]) -> tuple[float, Rates]:
    """The share of good documents and the rates of ``(class, rule, vote)``, by expectation-maximisation.

    The latent class of a document is good (1) or bad (0); a rule's accuracies are its probabilities of a bad
    vote, none and a good vote in either class. They start from the balance of the votes, with a bad vote
    counting three times, and have the pseudo-counts of PRIOR.
    """
    rules = range(len(next(iter(patterns), RULES)))
    total = sum(patterns.values())
    post = {p: (1 + p.count(1)) / (2 + p.count(1) + 3 * p.count(-1)) for p in patterns}
    good, rate = 0.5, {}
    for _ in range(ROUNDS):
        of = {1: {p: n * post[p] for p, n in patterns.items()}, 0: {p: n * (1 - post[p]) for p, n in patterns.items()}}
        size = {y: sum(of[y].values()) for y in of}
        good = (1 + size[1]) / (2 + total)
        rate = {(y, j, v): (PRIOR[y][v + 1] + sum(x for p, x in of[y].items() if p[j] == v)) / (sum(PRIOR[y]) + size[y]) for y in of for j in rules for v in (-1, 0, 1)}
        post = {p: posterior(p, good, rate) for p in patterns}
    return good, rate


def posterior(votes: Sequence[int], good: float, rate: Rates) -> float:
    """The probability that a document with these votes is good."""
    odds = math.log(good / (1 - good)) + sum(math.log(rate[1, j, v] / rate[0, j, v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def _votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END").alias(f"vote_{name}") for name, (good, bad) in RULES.items()]


def _judged(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``rows`` with the features and ``base_failed, quality, kept``; ``rows`` are read twice."""
    votes = [f"vote_{name}" for name in RULES]
    voted = rows.select(*keep, *FEATURES, *_votes())
    patterns = {tuple(r[v] for v in votes): r["count"] for r in voted.groupBy(*votes).count().collect()}  # at most 3 ** rules rows
    good, rate = fit(patterns)
    odds = F.lit(math.log(good / (1 - good)))
    for j, v in enumerate(votes):
        gain = [math.log(rate[1, j, x] / rate[0, j, x]) for x in (-1, 0, 1)]
        odds = odds + F.element_at(F.lit(gain), F.col(v) + 2)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return judged.select(*keep, *FEATURES, "base_failed", F.round("quality", 6).alias("quality"), (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"))


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the features, ``base_failed, quality, kept``.

    A null or empty text has no words and fails the base. Repeated rows are judged alike. A null doc_id is
    carried along. Very long texts are read whole, one at a time. Ties and the order of rows play no part, as only counts of vote
    patterns do. An empty table gives an empty result. Other columns, whatever their names, play no part.
    """
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), features(F.col(text)).alias("f")).select("doc_id", "f.*"), "quality-features")
    return _judged(rows, ["doc_id"])


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with the columns of ``docs``.

    Nulls, empty and very long texts, repeated rows and an empty table as there; rows that repeat are kept or dropped together.
    The texts and their features are written once to the shared folder and read twice.
    """
    rows = cut(docs.select(F.struct("*").alias("row"), features(F.col(text)).alias("f")).select("row", "f.*"), "quality-rows")
    return _judged(rows, ["row"]).filter("kept").select("row.*")


def em_sql(features_sql: str) -> str:
    """The same judgement in SQL, from a query of ``doc_id``, the features and the evidence."""
    rules = range(len(RULES))
    cases = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS v{j}" for j, (good, bad) in enumerate(RULES.values()))
    votes = ", ".join(f"v{j}" for j in rules)
    count = lambda v: "(" + " + ".join(f"(v{j} = {v})::INT" for j in rules) + ")"
    steps = [f"f AS MATERIALIZED ({features_sql})", f"v AS MATERIALIZED (SELECT *, {cases} FROM f)", f"p AS MATERIALIZED (SELECT {votes}, count(*)::DOUBLE AS n FROM v GROUP BY ALL)", f"q0 AS MATERIALIZED (SELECT *, (1 + {count(1)})::DOUBLE / (2 + {count(1)} + 3 * {count(-1)}) AS q FROM p)"]
    for t in range(ROUNDS):
        rates = ", ".join(f"({PRIOR[y][v + 1]} + coalesce(sum(n * {q}) FILTER (v{j} = {v}), 0)) / ({sum(PRIOR[y])} + sum(n * {q})) AS r{y}_{j}_{v + 1}" for y, q in ((1, "q"), (0, "(1 - q)")) for j in rules for v in (-1, 0, 1))
        steps.append(f"m{t} AS MATERIALIZED (SELECT (1 + sum(n * q)) / (2 + sum(n)) AS good, {rates} FROM q{t})")
        odds = " + ".join(f"CASE v{j} WHEN 1 THEN ln(r1_{j}_2 / r0_{j}_2) WHEN -1 THEN ln(r1_{j}_0 / r0_{j}_0) ELSE ln(r1_{j}_1 / r0_{j}_1) END" for j in rules)
        steps.append(f"q{t + 1} AS MATERIALIZED (SELECT {votes}, n, 1 / (1 + exp(-(ln(good / (1 - good)) + {odds}))) AS q FROM q{t}, m{t})")
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)"
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(FEATURES)}, {failed} AS base_failed, round(q, 6) AS quality, NOT {failed} AND q >= 0.5 AS kept FROM v JOIN q{ROUNDS} USING ({votes})"
