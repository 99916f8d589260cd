"""Small tables with everything that is odd."""

from __future__ import annotations

import random

#: Extra columns whose names clash with those that operators use inside.
EXTRA = ["row", "id", "h", "digest", "n", "key", "size", "fp", "bucket", "chunk", "v1", "before", "token", "host", "path", "rule", "first", "norm"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 40)}" for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empties, ties, copies, repeated rows, a long text."""
    long = prose(1, 4000)
    near = prose(2, 300)
    rows = [(k, prose(100 + k, 120 + k), f"src{k % 3}") for k in range(12)]
    rows += [(20, None, "src0"), (21, "", "src1"), (22, " \t\n", None), (23, long, "src1"), (24, long.upper(), "src2"), (None, prose(3, 90), "src0"), (None, None, None)]
    rows += [(25, near, "src0"), (26, near + " tail", "src1"), (27, near, None), (27, near, None)]
    rows += [(28, "Line one here\nLine one here\nLine one here\n" * 20, "src2"), (29, "a#b $5 <|endoftext|> x'll don't  é漢字🙂", "src2"), (30, "x" * 500, "src1"), (31, "word", "src9")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["clash"] * len(EXTRA)) for i, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t: str | None) -> str:
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
