"""The vector-space model: term weights as driver arithmetic, per-document factors as columns."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_value(code: int) -> float:
    """The number that a norm's byte stands for: three bits of mantissa, five of exponent, 0 for 0."""
    return struct.unpack(">f", struct.pack(">I", ((code & 7) << 21) | (((code >> 3) + 48) << 24)))[0] if code else 0.0


NORM_VALUES = [norm_value(b) for b in range(256)]


def norm_code(x: float) -> int:
    """The byte of the largest norm value at or below ``x``; positive numbers have code 1 at least."""
    return 0 if x <= 0 else max(1, max(b for b, v in enumerate(NORM_VALUES) if v <= x))


def decoded_norm(x: Column) -> Column:
    """``x`` as it comes back from its byte, found by halving: eight comparisons, and ``x`` is worked out once."""
    table, halves = F.lit(NORM_VALUES), F.array(*[F.lit(1 << k) for k in range(7, -1, -1)])
    code = lambda v: F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(table, at + half) <= v, half).otherwise(0))
    kept = F.element_at(F.transform(F.array(x), lambda v: F.get(table, F.greatest(code(v), F.lit(1)))), 1)
    return F.when(x <= 0, F.lit(0.0)).otherwise(kept)


@dataclass(frozen=True)
class Similarity:
    """How frequencies become scores; subclass and pass to a searcher to change it."""

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq)

    def idf(self, df: int, n: int) -> float:
        return math.log(n / (df + 1)) + 1 if n else 0.0

    def length_norm(self, length: Column) -> Column:
        return F.lit(1.0) / F.sqrt(length)

    def query_norm(self, sum_of_squares: float) -> float:
        return 1 / math.sqrt(sum_of_squares) if sum_of_squares > 0 else 0.0

    def sloppy(self, distance: Column) -> Column:
        return F.lit(1.0) / (distance + 1)

    def coord(self, matched: Column, most: int) -> Column:
        return matched / F.lit(float(most))
