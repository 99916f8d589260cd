"""URL filters: rules by host and path, and a classifier for what no rule covers.

The classifier is a logistic regression on hashed character n-grams of host and path, trained from a small
labelled table of URLs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (host and path, verdict); the longest rule that fits wins.
RULES: tuple[tuple[str, str], ...] = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hashed features, lengths of the n-grams, passes over the labelled table, step and penalty; labelled rows used at most.
FEATURES, GRAMS, PASSES, STEP, PENALTY, MOST_LABELLED = 1 << 15, (2, 3, 4), 30, 0.5, 1e-5, 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where the url is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host or a domain above it and begins the path; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, begin = rule.partition("/")[0], "/" + rule.partition("/")[2]
        out = F.when(((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(begin)), F.lit(rule)).otherwise(out)
    return out


def hashed(host: str, path: str) -> list[int]:
    """Feature numbers of the n-grams of host and path, each with its bounds; host and path have their own."""
    found = []
    for kind, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = s.encode("utf-8", "surrogatepass")
        seed = zlib.crc32(kind.encode())
        found += [zlib.crc32(raw[i : i + n], seed) % FEATURES for n in GRAMS for i in range(len(raw) - n + 1)]
    return found


def design(urls: Sequence[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all urls end to end, the row of each, and for each the inverse root of its row's number."""
    lists = [sorted(set(hashed(h, p))) for h, p in urls]
    sizes = np.array([len(x) for x in lists], np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    cols = np.fromiter((c for x in lists for c in x), np.int64, int(sizes.sum()))
    return cols, rows, (1 / np.sqrt(np.maximum(sizes, 1)))[rows]


def train(urls: Sequence[tuple[str, str]], labels: Sequence[int]) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with steps scaled by past gradients; the order of rows plays no part."""
    cols, rows, x = design(urls)
    y, n = np.asarray(labels, float), max(len(urls), 1)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(PASSES if 0 < y.sum() < len(y) else 0):
        score = bias + np.bincount(rows, w[cols] * x, n)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        slope = np.bincount(cols, error[rows] * x, FEATURES) / n + PENALTY * w
        seen += slope**2
        w -= STEP * slope / np.sqrt(seen)
        bias -= STEP * float(error.mean())
    return w, bias


def probability(urls: Sequence[tuple[str, str]], w: np.ndarray, bias: float) -> np.ndarray:
    """The probability that each url is to be allowed."""
    cols, rows, x = design(urls)
    score = bias + np.bincount(rows, w[cols] * x, len(urls))
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def labelled_by_rules(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, most: int = MOST_LABELLED) -> list[tuple[str, str, int]]:
    """A labelled table of at most ``most`` urls: (host, path, 1 for allow) of urls that a rule judges.

    They are those with the smallest digests among all distinct ones, so that reruns agree. A bound on the digest,
    from an estimate of how many there are, is applied where the rows lie: little more than ``most`` rows move.
    """
    host, path = url_parts(F.col(url))
    judged = pages.select(host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).filter("rule IS NOT NULL")
    judged = judged.select("host", "path", F.col("rule").isin([r for r, v in rules if v == "allow"]).cast("int").alias("label"), F.shiftrightunsigned(F.xxhash64("host", "path"), 24).alias("digest"))
    n = judged.agg(F.approx_count_distinct("digest", 0.02)).first()[0]
    bound = int((1 << 40) * min(1.0, 1.2 * most / max(n, 1)))
    drawn = judged.filter(F.col("digest") < bound).distinct().orderBy("digest", "host", "path").limit(most)
    return sorted((r.host, r.path, r.label) for r in drawn.collect())


def filter_urls(pages: DataFrame, labelled: Sequence[tuple[str, str, int]], page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, probability``.

    The longest fitting rule decides; else the classifier trained from ``labelled`` (host, path, label)
    does, with allow from 0.5. Without labels of both kinds all probabilities are the share of allowed
    ones. A null url or one without ``://`` has empty host and path, and is judged by the classifier. Very long urls are
    read whole. A null page_id is carried along. Repeated rows are judged alike; an empty table gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    w, bias = train([(h, p) for h, p, _ in labelled], [y for _, _, y in labelled])
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    w32 = w.astype(np.float32)  # 128 KB whatever the table

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(probability(urls, w32, bias), 6), pa.float64())], [*batch.schema.names, "probability"])

    kind = rows.schema["page_id"].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, probability double")
    verdict = F.when(F.col("probability") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")
