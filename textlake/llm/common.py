"""What several operators share: shared storage, lambda-bound values and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Has Spark delete the shuffle files of a query when the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A key with more than one part in so many of a join's rows is sent to every task.
HOT_KEYS = 2048
#: Ids of rows that go, up to which they are sent to every task (some 30 MB); beyond that the rows are shuffled.
MOST_GONE = 300_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="textlake-")
    return _own_dirs[app]


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends in replicated files, so lost executors cost only their running tasks. Tables lie
    in ``<spark.checkpoint.dir>/textlake/<application id>/`` and can be deleted once results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema, was = df.schema, spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, was)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing to come reads: their successors are written."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_parts(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, total: int) -> DataFrame:
    """``rows``, ``total`` of them, joined with ``table``, whose ``count`` says how many of them each of its keys has.

    Keys with more than a 2,048th of all rows, of which there are fewer than 2,048, go to every task and their rows stay
    where they are; the other keys are shuffled, and none of them is hot. Keys are unique in ``table``.
    """
    on = [on] if isinstance(on, str) else on
    keys = [f"_{c}" for c in on]
    named = table.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    hot, cold = (named.filter(x) for x in (F.col(count) * HOT_KEYS > total, F.col(count) * HOT_KEYS <= total))
    same = [F.col(c) == F.col(k) for c, k in zip(on, keys, strict=True)]
    met = rows.join(F.broadcast(hot), same).drop(*keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), same, "left_anti").join(cold.hint("merge"), same).drop(*keys)
    return met.unionByName(rest)


def id_key(c: Column) -> Column:
    """An id as a key of joins, which is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def keep_judged(docs: DataFrame, doc_id: str, digest: Column, judged: DataFrame, most_gone: int = MOST_GONE) -> DataFrame:
    """The rows of ``docs`` less those that ``judged`` says to drop, and one of each set of rows equal in id and digest.

    ``judged`` has ``doc_id, digest, stays, times`` once for each id and digest of the table, ``times`` being its rows; entries
    of one row that stays may be missing. Texts are not shuffled unless ``judged`` says more than ``most_gone`` such things.
    """
    judged = cut(judged.filter("NOT stays OR times > 1").select(id_key(F.col("doc_id")).alias("k"), F.col("digest").alias("d"), "stays"), "judged")
    small = judged.count() <= most_gone
    sent = F.broadcast if small else (lambda df: df.hint("merge"))
    full = docs.select(F.struct("*").alias("row"), id_key(F.col(doc_id)).alias("id_key"), digest.alias("digest"))
    same = (F.col("id_key") == F.col("k")) & (F.col("digest") == F.col("d"))
    kept = full.join(sent(judged), same, "left_anti").select("row.*")
    twice = judged.filter("stays")
    if twice.isEmpty():
        return kept
    return kept.union(full.join(sent(twice), same).dropDuplicates(["id_key", "digest"]).select("row.*"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once: a lambda variable is never inlined by the optimizer."""
    return F.transform(F.array(value), f)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone, most of them, take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
