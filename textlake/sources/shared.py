"""Where indexes that queries share are stored: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import SparkSession

from .index import SearchIndex

_stored: dict[tuple[str, str, str], SearchIndex] = {}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return named or _own.setdefault(app, tempfile.mkdtemp(prefix="textlake-"))


def stored_index(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], SearchIndex]) -> SearchIndex:
    """An index that is built once for a session and a folder of tables, then read; ``make`` gets a scratch folder."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _stored:
        folder = f"{shared_folder(spark)}/textlake/{app}/index-{name}-{len(_stored)}"
        _stored[key] = make(f"{folder}/inverted").save(folder)
    return _stored[key]
