"""Lexicon tables (S4), learned lexicon load/save/reset."""

from __future__ import annotations

import json
import os
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L

SHIPPED_LEARNED = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data",
                               "learned_forms.json")
LEARNED_SCHEMA = "form string, lemma string"


@lru_cache(maxsize=1)
def shipped_learned_map() -> dict[str, str]:
    """The learned lexicon that ships with the package (90 entries)."""
    with open(SHIPPED_LEARNED, encoding="utf-8") as fh:
        return dict(json.load(fh))


def verb_forms_df(spark: SparkSession) -> DataFrame:
    """Static lexicon (pos, form, lemma)."""
    return spark.createDataFrame(L.verb_forms(), "pos int, form string, lemma string")


def infinitives_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in L.infinitives()], "lemma string")


LEXICONS = {
    "integration_objects": L.INTEGRATION_OBJECTS,
    "email_contexts": L.EMAIL_CONTEXTS,
    "share_contexts": L.SHARE_CONTEXTS,
    "schedule_contexts": L.SCHEDULE_CONTEXTS,
    "cancel_contexts": L.CANCEL_CONTEXTS,
    "integration_exclusions": L.INTEGRATION_EXCLUSIONS,
    "system_keywords": L.SYSTEM_KEYWORDS,
}


def lexicon_df(spark: SparkSession) -> DataFrame:
    """One table (lexicon, pos, literal) for all literal sets."""
    rows = [(name, i, lit) for name, lits in LEXICONS.items() for i, lit in enumerate(lits)]
    return spark.createDataFrame(rows, "lexicon string, pos int, literal string")


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_learned(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A learned lexicon written as one JSON object {form: lemma}, at any path that
    Spark reads; without a path the shipped one, which the driver reads.  A path that
    does not exist gives an empty table; any other failure is raised."""
    if path is None:
        return spark.createDataFrame(sorted(shipped_learned_map().items()), LEARNED_SCHEMA)
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], LEARNED_SCHEMA)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("form", "lemma"))


#: A version folder counts once this file stands in it; it is written after the data.
COMMITTED = "_COMMITTED"


def _fs(spark: SparkSession, path: str):
    """(file system, path) by the URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _is_committed(spark: SparkSession, folder: str) -> bool:
    fs, marker = _fs(spark, f"{folder}/{COMMITTED}")
    return fs.exists(marker)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed version folders under ``root``, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return [n for n in names if n.startswith("v=") and _is_committed(spark, f"{root}/{n}")]


def read_learned_versioned(spark: SparkSession, root: str) -> DataFrame:
    """Newest committed version under ``root``, else empty; a version whose writer died, or
    is still at work, isn't seen."""
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], LEARNED_SCHEMA)
    return spark.read.schema(LEARNED_SCHEMA).parquet(f"{root}/{found[-1]}")


def save_learned(df: DataFrame, root: str, version: int) -> str:
    """Write the learned lexicon sorted by form as a new version (one batch per run):
    the data first, then the marker that commits it.  Earlier versions stay readable.  What
    a dead writer left of this version is replaced; a committed version is an error."""
    spark, path = df.sparkSession, f"{root}/v={version:06d}"
    if _is_committed(spark, path):
        raise ValueError(f"version is committed already: {path}")
    df.select("form", "lemma").orderBy("form").write.mode("overwrite").parquet(path)
    fs, marker = _fs(spark, f"{path}/{COMMITTED}")
    fs.create(marker, False).close()
    return path


def reset_learned(spark: SparkSession, root: str, version: int) -> str:
    """A new, empty version."""
    return save_learned(spark.createDataFrame([], LEARNED_SCHEMA), root, version)
