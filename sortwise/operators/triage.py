"""End-to-end triage: prepare -> classify (C1) -> scopes (D1) -> reclassify (C4).

One narrow plan over the input: Project(s) over the scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lemma import Lexicon
from .classify import classify, default_lexicon, reclassify
from .scopes import with_scopes


def triage(df: DataFrame, lex: Lexicon | None = None, text_col: str = "message") -> DataFrame:
    """Adds rule_id, bucket (final), reasons, scope, reclassified, plus the
    helper columns message (stripped), norm and lemmas."""
    lex = lex or default_lexicon()
    c = classify(df, lex, text_col)
    return reclassify(with_scopes(c))


def classification_struct(df: DataFrame) -> DataFrame:
    """S7 layout: classification struct<bucket, rule_id, reasons, scope>."""
    return df.withColumn("classification",
                         F.struct("bucket", "rule_id", "reasons", "scope"))
