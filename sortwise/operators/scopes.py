"""Scope detection.

D1 is a column expression over ``norm``; scopes are detected only for rows
whose cascade verdict is ``system``.  J10 is also offered as a join against
the 29-row pattern table for users who keep patterns as data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def _arr(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def empty() -> Column:
    return F.array().cast("array<string>")


def pattern_scopes(norm: Column) -> Column:
    """J10 as an expression: scopes of the first pattern contained in norm."""
    expr = None
    for pat, scopes in L.SCOPE_PATTERNS:
        cond = T.has(norm, pat)
        expr = F.when(cond, _arr(*scopes)) if expr is None else expr.when(cond, _arr(*scopes))
    return expr


def detect_scopes(norm: Column) -> Column:
    """array<string> of scopes for a normalised text."""
    n, has, any_ = norm, T.has, T.has_any
    mail_act = any_(n, L.MAIL_ACTIONS)
    mail_word = any_(n, L.MAIL_WORDS)
    cal_act = any_(n, L.CALENDAR_ACTIONS)
    cal_word = any_(n, L.CALENDAR_WORDS)
    multi = any_(n, L.MULTI_ACTION_CONNECTORS)
    cal_part = (F.when(any_(n, L.CALENDAR_LOOSE), _arr(L.CALENDAR))
                .when(has(n, L.COMMITMENT) & ~mail_act, _arr(L.CALENDAR))
                .otherwise(empty()))
    loose_tail = F.concat(
        F.when(any_(n, L.MAIL_WORDS), _arr(L.MAIL)).otherwise(empty()),
        F.when(has(n, "drive"), _arr(L.DRIVE)).otherwise(empty()),
        F.when(any_(n, L.BILLING_WORDS), _arr(L.BOLETO)).otherwise(empty()))
    tail = F.concat(cal_part,
                    F.when(any_(n, L.SHEET_WORDS), _arr(L.SHEETS, L.DRIVE))
                    .when(any_(n, L.DOC_WORDS), _arr(L.DRIVE, L.DOCUMENTS))
                    .otherwise(loose_tail))
    patterns = [p for p, _ in L.SCOPE_PATTERNS]
    return (F.when(any_(n, patterns), pattern_scopes(n))
            .when(mail_act & mail_word & (cal_act | cal_word) & multi, _arr(L.MAIL, L.CALENDAR))
            .when(mail_act & mail_word, _arr(L.MAIL))
            .when(cal_act & (cal_word | has(n, L.COMMITMENT)), _arr(L.CALENDAR))
            .otherwise(tail))


_MEMO: dict = {}


def norm_scopes() -> Column:
    """detect_scopes(col('norm')), built once per process."""
    if "scopes" not in _MEMO:
        _MEMO["scopes"] = detect_scopes(F.col("norm"))
    return _MEMO["scopes"]


def with_scopes(df: DataFrame, bucket_col: str = "bucket") -> DataFrame:
    """Scopes only for rows judged 'system' (others get an empty array)."""
    return df.withColumn("scope", F.when(F.col(bucket_col) == "system",
                                         norm_scopes()).otherwise(empty()))


def scope_pattern_table(spark, patterns=L.SCOPE_PATTERNS) -> DataFrame:
    rows = [(i, p, list(s)) for i, (p, s) in enumerate(patterns)]
    return spark.createDataFrame(rows, "prio int, pattern string, scopes array<string>")


#: Length of the substrings that ``first_pattern_join`` indexes.
GRAM = 3


def _substrings(text: Column, size: int) -> Column:
    last = F.length(text) - F.lit(size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))) \
        .otherwise(empty())


def first_pattern_join(df: DataFrame, patterns: DataFrame, key: str = "msg_id") -> DataFrame:
    """J10 as a join, for a pattern table of any size: (key, pattern, scopes) of the first
    pattern, by ``prio``, that each row's ``norm`` contains.

    ``patterns`` has ``prio`` (unique), ``pattern`` (an empty or null one matches nothing)
    and ``scopes``.  Distinct texts are indexed by their distinct substrings of ``GRAM``
    characters and fewer.  A pattern is looked up by the one of its own that fewest texts
    hold, with an equi-join, and verified on the text; both sides may be large, nothing
    is broadcast by hint.  A pattern shorter than ``GRAM`` is its own substring.  Rows of
    equal text share the work, so a frequent message weighs once."""
    digest = F.unhex(F.md5("norm"))
    texts = df.where(F.col("norm").isNotNull()).select("norm").distinct().select(digest.alias("digest"), "norm")
    grams = texts.select("digest", F.explode(F.array_distinct(F.concat(
        *[_substrings(F.col("norm"), n) for n in range(1, GRAM + 1)]))).alias("gram"))
    own = F.least(F.length("pattern"), F.lit(GRAM))
    parts = patterns.where(F.length("pattern") > 0).select("prio", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("pattern") - own + 1), lambda i: F.substr(F.col("pattern"), i, own)))).alias("gram"))
    spread = grams.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A pattern with a substring that no text holds matches nothing.
    rarest = parts.join(spread, "gram", "left").groupBy("prio").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    looked_up = patterns.join(rarest.where("least.n > 0"), "prio").select("prio", "pattern", F.col("least.gram").alias("gram"))
    first = (grams.join(looked_up, "gram").join(texts, "digest")
             .where(F.instr(F.col("norm"), F.col("pattern")) > 0)
             .groupBy("digest").agg(F.min("prio").alias("prio")))
    return (df.select(key, digest.alias("digest")).join(first, "digest")
              .join(patterns.select("prio", "pattern", "scopes"), "prio").select(key, "pattern", "scopes"))


def scope_demand(df: DataFrame) -> DataFrame:
    """Number of messages needing each scope."""
    return (T.explode_values(df, F.col("scope"), "scope")
              .groupBy("scope").agg(F.count(F.lit(1)).alias("n_messages")))
