"""Token tables, lemma joins and lexicon maintenance.

The classifier lemmatises inside ``transform`` (narrow).  The operators here
expose the same lookup as relational joins.  The static lexicon is a fixed
relation of 445 rows and is broadcast; the learned lexicon grows with the data and
carries no hint (adaptive execution broadcasts it while it is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokenize(df: DataFrame, text_col: str = "norm", key: str = "msg_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, token) with pos starting at 1; Python str.split().  Columns named
    in ``carry`` go along, so reports need no join back."""
    out = df.select(key, *carry, F.posexplode_outer(T.tokens(F.col(text_col))).alias("pos0", "token"))
    return out.where(F.col("token").isNotNull()) \
              .select(key, *carry, (F.col("pos0") + 1).alias("pos"), "token")


def lemmatise_tokens(tokens: DataFrame, static: DataFrame, learned: DataFrame) -> DataFrame:
    """Static map, else learned map, else the token; ``source`` tells which."""
    s = F.broadcast(static.select(F.col("form").alias("token"), F.col("lemma").alias("s_lemma")))
    lrn = learned.select(F.col("form").alias("token"), F.col("lemma").alias("l_lemma"))
    j = tokens.join(s, "token", "left").join(lrn, "token", "left")
    return j.select(*tokens.columns,
                    F.coalesce("s_lemma", "l_lemma", "token").alias("lemma"),
                    F.when(F.col("s_lemma").isNotNull(), "static")
                     .when(F.col("l_lemma").isNotNull(), "learned").otherwise("unknown")
                     .alias("source"))


def lemmatise_messages(df: DataFrame, static: DataFrame, learned: DataFrame, key: str = "msg_id") -> DataFrame:
    """``tokens`` and ``lemmas`` of every message by joins, for a lexicon kept as tables
    of any size; ``key`` is unique.  Ready for ``classify(..., prepared=True)``.

    The words of one message meet again in one row, as they must for the rules."""
    words = lemmatise_tokens(tokenize(df, key=key), static, learned)
    per = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_l"))
    none = F.array().cast("array<string>")
    return (df.join(per, key, "left").withColumn("tokens", T.tokens(F.col("norm")))
              .withColumn("lemmas", F.coalesce(F.col("_l.lemma"), none)).drop("_l"))


def unknown_tokens(tokens: DataFrame, static: DataFrame, learned: DataFrame) -> DataFrame:
    """Tokens found in neither map, with frequency (partial aggregation
    map-side, then one shuffle on the token)."""
    s = F.broadcast(static.select(F.col("form").alias("token")))
    lrn = learned.select(F.col("form").alias("token"))
    return (tokens.join(s, "token", "left_anti").join(lrn, "token", "left_anti")
                  .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))


def merge_learned(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add candidate (form, lemma) pairs whose form is not known yet; among
    candidates for one form the first seen wins (min_by over seen_at)."""
    first = candidates.groupBy("form").agg(F.min_by("lemma", "seen_at").alias("lemma"))
    new = first.join(existing.select("form"), "form", "left_anti")
    return existing.select("form", "lemma").unionByName(new.select("form", "lemma"))


def extend_static(static: DataFrame, additions: DataFrame) -> DataFrame:
    """Append (form, lemma) entries after the current lexicon; a later entry
    for the same form overwrites the earlier one (last wins)."""
    base = static.select("form", "lemma", F.col("pos").cast("long").alias("pos"))
    offset = F.lit(1 << 40)
    add = additions.select("form", "lemma", (offset + F.col("pos")).cast("long").alias("pos"))
    w = Window.partitionBy("form").orderBy(F.col("pos").desc())
    return (base.unionByName(add).withColumn("rn", F.row_number().over(w))
                .where("rn = 1").drop("rn"))


def missing_required(required: DataFrame, infinitives: DataFrame) -> DataFrame:
    """Required lemmas that the lexicon does not offer."""
    return required.select("lemma").join(infinitives.select("lemma"), "lemma", "left_anti")


def forms_per_lemma(static: DataFrame) -> DataFrame:
    """Number of forms per lemma, sorted by lemma."""
    return static.groupBy("lemma").agg(F.count(F.lit(1)).alias("n_forms")).orderBy("lemma")


def lexicon_stats(static: DataFrame, learned: DataFrame, extra_infinitives: list[str]) -> DataFrame:
    """Forms, lemmas (with the extra accepted infinitives), forms per lemma
    (2 decimals), learned forms, total known forms."""
    extra = static.sparkSession.createDataFrame([(x,) for x in extra_infinitives], "lemma string")
    tagged = (static.select(F.lit("form").alias("kind"), F.col("form").alias("v"))
              .unionByName(static.select(F.lit("lemma").alias("kind"), F.col("lemma").alias("v")))
              .unionByName(extra.select(F.lit("lemma").alias("kind"), F.col("lemma").alias("v")))
              .unionByName(learned.select(F.lit("learned").alias("kind"), F.col("form").alias("v"))))
    agg = tagged.agg(F.count_distinct(F.when(F.col("kind") == "form", F.col("v"))).alias("n_forms"),
                     F.count_distinct(F.when(F.col("kind") == "lemma", F.col("v"))).alias("n_lemmas"),
                     F.count(F.when(F.col("kind") == "learned", F.lit(1))).alias("n_learned"))
    return agg.select("n_forms", "n_lemmas",
                      F.round(F.col("n_forms") / F.col("n_lemmas"), 2).alias("forms_per_lemma"),
                      "n_learned", (F.col("n_forms") + F.col("n_learned")).alias("total_known"))


def keyword_hits(df: DataFrame, keywords: list[str], key: str = "msg_id") -> DataFrame:
    """Messages x keyword list by substring, hits in keyword order.

    Expressed per row instead of a nested-loop join followed by a regroup: the
    result is identical, and the plan stays narrow.  The hits are computed once, in
    a projection of their own; the generator keeps the filter on the finished column
    from being pushed below it and computed again."""
    hits = T.found_in_order(F.col("norm"), keywords)
    rows = df.select(key, F.explode_outer(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    return rows.select(key, F.size("hits").alias("n_keywords"),
                       F.array_join(F.slice("hits", 1, 6), ", ").alias("first_keywords"))
