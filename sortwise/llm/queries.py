"""Registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_texts, exact_dedup, host_rules, licenses, lm_scoring, ngram_join, packing, periodic_runs, quality,
               secrets, stand_ins, token_counts, toxicity, turn_repair)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Spark's white space set deleted; the digest is over the rest, in UTF-8.
_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(sql: str | None = None):
    def keep(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build
    return keep


@query()
def op1_lm_scoring(spark, sf_dir):
    """Target: documents labelled good and not toxic.  Labels grow with the documents, so
    they are joined by a shuffle at every size."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    good = labels.select("doc_id").distinct().withColumn("target", F.lit(True))
    docs = documents(spark, sf_dir).select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    return lm_scoring.scores(docs, F.col("target"), public_tokenizers.path("byte_bpe_50k.json"))


#: All pairs that share a shingle, then all documents that links reach.
_NGRAM_JOIN = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, len(words) AS n, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
shingle AS (
  SELECT DISTINCT doc_id, md5(concat_ws(' ', word, b, c, d, e)) AS s FROM (
    SELECT doc_id, n, i, word, lead(word, 1) OVER t AS b, lead(word, 2) OVER t AS c, lead(word, 3) OVER t AS d,
           lead(word, 4) OVER t AS e FROM word WINDOW t AS (PARTITION BY doc_id ORDER BY i))
  WHERE i = 1 OR i <= n - 4),
size AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingle USING (doc_id) GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT doc_id, CAST(size.n AS BIGINT) AS n_shingles, c.component_id
FROM size JOIN (SELECT doc_id, CAST(min(r) AS BIGINT) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""


@query(_NGRAM_JOIN)
def op2_ngram_join(spark, sf_dir):
    return ngram_join.similar_classes(documents(spark, sf_dir))


@query()
def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 1)
    scored = toxicity.toxicity(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op4_quality_rules(spark, sf_dir):
    return host_rules.judge(documents(spark, sf_dir))


@query()
def op5_bpe_texts(spark, sf_dir):
    return bpe_texts.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op6_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


@query(f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({_SQUEEZED}) AS text_sha256
           FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(keep_id AS BIGINT) AS keep_id,
       CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query()
def op8_token_counts(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    trees = token_counts.build_trees(documents(spark, sf_dir), vocabulary, edits_of=token_counts.cleaning_edits)
    return token_counts.edit_counts(trees, vocabulary)


@query()
def op9_secret_scan(spark, sf_dir):
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


@query()
def op10_quality_classifier(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir))


@query()
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.find_runs(stand_ins.looped(documents(spark, sf_dir))))


@query()
def op12_license_scan(spark, sf_dir):
    return licenses.digests(licenses.scan(documents(spark, sf_dir)))


@query()
def op13_conversation_repair(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.repair(stand_ins.damaged(conversations), conversations)
