"""Streaming queries (T1-T5): ``events`` is replayed in several stretches, one a micro-batch
(``tables.replay_events``); each stream runs with ``availableNow`` into a sink under
``spark.checkpoint.dir`` and the query returns the sink read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import lexicon_io as LX
from ..sources import payloads as SP
from ..sources import tables as TB
from ..streaming import jobs as ST
from . import sqlgen as S
from .catalog import register
from .queries_core import _flat_sql
from .queries_more import _payload_src, _tok_sql, _ttl_sql


def _scratch(spark, sf, tag):
    """(message stream over replayed events, sink, checkpoint)"""
    root = f"{ensure_checkpoint_dir(spark)}/streams/{tag}-{uuid.uuid4().hex}"
    files = TB.replay_events(spark, sf, f"{root}/in")
    return ST.message_stream(spark, f"{root}/in", files), f"{root}/out", f"{root}/checkpoint"


@register("stream_triage", "T1", _flat_sql(S.msg_stream_sql(), "expected"))
def stream_triage(spark, sf):
    stream, out, ck = _scratch(spark, sf, "triage")
    ST.run_available_now(ST.triage_stream(stream).drop("ts", "event_type"), out, ck)
    return spark.read.parquet(out).select(F.col("msg_id").cast("bigint").alias("msg_id"),
                                          "rule_id", "bucket", "reasons", "scope",
                                          "reclassified", "expected")


_HOURS = """date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS requests,
       CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS errors,
       ((2 * sum(CASE WHEN event_type <> 'error' THEN CAST(round(latency_ms * 1000000) AS BIGINT) ELSE 0 END)
         + 10000 * count(*)) // (20000 * count(*))) / 100 AS avg_latency_ms"""
_CLOSED = "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= mx.m - INTERVAL 10 MINUTE"


@register("stream_hourly_metrics", "T2", f"""WITH mx AS (SELECT max(ts) AS m FROM events),
e AS (SELECT ts, event_type, value AS latency_ms FROM events)
SELECT {_HOURS} FROM e, mx GROUP BY 1, mx.m {_CLOSED}""")
def stream_hourly_metrics(spark, sf):
    stream, out, ck = _scratch(spark, sf, "hourly")
    ST.run_available_now(ST.hourly_metrics(stream), out, ck)
    return _hours(spark.read.parquet(out))


def _hours(r, *more):
    return r.select(F.col("hour").cast("timestamp_ntz").alias("hour"),
                    F.col("requests").cast("bigint").alias("requests"),
                    F.col("errors").cast("bigint").alias("errors"), "avg_latency_ms",
                    *[F.col(c).cast("bigint").alias(c) for c in more])


# The rows whose slice of ten minutes T3's watermark (two hours behind the last row) has passed.
_SETTLED = """,
wm AS (SELECT epoch_ms(max(ts)) - 7200000 AS w FROM kb),
settled AS (SELECT rl.* FROM rl, wm WHERE (epoch_us(ts) // 600000000 + 1) * 600000 < w)"""


@register("stream_ttl_hits", "T3", _ttl_sql() + _SETTLED + """
SELECT CAST(msg_id AS BIGINT) AS msg_id, msg_key, latency_ms, CAST(is_hit AS INTEGER) AS is_hit FROM settled""")
def stream_ttl_hits(spark, sf):
    stream, out, ck = _scratch(spark, sf, "ttl")
    ST.run_available_now(ST.ttl_dedupe(stream), out, ck)
    r = spark.read.parquet(out)
    return r.select(F.col("msg_id").cast("bigint").alias("msg_id"), "msg_key", "latency_ms",
                    F.col("is_hit").cast("int").alias("is_hit"))


@register("stream_hourly_hits", "T2,T3", _ttl_sql() + _SETTLED + f"""
SELECT {_HOURS},
       CAST(sum(CAST(event_type <> 'error' AND is_hit AS INTEGER)) AS BIGINT) AS hits,
       CAST(sum(CAST(event_type <> 'error' AND NOT is_hit AS INTEGER)) AS BIGINT) AS misses
FROM settled, wm GROUP BY 1, wm.w
HAVING epoch_ms(date_trunc('hour', ts)) + 3600000 + 600000 < wm.w""")
def stream_hourly_hits(spark, sf):
    """T2 over the rows that T3 has settled, with their hits and misses: one query of three
    chained stateful operators, one checkpoint."""
    stream, out, ck = _scratch(spark, sf, "hits")
    ST.run_available_now(ST.hourly_hits(stream), out, ck)
    return _hours(spark.read.parquet(out), "hits", "misses")


@register("stream_ttl_approximate", "T3")
def stream_ttl_approximate(spark, sf):
    """Rows kept by the approximation.  Which of a key's rows comes first in a micro-batch
    is not fixed, so there is no SQL for it; the README has its distance from K2."""
    stream, out, ck = _scratch(spark, sf, "approximate")
    ST.run_available_now(ST.ttl_approximate(stream).select("msg_id", "msg_key"), out, ck)
    return spark.read.parquet(out).select(F.col("msg_id").cast("bigint").alias("msg_id"), "msg_key")


@register("stream_quarantine", "T4", f"""WITH {S.features_cte(S.msg_stream_sql(blank_signups=True))}
SELECT CASE WHEN m = '' THEN 'EMPTY_INPUT' ELSE 'accepted' END AS status,
       CAST(count(*) AS BIGINT) AS n FROM feat GROUP BY 1""")
def stream_quarantine(spark, sf):
    stream, out, ck = _scratch(spark, sf, "quarantine")
    stream = stream.withColumn(
        "message", F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("message")))
    ST.quarantine_job(stream, f"{out}/ok", f"{out}/err", ck)
    ok = spark.read.parquet(f"{out}/ok").select(F.lit("accepted").alias("status"))
    bad = spark.read.parquet(f"{out}/err").select(F.col("error").alias("status"))
    return ok.unionByName(bad).groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("stream_ingest", "S1,S3,T4", f"""WITH {S.features_cte(_payload_src())}
SELECT CAST(msg_id AS BIGINT) AS msg_id,
  CASE WHEN msg_id % 10 IN (0, 6) THEN 'MALFORMED' WHEN msg_id % 10 < 6 THEN 'NO_PAYLOAD'
       WHEN m = '' THEN 'EMPTY_INPUT' ELSE 'accepted' END AS status,
  CASE WHEN msg_id % 10 IN (0, 6) THEN CASE msg_id % 10 WHEN 0 THEN {S.q(SP.REFUSED[0])} ELSE {S.q(SP.REFUSED[6])} END
       WHEN msg_id % 10 > 6 AND m <> '' THEN m END AS body FROM feat""")
def stream_ingest(spark, sf):
    """Bodies as a stream of several micro-batches into three sinks, all read back."""
    root = f"{ensure_checkpoint_dir(spark)}/streams/ingest-{uuid.uuid4().hex}"
    files = spark.sparkContext.defaultParallelism
    bodies = SP.with_refused(SP.stream_payloads(TB.msg_stream(spark, sf))).select("msg_id", "payload")
    bodies.repartition(2 * files).write.json(f"{root}/in")
    ST.ingest_job(ST.body_stream(spark, f"{root}/in", files), f"{root}/out", f"{root}/checkpoint")

    def sink(name, status, body):
        return spark.read.parquet(f"{root}/out/{name}").select(
            F.col("msg_id").cast("bigint").alias("msg_id"), status.alias("status"), body.cast("string").alias("body"))
    refused = F.when(F.col("reject_reason") == "MALFORMED", F.col("payload"))
    return (sink("accepted", F.lit("accepted"), F.col("message"))
            .unionByName(sink("empty", F.col("error"), F.lit(None)))
            .unionByName(sink("refused", F.col("reject_reason"), refused)))


@register("stream_learned_candidates", "T5", _tok_sql(S.msg_stream_sql()) + """
SELECT token, CAST(count(*) AS BIGINT) AS freq FROM lt
WHERE s_lemma IS NULL AND l_lemma IS NULL GROUP BY token""")
def stream_learned_candidates(spark, sf):
    stream, out, ck = _scratch(spark, sf, "candidates")
    ST.learned_candidates_job(stream, LX.verb_forms_df(spark), LX.read_learned(spark), out, ck)
    return ST.read_candidates(spark, out)


@register("stream_learned_lexicon", "T5,J6,S5,S6", _tok_sql(S.msg_stream_sql()) + """
SELECT DISTINCT token AS form, l_lemma AS lemma FROM lt WHERE s_lemma IS NULL AND l_lemma IS NOT NULL""")
def stream_learned_lexicon(spark, sf):
    """The newest version that a stream has published, starting from an empty lexicon; what
    it may learn is the shipped table."""
    stream, out, ck = _scratch(spark, sf, "lexicon")
    ST.learned_lexicon_job(stream, LX.verb_forms_df(spark), LX.read_learned(spark), out, ck)
    return LX.read_learned_versioned(spark, out)
