"""Structured Streaming jobs.

The batch expressions are reused unchanged: a streaming DataFrame goes
through the same ``triage`` projection.  Static lexicons are literals inside
the expressions (or broadcast relations), so stream-static joins never
shuffle the stream.  Event time is ``ts`` cast to ``timestamp`` under the
session time zone (watermarks need a zoned timestamp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import classify as C
from ..operators import dedupe as K
from ..operators import reports as A
from ..operators import tokens as J
from ..operators.triage import triage
from ..sources import lexicon_io as LX
from ..sources import payloads as SP
from ..sources import tables as TB
from ..sources.phrases import phrases_df
from . import ttl as TTL

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def message_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """T-side twin of ``tables.msg_stream`` over the event files below ``path``, at most
    ``max_files`` a micro-batch: a stream-static join with the fixed 37-row phrase
    dimension (broadcast; bounded)."""
    ev = (spark.readStream.schema(EVENTS_SCHEMA).option("recursiveFileLookup", "true")
          .option("maxFilesPerTrigger", max_files).parquet(path))
    ph = F.broadcast(phrases_df(spark).select("idx", "rule", "message", "final_bucket"))
    return (ev.withColumn("idx", TB.phrase_key(F.col("event_id"), F.col("user_id")).cast("int"))
              .join(ph, "idx")
              .select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("sender"), "ts",
                      "event_type", F.col("value").alias("latency_ms"), "message",
                      F.col("final_bucket").alias("expected"), "rule"))


def run_available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet"):
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return q


# T1 -------------------------------------------------------------------------
def triage_stream(stream: DataFrame) -> DataFrame:
    """Streaming triage: the batch projection applied to the stream."""
    t = triage(stream)
    return t.select("msg_id", "ts", "event_type", "rule_id", "bucket",
                    F.array_join("reasons", " | ").alias("reasons"),
                    F.array_join("scope", ",").alias("scope"),
                    F.col("reclassified").cast("int").alias("reclassified"), "expected")


# T2 -------------------------------------------------------------------------
def hourly_metrics(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Service metrics per hour as A1 defines them (an error adds no latency); rows later
    than the watermark are dropped."""
    ev = stream.withColumn("event_time", F.col("ts").cast("timestamp"))
    err = F.col("event_type") == "error"
    g = (ev.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", "1 hour").alias("w"))
           .agg(F.count(F.lit(1)).alias("requests"), F.sum(err.cast("int")).alias("errors"),
                F.sum(F.when(~err, A.micro(F.col("latency_ms"))).otherwise(0)).alias("_lat")))
    return g.select(F.col("w.start").alias("hour"), "requests", "errors",
                    A.mean_ms(F.col("_lat"), F.col("requests")).alias("avg_latency_ms"))


# T3 -------------------------------------------------------------------------
TTL_OUT = "msg_id long, msg_key string, ts timestamp, event_type string, latency_ms double, is_hit boolean"


def keyed_events(stream: DataFrame) -> DataFrame:
    """What T3 reads: msg_id, msg_key, ts (timestamp), event_type, latency_ms."""
    p = C.prepare(stream, C.default_lexicon()).withColumn("msg_key", K.message_key())
    return p.select("msg_id", "msg_key", F.col("ts").cast("timestamp").alias("ts"), "event_type", "latency_ms")


def ttl_dedupe(stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Streaming TTL duplicate detection: equals K2 on every row whose slice of event time
    (``ttl.SLICE_SECONDS``) the watermark has passed."""
    return TTL.settled(keyed_events(stream), watermark).select(
        "msg_id", "msg_key", F.timestamp_micros("us").alias("ts"), "event_type", "latency_ms", "is_hit")


def ttl_approximate(stream: DataFrame, ttl_seconds: int = L.CACHE_TTL_SECONDS) -> DataFrame:
    """T3's approximation, with Spark's own operator: the first row of a key is kept, others
    go until the watermark is a TTL behind it.  State is one time a key, nothing waits;
    but rows count as they arrive, and a key is forgotten by the watermark, which moves
    between micro-batches only, so long batches suppress more than a TTL."""
    return keyed_events(stream).withWatermark("ts", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["msg_key"])


def hourly_hits(stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """T2 over T3's rows in one query: service metrics per hour with hits and misses."""
    h = TTL.hourly(keyed_events(stream), watermark, A.micro)
    return h.select(F.timestamp_micros("hour_us").alias("hour"), "requests", "errors",
                    A.mean_ms(F.col("latency_ns"), F.col("requests")).alias("avg_latency_ms"), "hits", "misses")


# T4 -------------------------------------------------------------------------
def write_quarantine(batch: DataFrame, batch_id: int, ok_path: str, err_path: str) -> None:
    """One micro-batch into a folder of its own under each sink; a replay of the batch
    replaces both, so no row is written twice."""
    batch.persist()
    try:
        ok, bad = SP.split_empty(batch)
        triage(ok.drop("norm", "lemmas")).select("msg_id", "bucket", "rule_id") \
            .write.mode("overwrite").parquet(f"{ok_path}/batch={batch_id}")
        bad.select("msg_id", "error", F.col("reply.messages")[0]["content"].alias("reply")) \
            .write.mode("overwrite").parquet(f"{err_path}/batch={batch_id}")
    finally:
        batch.unpersist()


def quarantine_job(stream: DataFrame, ok_path: str, err_path: str, checkpoint: str):
    """Blank messages to an error sink, the rest triaged to the main sink,
    both written from one micro-batch (``foreachBatch``)."""
    prepared = C.prepare(stream, C.default_lexicon())
    q = (prepared.writeStream.foreachBatch(lambda b, i: write_quarantine(b, i, ok_path, err_path))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# S1 / S2 as a stream ----------------------------------------------------------
BODIES_SCHEMA = "msg_id long, payload string"


def body_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Request bodies as they came: JSON lines of (msg_id, payload), at most ``max_files``
    a micro-batch."""
    return spark.readStream.schema(BODIES_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def write_ingested(batch: DataFrame, batch_id: int, root: str) -> None:
    """One micro-batch of parsed bodies into three sinks under ``root``: ``accepted``,
    ``empty`` (S3) and ``refused`` (dead letters, with their text).  Each gets a folder
    of its own, which a replay of the batch replaces."""
    batch.persist()
    try:
        valid, refused = SP.split_rejected(batch)
        accepted, blank = SP.split_empty(valid)
        for name, rows in (("accepted", accepted.select("msg_id", "message", "ctx", "history")),
                           ("empty", blank.select("msg_id", "error", "reply")),
                           ("refused", refused.select("msg_id", "reject_reason", "payload"))):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    finally:
        batch.unpersist()


def ingest_job(bodies: DataFrame, root: str, checkpoint: str, parse=SP.parse_payloads):
    """S1 (or S2, with ``parse_webhooks``) over a stream of bodies: see ``write_ingested``."""
    q = (parse(bodies).writeStream.foreachBatch(lambda b, i: write_ingested(b, i, root))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# T5 -------------------------------------------------------------------------
def write_candidates(batch: DataFrame, batch_id: int, root: str) -> None:
    """The counts that a micro-batch changed, as a folder of its own (a replay replaces it)."""
    batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def read_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Latest count of every token: counts only grow, so it is the greatest."""
    return (spark.read.schema("token string, freq long, batch int").parquet(root)
                 .groupBy("token").agg(F.max("freq").alias("freq")))


def learned_candidates_job(stream: DataFrame, static: DataFrame, learned: DataFrame,
                           root: str, checkpoint: str):
    """Unknown tokens with running counts (update mode: only counts that changed)."""
    p = C.prepare(stream, C.default_lexicon())
    counts = J.unknown_tokens(J.tokenize(p), static, learned)
    q = (counts.writeStream.outputMode("update").foreachBatch(lambda b, i: write_candidates(b, i, root))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def publish_learned(batch: DataFrame, batch_id: int, static: DataFrame, suggestions: DataFrame, root: str) -> None:
    """One turn of the learned-lexicon loop (T5, J6, S6, S5): tokens of the micro-batch that
    neither ``static`` nor the newest committed version knows and ``suggestions`` (form,
    lemma) can lemmatise become a new version.  A replayed batch finds its version
    committed and does nothing; one whose writer died half-way writes it anew."""
    spark, name = batch.sparkSession, f"v={batch_id + 1:06d}"
    if name in LX.versions(spark, root):
        return
    learned = LX.read_learned_versioned(spark, root)
    seen = batch.groupBy(F.col("token").alias("form")).agg(F.min("ts").alias("seen_at"))
    known = F.broadcast(static.select("form"))
    candidates = seen.join(known, "form", "left_anti").join(suggestions, "form")
    LX.save_learned(J.merge_learned(learned, candidates), root, batch_id + 1)


def learned_lexicon_job(stream: DataFrame, static: DataFrame, suggestions: DataFrame, root: str, checkpoint: str):
    """Publishes a version of the learned lexicon under ``root`` per micro-batch."""
    tokens = C.prepare(stream, C.default_lexicon()).select("ts", F.explode("tokens").alias("token"))
    q = (tokens.writeStream.foreachBatch(lambda b, i: publish_learned(b, i, static, suggestions, root))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
