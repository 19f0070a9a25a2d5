"""Input relations over the driver's parquet tables.

``msg_stream``: events joined to the phrase dimension; ``msg_conv``: user
turns of ``conversations``; ``msg_docs``: ``documents`` texts.  Every read
names its columns so the parquet scan prunes the rest.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrases import N_PHRASES, phrases_df
from .variants import variants, variants_df

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


#: Session setting: partitions that message relations are dealt over before per-row
#: work.  Unset (the default) leaves a scan's own partitions, with no shuffle, but for long
#: texts; set it for input in few row groups, which would otherwise run on few cores.
SPREAD_CONF = "spark.sortwise.scanPartitions"
#: Partitions that long texts are dealt over, for each core.
SPREAD_TEXTS = 4


def spread(df: DataFrame, least: int = 0) -> DataFrame:
    """``df`` round-robin over as many partitions as ``SPREAD_CONF`` says, if it is set;
    else over ``least`` or as many as the scan's splits, whichever is more, if it is given."""
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    if n:
        return df.repartition(int(n))
    return df.repartition(max(least, df.rdd.getNumPartitions())) if least else df


def replay_events(spark: SparkSession, sf_dir: str, path: str, stretches: int = 4, overlap: str = "5 minutes") -> int:
    """``events`` as Parquet files under ``path``, in order of arrival: each stretch of event
    time is several files, its rows in no order, and a fifth of its last ``overlap``
    arrives with the next one.  Returns the files of a stretch, which is what a
    micro-batch should take."""
    ev = read(spark, sf_dir, "events")
    files = spark.sparkContext.defaultParallelism
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        ev.write.parquet(f"{path}/0")
        return files
    step = (hi - lo) / stretches
    late = F.pmod(F.col("event_id"), F.lit(5)) == 0
    arrives = F.when(late, F.col("ts") + F.expr(f"INTERVAL {overlap}")).otherwise(F.col("ts"))
    for k in range(stretches):
        part = ev
        if k:
            part = part.where(arrives >= F.lit(lo + k * step))
        if k < stretches - 1:
            part = part.where(arrives < F.lit(lo + (k + 1) * step))
        part.repartition(files).write.parquet(f"{path}/{k}")
    return files


def phrase_key(event_id, user_id):
    """(event_id^2 + user_id) mod 37, computed without 64-bit overflow."""
    e = F.pmod(event_id, F.lit(N_PHRASES))
    return F.pmod(e * e + F.pmod(user_id, F.lit(N_PHRASES)), F.lit(N_PHRASES))


def msg_stream(spark: SparkSession, sf_dir: str, blank_signups: bool = False) -> DataFrame:
    """msg_id, sender, ts, event_type, latency_ms, message, expected, rule.

    The phrase table is a fixed 37-row dimension, so the broadcast is bounded
    regardless of the size of ``events``."""
    ev = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    ph = F.broadcast(phrases_df(spark).select("idx", "rule", "message", "final_bucket"))
    out = (ev.withColumn("idx", phrase_key(F.col("event_id"), F.col("user_id")).cast("int"))
             .join(ph, "idx")
             .select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("sender"), "ts",
                     "event_type", F.col("value").alias("latency_ms"), "message",
                     F.col("final_bucket").alias("expected"), "rule"))
    out = spread(out)
    if blank_signups:
        out = out.withColumn("message", F.when(F.col("event_type") == "signup", F.lit(""))
                             .otherwise(F.col("message")))
    return out


def msg_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, sender, ts, event_type, message: ``events`` over the fixed table of literal
    variants (a bounded broadcast)."""
    n = len(variants())
    ev = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    idx = F.pmod(F.pmod(F.col("event_id"), F.lit(n)) * 13 + F.pmod(F.col("user_id"), F.lit(n)), F.lit(n))
    out = ev.withColumn("idx", idx.cast("int")).join(F.broadcast(variants_df(spark)), "idx")
    return spread(out.select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("sender"), "ts", "event_type",
                             "message"))


#: Fixed values of the test relation: share of a request's latency spent in each stage;
#: a hit stops after the second.
STAGE_SHARES = {"extracao_ms": 0.02, "cache_lookup_ms": 0.08, "normalizacao_ms": 0.10,
                "classificacao_ms": 0.45, "construcao_payload_ms": 0.35}
HIT_STAGES = ("extracao_ms", "cache_lookup_ms")


def with_latencies(df: DataFrame) -> DataFrame:
    """Test relation: ``latencies`` per stage out of ``latency_ms`` (and ``is_hit``)."""
    ms = F.col("latency_ms")
    hit = F.coalesce(F.col("is_hit"), F.lit(False)) if "is_hit" in df.columns else F.lit(False)
    kv = []
    for stage, share in STAGE_SHARES.items():
        spent = F.round(ms * F.lit(share), 2)
        kv += [F.lit(stage), spent if stage in HIT_STAGES else F.when(~hit, spent)]
    kv += [F.lit("total_ms"), F.round(ms, 2)]
    return df.withColumn("latencies", F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull()))


def msg_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: conv_id, turn, msg_id, message."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return spread(c.where(F.col("role") == "user")
             .select("conv_id", "turn",
                     (F.col("conv_id") * F.lit(1_000_000) + F.col("turn")).alias("msg_id"),
                     F.col("text").alias("message")))


def msg_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, dealt over all cores: they are much work a row, and a file of any size may
    be few row groups, each of which a scan reads in one task."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return spread(d.select(F.col("doc_id").alias("msg_id"), F.col("text").alias("message"),
                           "lang", "source"), SPREAD_TEXTS * spark.sparkContext.defaultParallelism)
