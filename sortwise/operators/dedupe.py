"""Repeated messages: what the reference's result cache computes (K1-K3).

K2 semantics: per message key, a row is a *hit* iff its timestamp is before
(last miss of that key) + TTL; a hit does not renew the entry.  So the misses
of a key are the orbit of its first event under
    f(x) = first event with ts >= ts(x) + TTL
This is not a gap session and not a tumbling window.

Plan (no group is ever collected; skew-safe):
0. (key, id, t) is materialised once; everything below reads that.
1. f(x) by an as-of lookup inside (key, bucket) partitions, buckets far narrower
   than the TTL: a probe at ts(x) + TTL meets the events of its bucket; without a
   later one there, the first event of the next bucket that has any is taken from a
   table of bucket minima.  A key that holds a third of all rows, even within one
   hour, is thereby split into minutes.
2. An event whose predecessor is a TTL or more earlier is a miss whatever came
   before.  These *roots* are first events of buckets, so the table of buckets tells
   them.  A chain of f from a root meets the next root, so it is cut there: its length
   is that of a stretch without a pause of a TTL, not of the whole time span.
3. Only roots and images of f can be misses, so f is kept for those alone.
   Pointer doubling: J_0 = f, J_{k+1} = J_k o J_k, and the orbit
   P_{k+1} = P_k U J_k(P_k), starting from all roots, until J is empty.  Every step is an
   equi-join on the event id (high cardinality, no skew), with the lineage cut by
   tables written to ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..session import ensure_checkpoint_dir

US = 1_000_000


def message_key(norm_col: str = "norm"):
    """md5 of the normalised text."""
    return F.md5(F.col(norm_col))


def text_key(text):
    """P2 of a raw text."""
    return F.md5(T.normalize(T.strip_ws(text)))


def classify_distinct(df: DataFrame, classify_fn, key_of, text_col: str = "message",
                      order: tuple[str, str] = ("ts", "msg_id")) -> DataFrame:
    """K1: classify each distinct key once and join the result back to every copy.

    ``key_of`` gives a text's key; ``classify_fn`` takes and returns rows with ``msg_key``.
    Rows combine by text first, so a text is normalised once however often it stands in
    the table, and rows are joined to its verdict by the text itself.  Texts of one key
    may differ (accents, case); the first request's text, by ``order`` (time, id), is the
    one classified.  Time and id are one number, which a hash aggregate can hold.  AQE
    broadcasts the distinct side at run time when it is small (its size is measured)."""
    rank = F.expr(f"cast(unix_micros(cast(`{order[0]}` AS timestamp)) AS decimal(18,0)) * 10000000000000000000BD"
                  f" + cast(`{order[1]}` AS decimal(19,0))")
    texts = df.groupBy(F.col(text_col).alias("_text")).agg(F.min(rank).alias("_first"))
    texts = texts.withColumn("msg_key", key_of(F.col("_text")))
    firsts = texts.groupBy("msg_key").agg(F.min_by("_text", "_first").alias(text_col))
    verdicts = texts.select("_text", "msg_key").join(classify_fn(firsts).drop(text_col), "msg_key")
    return df.join(verdicts, F.col(text_col).eqNullSafe(F.col("_text")), "left").drop("_text")


def _checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder ``spark.checkpoint.dir``: computed once
    (``checkpoint()`` computes twice), found again after an executor is lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/sortwise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Buckets of the as-of lookup per TTL.
BUCKETS_PER_TTL = 60
#: Doublings between two written tables.
DOUBLINGS = 2


def bucket_table(ev: DataFrame, width: int) -> DataFrame:
    """Per (k, b) of ``ev(k, id, t)``: first event and last time."""
    return (ev.withColumn("b", F.floor(F.col("t") / F.lit(width))).groupBy("k", "b")
              .agg(F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("last_t")))


def roots_of(buckets: DataFrame, ttl: int) -> DataFrame:
    """Ids of events without another of their key less than ``ttl`` before them; buckets
    are narrower than a TTL, so only first events of buckets can be such."""
    before = F.lag("last_t").over(Window.partitionBy("k").orderBy("b"))
    return (buckets.withColumn("before", before)
            .where(F.col("before").isNull() | (F.col("first.t") - F.col("before") >= ttl))
            .select(F.col("first.id").alias("id")))


def next_miss_candidates(ev: DataFrame, buckets: DataFrame, ttl: int, width: int) -> DataFrame:
    """f(x) for every event x of ``ev(k, id, t)``: the first event of the same key at or
    after t(x) + ttl, ordered by (t, id); events without one are left out.

    Inside the probe's bucket a running window (descending time, so the frame is
    unbounded-preceding: O(n) per partition) finds the answer; else it is the first
    event of the next bucket of that key that has any."""
    bucket = F.floor(F.col("t") / F.lit(width)).alias("b")
    none = F.lit(None).cast("long")
    rows = (ev.select("k", (F.col("t") + F.lit(ttl)).alias("t"), none.alias("id"), F.col("id").alias("src"))
              .unionByName(ev.select("k", "t", "id", none.alias("src")))
              .select("k", bucket, "t", "id", "src"))
    w = (Window.partitionBy("k", "b").orderBy(F.col("t").desc(), F.col("src").isNotNull(), F.col("id").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = rows.withColumn("best", F.min(F.when(F.col("src").isNull(), F.struct("t", "id"))).over(w))
    probes = seen.where(F.col("src").isNotNull()).select("k", "b", "src", F.col("best.id").alias("f_local"))
    # a probe's bucket may hold no event
    firsts = buckets.select("k", "b", "first").unionByName(
        probes.where("f_local IS NULL").select("k", "b").distinct().withColumn(
            "first", F.lit(None).cast("struct<t:bigint,id:bigint>"))).groupBy("k", "b").agg(F.max("first").alias("first"))
    later = (Window.partitionBy("k").orderBy(F.col("b").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    nxt = firsts.select("k", "b", F.last("first.id", ignorenulls=True).over(later).alias("f_next"))
    j = probes.where("f_local IS NOT NULL").select("src", F.col("f_local").alias("to")).unionByName(
        probes.where("f_local IS NULL").join(nxt, ["k", "b"]).select("src", F.col("f_next").alias("to")))
    return j.where(F.col("to").isNotNull()).select(F.col("src").alias("id"), "to")


def ttl_hits(df: DataFrame, key_col: str = "msg_key", ts_col: str = "ts",
             id_col: str = "msg_id", ttl_seconds: int = L.CACHE_TTL_SECONDS) -> DataFrame:
    """K2: adds ``is_hit`` (bool) to every row of ``df``; ``id_col`` must be
    unique.  Arrival order within a key is (ts, id)."""
    ttl = ttl_seconds * US
    width = max(1, ttl // BUCKETS_PER_TTL)
    ev = _checkpoint(df.select(F.col(key_col).alias("k"), F.col(id_col).cast("long").alias("id"),
                               F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t")))
    buckets = _checkpoint(bucket_table(ev, width))
    orbit = roots = _checkpoint(roots_of(buckets, ttl))
    f = _checkpoint(next_miss_candidates(ev, buckets, ttl, width))
    starts = f.select(F.col("to").alias("id")).unionByName(roots).distinct()
    jump = _checkpoint(f.join(starts, "id", "left_semi").join(roots.withColumnRenamed("id", "to"), "to", "left_anti")
                        .select("id", "to"))
    while not jump.isEmpty():
        for _ in range(DOUBLINGS):
            orbit = orbit.unionByName(orbit.join(jump, "id").select(F.col("to").alias("id")))
            jump = (jump.alias("a").join(jump.alias("c"), F.col("a.to") == F.col("c.id"))
                        .select(F.col("a.id").alias("id"), F.col("c.to").alias("to")))
        orbit, jump = _checkpoint(orbit), _checkpoint(jump)
    misses = orbit.select(F.col("id").alias("_miss_id"), F.lit(True).alias("_miss"))
    out = df.join(misses, F.col(id_col).cast("long") == F.col("_miss_id"), "left")
    return out.withColumn("is_hit", F.col("_miss").isNull()).drop("_miss_id", "_miss")


def _hit_rates(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("is_hit").cast("int")).alias("hits")).withColumn(
        "hit_rate_pct", F.round(F.col("hits") / F.col("requests") * 100, 2))


def hit_rate_by_hour(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """K3: requests, hits and hit rate per hour."""
    rates = _hit_rates(df.groupBy(F.window(F.col(ts_col).cast("timestamp"), "1 hour").alias("w")))
    return rates.select(F.col("w.start").alias("hour"), "requests", "hits", "hit_rate_pct")


def hit_rate_by_key(df: DataFrame, key_col: str = "msg_key") -> DataFrame:
    """K3: requests, hits and hit rate per message key."""
    return _hit_rates(df.groupBy(key_col))
