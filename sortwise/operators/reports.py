"""Service and evaluation reports.

All are aggregations with map-side partial aggregation; the only windows
are over already-aggregated rows (shares, ranks) or partitioned by a class
label with a bounded output (first-k per class).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import _checkpoint as checkpointed


def _pct(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.round(num / den * 100, 2)).otherwise(F.lit(0.0))


def micro(ms: Column) -> Column:
    """Milliseconds as whole nanoseconds, so sums don't depend on the order of rows."""
    return F.round(ms * 1_000_000).cast("long")


def mean_ms(total: Column, n: Column) -> Column:
    """Whole nanoseconds over a count, in milliseconds rounded half up to 2 decimals."""
    half_up = F.call_function("div", 2 * total + 10_000 * n, 20_000 * n)
    return F.when(n > 0, half_up / 100).otherwise(F.lit(0.0))


def service_summary(df: DataFrame, *group_cols: str) -> DataFrame:
    """A1 (A2 with group columns): requests, hits, misses, hit % (hits over
    *all* requests), average latency (errors add none), errors, error %.
    Needs is_error, is_hit (null for errors) and latency_ms."""
    err = F.col("is_error")
    agg = [F.count(F.lit(1)).alias("total_requests"),
           F.sum(F.when(~err & F.col("is_hit"), 1).otherwise(0)).alias("cache_hits"),
           F.sum(F.when(~err & ~F.col("is_hit"), 1).otherwise(0)).alias("cache_misses"),
           F.sum(F.when(~err, micro(F.col("latency_ms"))).otherwise(0)).alias("_lat"),
           F.sum(err.cast("int")).alias("error_count")]
    g = df.groupBy(*group_cols) if group_cols else df
    out = g.agg(*agg)
    tot = F.col("total_requests")
    return out.select(*group_cols, "total_requests", "cache_hits", "cache_misses",
                      _pct(F.col("cache_hits"), tot).alias("cache_hit_rate_percent"),
                      mean_ms(F.col("_lat"), tot).alias("avg_latency_ms"),
                      "error_count", _pct(F.col("error_count"), tot).alias("error_rate_percent"))


def service_rollup(df: DataFrame, a: str, b: str) -> DataFrame:
    """A2: A1 with subtotals over (a, b), (a) and the grand total."""
    err = F.col("is_error")
    out = df.rollup(a, b).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(F.when(~err & F.col("is_hit"), 1).otherwise(0)).alias("cache_hits"),
        F.sum(F.when(~err, micro(F.col("latency_ms"))).otherwise(0)).alias("_lat"),
        F.sum(err.cast("int")).alias("error_count"),
        F.grouping_id().alias("level"))
    tot = F.col("total_requests")
    return out.select(a, b, "level", "total_requests", "cache_hits",
                      _pct(F.col("cache_hits"), tot).alias("cache_hit_rate_percent"),
                      mean_ms(F.col("_lat"), tot).alias("avg_latency_ms"), "error_count")


def live_keys(df: DataFrame, ttl_seconds: int, at: Column | None = None) -> DataFrame:
    """A1's cache size: keys whose last miss is less than ``ttl_seconds`` before ``at``
    (default: the last request).  Needs msg_key, is_hit and ts."""
    misses = df.where(~F.col("is_hit")).groupBy("msg_key").agg(F.max("ts").alias("miss"))
    if at is None:  # one row, joined to all
        misses = misses.join(F.broadcast(df.agg(F.max("ts").alias("_at"))), F.lit(True))
    else:
        misses = misses.withColumn("_at", at)
    live = misses.where(F.col("miss") + F.expr(f"INTERVAL {ttl_seconds} SECONDS") > F.col("_at"))
    return live.agg(F.count(F.lit(1)).alias("live_keys"))


def stage_latency(log: DataFrame) -> DataFrame:
    """A3: per stage: samples, mean, approximate median and p95."""
    e = log.select(F.explode_outer("latencies").alias("stage", "ms")).where(F.col("stage").isNotNull())
    return e.groupBy("stage").agg(F.count(F.lit(1)).alias("samples"),
                                  F.round(F.avg("ms"), 4).alias("avg_ms"),
                                  F.percentile_approx("ms", 0.5).alias("p50_ms"),
                                  F.percentile_approx("ms", 0.95).alias("p95_ms"))


#: Size parameter of a quantile sketch: a rank is off by 0.7 % with it (99 % of the time).
SKETCH_K = 400


def stage_sketches(log: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A3 as a table to keep: per hour and stage, the samples and a mergeable quantile sketch."""
    e = log.select(F.date_trunc("hour", ts_col).alias("hour"), F.explode_outer("latencies").alias("stage", "ms"))
    return e.where(F.col("stage").isNotNull() & F.col("ms").isNotNull()).groupBy("hour", "stage").agg(
        F.count(F.lit(1)).alias("samples"), F.kll_sketch_agg_double("ms", SKETCH_K).alias("sketch"))


def stage_quantiles(sketches: DataFrame, *by: str) -> DataFrame:
    """Median and p95 per stage (and ``by``, such as a day of the hour), rolled up from the
    sketches alone; no latency is read again."""
    merged = sketches.groupBy(*by, "stage").agg(
        F.sum("samples").alias("samples"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    return merged.select(*by, "stage", "samples",
                         F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("p50_ms"),
                         F.kll_sketch_get_quantile_double("s", F.lit(0.95)).alias("p95_ms"))


def bucket_distribution(df: DataFrame, by: str) -> DataFrame:
    """A4: messages per (by, bucket) and the share within ``by`` (window over
    the aggregated rows only)."""
    c = df.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    return c.withColumn("share_pct", F.round(F.col("n") / F.sum("n").over(w) * 100, 2))


def accuracy_by_class(df: DataFrame, pred: str = "bucket", label: str = "expected") -> DataFrame:
    """A5: hits, cases and accuracy % per expected class."""
    ok = (F.col(pred) == F.col(label)).cast("int")
    return (df.groupBy(label).agg(F.sum(ok).alias("hits"), F.count(F.lit(1)).alias("cases"))
              .withColumn("accuracy_pct", F.round(F.col("hits") / F.col("cases") * 100, 2)))


def confusion_matrix(df: DataFrame, buckets, pred: str = "bucket",
                     label: str = "expected") -> DataFrame:
    """Expected x predicted counts (pivot over the fixed bucket list, so
    no extra pass is needed to find the pivot values)."""
    return (df.groupBy(label).pivot(pred, list(buckets)).count().na.fill(0))


# FIXED VALUES: gate bands of the evaluation script (overall accuracy %)
GATE_BANDS = [(95.0, "EXCELENTE"), (90.0, "BOM"), (80.0, "ATENÇÃO")]
GATE_FAIL = "CRÍTICO"
GATE_PASS_PCT = 90.0


def quality_gate(df: DataFrame, pred: str = "bucket", label: str = "expected") -> DataFrame:
    """Overall accuracy, band and pass flag (>= 90 %)."""
    o = df.agg(F.sum((F.col(pred) == F.col(label)).cast("int")).alias("hits"),
               F.count(F.lit(1)).alias("cases"))
    pct = F.round(F.col("hits") / F.col("cases") * 100, 2)
    band = None
    for lim, name in GATE_BANDS:
        band = F.when(pct >= lim, F.lit(name)) if band is None else band.when(pct >= lim, F.lit(name))
    band = band.otherwise(F.lit(GATE_FAIL))
    return o.select("hits", "cases", pct.alias("accuracy_pct"), band.alias("band"),
                    (pct >= GATE_PASS_PCT).alias("passed"))


def first_errors(df: DataFrame, k: int = 10, pred: str = "bucket", label: str = "expected",
                 order: str = "msg_id") -> DataFrame:
    """The first ``k`` misclassified cases of each expected class.

    Misclassified rows sort first inside each class, so their row numbers are
    1..E; the filter runs after the window on a non-partition column, where
    the optimiser cannot push it below the window into the (expensive)
    derived columns."""
    ok = F.col(pred) == F.col(label)
    w = Window.partitionBy(label).orderBy(ok.asc(), F.col(order))
    ranked = df.withColumn("err_rank", F.row_number().over(w))
    return ranked.where((F.col("err_rank") <= k) & (F.col(pred) != F.col(label)))


def case_positions(df: DataFrame, label: str = "expected", order: str = "msg_id") -> DataFrame:
    """``df`` with ``position``, from 1, of every row within its class.

    Rows are range-sorted by (class, order) and written, so a class that holds most rows is
    many tasks; a row's position is its number in its task's stretch of the class plus
    the sizes of the class's stretches before.  The table of stretches has a row a task
    and class, and is broadcast."""
    rows = checkpointed(df.repartitionByRange(label, order).sortWithinPartitions(label, order)
                        .withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)  # the id's upper bits number the task, the others its rows
    parts = rows.groupBy(F.col(label).alias("_class"), task.alias("_task")).agg(
        F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    met = rows.withColumn("_row_task", task).join(
        F.broadcast(parts), F.col(label).eqNullSafe(F.col("_class")) & (F.col("_row_task") == F.col("_task")))
    return met.withColumn("position", F.col("_at") - F.col("_from") + F.col("_before") + 1).drop(
        "_at", "_row_task", "_class", "_task", "_from", "_before")


# FIXED VALUES: what the evaluation shows besides errors: the first cases of a class, and each so-many-th
SHOWN_FIRST, SHOWN_EVERY = 5, 20


def case_samples(df: DataFrame, pred: str = "bucket", label: str = "expected", order: str = "msg_id") -> DataFrame:
    """The cases that the evaluation shows: every misclassified one, the first of each
    class, and each ``SHOWN_EVERY``-th."""
    rows = case_positions(df, label, order).withColumn("correct", F.col(pred) == F.col(label))
    return rows.where(~F.col("correct") | (F.col("position") <= SHOWN_FIRST) | (F.col("position") % SHOWN_EVERY == 0))


def lexicon_coverage(lemmatised: DataFrame, by: str) -> DataFrame:
    """A10: share of tokens that are static forms, learned forms or unknown."""
    c = lemmatised.groupBy(by).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.sum((F.col("source") == "static").cast("int")).alias("static"),
        F.sum((F.col("source") == "learned").cast("int")).alias("learned"),
        F.sum((F.col("source") == "unknown").cast("int")).alias("unknown"))
    t = F.col("tokens")
    return c.select(by, "tokens", "static", "learned", "unknown",
                    F.round(F.col("static") / t * 100, 4).alias("static_pct"),
                    F.round(F.col("learned") / t * 100, 4).alias("learned_pct"),
                    F.round(F.col("unknown") / t * 100, 4).alias("unknown_pct"))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values (ties by value).  Partial counts first;
    the final ordering runs on the aggregated rows."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), F.col(col)).limit(k)
