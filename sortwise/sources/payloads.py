"""Ingest of request payloads (S1, S2) and the empty-input quarantine (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators.payload import CTX_SCHEMA, MSG_SCHEMA

PAYLOAD_SCHEMA = (f"message string, ctx {CTX_SCHEMA}, history array<{MSG_SCHEMA}>, "
                  "_corrupt string")
WEBHOOK_SCHEMA = "`from` string, message string, _corrupt string"


def parse_payloads(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """JSON text -> typed request.  A missing message becomes '' and is stripped.

    Malformed text is kept in ``corrupt``.  ``reject_reason`` tells requests that are
    refused before triage: MALFORMED, or NO_PAYLOAD for null, empty, ``null`` and an
    empty object; ``rejected`` is true for both."""
    p = F.from_json(F.col(json_col), PAYLOAD_SCHEMA,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return (df.withColumn("_p", p)
              .withColumn("message", T.strip_ws(F.coalesce(F.col("_p.message"), F.lit(""))))
              .withColumn("ctx", F.col("_p.ctx"))
              .withColumn("history", F.coalesce(F.col("_p.history"),
                                                F.array().cast(f"array<{MSG_SCHEMA}>")))
              .withColumns(_refusal(json_col)).drop("_p"))


def _refusal(json_col: str, empty: str = r"^\s*(\{\s*\}|null)?\s*$") -> dict:
    """corrupt, reject_reason and rejected, out of the parsed ``_p``."""
    reason = (F.when(F.col(json_col).isNull() | F.col(json_col).rlike(empty), "NO_PAYLOAD")
              .when(F.col("_p._corrupt").isNotNull(), "MALFORMED"))
    return {"corrupt": F.col("_p._corrupt"), "reject_reason": reason, "rejected": reason.isNotNull()}


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests to triage, refused ones) of ``parse_payloads``; no row is in both."""
    return df.where(~F.col("rejected")), df.where("rejected")


def parse_webhooks(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """{from, message} -> request with from defaulting to 'unknown', a
    fixed ctx {lang 'pt', temperature 0.3} and an empty history.

    A body that is no JSON object never reaches triage: it is kept in ``corrupt`` and
    refused as in S1.  An empty object is a request of an unknown sender."""
    p = F.from_json(F.col(json_col), WEBHOOK_SCHEMA,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ctx = F.struct(F.lit(L.WEBHOOK_CTX_LANG).alias("lang"), F.lit(None).cast("string").alias("model"),
                   F.lit(L.WEBHOOK_CTX_TEMPERATURE).cast("double").alias("temperature"))
    return (df.withColumn("_p", p)
              .withColumn("sender", F.coalesce(F.col("_p.from"), F.lit(L.WEBHOOK_DEFAULT_SENDER)))
              .withColumn("message", T.strip_ws(F.coalesce(F.col("_p.message"), F.lit(""))))
              .withColumn("ctx", ctx)
              .withColumn("history", F.array().cast(f"array<{MSG_SCHEMA}>"))
              .withColumns(_refusal(json_col, r"^\s*(null)?\s*$")).drop("_p"))


def split_empty(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (accepted, quarantined).  A blank message yields the EMPTY_INPUT
    error row with the apology reply; both sides come from one scan."""
    blank = F.col("message") == ""
    reply = F.struct(F.array(F.struct(F.lit("assistant").alias("role"),
                                      F.lit(L.EMPTY_INPUT_REPLY).alias("content"))).alias("messages"))
    bad = (df.where(blank).withColumn("error", F.lit(L.EMPTY_INPUT_ERROR))
             .withColumn("reply", reply))
    return df.where(~blank), bad


#: Payloads that a service refuses, by a number from 0 (fixed values of the test relation).
REFUSED = ['{"message": "oi", bad', None, "{}", "{ }", "null", "  ", '"texto"']


def with_refused(payloads: DataFrame) -> DataFrame:
    """``payloads`` with the text of every tenth message id, and of the six after it,
    replaced by one of ``REFUSED``."""
    place = F.pmod(F.col("msg_id"), F.lit(10))
    body = F.col("payload")
    for i, text in enumerate(REFUSED):
        body = F.when(place == i, F.lit(text)).otherwise(body)
    return payloads.withColumn("payload", body)


def stream_payloads(ms: DataFrame) -> DataFrame:
    """Request JSON for every row of the message stream: 'view' events omit
    the message, ctx varies with the event type, 'error' events carry a
    five-item history with one invalid item."""
    et = F.col("event_type")
    ctx = F.struct(
        F.when(et == "click", F.lit("en")).when(et == "purchase", F.lit("")).alias("lang"),
        F.when(et == "purchase", F.lit("gpt-4o-mini")).alias("model"),
        F.when(et.isin("click", "error"), F.col("latency_ms") / 20).alias("temperature"))

    def m(role, content):
        return F.struct(F.lit(role).cast("string").alias("role"), F.lit(content).alias("content"))
    hist = F.when(et == "error", F.array(m("user", "oi"), m("assistant", "Olá!"),
                                         m(None, "sem papel"), m("user", "tudo bem?"),
                                         m("assistant", "Tudo certo.")))
    body = F.struct(F.when(et != "view", F.col("message")).alias("message"), ctx.alias("ctx"),
                    hist.alias("history"))
    return ms.select("msg_id", "sender", "ts", "event_type", "latency_ms", "expected",
                     F.to_json(body).alias("payload"))


def stream_webhooks(ms: DataFrame) -> DataFrame:
    et = F.col("event_type")
    body = F.struct(F.when(et != "view", F.col("sender").cast("string")).alias("from"),
                    F.col("message").alias("message"))
    return ms.select("msg_id", "ts", "event_type", F.to_json(body).alias("payload"))
