"""Token, duplicate, payload, ingest and report queries (J*, K*, B*, S*, A*)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.lemma import Lexicon
from ..operators import classify as C
from ..operators import dedupe as K
from ..operators import payload as B
from ..operators import reports as A
from ..operators import scopes as D
from ..operators import tokens as J
from ..operators.triage import triage
from ..session import ensure_checkpoint_dir
from ..sources import lexicon_io as LX
from ..sources import payloads as SP
from ..sources import sinks as SK
from ..sources import tables as TB
from . import sqlgen as S
from .catalog import register
from .queries_core import _flat, _flat_sql

q = S.q


# ---------------------------------------------------------------------------
# shared relations
# ---------------------------------------------------------------------------
def prepared_stream(spark, sf):
    return C.prepare(TB.msg_stream(spark, sf), C.default_lexicon())


def request_log(spark, sf):
    """msg_stream + key + is_error + is_hit (K2 over the requests that reached
    the cache; errored requests never did)."""
    p = prepared_stream(spark, sf).withColumn("msg_key", K.message_key()) \
        .withColumn("is_error", F.col("event_type") == "error")
    ok = K.ttl_hits(p.where(~F.col("is_error")))
    bad = p.where(F.col("is_error")).withColumn("is_hit", F.lit(None).cast("boolean"))
    return ok.unionByName(bad)


def _ttl_sql(src_where: str = "") -> str:
    return f"""WITH RECURSIVE {S.features_cte(S.msg_stream_sql())},
kb AS (SELECT msg_id, sender, ts, event_type, latency_ms, md5(norm) AS msg_key FROM feat),
ev AS (SELECT msg_key, msg_id, ts, row_number() OVER (PARTITION BY msg_key ORDER BY ts, msg_id) AS rn
       FROM kb {src_where}),
r AS (SELECT msg_key, rn, msg_id, ts AS last_miss, false AS is_hit FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.msg_key, e.rn, e.msg_id,
             CASE WHEN e.ts < r.last_miss + INTERVAL 3600 SECOND THEN r.last_miss ELSE e.ts END,
             e.ts < r.last_miss + INTERVAL 3600 SECOND
      FROM r JOIN ev e ON e.msg_key = r.msg_key AND e.rn = r.rn + 1),
hits AS (SELECT msg_id, msg_key, is_hit FROM r),
rl AS (SELECT kb.*, (kb.event_type = 'error') AS is_error, hits.is_hit FROM kb LEFT JOIN hits ON kb.msg_id = hits.msg_id)"""


# ---------------------------------------------------------------------------
# K1 / K2 / K3
# ---------------------------------------------------------------------------
@register("classify_distinct_stream", "K1,P2", f"""WITH {S.features_cte(S.msg_stream_sql())},
r1 AS (SELECT *, {S.rule_case()} AS rule_id FROM feat)
SELECT CAST(msg_id AS BIGINT) AS msg_id, md5(norm) AS msg_key, rule_id, {S.bucket_case()} AS bucket FROM r1""")
def classify_distinct_stream(spark, sf):
    ms = TB.msg_stream(spark, sf)
    return _distinct(ms)


def _distinct(ms):
    out = K.classify_distinct(ms, lambda d: C.classify(d).select("msg_key", "rule_id", "bucket"), K.text_key)
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"), "msg_key", "rule_id", "bucket")


def _first_requester_sql(src: str) -> str:
    """One row per key: the first request's message, under the key's first msg_id."""
    return (f"SELECT arg_min(msg_id, (ts, msg_id)) AS msg_id, arg_min(message, (ts, msg_id)) AS message, k AS msg_key "
            f"FROM (SELECT *, md5({S.norm(S.strip('message'))}) AS k FROM ({src})) GROUP BY k")


@register("classify_distinct_variants", "K1,P1,P2", f"""WITH {S.features_cte(_first_requester_sql(S.msg_variants_sql()))},
r1 AS (SELECT *, {S.rule_case()} AS rule_id FROM feat),
v AS (SELECT msg_key, rule_id, {S.bucket_case()} AS bucket FROM r1),
m AS (SELECT msg_id, md5({S.norm(S.strip('message'))}) AS msg_key FROM ({S.msg_variants_sql()}))
SELECT CAST(m.msg_id AS BIGINT) AS msg_id, m.msg_key, rule_id, bucket FROM m JOIN v USING (msg_key)""")
def classify_distinct_variants(spark, sf):
    return _distinct(TB.msg_variants(spark, sf))


@register("triage_lexicon_stream", "C1,D1,C4,P1", _flat_sql(S.msg_variants_sql()))
def triage_lexicon_stream(spark, sf):
    return _flat(triage(TB.msg_variants(spark, sf)))


@register("scopes_lexicon_stream", "D1,P1", f"""WITH {S.features_cte(S.msg_variants_sql())}
SELECT CAST(msg_id AS BIGINT) AS msg_id, array_to_string({S.scopes_sql()}, ',') AS scope FROM feat""")
def scopes_lexicon_stream(spark, sf):
    df = C.prepare(TB.msg_variants(spark, sf), C.default_lexicon())
    return df.select(F.col("msg_id").cast("bigint").alias("msg_id"), F.array_join(D.norm_scopes(), ",").alias("scope"))


@register("normalized_text_variants", "P1", f"""SELECT CAST(msg_id AS BIGINT) AS msg_id,
  {S.norm(S.strip('message'))} AS norm FROM ({S.msg_variants_sql()})""")
def normalized_text_variants(spark, sf):
    df = C.prepare(TB.msg_variants(spark, sf), C.default_lexicon())
    return df.select(F.col("msg_id").cast("bigint").alias("msg_id"), "norm")


#: J7 additions of the extended lexicon (form, lemma).
ADDED_FORMS = [("abcd", "enviar"), ("planilha", "tabelar"), ("resumo", "criar"), ("hoje", "agendar")]


@register("triage_stream_extended", "C1,J7", _flat_sql(S.msg_stream_sql(), extra_forms=dict(ADDED_FORMS)))
def triage_stream_extended(spark, sf):
    """C1 with a lexicon that J7 has extended."""
    add = spark.createDataFrame([(i, f, lm) for i, (f, lm) in enumerate(ADDED_FORMS)], "pos int, form string, lemma string")
    table = J.extend_static(LX.verb_forms_df(spark), add).orderBy("pos")
    lex = Lexicon(static={r.form: r.lemma for r in table.collect()}, learned=LX.shipped_learned_map())
    return _flat(triage(TB.msg_stream(spark, sf), lex))


@register("triage_conversations_joined", "C1,J2", _flat_sql(S.msg_conv_sql()))
def triage_conversations_joined(spark, sf):
    """C1 over lemmas that come from lexicon tables by joins."""
    lex = C.default_lexicon()
    p = C.prepare(TB.msg_conv(spark, sf), lex).drop("tokens", "lemmas")
    p = J.lemmatise_messages(p, LX.verb_forms_df(spark), LX.read_learned(spark))
    return _flat(C.reclassify(D.with_scopes(C.classify(p, lex, prepared=True))))


@register("live_keys_stream", "A1,K2", _ttl_sql("WHERE event_type <> 'error'") + """,
ms AS (SELECT msg_key, max(ts) FILTER (WHERE NOT is_hit) AS miss FROM rl WHERE NOT is_error GROUP BY msg_key),
e AS (SELECT max(ts) AS t FROM rl WHERE NOT is_error)
SELECT CAST(count(*) AS BIGINT) AS live_keys FROM ms, e WHERE miss + INTERVAL 3600 SECOND > t""")
def live_keys_stream(spark, sf):
    return A.live_keys(request_log(spark, sf).where(~F.col("is_error")), L.CACHE_TTL_SECONDS)


def _refused_case(column: str) -> str:
    rows = ["NULL" if t is None else q(t) for t in SP.REFUSED]
    return "CASE " + " ".join(f"WHEN msg_id % 10 = {i} THEN {t}" for i, t in enumerate(rows)) + f" ELSE {column} END"


@register("ingest_rejected", "S1,S3", f"""WITH m AS ({S.msg_stream_sql()}),
p AS (SELECT msg_id, msg_id % 10 < {len(SP.REFUSED)} AS swapped, {_refused_case("'kept'")} AS payload FROM m)
SELECT CAST(msg_id AS BIGINT) AS msg_id,
  CASE WHEN NOT swapped THEN 'OK'
       WHEN payload IS NULL OR regexp_matches(payload, '^\\s*(\\{{\\s*\\}}|null)?\\s*$') THEN 'NO_PAYLOAD'
       ELSE 'MALFORMED' END AS status,
  CASE WHEN swapped AND payload NOT IN ('{{}}', '{{ }}', 'null', '  ') THEN payload END AS corrupt FROM p""")
def ingest_rejected(spark, sf):
    p = SP.parse_payloads(SP.with_refused(SP.stream_payloads(TB.msg_stream(spark, sf))))
    ok, bad = SP.split_rejected(p)
    kept = ok.select(F.col("msg_id").cast("bigint").alias("msg_id"), F.lit("OK").alias("status"),
                     F.lit(None).cast("string").alias("corrupt"))
    return kept.unionByName(bad.select(
        F.col("msg_id").cast("bigint").alias("msg_id"), F.col("reject_reason").alias("status"),
        F.when(F.col("reject_reason") == "MALFORMED", F.col("corrupt")).alias("corrupt")))


@register("ttl_hits_stream", "K2", _ttl_sql() + """
SELECT CAST(msg_id AS BIGINT) AS msg_id, msg_key, CAST(is_hit AS INTEGER) AS is_hit FROM hits""")
def ttl_hits_stream(spark, sf):
    p = prepared_stream(spark, sf).withColumn("msg_key", K.message_key())
    out = K.ttl_hits(p.select("msg_id", "ts", "msg_key"))
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"), "msg_key",
                      F.col("is_hit").cast("int").alias("is_hit"))


@register("hit_rate_hourly", "K3", _ttl_sql() + """
SELECT date_trunc('hour', kb.ts) AS hour, CAST(count(*) AS BIGINT) AS requests,
       CAST(sum(CAST(hits.is_hit AS INTEGER)) AS BIGINT) AS hits,
       round(sum(CAST(hits.is_hit AS INTEGER)) / count(*) * 100, 2) AS hit_rate_pct
FROM kb JOIN hits USING (msg_id) GROUP BY 1""")
def hit_rate_hourly(spark, sf):
    p = prepared_stream(spark, sf).withColumn("msg_key", K.message_key())
    out = K.hit_rate_by_hour(K.ttl_hits(p.select("msg_id", "ts", "msg_key")))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"),
                      F.col("requests").cast("bigint").alias("requests"),
                      F.col("hits").cast("bigint").alias("hits"), "hit_rate_pct")


@register("hit_rate_by_key", "K3", _ttl_sql() + """
SELECT kb.msg_key, CAST(count(*) AS BIGINT) AS requests,
       CAST(sum(CAST(hits.is_hit AS INTEGER)) AS BIGINT) AS hits,
       round(sum(CAST(hits.is_hit AS INTEGER)) / count(*) * 100, 2) AS hit_rate_pct
FROM kb JOIN hits USING (msg_id) GROUP BY 1""")
def hit_rate_by_key(spark, sf):
    p = prepared_stream(spark, sf).withColumn("msg_key", K.message_key())
    return K.hit_rate_by_key(K.ttl_hits(p.select("msg_id", "ts", "msg_key")))


# ---------------------------------------------------------------------------
# A1 / A2 / A3
# ---------------------------------------------------------------------------
def _summary_sql(group: str = "") -> str:
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return _ttl_sql("WHERE event_type <> 'error'") + f"""
SELECT {sel}CAST(count(*) AS BIGINT) AS total_requests,
  CAST(sum(CASE WHEN NOT is_error AND is_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits,
  CAST(sum(CASE WHEN NOT is_error AND NOT is_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_misses,
  round(sum(CASE WHEN NOT is_error AND is_hit THEN 1 ELSE 0 END) / count(*) * 100, 2) AS cache_hit_rate_percent,
  ((2 * sum(CASE WHEN NOT is_error THEN CAST(round(latency_ms * 1000000) AS BIGINT) ELSE 0 END) + 10000 * count(*))
    // (20000 * count(*))) / 100 AS avg_latency_ms,
  CAST(sum(CAST(is_error AS INTEGER)) AS BIGINT) AS error_count,
  round(sum(CAST(is_error AS INTEGER)) / count(*) * 100, 2) AS error_rate_percent
FROM rl {gb}"""


def _summary_cast(df, *g):
    return df.select(*g, *[F.col(c).cast("bigint").alias(c) for c in
                           ("total_requests", "cache_hits", "cache_misses")],
                     "cache_hit_rate_percent", "avg_latency_ms",
                     F.col("error_count").cast("bigint").alias("error_count"), "error_rate_percent")


@register("service_summary", "A1", _summary_sql())
def service_summary(spark, sf):
    return _summary_cast(A.service_summary(request_log(spark, sf)))


@register("service_summary_by_sender", "A2", _summary_sql("sender"))
def service_summary_by_sender(spark, sf):
    return _summary_cast(A.service_summary(request_log(spark, sf).withColumn(
        "sender", F.col("sender")), "sender"), "sender")


@register("service_rollup", "A2", _ttl_sql("WHERE event_type <> 'error'") + """,
rl2 AS (SELECT *, CAST(ts AS DATE) AS day FROM rl)
SELECT event_type, day, CAST(grouping(event_type, day) AS BIGINT) AS level,
  CAST(count(*) AS BIGINT) AS total_requests,
  CAST(sum(CASE WHEN NOT is_error AND is_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits,
  round(sum(CASE WHEN NOT is_error AND is_hit THEN 1 ELSE 0 END) / count(*) * 100, 2) AS cache_hit_rate_percent,
  ((2 * sum(CASE WHEN NOT is_error THEN CAST(round(latency_ms * 1000000) AS BIGINT) ELSE 0 END) + 10000 * count(*))
    // (20000 * count(*))) / 100 AS avg_latency_ms,
  CAST(sum(CAST(is_error AS INTEGER)) AS BIGINT) AS error_count
FROM rl2 GROUP BY ROLLUP (event_type, day)""")
def service_rollup(spark, sf):
    rl = request_log(spark, sf).withColumn("day", F.to_date("ts"))
    out = A.service_rollup(rl, "event_type", "day")
    return out.select("event_type", "day", F.col("level").cast("bigint").alias("level"),
                      F.col("total_requests").cast("bigint").alias("total_requests"),
                      F.col("cache_hits").cast("bigint").alias("cache_hits"),
                      "cache_hit_rate_percent", "avg_latency_ms",
                      F.col("error_count").cast("bigint").alias("error_count"))


def _stage_sql():
    rows = []
    for st, share in TB.STAGE_SHARES.items():
        cond = "" if st in TB.HIT_STAGES else "WHERE NOT coalesce(is_hit, false)"
        rows.append(f"SELECT '{st}' AS stage, round(latency_ms * {share}, 2) AS ms FROM rl {cond}")
    rows.append("SELECT 'total_ms' AS stage, round(latency_ms, 2) AS ms FROM rl")
    return _ttl_sql("WHERE event_type <> 'error'") + f""",
st AS ({' UNION ALL '.join(rows)})
SELECT stage, CAST(count(*) AS BIGINT) AS samples, round(avg(ms), 4) AS avg_ms FROM st GROUP BY stage"""


@register("stage_latency", "A3,S8", _stage_sql())
def stage_latency(spark, sf):
    rl = request_log(spark, sf).withColumn("bucket", F.lit(None).cast("string")) \
        .withColumn("scope", F.array().cast("array<string>")).withColumn("model", F.lit(None).cast("string"))
    out = A.stage_latency(SK.event_log(TB.with_latencies(rl)))
    return out.select("stage", F.col("samples").cast("bigint").alias("samples"), "avg_ms")


@register("stage_quantiles", "A3")
def stage_quantiles(spark, sf):
    """Median and p95 per stage, from hourly sketches.  A sketch draws at random what it
    keeps, so there is no SQL for the values; a test holds their ranks to the bound."""
    return A.stage_quantiles(A.stage_sketches(TB.with_latencies(request_log(spark, sf))))


# ---------------------------------------------------------------------------
# A4 - A8 (evaluation uses the raw cascade verdict, like the reference's
# evaluation script, against the expected final label)
# ---------------------------------------------------------------------------
_CLS = f"""WITH {S.features_cte(S.msg_stream_sql())},
r1 AS (SELECT *, {S.rule_case()} AS rule_id FROM feat),
cl AS MATERIALIZED (SELECT *, {S.bucket_case()} AS bucket FROM r1)"""


@register("bucket_distribution_stream", "A4", f"""WITH {S.triage_ctes(S.msg_stream_sql())},
c AS (SELECT event_type, bucket, count(*) AS n FROM fin GROUP BY 1, 2)
SELECT event_type, bucket, CAST(n AS BIGINT) AS n,
       round(n / sum(n) OVER (PARTITION BY event_type) * 100, 2) AS share_pct FROM c""")
def bucket_distribution_stream(spark, sf):
    out = A.bucket_distribution(triage(TB.msg_stream(spark, sf)), "event_type")
    return out.select("event_type", "bucket", F.col("n").cast("bigint").alias("n"), "share_pct")


@register("bucket_distribution_documents", "A4", f"""WITH {S.triage_ctes(S.msg_docs_sql())},
c AS (SELECT lang, bucket, count(*) AS n FROM fin GROUP BY 1, 2)
SELECT lang, bucket, CAST(n AS BIGINT) AS n,
       round(n / sum(n) OVER (PARTITION BY lang) * 100, 2) AS share_pct FROM c""")
def bucket_distribution_documents(spark, sf):
    out = A.bucket_distribution(triage(TB.msg_docs(spark, sf)), "lang")
    return out.select("lang", "bucket", F.col("n").cast("bigint").alias("n"), "share_pct")


@register("bucket_distribution_labels", "A4", f"""WITH {S.triage_ctes(S.msg_docs_sql())},
lb AS (SELECT fin.bucket, CAST(l.quality AS VARCHAR) || '/' || CAST(l.toxic AS VARCHAR) AS label
       FROM fin JOIN labels l ON fin.msg_id = l.doc_id),
c AS (SELECT label, bucket, count(*) AS n FROM lb GROUP BY 1, 2)
SELECT label, bucket, CAST(n AS BIGINT) AS n,
       round(n / sum(n) OVER (PARTITION BY label) * 100, 2) AS share_pct FROM c""")
def bucket_distribution_labels(spark, sf):
    lab = TB.read(spark, sf, "labels", "doc_id", "quality", "toxic")
    labelled = TB.msg_docs(spark, sf).join(lab, F.col("msg_id") == F.col("doc_id")).withColumn(
        "label", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")))
    out = A.bucket_distribution(triage(labelled), "label")
    return out.select("label", "bucket", F.col("n").cast("bigint").alias("n"), "share_pct")


@register("accuracy_by_class", "A5", _CLS + """
SELECT expected, CAST(sum(CAST(bucket = expected AS INTEGER)) AS BIGINT) AS hits,
       CAST(count(*) AS BIGINT) AS cases,
       round(sum(CAST(bucket = expected AS INTEGER)) / count(*) * 100, 2) AS accuracy_pct
FROM cl GROUP BY expected""")
def accuracy_by_class(spark, sf):
    out = A.accuracy_by_class(C.classify(TB.msg_stream(spark, sf)))
    return out.select("expected", F.col("hits").cast("bigint").alias("hits"),
                      F.col("cases").cast("bigint").alias("cases"), "accuracy_pct")


@register("confusion_matrix", "A6", _CLS + "\nSELECT expected, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE bucket = '{b}') AS BIGINT) AS {b}" for b in L.BUCKETS)
    + " FROM cl GROUP BY expected")
def confusion_matrix(spark, sf):
    out = A.confusion_matrix(C.classify(TB.msg_stream(spark, sf)), L.BUCKETS)
    return out.select("expected", *[F.col(b).cast("bigint").alias(b) for b in L.BUCKETS])


@register("quality_gate", "A7", _CLS + """,
o AS (SELECT sum(CAST(bucket = expected AS INTEGER)) AS hits, count(*) AS cases FROM cl),
p AS (SELECT hits, cases, round(hits / cases * 100, 2) AS pct FROM o)
SELECT CAST(hits AS BIGINT) AS hits, CAST(cases AS BIGINT) AS cases, pct AS accuracy_pct,
  CASE WHEN pct >= 95 THEN 'EXCELENTE' WHEN pct >= 90 THEN 'BOM' WHEN pct >= 80 THEN 'ATENÇÃO'
       ELSE 'CRÍTICO' END AS band, CAST(pct >= 90 AS INTEGER) AS passed FROM p""")
def quality_gate(spark, sf):
    out = A.quality_gate(C.classify(TB.msg_stream(spark, sf)))
    return out.select(F.col("hits").cast("bigint").alias("hits"),
                      F.col("cases").cast("bigint").alias("cases"), "accuracy_pct", "band",
                      F.col("passed").cast("int").alias("passed"))


@register("first_errors", "A8", _CLS + """,
bad AS (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY msg_id) AS err_rank
        FROM cl WHERE bucket <> expected)
SELECT expected, CAST(err_rank AS INTEGER) AS err_rank, CAST(msg_id AS BIGINT) AS msg_id,
       message, bucket FROM bad WHERE err_rank <= 10""")
def first_errors(spark, sf):
    out = A.first_errors(C.classify(TB.msg_stream(spark, sf)))
    return out.select("expected", F.col("err_rank").cast("int").alias("err_rank"),
                      F.col("msg_id").cast("bigint").alias("msg_id"), "message", "bucket")


@register("case_samples", "A8", _CLS + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY msg_id) AS i FROM cl)
SELECT expected, CAST(i AS BIGINT) AS position, CAST(msg_id AS BIGINT) AS msg_id, bucket,
       bucket = expected AS correct FROM numbered WHERE bucket <> expected OR i <= 5 OR i % 20 = 0""")
def case_samples(spark, sf):
    cases = C.classify(TB.msg_stream(spark, sf)).select("expected", F.col("msg_id").cast("bigint").alias("msg_id"), "bucket")
    return A.case_samples(cases).select("expected", "position", "msg_id", "bucket", "correct")


# ---------------------------------------------------------------------------
# Top-k reasons and keywords
# ---------------------------------------------------------------------------
@register("reason_top10", "A11", f"""WITH {S.triage_ctes(S.msg_stream_sql())},
e AS (SELECT UNNEST(reasons) AS reason FROM fin),
c AS (SELECT reason, count(*) AS n FROM e GROUP BY reason)
SELECT reason, CAST(n AS BIGINT) AS n FROM c ORDER BY n DESC, reason LIMIT 10""")
def reason_top10(spark, sf):
    e = T.explode_values(triage(TB.msg_stream(spark, sf)), F.col("reasons"), "reason")
    out = A.top_k(e, "reason", 10)
    return out.select("reason", F.col("n").cast("bigint").alias("n"))


@register("keyword_top10_documents", "A11,J9", f"""WITH {S.features_cte(S.msg_docs_sql())},
e AS (SELECT UNNEST({S.found('norm', L.SYSTEM_KEYWORDS)}) AS keyword FROM feat),
c AS (SELECT keyword, count(*) AS n FROM e GROUP BY keyword)
SELECT keyword, CAST(n AS BIGINT) AS n FROM c ORDER BY n DESC, keyword LIMIT 10""")
def keyword_top10_documents(spark, sf):
    p = C.prepare(TB.msg_docs(spark, sf), C.default_lexicon())
    e = T.explode_values(p, T.found_in_order(F.col("norm"), L.SYSTEM_KEYWORDS), "keyword")
    out = A.top_k(e, "keyword", 10)
    return out.select("keyword", F.col("n").cast("bigint").alias("n"))


@register("keyword_hits_documents", "J9", f"""WITH {S.features_cte(S.msg_docs_sql())},
h AS (SELECT msg_id, {S.found('norm', L.SYSTEM_KEYWORDS)} AS hits FROM feat)
SELECT CAST(msg_id AS BIGINT) AS msg_id, CAST(len(hits) AS INTEGER) AS n_keywords,
       array_to_string(hits[1:6], ', ') AS first_keywords FROM h WHERE len(hits) > 0""")
def keyword_hits_documents(spark, sf):
    p = C.prepare(TB.msg_docs(spark, sf), C.default_lexicon())
    out = J.keyword_hits(p, L.SYSTEM_KEYWORDS)
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                      F.col("n_keywords").cast("int").alias("n_keywords"), "first_keywords")


# ---------------------------------------------------------------------------
# J1 - J5, J6, J12, A10
# ---------------------------------------------------------------------------
def _tok_sql(src):
    return f"""WITH {S.features_cte(src)},
lt AS (SELECT un.msg_id, un.pos, un.tok AS token, vf.lemma AS s_lemma, lf.lemma AS l_lemma
       FROM un LEFT JOIN {S.verb_values()} ON un.tok = vf.form
               LEFT JOIN {S.learned_values()} ON un.tok = lf.form)"""


@register("tokens_conversations", "J1", f"""WITH {S.features_cte(S.msg_conv_sql())}
SELECT CAST(msg_id AS BIGINT) AS msg_id, CAST(pos AS INTEGER) AS pos, tok AS token FROM un""")
def tokens_conversations(spark, sf):
    p = C.prepare(TB.msg_conv(spark, sf), C.default_lexicon())
    out = J.tokenize(p)
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                      F.col("pos").cast("int").alias("pos"), "token")


def _lemmatised(spark, df):
    p = C.prepare(df, C.default_lexicon())
    return J.lemmatise_tokens(J.tokenize(p), LX.verb_forms_df(spark), LX.read_learned(spark))


@register("lemmatised_tokens_stream", "J2", _tok_sql(S.msg_stream_sql()) + """
SELECT CAST(msg_id AS BIGINT) AS msg_id, CAST(pos AS INTEGER) AS pos, token,
  coalesce(s_lemma, l_lemma, token) AS lemma,
  CASE WHEN s_lemma IS NOT NULL THEN 'static' WHEN l_lemma IS NOT NULL THEN 'learned' ELSE 'unknown' END AS source
FROM lt""")
def lemmatised_tokens_stream(spark, sf):
    out = _lemmatised(spark, TB.msg_stream(spark, sf))
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                      F.col("pos").cast("int").alias("pos"), "token", "lemma", "source")


@register("lemma_text_conversations", "J3,J4", f"""WITH {S.features_cte(S.msg_conv_sql())}
SELECT CAST(msg_id AS BIGINT) AS msg_id, lemma_text, array_to_string(verbs, ',') AS verbs,
       CAST(has_verb AS INTEGER) AS has_verb FROM feat""")
def lemma_text_conversations(spark, sf):
    lex = C.default_lexicon()
    p = C.prepare(TB.msg_conv(spark, sf), lex)
    return p.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                    F.array_join("lemmas", " ").alias("lemma_text"),
                    F.array_join(lex.action_verbs(F.col("lemmas")), ",").alias("verbs"),
                    (F.size(lex.action_verbs(F.col("lemmas"))) > 0).cast("int").alias("has_verb"))


@register("action_verbs_stream", "J3,J4", f"""WITH {S.features_cte(S.msg_stream_sql())}
SELECT CAST(msg_id AS BIGINT) AS msg_id, lemma_text, array_to_string(verbs, ',') AS verbs,
       CAST(has_verb AS INTEGER) AS has_verb FROM feat""")
def action_verbs_stream(spark, sf):
    lex = C.default_lexicon()
    p = C.prepare(TB.msg_stream(spark, sf), lex)
    return p.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                    F.array_join("lemmas", " ").alias("lemma_text"),
                    F.array_join(lex.action_verbs(F.col("lemmas")), ",").alias("verbs"),
                    (F.size(lex.action_verbs(F.col("lemmas"))) > 0).cast("int").alias("has_verb"))


@register("unknown_tokens_documents", "J5", _tok_sql(S.msg_docs_sql()) + """
SELECT token, CAST(count(*) AS BIGINT) AS freq FROM lt
WHERE s_lemma IS NULL AND l_lemma IS NULL GROUP BY token""")
def unknown_tokens_documents(spark, sf):
    p = C.prepare(TB.msg_docs(spark, sf), C.default_lexicon())
    out = J.unknown_tokens(J.tokenize(p), LX.verb_forms_df(spark), LX.read_learned(spark))
    return out.select("token", F.col("freq").cast("bigint").alias("freq"))


@register("merged_learned_documents", "J6,S5", _tok_sql(S.msg_docs_sql()) + """,
cand AS (SELECT token AS form, token AS lemma, msg_id AS seen_at FROM lt
         WHERE s_lemma IS NULL AND l_lemma IS NULL AND regexp_matches(token, '^[a-z]+(ar|er|ir)$')),
first AS (SELECT form, arg_min(lemma, seen_at) AS lemma FROM cand GROUP BY form)
SELECT form, lemma FROM """ + S.learned_values() + """
UNION ALL SELECT form, lemma FROM first""")
def merged_learned_documents(spark, sf):
    """Candidates: unknown infinitive-shaped tokens (their own lemma, the
    model-free learner), first document wins; merged after the shipped
    learned lexicon."""
    p = C.prepare(TB.msg_docs(spark, sf), C.default_lexicon())
    unk = J.lemmatise_tokens(J.tokenize(p), LX.verb_forms_df(spark), LX.read_learned(spark)) \
        .where((F.col("source") == "unknown") & F.col("token").rlike("^[a-z]+(ar|er|ir)$"))
    cand = unk.select(F.col("token").alias("form"), F.col("token").alias("lemma"),
                      F.col("msg_id").alias("seen_at"))
    return J.merge_learned(LX.read_learned(spark), cand)


@register("lemma_usage_stream", "J12", _tok_sql(S.msg_stream_sql()) + """,
u AS (SELECT coalesce(s_lemma, l_lemma) AS lemma, token FROM lt WHERE s_lemma IS NOT NULL OR l_lemma IS NOT NULL)
SELECT lemma, CAST(count(DISTINCT token) AS BIGINT) AS n_forms, CAST(count(*) AS BIGINT) AS occurrences
FROM u GROUP BY lemma""")
def lemma_usage_stream(spark, sf):
    lt = _lemmatised(spark, TB.msg_stream(spark, sf)).where(F.col("source") != "unknown")
    out = lt.groupBy("lemma").agg(F.countDistinct("token").alias("n_forms"),
                                  F.count(F.lit(1)).alias("occurrences"))
    return out.select("lemma", F.col("n_forms").cast("bigint").alias("n_forms"),
                      F.col("occurrences").cast("bigint").alias("occurrences"))


@register("lexicon_coverage_documents", "A10", _tok_sql(S.msg_docs_sql()) + """,
lt2 AS (SELECT lt.*, d.source AS src FROM lt JOIN documents d ON lt.msg_id = d.doc_id),
c AS (SELECT src, count(*) AS tokens, sum(CAST(s_lemma IS NOT NULL AS INTEGER)) AS st,
             sum(CAST(s_lemma IS NULL AND l_lemma IS NOT NULL AS INTEGER)) AS le,
             sum(CAST(s_lemma IS NULL AND l_lemma IS NULL AS INTEGER)) AS un FROM lt2 GROUP BY src)
SELECT src AS source, CAST(tokens AS BIGINT) AS tokens, CAST(st AS BIGINT) AS static,
  CAST(le AS BIGINT) AS learned, CAST(un AS BIGINT) AS unknown,
  round(st / tokens * 100, 4) AS static_pct, round(le / tokens * 100, 4) AS learned_pct,
  round(un / tokens * 100, 4) AS unknown_pct FROM c""")
def lexicon_coverage_documents(spark, sf):
    p = C.prepare(TB.msg_docs(spark, sf).withColumnRenamed("source", "doc_source"), C.default_lexicon())
    tok = J.tokenize(p, carry=("doc_source",))
    lt = J.lemmatise_tokens(tok, LX.verb_forms_df(spark), LX.read_learned(spark))
    out = A.lexicon_coverage(lt, "doc_source")
    return out.select(F.col("doc_source").alias("source"),
                      *[F.col(c).cast("bigint").alias(c) for c in ("tokens", "static", "learned", "unknown")],
                      "static_pct", "learned_pct", "unknown_pct")


# ---------------------------------------------------------------------------
# S1 / S2 / S3 / S8 and B1 - B6
# ---------------------------------------------------------------------------
_CTX_SQL = """CASE WHEN event_type = 'click' THEN 'en' WHEN event_type = 'purchase' THEN '' END AS ctx_lang,
  CASE WHEN event_type = 'purchase' THEN 'gpt-4o-mini' END AS ctx_model,
  CASE WHEN event_type IN ('click', 'error') THEN latency_ms / 20 END AS ctx_temperature"""


def _payload_src():
    return ("SELECT msg_id, sender, ts, event_type, latency_ms, expected, "
            "CASE WHEN event_type = 'view' THEN NULL ELSE message END AS message, "
            f"{_CTX_SQL} FROM ({S.msg_stream_sql()})")


def _parsed(spark, sf):
    return SP.parse_payloads(SP.stream_payloads(TB.msg_stream(spark, sf)))


@register("ingest_payloads", "S1", f"""WITH {S.features_cte(_payload_src())}
SELECT CAST(msg_id AS BIGINT) AS msg_id, m AS message, ctx_lang, ctx_model,
  round(ctx_temperature, 6) AS ctx_temperature,
  CAST(CASE WHEN event_type = 'error' THEN 5 ELSE 0 END AS INTEGER) AS n_history FROM feat""")
def ingest_payloads(spark, sf):
    p = _parsed(spark, sf)
    return p.select(F.col("msg_id").cast("bigint").alias("msg_id"), "message",
                    F.col("ctx.lang").alias("ctx_lang"), F.col("ctx.model").alias("ctx_model"),
                    F.round(F.col("ctx.temperature"), 6).alias("ctx_temperature"),
                    F.size("history").cast("int").alias("n_history"))


@register("ingest_webhooks", "S2", f"""WITH src AS ({S.msg_stream_sql()})
SELECT CAST(msg_id AS BIGINT) AS msg_id,
  CASE WHEN event_type = 'view' THEN 'unknown' ELSE CAST(sender AS VARCHAR) END AS sender,
  {S.strip('message')} AS message, 'pt' AS ctx_lang, CAST(0.3 AS DOUBLE) AS ctx_temperature FROM src""")
def ingest_webhooks(spark, sf):
    w = SP.parse_webhooks(SP.stream_webhooks(TB.msg_stream(spark, sf)))
    return w.select(F.col("msg_id").cast("bigint").alias("msg_id"), "sender", "message",
                    F.col("ctx.lang").alias("ctx_lang"),
                    F.col("ctx.temperature").alias("ctx_temperature"))


@register("quarantine_split", "S3", f"""WITH {S.features_cte(S.msg_stream_sql(blank_signups=True))}
SELECT CASE WHEN m = '' THEN 'EMPTY_INPUT' ELSE 'accepted' END AS status,
       CAST(count(*) AS BIGINT) AS n FROM feat GROUP BY 1""")
def quarantine_split(spark, sf):
    ms = C.prepare(TB.msg_stream(spark, sf, blank_signups=True), C.default_lexicon())
    ok, bad = SP.split_empty(ms)
    return (ok.select(F.lit("accepted").alias("status"))
              .unionByName(bad.select(F.col("error").alias("status")))
              .groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("quarantine_errors", "S3", f"""WITH {S.features_cte(S.msg_stream_sql(blank_signups=True))}
SELECT CAST(msg_id AS BIGINT) AS msg_id, 'EMPTY_INPUT' AS error, 'assistant' AS reply_role,
       {q(L.EMPTY_INPUT_REPLY)} AS reply FROM feat WHERE m = ''""")
def quarantine_errors(spark, sf):
    ms = C.prepare(TB.msg_stream(spark, sf, blank_signups=True), C.default_lexicon())
    _, bad = SP.split_empty(ms)
    return bad.select(F.col("msg_id").cast("bigint").alias("msg_id"), "error",
                      F.col("reply.messages")[0]["role"].alias("reply_role"),
                      F.col("reply.messages")[0]["content"].alias("reply"))


def _assembled(spark, sf):
    ok, _ = SP.split_empty(_parsed(spark, sf))
    t = triage(ok)
    return B.assemble(t)


def _payload_sql(select: str) -> str:
    caps = " ".join(f"WHEN bucket = '{b}' THEN {c}" for b, (c, _) in L.GENERATION_PARAMS.items())
    mts = " ".join(f"WHEN bucket = '{b}' THEN {m}" for b, (_, m) in L.GENERATION_PARAMS.items())
    return f"""WITH {S.triage_ctes(_payload_src())},
pl AS (SELECT *, coalesce(nullif(ctx_model, ''), {q(L.DEFAULT_MODEL)}) AS model,
  least(coalesce(CAST(ctx_temperature AS DOUBLE), CAST({L.DEFAULT_TEMPERATURE} AS DOUBLE)),
        CAST(CASE {caps} END AS DOUBLE)) AS temperature,
  CASE {mts} END AS max_tokens,
  coalesce(nullif(ctx_lang, ''), {S.language_sql('m')}) AS lang,
  CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS n_history FROM fin WHERE m <> '')
{select}"""


@register("generation_params_stream", "B1", _payload_sql("""SELECT CAST(msg_id AS BIGINT) AS msg_id,
  bucket, model, round(temperature, 6) AS temperature, CAST(max_tokens AS INTEGER) AS max_tokens FROM pl"""))
def generation_params_stream(spark, sf):
    a = _assembled(spark, sf)
    return a.select(F.col("msg_id").cast("bigint").alias("msg_id"), "bucket",
                    F.col("payload.model").alias("model"),
                    F.round(F.col("payload.temperature"), 6).alias("temperature"),
                    F.col("payload.max_tokens").cast("int").alias("max_tokens"))


@register("system_prompts_stream", "B2,B6", _payload_sql(f"""SELECT CAST(msg_id AS BIGINT) AS msg_id, lang,
  CASE WHEN lang = 'en' THEN {q(L.LANG_PROMPT_EN)} ELSE {q(L.LANG_PROMPT_PT)} END AS lang_prompt,
  CASE WHEN len(scope) > 0 THEN array_to_string(scope, ', ') ELSE {q(L.NO_SCOPES)} END AS apis FROM pl"""))
def system_prompts_stream(spark, sf):
    a = _assembled(spark, sf)
    pre, post = B.BASE_PROMPT.split("{scopes}")
    base = F.col("payload.messages")[1]["content"]
    apis = F.substring(base, len(pre) + 1, F.length(base) - len(pre) - len(post))
    return a.select(F.col("msg_id").cast("bigint").alias("msg_id"), "lang",
                    F.col("payload.messages")[0]["content"].alias("lang_prompt"),
                    apis.alias("apis"))


@register("assembled_payloads_stream", "B3,B5", _payload_sql("""SELECT CAST(msg_id AS BIGINT) AS msg_id,
  CAST(4 + n_history + 1 AS INTEGER) AS n_messages,
  'system,system,system,system' || CASE WHEN n_history = 3 THEN ',assistant,user,assistant' ELSE '' END
    || ',user' AS roles, model, CAST(max_tokens AS INTEGER) AS max_tokens FROM pl"""))
def assembled_payloads_stream(spark, sf):
    a = _assembled(spark, sf)
    return a.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                    F.size("payload.messages").cast("int").alias("n_messages"),
                    F.array_join(F.col("payload.messages.role"), ",").alias("roles"),
                    F.col("payload.model").alias("model"),
                    F.col("payload.max_tokens").cast("int").alias("max_tokens"))


@register("results_replaced", "S7", _payload_sql("""SELECT CAST(msg_id AS BIGINT) AS msg_id, bucket, rule_id,
  m AS message, norm, model FROM pl WHERE bucket <> 'unclear' OR event_type <> 'error'"""))
def results_replaced(spark, sf):
    """All results written by bucket; then ``unclear`` replaced by its requests without an
    error, the other buckets' files untouched; then each bucket read on its own."""
    path = f"{ensure_checkpoint_dir(spark)}/results/{uuid.uuid4().hex}"
    SK.write_results(SK.result_rows(_assembled(spark, sf)), path)
    fine = TB.read(spark, sf, "events", "event_id", "event_type").where(F.col("event_type") != "error")
    kept = SK.read_results(spark, path, "unclear").join(fine, F.col("msg_id") == F.col("event_id"), "left_semi")
    SK.replace_buckets(kept.checkpoint(), path)  # a table of its own: the bucket's old files go
    parts = [SK.read_results(spark, path, bucket).select(
        "msg_id", "bucket", F.col("classification.rule_id").alias("rule_id"), F.col("mensagem_completa").alias("message"),
        F.col("texto_normalizado").alias("norm"), F.col("openaiPayload.model").alias("model")) for bucket in L.BUCKETS]
    return functools.reduce(DataFrame.unionByName, parts)


@register("history_from_conversations", "B4", """WITH w AS (
  SELECT conv_id, turn, role,
    list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roles,
    list(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS keys
  FROM conversations)
SELECT CAST(conv_id * 1000000 + turn AS BIGINT) AS msg_id, CAST(coalesce(len(roles), 0) AS INTEGER) AS n_history,
  coalesce(array_to_string(roles, ','), '') AS roles, coalesce(array_to_string(keys, ','), '') AS content_keys
FROM w WHERE role = 'user'""")
def history_from_conversations(spark, sf):
    c = TB.read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    h = B.history_from_turns(c).where(F.col("role") == "user")
    return h.select((F.col("conv_id") * 1_000_000 + F.col("turn")).cast("bigint").alias("msg_id"),
                    F.size("history").cast("int").alias("n_history"),
                    F.array_join(F.col("history.role"), ",").alias("roles"),
                    F.array_join(F.transform("history", lambda m: F.md5(m["content"])), ",")
                    .alias("content_keys"))


@register("event_log_stream", "S8", f"""WITH {S.triage_ctes(S.msg_stream_sql())}
SELECT CAST(msg_id AS BIGINT) AS msg_id, 'preprocessing_result' AS log_type,
  bucket AS classification_bucket, array_to_string(scope, ',') AS scope_found,
  CAST(length(m) AS INTEGER) AS original_message_length, {q(L.DEFAULT_MODEL)} AS model_used FROM fin""")
def event_log_stream(spark, sf):
    t = triage(TB.msg_stream(spark, sf)).withColumn("model", F.lit(L.DEFAULT_MODEL))
    log = SK.event_log(TB.with_latencies(t))
    return log.select(F.col("msg_id").cast("bigint").alias("msg_id"), "log_type",
                      "classification_bucket", F.array_join("scope_found", ",").alias("scope_found"),
                      F.col("original_message_length").cast("int").alias("original_message_length"),
                      "model_used")
