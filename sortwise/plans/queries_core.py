"""Classification, scope and text-feature queries (C*, D*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import classify as C
from ..operators import scopes as D
from ..operators.triage import triage
from ..sources import tables as TB
from ..sources.variants import literals
from . import sqlgen as S
from .catalog import register

RSEP = " | "


def _flat(df, *extra):
    return df.select(F.col("msg_id").cast("bigint").alias("msg_id"), "rule_id", "bucket",
                     F.array_join("reasons", RSEP).alias("reasons"),
                     F.array_join("scope", ",").alias("scope"),
                     F.col("reclassified").cast("int").alias("reclassified"), *extra)


def _flat_sql(src: str, *extra: str, extra_forms: dict[str, str] | None = None) -> str:
    ex = "".join(", " + e for e in extra)
    return (f"WITH {S.triage_ctes(src, extra_forms)} SELECT CAST(msg_id AS BIGINT) AS msg_id, rule_id, bucket, "
            f"array_to_string(reasons, '{RSEP}') AS reasons, array_to_string(scope, ',') AS scope, "
            f"CAST(reclassified AS INTEGER) AS reclassified{ex} FROM fin")


# C1 ------------------------------------------------------------------------
@register("classify_stream", "C1", f"""WITH {S.features_cte(S.msg_stream_sql())},
r1 AS (SELECT *, {S.rule_case()} AS rule_id FROM feat)
SELECT CAST(msg_id AS BIGINT) AS msg_id, rule_id, {S.bucket_case()} AS bucket,
       {S.reason_case()} AS reason FROM r1""")
def classify_stream(spark, sf):
    out = C.classify(TB.msg_stream(spark, sf))
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"), "rule_id", "bucket", "reason")


# C1+D1+C4 --------------------------------------------------------------------
@register("triage_stream", "C1,D1,C4", _flat_sql(S.msg_stream_sql(), "expected"))
def triage_stream(spark, sf):
    return _flat(triage(TB.msg_stream(spark, sf)), "expected")


@register("triage_conversations", "C1,D1,C4", _flat_sql(S.msg_conv_sql()))
def triage_conversations(spark, sf):
    return _flat(triage(TB.msg_conv(spark, sf)))


@register("triage_documents", "C1,D1,C4", _flat_sql(S.msg_docs_sql()))
def triage_documents(spark, sf):
    return _flat(triage(TB.msg_docs(spark, sf)))


# C2 ------------------------------------------------------------------------
def _evidence_sql(src):
    arr = "[" + ", ".join(f"CASE WHEN {cond} THEN '{rid}' END" for rid, cond in S.rule_conditions()) + "]"
    return (f"WITH {S.features_cte(src)} SELECT CAST(msg_id AS BIGINT) AS msg_id, "
            f"array_to_string(list_filter({arr}, lambda x: x IS NOT NULL), ',') AS matched_rules FROM feat")


@register("rule_evidence", "C2", _evidence_sql(S.msg_stream_sql()))
def rule_evidence(spark, sf):
    ev = C.evidence(TB.msg_stream(spark, sf))
    return ev.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                     F.array_join("matched_rules", ",").alias("matched_rules"))


# C3 ------------------------------------------------------------------------
def _shadow_sql(src):
    arr = "[" + ", ".join(f"CASE WHEN {cond} THEN '{rid}' END" for rid, cond in S.rule_conditions()) + "]"
    return f"""WITH {S.features_cte(src)},
ev AS (SELECT msg_id, list_filter({arr}, lambda x: x IS NOT NULL) AS hits FROM feat),
m AS (SELECT UNNEST(hits) AS rule_id FROM ev),
w AS (SELECT hits[1] AS rule_id FROM ev),
mc AS (SELECT rule_id, count(*) AS matches FROM m GROUP BY rule_id),
wc AS (SELECT rule_id, count(*) AS wins FROM w GROUP BY rule_id)
SELECT mc.rule_id, CAST(mc.matches AS BIGINT) AS matches, CAST(coalesce(wc.wins, 0) AS BIGINT) AS wins,
       CAST(mc.matches - coalesce(wc.wins, 0) AS BIGINT) AS shadowed
FROM mc LEFT JOIN wc USING (rule_id)"""


def shadowing(ev):
    """Per rule, how many messages satisfy it and how many it wins (the
    first satisfied rule wins).  One pass: positions of the matched rules,
    position 0 being the winner; partial aggregation before the shuffle, which
    then carries at most 43 rows per partition."""
    e = (ev.select(F.posexplode_outer("matched_rules").alias("pos", "rule_id"))
           .where(F.col("rule_id").isNotNull()))
    c = e.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"),
                                 F.sum((F.col("pos") == 0).cast("int")).alias("wins"))
    return c.select("rule_id", F.col("matches").cast("bigint").alias("matches"),
                    F.col("wins").cast("bigint").alias("wins"),
                    (F.col("matches") - F.col("wins")).cast("bigint").alias("shadowed"))


@register("rule_shadowing", "C3", _shadow_sql(S.msg_stream_sql()))
def rule_shadowing(spark, sf):
    return shadowing(C.evidence(TB.msg_stream(spark, sf)))


@register("rule_shadowing_documents", "C3", _shadow_sql(S.msg_docs_sql()))
def rule_shadowing_documents(spark, sf):
    return shadowing(C.evidence(TB.msg_docs(spark, sf)))


# D1 / D2 ---------------------------------------------------------------------
_SCOPE_ALL_SQL = (f"WITH {S.features_cte(S.msg_stream_sql())} SELECT CAST(msg_id AS BIGINT) AS msg_id, "
                  f"array_to_string({S.scopes_sql()}, ',') AS scope FROM feat")


@register("scopes_stream", "D1", _SCOPE_ALL_SQL)
def scopes_stream(spark, sf):
    df = C.prepare(TB.msg_stream(spark, sf), C.default_lexicon())
    return df.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                     F.array_join(D.norm_scopes(), ",").alias("scope"))


@register("scopes_conversations", "D1",
          f"WITH {S.features_cte(S.msg_conv_sql())} SELECT CAST(msg_id AS BIGINT) AS msg_id, "
          f"array_to_string({S.scopes_sql()}, ',') AS scope FROM feat")
def scopes_conversations(spark, sf):
    df = C.prepare(TB.msg_conv(spark, sf), C.default_lexicon())
    return df.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                     F.array_join(D.norm_scopes(), ",").alias("scope"))


@register("scope_demand", "D2", f"""WITH {S.triage_ctes(S.msg_stream_sql())},
e AS (SELECT UNNEST(scope) AS scope FROM fin)
SELECT scope, CAST(count(*) AS BIGINT) AS n_messages FROM e GROUP BY scope""")
def scope_demand(spark, sf):
    d = D.scope_demand(triage(TB.msg_stream(spark, sf)))
    return d.select("scope", F.col("n_messages").cast("bigint").alias("n_messages"))


@register("scope_demand_all", "D2", f"""WITH {S.features_cte(S.msg_stream_sql())},
e AS (SELECT UNNEST({S.scopes_sql()}) AS scope FROM feat)
SELECT scope, CAST(count(*) AS BIGINT) AS n_messages FROM e GROUP BY scope""")
def scope_demand_all(spark, sf):
    df = C.prepare(TB.msg_stream(spark, sf), C.default_lexicon())
    d = D.scope_demand(df.withColumn("scope", D.norm_scopes()))
    return d.select("scope", F.col("n_messages").cast("bigint").alias("n_messages"))


# J10 -----------------------------------------------------------------------
def _first_pattern_sql(src, patterns=L.SCOPE_PATTERNS):
    pats = ", ".join(f"({i}, {S.q(p)}, {S.list_lit(s)})" for i, (p, s) in enumerate(patterns))
    return f"""WITH {S.features_cte(src)},
pt AS (SELECT * FROM (VALUES {pats}) AS t(prio, pattern, scopes)),
pr AS (SELECT feat.msg_id, pt.prio, pt.pattern, pt.scopes FROM feat JOIN pt ON contains(feat.norm, pt.pattern)),
best AS (SELECT msg_id, arg_min(pattern, prio) AS pattern, arg_min(scopes, prio) AS scopes FROM pr GROUP BY msg_id)
SELECT CAST(msg_id AS BIGINT) AS msg_id, pattern, array_to_string(scopes, ',') AS scopes FROM best"""


@register("first_scope_pattern", "J10", _first_pattern_sql(S.msg_stream_sql()))
def first_scope_pattern(spark, sf):
    df = C.prepare(TB.msg_stream(spark, sf), C.default_lexicon())
    out = D.first_pattern_join(df, D.scope_pattern_table(spark))
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"), "pattern",
                      F.array_join("scopes", ",").alias("scopes"))


_SCOPES_OF = dict(L.SCOPE_PATTERNS)
_ALL_PATTERNS = [(x, _SCOPES_OF.get(x, [])) for x in sorted(literals())]


@register("first_literal_variants", "J10", _first_pattern_sql(S.msg_variants_sql(), _ALL_PATTERNS))
def first_literal_variants(spark, sf):
    """J10 with every literal of every list as a pattern, in alphabetical order."""
    df = C.prepare(TB.msg_variants(spark, sf), C.default_lexicon())
    out = D.first_pattern_join(df, D.scope_pattern_table(spark, _ALL_PATTERNS))
    return out.select(F.col("msg_id").cast("bigint").alias("msg_id"), "pattern",
                      F.array_join("scopes", ",").alias("scopes"))


# P1 / P2 / P3 ----------------------------------------------------------------
def _text_sql(src):
    return (f"WITH {S.features_cte(src)} SELECT CAST(msg_id AS BIGINT) AS msg_id, "
            f"md5(norm) AS msg_key, CAST(length(m) AS BIGINT) AS n_chars, "
            f"CAST(nw AS BIGINT) AS n_words, CAST(length(norm) AS BIGINT) AS norm_chars FROM feat")


def _text_features(df):
    p = C.prepare(df, C.default_lexicon())
    return p.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                    F.md5(F.col("norm")).alias("msg_key"),
                    F.length("message").cast("bigint").alias("n_chars"),
                    T.n_words(F.col("norm")).cast("bigint").alias("n_words"),
                    F.length("norm").cast("bigint").alias("norm_chars"))


@register("text_features_documents", "P1,P2,P3", _text_sql(S.msg_docs_sql()))
def text_features_documents(spark, sf):
    return _text_features(TB.msg_docs(spark, sf))


@register("text_features_conversations", "P1,P2,P3", _text_sql(S.msg_conv_sql()))
def text_features_conversations(spark, sf):
    return _text_features(TB.msg_conv(spark, sf))


@register("normalized_text_conversations", "P1",
          f"SELECT conv_id * 1000000 + turn AS msg_id, {S.norm('text')} AS norm FROM conversations")
def normalized_text_conversations(spark, sf):
    c = TB.read(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("msg_id"),
                    T.normalize(F.col("text")).alias("norm"))


# P4 / P5 / P6 / P8 / P9 ----------------------------------------------------------
def _cue_sql(src):
    marks = "(length(m) - length(regexp_replace(m, '[.?!;]', '', 'g')))"
    pieces = f"({S.nonblank('m', '.')} + {S.nonblank('m', '?')} + {S.nonblank('m', '!')})"
    return (f"WITH {S.features_cte(src)} SELECT CAST(msg_id AS BIGINT) AS msg_id, "
            f"{S.language_sql('m')} AS lang_tag, CAST({marks} AS BIGINT) AS n_marks, "
            f"CAST({pieces} AS BIGINT) AS n_pieces, "
            f"CAST({S.word_re('norm', L.FACTUAL_TERMS)} AS INTEGER) AS factual, "
            f"CAST({S.word_re('m', L.PERSONAL_REFERENCES)} AS INTEGER) AS personal, "
            f"CAST({S.word_re('m', L.PLAN_TERMS)} AS INTEGER) AS plan, "
            f"CAST({S.question_sql('m')} AS INTEGER) AS question, "
            f"CAST(({S.anyc('norm', L.NARRATIVE_SUBJECTS)} AND {S.anyc('norm', L.NARRATIVE_PAST)}) AS INTEGER) AS narrative "
            f"FROM feat")


def _cues(df):
    p = C.prepare(df, C.default_lexicon())
    o, n = F.col("message"), F.col("norm")
    return p.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                    T.language(o).alias("lang_tag"),
                    T.sentence_marks(o).cast("bigint").alias("n_marks"),
                    T.piece_sum(o).cast("bigint").alias("n_pieces"),
                    T.factual_cue(n).cast("int").alias("factual"),
                    T.personal_cue(o).cast("int").alias("personal"),
                    T.plan_cue(o).cast("int").alias("plan"),
                    T.is_question(o).cast("int").alias("question"),
                    T.narrative(n).cast("int").alias("narrative"))


@register("text_cues_documents", "P4,P5,P6,P8,P9", _cue_sql(S.msg_docs_sql()))
def text_cues_documents(spark, sf):
    return _cues(TB.msg_docs(spark, sf))


@register("text_cues_conversations", "P4,P5,P6,P8,P9", _cue_sql(S.msg_conv_sql()))
def text_cues_conversations(spark, sf):
    return _cues(TB.msg_conv(spark, sf))


@register("text_cues_stream", "P4,P5,P6,P8,P9", _cue_sql(S.msg_stream_sql()))
def text_cues_stream(spark, sf):
    return _cues(TB.msg_stream(spark, sf))


# P7 / P10 --------------------------------------------------------------------
def _flag_lists():
    return [("f_objects", L.INTEGRATION_OBJECTS), ("f_email", L.EMAIL_CONTEXTS),
            ("f_share", L.SHARE_CONTEXTS), ("f_schedule", L.SCHEDULE_CONTEXTS),
            ("f_cancel", L.CANCEL_CONTEXTS), ("f_exclusions", L.INTEGRATION_EXCLUSIONS),
            ("f_keywords", L.SYSTEM_KEYWORDS)]


def _flags_sql(src):
    cols = ", ".join(f"CAST({S.anyc('norm', lits)} AS INTEGER) AS {name}" for name, lits in _flag_lists())
    return (f"WITH {S.features_cte(src)} SELECT CAST(msg_id AS BIGINT) AS msg_id, {cols}, "
            f"CAST({S.intent_sql()} AS INTEGER) AS intent FROM feat")


def _flags(df):
    lex = C.default_lexicon()
    p = C.with_literals(C.prepare(df, lex), lex)
    f = C.Features(lex)
    return p.select(F.col("msg_id").cast("bigint").alias("msg_id"),
                    *[T.has_any(f.n, lits).cast("int").alias(name)
                      for name, lits in _flag_lists()],
                    f.integration_intent().cast("int").alias("intent"))


@register("lexicon_flags_documents", "P7,P10", _flags_sql(S.msg_docs_sql()))
def lexicon_flags_documents(spark, sf):
    return _flags(TB.msg_docs(spark, sf))


@register("lexicon_flags_stream", "P7,P10", _flags_sql(S.msg_stream_sql()))
def lexicon_flags_stream(spark, sf):
    return _flags(TB.msg_stream(spark, sf))
