"""Registered queries against their DuckDB oracles on the smallest scale."""
import hashlib

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF_SMALL

FAST = ["triage_stream", "triage_conversations", "rule_shadowing", "scopes_stream",
        "scope_demand_all", "first_scope_pattern", "text_cues_stream", "lexicon_flags_stream",
        "classify_distinct_stream", "ttl_hits_stream", "service_summary", "confusion_matrix",
        "quality_gate", "first_errors", "reason_top10", "tokens_conversations",
        "lemmatised_tokens_stream", "action_verbs_stream", "ingest_payloads", "ingest_webhooks",
        "quarantine_split", "generation_params_stream", "assembled_payloads_stream",
        "history_from_conversations", "event_log_stream", "stream_triage",
        "triage_lexicon_stream", "normalized_text_variants", "scopes_lexicon_stream",
        "classify_distinct_variants", "triage_stream_extended", "triage_conversations_joined",
        "ingest_rejected", "live_keys_stream", "keyword_hits_documents", "service_rollup",
        "stream_ttl_hits", "stream_hourly_metrics", "stream_learned_candidates"]


def _digest(rows):
    def val(v):
        return repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return sorted(hashlib.md5("|".join(val(x) for x in r).encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert sorted(dcols) == cols
    assert len(srows) == len(drows)
    assert _digest(srows) == _digest(drows)


def test_every_query_has_a_builder_and_most_have_oracles():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 55
    from sortwise.plans.catalog import REGISTRY
    # every query of the triage operators has an SQL oracle, but for two whose rows are not fixed
    assert set(REGISTRY) - set(o) == {"stream_ttl_approximate", "stage_quantiles"}


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "bucket" in df.columns
