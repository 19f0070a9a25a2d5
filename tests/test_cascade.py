"""The rule cascade on the phrase table (one phrase per live rule) and the
reference's own unit-test cases."""
import pytest
from pyspark.sql import functions as F

from sortwise.operators import classify as C
from sortwise.operators.scopes import detect_scopes
from sortwise.operators.triage import triage
from sortwise.sources.phrases import PHRASES, phrases_df
from sortwise.functions import lexicon as L


def test_phrase_table(spark):
    out = triage(phrases_df(spark)).select("idx", "rule_id", "bucket").orderBy("idx").collect()
    got = {r.idx: (r.rule_id, r.bucket) for r in out}
    for idx, rule, _msg, _bucket, final in PHRASES:
        assert got[idx] == (rule, final), (idx, got[idx])


def test_cascade_verdict_before_reclassification(spark):
    out = C.classify(phrases_df(spark)).select("idx", "bucket").collect()
    got = {r.idx: r.bucket for r in out}
    for idx, _rule, _msg, bucket, _final in PHRASES:
        assert got[idx] == bucket


def _classify(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, message string")
    return {r.msg_id: r for r in triage(df).collect()}


def test_reference_unit_cases(spark):
    long_msg = ("Gostaria muito de aprender mais sobre inteligência artificial. "
                "Você poderia me ajudar a entender melhor os conceitos fundamentais "
                "e como posso aplicar isso na minha vida profissional?")
    r = _classify(spark, ["Enviar email para joão", "Que dia é hoje?", long_msg])
    assert r[0].bucket == "system" and L.MAIL in r[0].scope
    assert r[1].bucket == "messages"
    assert r[2].bucket == "user"


@pytest.mark.parametrize("text,expected", [
    ("enviar email", [L.MAIL]),
    ("agendar reuniao", [L.CALENDAR]),
    ("criar planilha", [L.SHEETS, L.DRIVE]),
    ("verificar agenda", [L.CALENDAR_RO]),
    ("gerar pix", [L.PIX]),
    ("mande um email e tambem marque a reuniao", [L.MAIL, L.CALENDAR]),
    ("envie um email", [L.MAIL]),
    ("uma planilha nova", [L.SHEETS, L.DRIVE]),
    ("um pdf", [L.DRIVE, L.DOCUMENTS]),
    ("boleto", [L.BOLETO]),
    ("oi tudo bem", []),
])
def test_scope_phrases(spark, text, expected):
    got = spark.createDataFrame([(text,)], "norm string").select(
        detect_scopes(F.col("norm")).alias("s")).first().s
    assert list(got) == expected


def test_normalisation(spark):
    from sortwise.functions.text import normalize
    rows = [("Olá Mundo", "ola mundo"), ("Você está aqui?", "voce esta aqui?"),
            ("TESTE", "teste"), ("CaMeLcAsE", "camelcase"), ("", ""), ("Straße", "strasse"),
            ("Ação Rápida", "acao rapida")]
    df = spark.createDataFrame(rows, "t string, e string")
    for r in df.select(normalize(F.col("t")).alias("n"), "e").collect():
        assert r.n == r.e


def test_exactly_one_bucket_and_first_rule_wins(spark):
    """Properties: every row gets exactly one bucket; the cascade's rule is
    the first rule that C2 reports as satisfied."""
    from sortwise.sources import tables as TB
    ms = TB.msg_stream(spark, "/root/testdata/sf0.001")
    ev = C.evidence(ms)
    cl = C.classify(ms).select("msg_id", "rule_id", "bucket")
    j = ev.select("msg_id", F.col("matched_rules")[0].alias("first")).join(cl, "msg_id")
    assert j.where(F.col("first") != F.col("rule_id")).count() == 0
    assert cl.where(F.col("bucket").isNull() | ~F.col("bucket").isin(list(L.BUCKETS))).count() == 0


def test_blank_and_whitespace_messages(spark):
    r = _classify(spark, ["   oi  ", " sim ", "\t"])
    assert r[0].rule_id == "R01" and r[1].rule_id == "R02"
    assert r[2].message == ""


def test_literal_index_finds_what_a_plain_search_finds(spark):
    import random

    from pyspark.sql import functions as F

    from sortwise.functions import text as T
    r = random.Random(6)
    literals = ["aba", "abab", "bab", "ba", "a", "cab.", "b c", " ca", "ccc", "cccc"]
    texts = ["".join(r.choice("abc .") for _ in range(r.randint(0, 40))) for _ in range(300)]
    index = T.LiteralIndex(literals)
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("found", index.scan(F.col("t")))
    seen = T.IndexedText(F.col("t"), F.col("found"), index)
    lists = [literals, ["bab", "a"], ["cccc", " ca"]]
    got = df.select("t", *[T.has(seen, x).alias(f"h{i}") for i, x in enumerate(literals)],
                    *[T.has_any(seen, xs).alias(f"a{i}") for i, xs in enumerate(lists)],
                    T.found_in_order(seen, [x for x in literals if len(x) > 2]).alias("o")).collect()
    for row in got:
        t = row.t
        assert [row[f"h{i}"] for i in range(len(literals))] == [x in t for x in literals]
        assert [row[f"a{i}"] for i in range(3)] == [any(x in t for x in xs) for xs in lists]
        assert row.o == [x for x in literals if len(x) > 2 and x in t]
