"""Operators without an SQL oracle: lexicon IO, sinks, payload pieces, reports."""
import os
import tempfile

from pyspark.sql import functions as F

from sortwise.functions import lexicon as L
from sortwise.operators import payload as B
from sortwise.operators import reports as A
from sortwise.operators import tokens as J
from sortwise.sources import lexicon_io as LX
from sortwise.sources import sinks as SK
from sortwise.sources import tables as TB


def test_learned_lexicon_roundtrip(spark):
    learned = LX.read_learned(spark)
    assert learned.count() == 90
    root = tempfile.mkdtemp(prefix="lexicon-")
    LX.save_learned(learned, root, 1)
    LX.reset_learned(spark, root, 2)
    assert LX.read_learned_versioned(spark, root).count() == 0
    assert spark.read.parquet(os.path.join(root, "v=000001")).count() == 90
    assert LX.read_learned(spark, "/nonexistent/file.json").count() == 0
    assert LX.read_learned(spark, "file:" + LX.SHIPPED_LEARNED).count() == 90
    assert LX.read_learned_versioned(spark, "file:" + root).count() == 0


def test_lexicon_stats_and_forms_per_lemma(spark):
    st = J.lexicon_stats(LX.verb_forms_df(spark), LX.read_learned(spark), L.EXTRA_INFINITIVES).first()
    assert (st.n_forms, st.n_lemmas, st.n_learned, st.total_known) == (445, 50, 90, 535)
    assert st.forms_per_lemma == 8.9
    fpl = {r.lemma: r.n_forms for r in J.forms_per_lemma(LX.verb_forms_df(spark)).collect()}
    assert fpl["buscar"] == 17 and fpl["enviar"] == 9


def test_merge_and_extend(spark):
    existing = spark.createDataFrame([("a", "x")], "form string, lemma string")
    cand = spark.createDataFrame([("a", "y", 1), ("b", "z", 5), ("b", "w", 2)],
                                 "form string, lemma string, seen_at long")
    merged = {r.form: r.lemma for r in J.merge_learned(existing, cand).collect()}
    assert merged == {"a": "x", "b": "w"}
    static = LX.verb_forms_df(spark)
    add = spark.createDataFrame([(0, "conectar", "conectar"), (1, "envia", "mandar")],
                                "pos int, form string, lemma string")
    ext = {r.form: r.lemma for r in J.extend_static(static, add).collect()}
    assert ext["conectar"] == "conectar" and ext["envia"] == "mandar" and len(ext) == 446
    req = spark.createDataFrame([("enviar",), ("voar",)], "lemma string")
    miss = [r.lemma for r in J.missing_required(req, LX.infinitives_df(spark)).collect()]
    assert miss == ["voar"]


def test_last_history_and_params(spark):
    df = spark.createDataFrame(
        [([("user", "a"), (None, "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e")],)],
        "h array<struct<role:string,content:string>>")
    got = df.select(B.last_history(F.col("h")).alias("x")).first().x
    assert [m.content for m in got] == ["c", "d", "e"]
    ctx = spark.createDataFrame([("system", 0.9, None), ("user", None, "m")],
                                "bucket string, temperature double, model string")
    rows = ctx.select(B.generation_params(F.col("bucket"), F.struct("temperature", "model")).alias("p")).collect()
    assert (rows[0].p.temperature, rows[0].p.max_tokens, rows[0].p.model) == (0.7, 1200, "gpt-4o")
    assert (rows[1].p.temperature, rows[1].p.max_tokens, rows[1].p.model) == (1.0, 2000, "m")


def test_results_sink_and_stage_latency(spark):
    from sortwise.operators.triage import triage, classification_struct
    from sortwise.sources.phrases import phrases_df
    t = triage(phrases_df(spark).withColumn("msg_id", F.col("idx").cast("long")))
    path = tempfile.mkdtemp(prefix="results-")
    SK.write_results(classification_struct(t).select("msg_id", "bucket", "classification"),
                     os.path.join(path, "r"))
    assert spark.read.parquet(os.path.join(path, "r")).count() == 37
    log = SK.event_log(TB.with_latencies(t.withColumn("latency_ms", F.lit(1.0)).withColumn("ts", F.current_timestamp())
                                         .withColumn("model", F.lit("gpt-4o"))))
    st = {r.stage: r.samples for r in A.stage_latency(log).collect()}
    assert st["total_ms"] == 37 and st["classificacao_ms"] == 37


def test_full_result_row(spark):
    from sortwise.operators.triage import triage
    from sortwise.sources.phrases import phrases_df
    df = phrases_df(spark).select(F.col("idx").cast("long").alias("msg_id"), "message", F.lit("a").alias("sender"),
                                  F.current_timestamp().alias("ts"), F.lit(None).cast(B.CTX_SCHEMA).alias("ctx"),
                                  F.array().cast(f"array<{B.MSG_SCHEMA}>").alias("history"))
    rows = SK.result_rows(B.assemble(triage(df)))
    assert rows.columns == SK.RESULT
    first = rows.where("msg_id = 3").first()
    assert first.mensagem_completa == first.texto_normalizado == "documento"
    assert first.classification.rule_id == "R04" and first.webhook["from"] == "a"
    assert first.openaiPayload.messages[-1].content == "documento"


def test_two_lexicons_in_turn(spark):
    """Trees belong to the lexicon: a new one never gets those of one that is gone."""
    import gc

    from sortwise.functions.lemma import Lexicon
    from sortwise.operators.classify import classify
    df = spark.createDataFrame([(1, "zorpe o relatorio da Maria")], "msg_id long, message string")
    for _ in range(3):
        plain = classify(df, Lexicon({"enviar": "enviar"})).first()
        gc.collect()
        added = classify(df, Lexicon({"zorpe": "enviar", "enviar": "enviar"})).first()
        gc.collect()
        assert plain.lemmas[0] == "zorpe" and added.lemmas[0] == "enviar"
        assert plain.rule_id != added.rule_id


def test_emoji_and_marks_are_dropped(spark):
    from sortwise.operators.classify import classify
    want = {"isso 👍": "R05", "documento 📄": "R04", "criar\ufe0f": "R04", "ok\u200d": "R02"}
    df = spark.createDataFrame([(i, m) for i, m in enumerate(want)], "msg_id long, message string")
    assert {r.message: r.rule_id for r in classify(df).collect()} == want
    nfd = spark.createDataFrame([(1, "reunia\u0303o")], "msg_id long, message string")
    assert classify(nfd).first().norm == "reuniao"


def test_case_positions_with_one_large_class(spark):
    """One class holds 90 % of the rows, over many tasks; ids come in no order."""
    from sortwise.operators import reports as A
    n = 3000
    df = spark.range(n).selectExpr("(id * 7919) % 3000 AS msg_id", "CASE WHEN id % 10 = 0 THEN 'few' ELSE 'many' END AS expected",
                                   "CASE WHEN id % 700 = 1 THEN 'wrong' WHEN id % 10 = 0 THEN 'few' ELSE 'many' END AS bucket")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = df.collect()
        got = {(r.expected, r.position, r.msg_id) for r in A.case_samples(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = set()
    for c in ("few", "many"):
        mine = sorted((r.msg_id, r.bucket) for r in rows if r.expected == c)
        want |= {(c, i, m) for i, (m, b) in enumerate(mine, 1) if b != c or i <= 5 or i % 20 == 0}
    assert got == want


def test_stage_quantiles_are_within_the_sketch_bound(spark):
    """Rolled up from many hours; compared with the exact ranks."""
    from sortwise.operators import reports as A
    df = spark.range(20_000).selectExpr("timestamp_seconds(id * 97) AS ts", "map('a', (id * 7919 % 20011) / 7.0, 'b', "
                                        "CASE WHEN id % 3 = 0 THEN double(id % 10) END) AS latencies")
    got = {r.stage: r for r in A.stage_quantiles(A.stage_sketches(df)).collect()}
    values = {"a": [], "b": []}
    for r in df.collect():
        for k, v in r.latencies.items():
            if v is not None:
                values[k].append(v)
    for k, exact in values.items():
        assert got[k].samples == len(exact)
        for q, v in ((0.5, got[k].p50_ms), (0.95, got[k].p95_ms)):
            below, upto = sum(x < v for x in exact) / len(exact), sum(x <= v for x in exact) / len(exact)
            assert below - 0.02 <= q <= upto + 0.02
    days = A.stage_quantiles(A.stage_sketches(df).withColumn("day", F.date_trunc("day", "hour")), "day")
    assert days.count() > 20 and days.columns == ["day", "stage", "samples", "p50_ms", "p95_ms"]


def test_indexed_pattern_join_against_brute_force(spark):
    from sortwise.operators import scopes as D
    texts = ["abra a planilha", "a", "ab", "", None, "planilha de planos", "ção e é", "x" * 500 + "fim"] + ["abra a planilha"] * 40
    pats = ["planilha", "plan", "a", "bra", "é", "xf", "xxfim", "nada disso", "", None, "abra a planilha inteira", "planos"]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, norm string")
    table = spark.createDataFrame([(i, p, [str(p)]) for i, p in enumerate(pats)], "prio int, pattern string, scopes array<string>")
    for order in (1, -1):
        out = D.first_pattern_join(df, table.withColumn("prio", F.col("prio") * order))
        want = {i: next((p for p in pats[::order] if p and p in t), None) for i, t in enumerate(texts) if t}
        assert {r.msg_id: r.pattern for r in out.collect()} == {i: p for i, p in want.items() if p}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert D.first_pattern_join(df, table.limit(0)).count() == D.first_pattern_join(df.limit(0), table).count() == 0


def test_one_bucket_replaced_and_read_alone(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="results-"), "r")

    def files():
        return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names
                if f.startswith("part-") and "bucket=user" in d}

    rows = spark.createDataFrame([(i, "user" if i % 2 else "unclear") for i in range(20)], "msg_id long, bucket string")
    SK.write_results(rows, path)
    before = files()
    SK.replace_buckets(rows.where("bucket = 'unclear' AND msg_id < 6"), path)
    assert files() == before and before
    one = SK.read_results(spark, path, "unclear")
    assert sorted(r.msg_id for r in one.collect()) == [0, 2, 4]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan
    assert SK.read_results(spark, path).count() == 13


def test_long_texts_are_dealt_over_all_cores(spark, tmp_path):
    from sortwise.sources import tables as TB
    rows = [(i, None if i == 5 else f"texto {i}", "pt", "a") for i in range(200)] + [(7, "texto 7", "pt", "a"), (None, "x", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    docs = TB.msg_docs(spark, str(tmp_path))
    sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < len(rows) / 2
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str)


def test_normalize_by_letter_is_the_same_as_by_text(spark):
    from sortwise.functions import text as T
    many = "".join(map(chr, range(0xC0, 0x250))) + "αβγ жщ € ½ — … 中文 é é \U0001f600 ßﬁ"
    texts = ["Ação é não ÇÉÀ", "œuvre — £5 ½ … “x”", many, "".join(sorted(set(many)))[:T.FEW_LETTERS], "İstanbul ‍á中", "", "ascii Only", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(T.normalize(F.col("t")).alias("a"), T._transliterate(F.lower("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert got[0].a == "acao e nao cea" and got[1].a == 'oeuvre -- ps5 1/2 ... "x"'
