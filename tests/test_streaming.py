"""Streams over several micro-batches, out-of-order and late rows, replayed batches."""
import datetime
import tempfile

from pyspark.sql import functions as F

from sortwise.streaming import jobs as ST
from test_dedupe import brute_force

T0 = datetime.datetime(2024, 1, 1)


def _files(spark, batches):
    """One event file a micro-batch; rows are (event_id, ts)."""
    path = tempfile.mkdtemp(prefix="stream-")
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, ts, 0, "view", 1.0, "{}") for i, ts in rows], ST.EVENTS_SCHEMA) \
            .coalesce(1).write.parquet(f"{path}/in/{k}")
    return path


def _settled(rows, last):
    """Rows whose slice of ten minutes ends before the watermark, two hours behind ``last``."""
    def end(ts):
        return T0 + ((ts - T0) // datetime.timedelta(minutes=10) + 1) * datetime.timedelta(minutes=10)
    return {i for i, ts in rows if end(ts) < last - datetime.timedelta(hours=2)}


def test_ttl_equals_batch_for_shuffled_files(spark):
    rows = [(37 * i, T0 + datetime.timedelta(seconds=i * 611)) for i in range(90)]  # one phrase: one key
    cut = [rows[:30], rows[32:60] + rows[30:32], rows[60:]]  # two rows arrive a file late
    cut = [sorted(c, key=lambda r: r[0] * 7919 % 101) for c in cut]
    path = _files(spark, cut)
    ST.run_available_now(ST.ttl_dedupe(ST.message_stream(spark, f"{path}/in")), f"{path}/out", f"{path}/ck")
    got = {r.msg_id: r.is_hit for r in spark.read.parquet(f"{path}/out").collect()}
    want = brute_force([("k", ts, i) for i, ts in rows])
    passed = _settled(rows, rows[-1][1])
    assert got == {i: h for i, h in want.items() if i in passed}
    assert 0 < sum(got.values()) < len(got)


def test_hourly_hits_are_one_query_over_ttl(spark):
    """Chained operators give the same as T3's rows summed up by hour."""
    rows = [(37 * i + i % 2, T0 + datetime.timedelta(seconds=i * 611)) for i in range(90)]
    path = _files(spark, [rows[:45], rows[45:]])
    ST.run_available_now(ST.hourly_hits(ST.message_stream(spark, f"{path}/in")), f"{path}/out", f"{path}/ck")
    got = {r.hour: (r.requests, r.hits, r.misses) for r in spark.read.parquet(f"{path}/out").collect()}
    phrase = {i: (i % 37) ** 2 % 37 for i, _ in rows}  # user 0
    hit = brute_force([(phrase[i], ts, i) for i, ts in rows])
    hour, closed = datetime.timedelta(hours=1), rows[-1][1] - datetime.timedelta(hours=2)
    want = {}
    for i, ts in rows:
        h = T0 + (ts - T0) // hour * hour
        if h + hour + datetime.timedelta(minutes=10) < closed:
            r = want.setdefault(h, [0, 0, 0])
            r[0] += 1
            r[1 if hit[i] else 2] += 1
    assert got == {h: tuple(r) for h, r in want.items()}


def test_ttl_of_a_key_with_many_waiting_rows(spark):
    """100,000 rows of one key wait at once; doubles come back bit by bit."""
    n, path = 100_000, tempfile.mkdtemp(prefix="stream-")
    ms = F.col("id") * 70
    ev = spark.range(n).select((F.col("id") * 37).alias("event_id"), F.timestamp_millis(ms + 1_704_067_200_000).cast("timestamp_ntz").alias("ts"),
                               F.lit(0).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
                               (F.lit(0.1) + F.lit(0.2) + F.col("id") / 7).alias("value"), F.lit("{}").alias("props"))
    ev.repartition(4).write.parquet(f"{path}/in/0")
    end = spark.createDataFrame([(37, T0 + datetime.timedelta(hours=9), 0, "view", 1.0, "{}")], ST.EVENTS_SCHEMA)
    end.coalesce(1).write.parquet(f"{path}/in/1")
    ST.run_available_now(ST.ttl_dedupe(ST.message_stream(spark, f"{path}/in", 4)), f"{path}/out", f"{path}/ck")
    out = spark.read.parquet(f"{path}/out").join(ev.select(F.col("event_id").alias("msg_id"), "value"), "msg_id")
    r = out.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") == F.col("latency_ms")).cast("int")).alias("same"),
                F.sum((~F.col("is_hit")).cast("int")).alias("misses")).first()
    assert r.n == r.same and r.misses == 2  # 0:00 and 1:00; the rest is in the hour after
    assert n > r.n > 99_000 or r.n == n


def test_waiting_rows_cost_by_slice_not_by_key(spark):
    """37 messages of one slice wait in a few states with a timer each, and all come back."""
    from sortwise.streaming import ttl as TTL
    path = _files(spark, [[(k, T0 + datetime.timedelta(seconds=k)) for k in range(1, 75)], [(111, T0 + datetime.timedelta(hours=9))]])
    rows = TTL.buffered(ST.keyed_events(ST.message_stream(spark, f"{path}/in")), "2 hours")
    q = ST.run_available_now(rows, f"{path}/out", f"{path}/ck")
    timers = max(int(p.stateOperators[0].customMetrics["numRegisteredTimers"]) for p in q.recentProgress if p.stateOperators)
    got = spark.read.parquet(f"{path}/out")
    assert sorted(r.msg_id for r in got.collect()) == list(range(1, 75))
    assert got.select("msg_key").distinct().count() > TTL.BUCKETS >= timers


def test_approximate_ttl_forgets_keys(spark):
    hour = datetime.timedelta(hours=1)
    path = _files(spark, [[(37, T0), (74, T0 + hour / 2)], [(111, T0 + 3 * hour)], [(148, T0 + 6 * hour)],
                          [(185, T0 + 9 * hour)]])
    ST.run_available_now(ST.ttl_approximate(ST.message_stream(spark, f"{path}/in")), f"{path}/out", f"{path}/ck")
    got = {r.msg_id for r in spark.read.parquet(f"{path}/out").collect()}
    assert len(got & {37, 74}) == 1 and 111 not in got and 185 in got


def test_hourly_metrics_drop_late_rows(spark):
    hour = datetime.timedelta(hours=1)
    path = _files(spark, [[(37, T0), (74, T0 + 3 * hour)], [(111, T0 + 4 * hour)],
                          [(148, T0 + datetime.timedelta(minutes=1)), (185, T0 + 6 * hour)]])
    ST.run_available_now(ST.hourly_metrics(ST.message_stream(spark, f"{path}/in")), f"{path}/out", f"{path}/ck")
    got = {r.hour: r.requests for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {T0: 1, T0 + 3 * hour: 1, T0 + 4 * hour: 1}  # the row of T0 + 1 minute came four hours late


def test_replayed_batches_write_once(spark):
    from sortwise.operators import classify as C
    path = tempfile.mkdtemp(prefix="replay-")
    batch = C.prepare(spark.createDataFrame([(1, "oi"), (2, "")], "msg_id long, message string"), C.default_lexicon())
    counts = spark.createDataFrame([("a", 1)], "token string, freq long")
    for _ in range(2):
        ST.write_quarantine(batch, 0, f"{path}/ok", f"{path}/err")
        ST.write_candidates(counts, 0, f"{path}/tok")
    ST.write_candidates(counts.withColumn("freq", F.lit(3).cast("long")), 1, f"{path}/tok")
    assert spark.read.parquet(f"{path}/ok").count() == spark.read.parquet(f"{path}/err").count() == 1
    assert [tuple(r) for r in ST.read_candidates(spark, f"{path}/tok").collect()] == [("a", 3)]


def test_learned_lexicon_versions(spark):
    """Two versions by one stream; what a dead writer leaves is neither read nor in the way."""
    from sortwise.sources import lexicon_io as LX
    root = tempfile.mkdtemp(prefix="lexicon-")
    static = spark.createDataFrame([("cria", "criar")], "form string, lemma string")
    known = spark.createDataFrame([("oi", "saudar"), ("bip", "bipar"), ("cria", "outra")], "form string, lemma string")

    def batch(*tokens):
        return spark.createDataFrame([(T0, t) for t in tokens], "ts timestamp, token string")

    def newest():
        return {tuple(r) for r in LX.read_learned_versioned(spark, root).collect()}

    spark.createDataFrame([("half", "written")], "form string, lemma string").write.parquet(f"{root}/v=000001")
    assert newest() == set() and LX.versions(spark, root) == []
    ST.publish_learned(batch("oi", "cria", "zzz"), 0, static, known, root)
    assert newest() == {("oi", "saudar")}
    spark.createDataFrame([], "form string, lemma string").write.parquet(f"{root}/v=000002")  # died before the marker
    assert newest() == {("oi", "saudar")}
    for _ in range(2):  # the batch is replayed
        ST.publish_learned(batch("bip", "oi"), 1, static, known.replace("saudar", "nunca"), root)
    assert newest() == {("oi", "saudar"), ("bip", "bipar")}
    assert LX.versions(spark, root) == ["v=000001", "v=000002"]


def test_malformed_webhooks_are_refused(spark):
    from sortwise.sources import payloads as SP
    texts = ['{"from": "a", "message": " oi "}', "{", "plain words", None, "null", " ", "{}", '{"message": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = {r.id: (r.sender, r.message, r.reject_reason, r.corrupt) for r in SP.parse_webhooks(df).collect()}
    assert got[0] == ("a", "oi", None, None)
    assert [got[k][2] for k in range(1, 8)] == ["MALFORMED", "MALFORMED", "NO_PAYLOAD", "NO_PAYLOAD", "NO_PAYLOAD", None, None]
    assert got[1][3] == "{" and got[2][3] == "plain words" and got[6][:2] == ("unknown", "")


def test_bodies_go_to_three_sinks_once(spark):
    from sortwise.sources import payloads as SP
    path = tempfile.mkdtemp(prefix="ingest-")
    good = ['{"message": " oi "}', '{"message": ""}', '{"ctx": {"lang": "en"}}', '{"message": "tudo bem?", "history": []}']
    bodies = list(enumerate(good + SP.REFUSED))
    for k in range(2):  # two micro-batches
        spark.createDataFrame(bodies[k::2], ST.BODIES_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/in")

    def sinks(root):
        return {n: sorted(r.msg_id for r in spark.read.parquet(f"{root}/{n}").collect()) for n in ("accepted", "empty", "refused")}

    ST.ingest_job(ST.body_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/ck")
    want = {"accepted": [0, 3], "empty": [1, 2], "refused": list(range(4, 4 + len(SP.REFUSED)))}
    assert sinks(f"{path}/out") == want
    kept = {r.msg_id: (r.reject_reason, r.payload) for r in spark.read.parquet(f"{path}/out/refused").collect()}
    assert kept[4] == ("MALFORMED", SP.REFUSED[0]) and kept[5] == ("NO_PAYLOAD", None)
    # A batch that is run again replaces its own rows.
    batch = SP.parse_payloads(spark.createDataFrame(bodies, ST.BODIES_SCHEMA))
    for _ in range(2):
        ST.write_ingested(batch, 0, f"{path}/again")
    assert sinks(f"{path}/again") == want
    # Webhooks: a body that is no JSON object is a dead letter, an empty object a blank message.
    ST.ingest_job(ST.body_stream(spark, f"{path}/in"), f"{path}/hooks", f"{path}/ck2", SP.parse_webhooks)
    hooks = sinks(f"{path}/hooks")
    assert hooks["accepted"] == [0, 3] and 4 in hooks["refused"] and 10 in hooks["refused"] and 6 in hooks["empty"]
