"""Runs of repeated words against brute force over all periods."""
import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from llm_cases import edge_rows, frame, words

from sortwise.llm import periodic_runs as R
from sortwise.llm import stand_ins


def brute_runs(w):
    best = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def looped(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, w):
    runs = brute_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lead = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *lead, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(kept)))


def random_texts():
    r = random.Random(5)
    for k in range(400):
        kinds = r.randint(1, 6)
        w = [f"w{r.randrange(kinds)}" for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            p = [f"w{r.randrange(kinds + 2)}" for _ in range(r.randint(1, 30))]
            at = r.randint(0, len(w))
            w[at:at] = (p * r.randint(2, 9))[: r.randint(1, 150)]
        yield k, w
    fib = [["a"], ["b"]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield 1000, fib[-1]
    yield 1001, ["a"] * 500
    yield 1002, (["a"] * 7 + ["b"]) * 30 + ["a"] * 40
    yield 1003, [c for k in range(40) for c in [f"x{k}"] * (k % 9)]
    yield 1004, ([f"p{i}" for i in range(300)] * 5)[: 1400]


def test_runs_equal_brute_force():
    for k, w in random_texts():
        text = " ".join(w).encode()
        import numpy as np
        data = np.frombuffer(text, dtype=np.uint8)
        stretches = R.repeated_stretches(data, np.array([0, len(data)]))[0]
        got = R.runs_of(w, stretches) if stretches else []
        assert got == brute_runs(w), (k, w)


def test_grammar_derives_its_sequences():
    r = random.Random(2)
    for _ in range(60):
        seqs = [[r.randrange(4) for _ in range(r.randint(1, 60))] for _ in range(r.randint(1, 4))]
        g = R.Grammar(seqs, 4)

        def derive(s, g=g):
            return [s] if s < 4 else [x for part in g.parts[s - 4] for x in derive(part)]
        assert [derive(s) for s, _ in g.tops] == seqs
        flat = [x for s in seqs for x in s]
        for k in range(len(g.parts)):  # every node stands where it says
            assert flat[g.place[k]: g.place[k] + g.length[k]] == derive(k + 4)


def test_query_rows_equal_brute_force(spark):
    rows = [(k, " ".join(w), "en", "a", 1) for k, w in random_texts()] + edge_rows()
    rows += [(k, "\t\x0b one" * 30 + "\n two", "en", "a", 1) for k in (2000, 2001)]
    rows = [r if r[1] is None or len(r[1]) < 5_000 else (r[0], r[1][:5_000], *r[2:]) for r in rows]
    got = R.digests(R.find_runs(stand_ins.looped(frame(spark, rows).repartition(3)))).collect()
    want = [expected(i, looped(i, words(t)) if i is not None else words(t)) for i, t, *_ in rows]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_columns_and_empty_table(spark):
    from sortwise.llm.queries import QUERIES
    assert R.find_runs(frame(spark, [])).count() == 0
    out = R.digests(R.find_runs(frame(spark, edge_rows())))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert "op11_periodic_runs" in QUERIES


@pytest.mark.parametrize("copies", [40_000])
def test_a_long_text_takes_linear_work(copies):
    w = [f"v{i}" for i in range(9)] * copies
    import numpy as np
    data = np.frombuffer(" ".join(w).encode(), dtype=np.uint8)
    assert R.runs_of(w, R.repeated_stretches(data, np.array([0, len(data)]))[0]) == [(0, len(w), 9)]
