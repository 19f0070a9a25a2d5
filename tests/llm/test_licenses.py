"""License scan against a plain search of every template at every place."""
import math
import random
import re

import pytest
from llm_cases import edge_rows, frame, lower_az, prose

from sortwise.llm import licenses as L


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


def expected(rows):
    texts = [plain_words(t) for _, t, *_ in rows]
    templates = L.default_templates()
    df = {}
    for w in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log((len(texts) + 2) / (df.get(x, 0) + 1)) for t in templates for x in t.words}
    out = []
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        places, base, labels, score = [], set(), set(), 0.0
        for t in templates:
            m, total = len(t.words), sum(idf[x] for x in t.words)
            for p in range(-m, len(w) + m):
                seen = [any(0 <= p + i + d < len(w) and w[p + i + d] == x for d in range(-t.drift, t.drift + 1))
                        for i, x in enumerate(t.words)]
                share = 1.0 if all(seen) else sum(idf[x] for x, s in zip(t.words, seen, strict=True) if s) / total
                if share < t.share - 1e-9:
                    continue
                keys = all(any(0 <= q and w[q: q + len(k)] == list(k)
                               for q in range(p - t.drift, p + m + t.drift - len(k) + 1)) for k in t.keys)
                if keys:
                    labels.add(t.label)
                    score = max(score, share)
                    if t.base:
                        places.append(p)
                        base.add(t.label)
        out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(labels)), round(score, 9)))
    return out


def rows():
    r = random.Random(4)
    out = [r for r in edge_rows() if r[1] is None or len(r[1]) < 5_000]
    for k, (_, text, _) in enumerate(L.NOTICES):
        out.append((100 + k, prose(k, 30) + "\n" + text + "\n" + prose(k + 50, 20), "en", "a", 1))
        w = text.split()
        for x in r.sample(range(len(w)), len(w) // 4):
            w[x] = "changed"
        out.append((200 + k, " ".join(w), "en", "a", 1))
        out.append((300 + k, " ".join(text.split()[: len(text.split()) // 2]), "en", "a", 1))
        w = text.split()
        w.insert(len(w) // 2, "extra")
        out.append((400 + k, prose(k, 5) + " " + " ".join(w), "en", "a", 1))
    out += [(500, "CC BY cc-by (cc by) General  Public\nLicense ALL RIGHTS RESERVED all rights reserved", "en", "a", 1),
            (501, "cc", "en", "a", 1), (502, "by nc 4.0 cc", "en", "a", 1), (503, "all rights", "en", "a", 1),
            (504, "reserved general public", "en", "a", 1), (505, "license license license", "en", "a", 1),
            (506, "çcc by ccby cc\x7fby CC_BY", "en", "a", 1)]
    return out


def rounded(df):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, df.collect())), key=key)


@pytest.mark.parametrize("block", [2, 4096])
def test_scan_equals_plain_search(spark, block, monkeypatch):
    table = rows()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    if block == 2:  # weigh few candidates at a time, in this process
        import numpy as np
        monkeypatch.setattr(L, "BLOCK", block)
        texts = [(t or "").encode() for _, t, *_ in table]
        vocabulary = L.Vocabulary(L.default_templates())
        docs = frame(spark, table)
        index = L.Index(L.default_templates(), vocabulary, L.idf_of(docs, vocabulary))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        count, found = L.match_texts(index, np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
        got = [(i, int(n), sum(m[1] for m in f), ",".join(sorted({m[0] for m in f})))
               for (i, *_), n, f in zip(table, count, found, strict=True)]
        assert got == [(e[0], e[1], e[2], e[6]) for e in expected(table)]
        return
    got = rounded(L.digests(L.scan(frame(spark, table).repartition(3))))
    assert got == sorted(expected(table), key=key)
    labels = {r[0]: r[6].split(",") for r in got if r[0] is not None}
    for k, (label, _, _) in enumerate(L.NOTICES):  # whole notices are found
        assert label in labels[100 + k]


def test_long_text_and_empty_table(spark):
    assert L.scan(frame(spark, [])).count() == 0
    text = ("all rights reserved " * 30_000).strip()
    r = L.digests(L.scan(frame(spark, [(1, text, "en", "a", 1)]))).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (90_000, 30_000, 0, 89_997, "reserved")


def test_own_templates(spark):
    own = [L.Template("x", ("very", "rare", "words", "here"), (("rare", "words"),), 0.5, 1)]
    got = L.scan(frame(spark, [(1, "a very rare words b", "en", "a", 1), (2, "rare here words", "en", "a", 1)]), own).collect()
    assert [[m.label for m in r.matches] for r in sorted(got, key=lambda r: r.doc_id)] == [["x"], []]
