"""Encoding, packing, exact deduplication, token counts: against the tokenizers library
and brute force."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_cases import edge_rows, frame, prose, rows_of
from tokenizers import Tokenizer

from sortwise.llm import bpe_texts, exact_dedup, packing, token_counts
from sortwise.llm.bpe import Encoder, Vocabulary

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "s", " ", "  ", "\n", "\n\n", "1", "é", "!", "'ll", "re", " the", "ing", "<|endoftext|>", "<|", "Σ", "İ",
         "日本", "́", "\x85", "½", "aaaa", "===="]


def texts(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    cases = texts(1500) + [t or "" for _, t, *_ in edge_rows()] + [prose(1, 3000), "ab" * 300]
    rows, stops = enc.encode(cases)
    first = 0
    for text, last in zip(cases, stops.tolist(), strict=True):
        assert enc.flat_ids(rows[first:last]).tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]
        first = last


def test_exact_merging_agrees_for_short_and_long_pieces():
    v = Vocabulary(BYTE)
    pieces = [w.encode() for w in texts(400, 3) if w]
    assert [x.tolist() for x in v.encode_pieces(pieces)[0]] == [v.exact(p) for p in pieces]


def test_digests(spark):
    lib = Tokenizer.from_file(WORD)
    rows = edge_rows()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    got = rows_of(bpe_texts.digests(frame(spark, rows), WORD))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert bpe_texts.digests(frame(spark, []), WORD).count() == 0


def test_encode_then_decode(spark):
    lib = Tokenizer.from_file(WORD)
    enc = bpe_texts.encode(frame(spark, [(1, "Hello, World's 42!", "en", "a", 1)]), WORD)
    ids = lib.encode("Hello, World's 42!", add_special_tokens=False).ids
    assert enc.first().ids == ids
    assert bpe_texts.decode(enc).first().text == lib.decode(ids, skip_special_tokens=False)


def _packed(spark, rows, **kw):
    df = packing.pack(frame(spark, rows).repartition(3), BYTE, end_id=1, **kw)
    return df.collect()


def _check_packing(rows, pieces, length):
    lib = Tokenizer.from_file(BYTE)
    docs = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows)
    want = sorted((i, zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in docs)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in docs)
    ids = {}
    for i, x in docs:
        ids.setdefault(i, x)
    whole = sorted((str(p.doc_id), p.ids_crc32) for p in pieces if p.length == p.doc_tokens)
    assert set(whole) <= set(want)
    for p in pieces:
        if sum(str(r[0]) == str(p.doc_id) for r in rows) == 1:
            part = np.array(ids[str(p.doc_id)][p.start: p.start + p.length], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[str(p.doc_id)])
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for group in by.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == group[0].sequence_tokens <= length
        assert group[0].padding == (0 if at & (at - 1) == 0 else length - at)
    return by


def test_packing_places_every_id_once(spark):
    rows = edge_rows() + [(100 + i, prose(i, 20 + 13 * i), "en", "a", 1) for i in range(60)]
    by = _check_packing(rows, _packed(spark, rows, windows=4, fan_in=2), 2048)
    small = _check_packing(rows, _packed(spark, rows, length=256, windows=3, cut=16, fan_in=2), 256)
    assert len(small) > len(by)
    assert _packed(spark, []) == []


def test_packing_pads_little(spark):
    rows = [(i, prose(i, 20 + i * 37 % 400), "en", "a", 1) for i in range(600)]
    by = _check_packing(rows, _packed(spark, rows), 2048)
    assert sum(g[0].padding for g in by.values()) < 0.03 * 2048 * len(by)


def test_merge_of_windows_is_whole_and_fits():
    r = random.Random(1)
    sizes = [r.randint(1, 2048) for _ in range(300)]
    put = packing.merge_windows(sizes, 2048)
    held = {}
    for size, (n, off) in zip(sizes, put, strict=True):
        held.setdefault(n, []).append((off, size))
    for parts in held.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= 2048


def _brute_dedup(rows):
    key = [hashlib.sha256("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest() for _, t, *_ in rows]
    out = []
    for i, row in enumerate(rows):
        group = [j for j in range(len(rows)) if key[j] == key[i]]
        best = min(group, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append([row[0], rows[best][0], len(group), i == best, key[i]])
    return out


@pytest.mark.parametrize("counters", [2, 256])
def test_exact_duplicates(spark, counters):
    rows = edge_rows() + [(200 + i, "same text " + " " * (i % 7), "en", "a", 1) for i in range(60)] + \
        [(300 + i % 5, "tie", "en", "a", 1) for i in range(10)] + [(400 + i, f"own {i}", "en", "a", 1) for i in range(40)]
    want = sorted(map(tuple, _brute_dedup(rows)), key=lambda r: tuple((v is None, str(v)) for v in r))
    got = rows_of(exact_dedup.exact_duplicates(frame(spark, rows).repartition(4), counters=counters))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    kept = sorted(str(r[0]) + r[4] for r in got if r[3])
    assert kept == sorted(str(r[0]) + r[4] for r in want if r[3])  # one row of each group


def test_drop_exact_duplicates_keeps_columns(spark):
    rows = edge_rows()
    df = frame(spark, rows)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns and out.schema["text"] == df.schema["text"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in _brute_dedup(rows) if r[3])
    assert exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_digests_hold_a_few_texts_at_a_time():
    """A batch of any size was one copy of all its texts."""
    import pyarrow as pa
    long = ["word " * 20_000 + str(i) for i in range(20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(long)], names=["_id", "_text"])
    out = list(exact_dedup.digest_texts([batch]))
    assert len(out) == 4 and [i for b in out for i in b["_id"].to_pylist()] == list(range(22))
    want = [hashlib.sha256((t or "").replace(" ", "").encode()).hexdigest() for t in long]
    assert [x for b in out for x in b["_sha"].to_pylist()] == want
    assert [n for b in out for n in b["_points"].to_pylist()] == [len(t or "") for t in long]


def test_drop_exact_duplicates_needs_one_worker_a_core(spark):
    """The summary read the digests of another Python operator in the same task: two
    workers for every core, which lived on through the stages behind."""
    plan = exact_dedup.drop_exact_duplicates(frame(spark, edge_rows()))._jdf.queryExecution().executedPlan().toString()
    marks = [m for m in ("MapInArrow" if "MapInArrow" in x else "Exchange" if "Exchange" in x else ""
                         for x in plan.splitlines()) if m]
    assert marks.count("MapInArrow") >= 3
    assert ("MapInArrow", "MapInArrow") not in set(zip(marks, marks[1:]))


def test_misra_gries_names_every_frequent_item():
    import pyarrow as pa
    r = random.Random(2)
    items = ["hot"] * 400 + ["warm"] * 150 + [f"x{i}" for i in range(900)]
    r.shuffle(items)
    batches = [pa.RecordBatch.from_arrays([pa.array(items[k: k + 100])], names=["_sha"]) for k in range(0, len(items), 100)]
    out = next(iter(exact_dedup.misra_gries(10)(batches))).to_pydict()
    assert {"hot", "warm"} <= set(out["_sha"]) and len(out["_sha"]) <= 10
    assert dict(zip(out["_sha"], out["n"], strict=True))["hot"] <= 400


def test_edited_trees_equal_a_fresh_count():
    enc, lib = Encoder(BYTE), Tokenizer.from_file(BYTE)
    r = random.Random(5)
    leaf, token_counts.LEAF = token_counts.LEAF, 4  # many leaves in a short text
    try:
        for text in texts(800, 7):
            k = r.randint(0, 4)
            cuts = sorted(r.sample(range(len(text) + 1), min(2 * k, (len(text) + 1) // 2 * 2)))
            edits = [(a, b, r.choice(["", "x", " ", "'s", "\n", " the", "a b c d e f g h i j", "|>"]))
                     for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            doc, = token_counts.build([text], enc)
            assert doc.n_tokens == len(lib.encode(text, add_special_tokens=False).ids)
            doc.apply(edits, enc)
            new = token_counts.edited(text, edits)
            assert "".join(doc.leaves) == new
            assert doc.n_tokens == len(lib.encode(new, add_special_tokens=False).ids), (text, edits)
            assert doc.tokens[1] == doc.tokens[len(doc.tokens) // 2:].sum()
    finally:
        token_counts.LEAF = leaf


def test_only_touched_regions_are_encoded_again():
    enc = Encoder(BYTE)
    doc, = token_counts.build([prose(3, 20_000)], enc)
    doc.apply([(5000, 5010, "changed words here")], enc)
    assert 0 < doc.encoded < 5 * token_counts.LEAF < len(doc.leaves) * token_counts.LEAF / 10


def test_token_counts_table(spark):
    lib = Tokenizer.from_file(BYTE)
    rows = edge_rows() + [(50, "one line 1234567\nother\none line 1234567\nother\n", "en", "a", 1)]
    trees = token_counts.build_trees(frame(spark, rows), BYTE, edits_of=token_counts.cleaning_edits)
    got = token_counts.edit_counts(trees, BYTE).collect()
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = [(i, n(t or ""), n(token_counts.edited(t or "", token_counts.cleaning_edits(t or "")))) for i, t, *_ in rows]
    assert sorted(map(str, [(r.doc_id, r.n_tokens, r.n_tokens_after) for r in got])) == sorted(map(str, want))
    after = token_counts.apply_edits(trees, BYTE).where("doc_id = 50").first()
    assert "".join(after.leaves) == "one line 0\nother\n" and after.tokens[1] == n("one line 0\nother\n")
    assert token_counts.edit_counts(token_counts.build_trees(frame(spark, []), BYTE), BYTE).count() == 0
