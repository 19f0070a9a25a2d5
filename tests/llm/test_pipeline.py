"""The corpus pipeline on a small table, against brute force after every stage."""
import zlib

import numpy as np
import public_tokenizers as P
from llm_cases import components, frame, prose
from test_judging import brute_secrets, junk, near
from tokenizers import Tokenizer

import corpus_pipeline
from sortwise.llm.scratch import materialise


def rows():
    out = [(i, prose(i, 60 + i % 60), "en", "a", 1) for i in range(120)]
    out += [(200 + i, junk(i), "en", "a", 1) for i in range(30)]
    out += [(300 + i, prose(i, 60 + i % 60).replace(" ", "  "), "en", "a", 1) for i in range(20)]  # copies but for spaces
    out += [(400 + i, near(prose(50 + i, 60 + (50 + i) % 60), i, 1), "en", "a", 1) for i in range(20)]
    out += [(500 + i, prose(700 + i, 70) + " password=" + f"{i:x}" * 9, "en", "a", 1) for i in range(20)]
    return out


def test_stages(spark):
    table = rows()
    docs = frame(spark, table, clash=False)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert {i for i, *_ in table if not 200 <= i < 230} <= ids["quality"]
    assert len([i for i in ids["quality"] if 200 <= i < 230]) <= 3
    # of equal texts the longer original stays: the copies with two spaces
    assert not ids["exact"] & set(range(20)) and set(range(300, 320)) <= ids["exact"]
    left = [(r.doc_id, r.text) for r in seen["exact"]]
    assert ids["near"] == {i for i, _, c in components(left) if i == c}
    assert ids["secrets"] == ids["near"] and all(brute_secrets(r.text) == "" for r in seen["secrets"])
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids + [1] for r in seen["secrets"]}
    for p in seen["packing"]:
        part = np.array(text[p.doc_id][p.start: p.start + p.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == p.ids_crc32
    assert sum(p.length for p in seen["packing"]) == sum(map(len, text.values()))


def test_empty_table(spark, tmp_path):
    frame(spark, [], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    from __spark_entry__ import queries
    names = queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
