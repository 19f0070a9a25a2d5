"""BPE encoding and decoding of whole texts (speculate and verify, see ``bpe``).

Null counts as empty; an empty text has no ids and decodes to the empty string.
One row per row of the input, repeated rows included; an empty table gives an
empty result.  Decoding joins the tokens' own strings with one space, which is
what a tokenizer file without a decoder does.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .textvec import slices


def _each(batches, vocabulary: str):
    """(ids of the rows, texts, encoder, table rows, row ends) per slice."""
    enc = encoder(vocabulary, True)
    for batch in batches:
        texts = batch.column(1)
        for lo, hi, _, _ in slices(texts):
            part = ["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()]
            rows, stops = enc.encode(part)
            yield batch.column(0).slice(lo, hi - lo), enc, rows, stops.tolist()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), tokens (array of string): the operator's full output."""
    def run(batches):
        for names, enc, rows, stops in _each(batches, vocabulary):
            first, ids = 0, []
            for last in stops:
                ids.append(enc.flat_ids(rows[first:last]).tolist())
                first = last
            tokens = [[enc.v.token[i] for i in x] for x in ids]
            yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "ids", "tokens"])
    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, tokens array<string>")


def decode(encoded: DataFrame) -> DataFrame:
    """doc_id, text: the inverse that the tokenizer file defines."""
    return encoded.select("doc_id", F.array_join("tokens", " ").alias("text"))


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded texts stay in
    the task.  Each distinct pre-token's ids and tokens are kept as text, so a
    document's digest input is one join of them."""
    def run(batches):
        for names, enc, rows, stops in _each(batches, vocabulary):
            first, out = 0, []
            listed = rows.tolist()
            for last in stops:
                mine = listed[first:last]
                ids = b"".join([enc.shown_ids[r] for r in mine])
                text = b"".join([enc.shown[r] for r in mine])
                out.append((ids.count(b" "), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(text[1:]).hexdigest()))
                first = last
            count, left, right = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(count, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _source(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
