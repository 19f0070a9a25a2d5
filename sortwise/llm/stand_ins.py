"""Inputs of queries that need faults which the given tables do not hold.

These functions change rows of a table by fixed rules; they know nothing of the
operators that read them.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import slices


def looped_words(words: list[bytes], doc_id: int) -> list[bytes]:
    """With h = crc32 of the decimal id and g = h // 10: if h is a multiple of 10, the
    words from number g % n on repeat a period that h fixes."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a: a + p] * (-(-(n - a) // p)))[: n - a]


def _looped(batches):
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
            raw, edges, out, pick = data.tobytes(), offsets.tolist(), [], []
            for d, doc_id in enumerate(ids.to_pylist()):
                if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
                    pick.append(True)
                    out.append(b" ".join(looped_words(raw[edges[d]: edges[d + 1]].split(), doc_id)).decode())
                else:
                    pick.append(False)
            texts = texts.cast(pa.string())
            if out:
                texts = pa.compute.replace_with_mask(texts, pa.array(pick), pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``; one in ten texts repeats a period from some word on."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _looped, "doc_id long, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` after faults by crc32(conv_id:turn) %
    20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes
    its role user.  A null counts as one space, in the sum, as a role and as a text."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space),
                               F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = rows.withColumns({
        "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")),
        "text": F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                 .otherwise(F.col("text"))})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")
