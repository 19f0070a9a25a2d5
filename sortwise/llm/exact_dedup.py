"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``;
null counts as empty.  Each task digests its texts.  A Misra-Gries summary of
``counters`` digests per task, merged by a sum, names every digest that may hold
more than 1/``counters`` of the rows.  The exact winner and count of each of them
come from an aggregation that combines on the map side, and these at most
``counters`` rows are broadcast: copies of frequent texts are settled where they
stand and never shuffled.  All other digests use an ordinary shuffle, whose
groups the summary bounds to that same share.

Of equal texts the row with the most code points in its original text stays, then
the smallest id (null ids last).  Of rows that repeat that id and length exactly
one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise
from .textvec import WHITE_BYTES, slices, tidy

#: Counters of a Misra-Gries summary; also the most rows that are broadcast.
COUNTERS = 4096
#: Bytes of text that are digested together.
SLICE = 1 << 19

_DIGEST = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_sha", T.StringType()),
                        T.StructField("_points", T.LongType())])


@tidy
def digest_texts(batches):
    """Append the digest of the white-space-free text and the code points of the
    original text to every row (last column: the text, dropped)."""
    for batch in batches:
        last = batch.num_columns - 1
        for lo, hi, data, offsets in slices(batch.column(last), SLICE):
            raw = data.tobytes()
            sha, points = [], []
            edges = offsets.tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                text = raw[a:b]
                sha.append(hashlib.sha256(text.translate(None, WHITE_BYTES)).hexdigest())
                points.append(len(text) if text.isascii() else len(text.decode()))
            keep = [batch.column(i).slice(lo, hi - lo) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sha, pa.string()), pa.array(points, pa.int64())],
                                             names=[*batch.schema.names[:-1], "_sha", "_points"])


def misra_gries(counters: int):
    """Per task: at most ``counters`` (digest, lower bound of its count) rows."""
    @tidy
    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for item in batch.column(0).to_pylist():
                if item in held:
                    held[item] += 1
                elif len(held) < counters:
                    held[item] = 1
                else:
                    held = {k: n - 1 for k, n in held.items() if n > 1}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                         names=["_sha", "n"])
    return run


def digest_summary(counters: int):
    """``misra_gries`` of the digests of the texts (only column), in one worker: a second
    Python operator behind the first would hold a second worker for every core."""
    def run(batches):
        return misra_gries(counters)(d.select(["_sha"]) for d in digest_texts(batches))
    return run


_SUMMARY = "_sha string, n long"


def frequent(digests: DataFrame, summary: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Winner and exact count of the digests that the merged summaries (_sha, n) rank
    first: (_sha, _size, _win_points, _win_id), at most ``counters`` rows.

    Only digests seen at least twice are kept, as a text without copies gains
    nothing from a broadcast."""
    first = (summary.groupBy("_sha").agg(F.sum("n").alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "_sha").limit(counters).select("_sha"))
    return (digests.join(F.broadcast(first), "_sha")
            .groupBy("_sha")
            .agg(F.count(F.lit(1)).alias("_size"), F.min(_order()).alias("_first"))
            .select("_sha", "_size", F.col("_first")["k"].alias("_win_points"),
                    F.col("_first")["id"].alias("_win_id")))


def _order():
    """Smaller is better: more code points, then the smaller id, null ids last."""
    return F.struct((-F.col("_points")).alias("k"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))


def settle(digests: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of ``digests`` (_id, _sha, _points, any others) with keep_id,
    group_size and kept; ``top``: the frequent digests' winners.

    A frequent digest's copies are settled against the broadcast winners; only rows
    that carry the winner's id and length go on, so that rows repeating them can be
    told apart by the shuffle that serves all other digests."""
    d = digests.join(F.broadcast(top), "_sha", "left")
    lost = F.col("_size").isNotNull() & ~((-F.col("_points") == F.col("_win_points"))
                                          & F.col("_id").eqNullSafe(F.col("_win_id")))
    removed = d.where(lost).select(*digests.columns, F.col("_win_id").alias("keep_id"),
                                   F.col("_size").alias("group_size"), F.lit(False).alias("kept"))
    w = Window.partitionBy("_sha")
    ranked = w.orderBy(_order())
    rest = (d.where(~lost)
            .withColumn("_n", F.count(F.lit(1)).over(w))
            .withColumn("_first_id", F.first("_id").over(ranked))
            .withColumn("_place", F.row_number().over(ranked))
            .select(*digests.columns, F.col("_first_id").alias("keep_id"),
                    F.coalesce("_size", "_n").alias("group_size"), (F.col("_place") == 1).alias("kept")))
    return removed.unionByName(rest)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialise(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
            .mapInArrow(digest_texts, _DIGEST), "digests")
    summary = digests.select("_sha").mapInArrow(misra_gries(counters), _SUMMARY)
    return settle(digests, frequent(digests, summary, counters)).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Frequent copies are removed on the map side; the rest is shuffled once with
    its rows, so that rows that repeat an id are told apart.  The passes that find the
    frequent ones read ids and texts only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    schema = T.StructType([_DIGEST.fields[0], T.StructField("_row", docs.schema), *_DIGEST.fields[1:]])
    own, text = F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")
    summary = docs.select(text).mapInArrow(digest_summary(counters), _SUMMARY)
    top = frequent(docs.select(own, text).mapInArrow(digest_texts, _DIGEST), summary, counters)
    kept = settle(docs.select(own, row, text).mapInArrow(digest_texts, schema), top).where("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
