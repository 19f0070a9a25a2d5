"""Cross-entropy difference of matched target and background n-gram models.

Both models share one vocabulary, the tokens of a public tokenizer file.  They are
token bigram models that back off to the token's own share:

p(w | h) = (count(h w) + WEIGHT p(w)) / (count(h) + WEIGHT),
p(w) = (count(w) + ADD) / (tokens + ADD vocabulary),

h a text's start or the token before, counted exactly over every document of either
corpus, with the same smoothing; nothing is pruned, capped or hashed together, so the
table of bigrams grows with the corpus.  The models are matched: the background's
counts are scaled to the target's number of tokens, so neither is sharper only for
having read more.

Texts are tokenised once, into blocks of at most about ``BLOCK`` tokens of one task and
fold.  A block sends each of its distinct bigrams once, with its counts, to the
bigram's place in a table keyed by it; there all blocks' counts are summed, and joined
back to every block that asks.  Only token counts, whose number is the vocabulary's,
are broadcast.  Counts are kept for two folds of the ids, and a document is scored by
the models of the other fold, as a text that a model has counted itself would look
like its corpus.

A document's score is the mean over its tokens of the target's loss less the
background's (nats; lower: more like the target).

Null and empty texts have no tokens: losses and score 0.  Repeated rows are scored
and counted each; an empty table gives an empty result; without any target text the
target's model is uniform over the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import materialise
from .textvec import slices

#: Classes of the models: every token of the registered query's vocabulary is its own.
CLASSES = 50_257
#: Smoothing: added count of a token, and weight of p(token) in p(token | token).
ADD = 0.1
WEIGHT = 8.0
FOLDS = 2
#: Tokens from which on a block is full.
BLOCK = 1 << 21


class Layout:
    """Class of every token (itself) and members of every class; the class before a
    text's first token is ``size``."""

    def __init__(self, size: int):
        self.size = size
        self.of = np.arange(size)
        self.members = np.ones(size, dtype=np.int64)

    def keys(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bigram ending at every token, as one number; ``sizes`` are the texts' tokens."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.size
        return before * self.size + ids


def _layout(vocabulary: str) -> Layout:
    return Layout(len(encoder(vocabulary).v.token))


def _tokens(texts: pa.Array, vocabulary: str):
    """(first row, rows, ids, text of each id) per slice."""
    enc = encoder(vocabulary)
    for lo, hi, _, _ in slices(texts):
        part = ["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()]
        rows, stops = enc.encode(part)
        upto = np.concatenate([[0], np.cumsum(enc.count[rows])])[stops]
        doc = np.repeat(np.arange(hi - lo), np.diff(np.concatenate([[0], upto])))
        yield lo, hi - lo, enc.flat_ids(rows).astype(np.int64), doc


def _fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS, F.lit(0)).cast("int")


_BLOCKS = "block long, fold int, doc_id array<long>, target array<boolean>, sizes array<int>, ids binary"


def _read(vocabulary: str):
    """Blocks of tokenised texts: each of one fold, with its rows' ids, targets, numbers
    of tokens, and tokens end to end."""
    def run(batches):
        kind = np.min_scalar_type(_layout(vocabulary).size)
        held = [[] for _ in range(FOLDS)]
        room = [BLOCK] * FOLDS
        number = TaskContext.get().partitionId() << 32

        def block(f):
            nonlocal number
            rows = [np.concatenate(x) for x in zip(*held[f], strict=True)]
            held[f], room[f] = [], BLOCK
            number += 1
            ids = pa.array(rows[1], pa.int64(), mask=rows[0])
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                      for x in (ids, pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.int32()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([f], pa.int32()), *arrays, pa.array([rows[4].tobytes()], pa.binary())],
                names=["block", "fold", "doc_id", "target", "sizes", "ids"])

        for batch in batches:
            known = batch.column(0)
            blank = known.is_null().to_numpy(zero_copy_only=False)
            docs = known.fill_null(0).to_numpy(zero_copy_only=False)
            folds = batch.column(1).to_numpy(zero_copy_only=False)
            target = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, n, ids, doc in _tokens(batch.column(3), vocabulary):
                part, sizes = slice(lo, lo + n), np.bincount(doc, minlength=n)
                for f in range(FOLDS):
                    mine = folds[part] == f
                    if mine.any():
                        own = ids[mine[doc]].astype(kind)
                        held[f].append((blank[part][mine], docs[part][mine], target[part][mine], sizes[mine], own))
                        room[f] -= len(own) + mine.sum()
                    if room[f] <= 0:
                        yield block(f)
        for f in range(FOLDS):
            if held[f]:
                yield block(f)
    return run


def _unpacked(table, k: int, layout: Layout):
    """Texts' target flags and numbers of tokens, and the tokens, of one block."""
    values = lambda name: table[name][k].values.to_numpy(zero_copy_only=False)
    raw = table["ids"][k].as_py()
    return values("target"), values("sizes"), np.frombuffer(raw, dtype=np.min_scalar_type(layout.size)).astype(np.int64)


_GRAMS = "block long, fold int, gram long, every long, target long"


def _grams(vocabulary: str):
    """Each block's distinct bigrams with their counts in either corpus."""
    def run(batches):
        layout = _layout(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                target, sizes, ids = _unpacked(batch, k, layout)
                gram, at, every = np.unique(layout.keys(ids, sizes), return_inverse=True, return_counts=True)
                good = np.bincount(at[np.repeat(target, sizes)], minlength=len(gram))
                for lo in range(0, len(gram), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    n = len(gram[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch.column(0)[k].as_py()), pa.int64()),
                         pa.array(np.full(n, batch.column(1)[k].as_py()), pa.int32()),
                         *(pa.array(x[part], pa.int64()) for x in (gram, every, good))],
                        names=["block", "fold", "gram", "every", "target"])
    return run


_COUNTS = "fold int, corpus int, as_context int, token int, n long"


def _count(vocabulary: str):
    """A task's counts of tokens, and of what bigrams begin with, for each fold and corpus."""
    def run(batches):
        layout = _layout(vocabulary)
        table = np.zeros((FOLDS, 2, 2, layout.size + 1), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                target, sizes, ids = _unpacked(batch, k, layout)
                keys, own = layout.keys(ids, sizes), np.repeat(target, sizes)
                for corpus, some in ((0, keys), (1, keys[own])):
                    for context, x in ((0, some % layout.size), (1, some // layout.size)):
                        table[batch.column(1)[k].as_py(), corpus, context] += np.bincount(x, minlength=layout.size + 1)
        at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in at), pa.array(table[at])],
                                         names=["fold", "corpus", "as_context", "token", "n"])
    return run


def token_counts(blocks: DataFrame, vocabulary: str) -> np.ndarray:
    """Counts by fold, corpus (0: all, 1: target) and place (0: token, 1: context)."""
    rows = (blocks.mapInArrow(_count(vocabulary), _COUNTS).groupBy("fold", "corpus", "as_context", "token")
            .agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros((FOLDS, 2, 2, _layout(vocabulary).size + 1), dtype=np.int64)
    at = tuple(rows[c].to_numpy() for c in ("fold", "corpus", "as_context", "token"))
    table[at] = rows["n"].to_numpy()
    return table


class Model:
    """A corpus' share of every token and count of every context, out of scaled counts."""

    def __init__(self, counts: np.ndarray, layout: Layout, scale: float = 1.0):
        token = counts[0, : layout.size] * scale
        self.scale = scale
        self.share = (token + ADD) / (token.sum() + ADD * layout.size)
        self.context = counts[1] * scale

    def loss(self, gram: np.ndarray, n: np.ndarray, layout: Layout) -> np.ndarray:
        before, own = gram // layout.size, gram % layout.size
        return -np.log((n * self.scale + WEIGHT * self.share[own]) / (self.context[before] + WEIGHT))


def matched_models(counts: np.ndarray, layout: Layout) -> list[tuple[Model, Model]]:
    """(target, background) of each fold."""
    out = []
    for every, target in counts:
        scale = target[0].sum() / max(int(every[0].sum()), 1)
        out.append((Model(target, layout), Model(every, layout, float(scale))))
    return out


_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _score(models, vocabulary: str):
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        layout, k = _layout(vocabulary), 0
        _, sizes, ids = _unpacked(block, k, layout)
        gram, at = np.unique(layout.keys(ids, sizes), return_inverse=True)
        place = np.searchsorted(gram, found["gram"].to_numpy())
        loss = []
        for model, column in zip(models.value[1 - block["fold"][k].as_py()], ("target", "every"), strict=True):
            n = np.zeros(len(gram))
            n[place] = found[column].to_numpy()
            loss.append(model.loss(gram, n, layout)[at])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        t, b, d = (np.bincount(doc, weights=x, minlength=len(sizes)) / np.maximum(sizes, 1) for x in (*loss, loss[0] - loss[1]))
        return pa.table([block["doc_id"][k].values, pa.array(sizes, pa.int64()), pa.array(t), pa.array(b), pa.array(d)],
                        names=[f.split()[0] for f in _SCORES.split(", ")])
    return run


def other_counts(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """block, gram, every, target: the other fold's counts of each bigram of a block, where
    it has any.  A bigram's rows are one per block, whatever its count."""
    rows = Window.partitionBy("gram")
    grams = blocks.mapInArrow(_grams(vocabulary), _GRAMS)
    other = {c: [F.sum(F.when(F.col("fold") == 1 - f, F.col(c)).otherwise(0)).over(rows) for f in range(FOLDS)]
             for c in ("every", "target")}
    return grams.select("block", "gram", *(F.when(F.col("fold") == 0, a).otherwise(b).alias(c) for c, (a, b) in other.items())
                        ).where("every > 0")


def scores(docs: DataFrame, target: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs``; the
    background is all of ``docs``, the target corpus its rows where ``target`` holds."""
    blocks = materialise(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), _fold(id_col).alias("fold"),
        F.coalesce(target, F.lit(False)).alias("target"),
        F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_read(vocabulary), _BLOCKS), "blocks")
    held = docs.sparkSession.sparkContext.broadcast(
        matched_models(token_counts(blocks, vocabulary), _layout(vocabulary)))
    return blocks.groupBy("block").cogroup(other_counts(blocks, vocabulary).groupBy("block")).applyInArrow(
        _score(held, vocabulary), _SCORES)
