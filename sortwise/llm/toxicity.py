"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word (white space delimited, outer punctuation off, A-Z lower-cased) is the mean of
the vectors of its byte 3-, 4- and 5-grams, boundaries marked, and of the whole word,
all hashed into ``BUCKETS`` rows; a misspelling never seen shares most of them.  A
text is read in every window of ``WINDOW`` words in a row (one window, if it is
shorter); a window is the mean of its words, goes into a linear softmax, and the text
scores as its most toxic window, so a few words in a long text are not diluted,
wherever they stand.  Vectors and softmax are trained jointly in numpy:
first on whole texts, then on each text's highest window.  A quarter of the sample is
held back to calibrate the score at the decision threshold.

The model is fitted on at most ``POSITIVE`` and ``NEGATIVE`` labelled rows, the first by
hash of their id, with the caller's condition on ids.  Everything else covers all rows.

Null and empty texts score as a window without words.  Repeated rows get a row each;
an empty table gives an empty result.  Without labels of both kinds the score is 0.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import LOWER, slices, span_hashes, word_spans

BUCKETS = 1 << 16
DIM = 8
WINDOW = 12
#: Words that the window of a shorter text is averaged over at least.
LEAST = 6
#: Word logits are summed as whole multiples of 1 / STEPS, so a window's sum is exact.
STEPS = 1 << 30
POSITIVE, NEGATIVE = 3000, 5000
THRESHOLD = 0.7

_OUTER = np.zeros(256, dtype=bool)
_OUTER[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def trimmed_words(data: np.ndarray, offsets: np.ndarray):
    """Spans and text index of words without outer punctuation (all punctuation: as is)."""
    start, end, doc = word_spans(data, offsets)
    first, last = start.copy(), end.copy()
    for _ in range(8):
        cut = (last - 1 > first) & _OUTER[data[np.maximum(last - 1, 0)]]
        last = last - cut
        skip = (first + 1 < last) & _OUTER[data[np.minimum(first, len(data) - 1)]]
        first = first + skip
        if not (cut.any() or skip.any()):
            break
    return first, last, doc


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, end to end, and where each word's begin."""
    marked = [b"<" + w + b">" for w in words]
    flat = np.frombuffer(b"".join(marked), dtype=np.uint8)
    size = np.array([len(w) for w in marked], dtype=np.int64)
    begin = np.cumsum(size) - size
    starts, ends, owner = [begin], [begin + size], [np.arange(len(words))]
    place = np.arange(len(flat))
    who = np.repeat(np.arange(len(words)), size)
    stop = np.repeat(begin + size, size)
    for n in (3, 4, 5):
        ok = place + n <= stop
        starts.append(place[ok])
        ends.append(place[ok] + n)
        owner.append(who[ok])
    owner_ = np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    grams = (span_hashes(flat, np.concatenate(starts)[order], np.concatenate(ends)[order]) % np.uint64(BUCKETS))
    return grams.astype(np.int64), np.searchsorted(owner_[order], np.arange(len(words)))


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct words as bytes, the index of each word of the texts, and its text."""
    low = LOWER[data]
    start, end, doc = trimmed_words(low, offsets)
    _, first, inverse = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], inverse, doc


def best_windows(logit: np.ndarray, doc: np.ndarray, n_docs: int):
    """Texts with words, and the first word, the end and the mean word logit of each
    one's highest window (the first of equals)."""
    stop = np.searchsorted(doc, np.arange(n_docs), side="right")
    begin = np.append(0, stop[:-1]) if n_docs else stop
    texts = np.flatnonzero(stop > begin)
    begin, stop = begin[texts], stop[texts]
    if not len(texts):
        return texts, begin, stop, np.zeros(0)
    upto = np.append(0, np.cumsum(np.rint(logit * STEPS).astype(np.int64)))
    count = np.maximum(stop - begin - WINDOW + 1, 1)
    head = np.cumsum(count) - count
    start = np.arange(count.sum()) + np.repeat(begin - head, count)
    end = np.minimum(start + WINDOW, np.repeat(stop, count))
    mean = (upto[end] - upto[start]) / STEPS / np.maximum(end - start, LEAST)
    high = np.maximum.reduceat(mean, head)
    at = np.flatnonzero(mean == np.repeat(high, count))
    top = at[np.searchsorted(at, head)]
    return texts, start[top], end[top], high


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.out = rng.normal(0, 0.5, (2, DIM))
        self.bias = np.zeros(2)
        self.scale, self.shift = 1.0, 0.0

    def weights(self) -> np.ndarray:
        """Each bucket's share of the logit of the toxic class against the other."""
        return self.vectors @ (self.out[1] - self.out[0])

    def word_logits(self, grams, begin) -> np.ndarray:
        return np.add.reduceat(self.weights()[grams], begin) / np.diff(np.append(begin, len(grams)))


class Scorer:
    """What the executors need: one weight a bucket."""

    def __init__(self, model: Model):
        self.weight = model.weights().astype(np.float32)
        self.bias = float(model.bias[1] - model.bias[0])
        self.scale, self.shift = model.scale, model.shift

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        words, inverse, doc = distinct_words(data, offsets)
        best = np.zeros(n)
        if words:
            grams, begin = subwords(words)
            per = np.add.reduceat(self.weight[grams].astype(np.float64), begin) / np.diff(np.append(begin, len(grams)))
            texts, _, _, high = best_windows(per[inverse], doc, n)
            best[texts] = high
        return best + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(data, offsets) + self.shift, -40, 40)))


class Corpus:
    """Distinct words of many texts as subword buckets, and the words of each text; read
    a few texts at a time, as the driver that holds it is small."""

    def __init__(self, texts: list[bytes], step: int = 200):
        known = np.zeros(0, dtype=np.uint64)
        grams, sizes, uses, counts = [], [], [], []
        for k in range(0, len(texts), step):
            part = texts[k: k + step]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            low = LOWER[np.frombuffer(b"".join(part), dtype=np.uint8)]
            start, end, doc = trimmed_words(low, offsets)
            hashes = span_hashes(low, start, end)
            uniq, first = np.unique(hashes, return_index=True)
            new = ~np.isin(uniq, known)
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            if words:
                g, begin = subwords(words)
                grams.append(g.astype(np.uint16))
                sizes.append(np.diff(np.append(begin, len(g))))
                known = np.concatenate([known, uniq[new]])
            order = np.argsort(known)
            uses.append(order[np.searchsorted(known, hashes, sorter=order)].astype(np.int32))
            counts.append(np.bincount(doc, minlength=len(part)))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint16)
        size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.stop = np.cumsum(size)
        self.begin = self.stop - size
        self.uses = np.concatenate(uses) if uses else np.zeros(0, dtype=np.int32)
        self.cut = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64)


def train(texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 100,
          rate: float = 0.03, decay: float = 0.3, seed: int = 11) -> Model:
    """Joint training by Adam with decay of the vectors, so that words of a single text
    don't outweigh those that many share; the first half of the steps, in whole epochs,
    averages whole texts, so that marks of few positives are learnt before the choice of
    a window can miss them.  The rate falls to nothing."""
    model, rng = Model(seed), np.random.default_rng(seed)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("v", model.vectors), ("o", model.out), ("b", model.bias))}
    corpus = Corpus(texts)
    inverse, grams, begin, stop, cut = corpus.uses, corpus.grams, corpus.begin, corpus.stop, corpus.cut
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    step = 0
    each = -(-len(texts) // batch)
    epochs = max(4, -(-steps // each))
    warm = -(-epochs // 2)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            part = order[k: k + batch]
            mine = np.concatenate([inverse[cut[d]: cut[d + 1]] for d in part])
            owner = np.repeat(np.arange(len(part)), cut[part + 1] - cut[part])
            if not len(mine):
                continue
            used, local = np.unique(mine, return_inverse=True)
            size = stop[used] - begin[used]
            at = np.repeat(begin[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            sub, first = grams[at], np.cumsum(size) - size
            if epoch < warm:
                chosen = np.arange(len(mine))
                group, low = owner, 1
            else:
                _, start, end, _ = best_windows(model.word_logits(sub, first)[local], owner, len(part))
                many = end - start
                chosen = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
                group, low = owner[chosen], LEAST
            # forward and backward over the chosen words
            act, back = np.unique(local[chosen], return_inverse=True)
            asize = size[act]
            aat = np.repeat(first[act] - (np.cumsum(asize) - asize), asize) + np.arange(asize.sum())
            agram, afirst = sub[aat], np.cumsum(asize) - asize
            vec = np.add.reduceat(model.vectors[agram], afirst, axis=0) / asize[:, None]
            number = np.maximum(np.bincount(group, minlength=len(part)), low)
            bag = np.zeros((len(part), DIM))
            np.add.at(bag, group, vec[back])
            bag /= number[:, None]
            z = bag @ model.out.T + model.bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part].astype(int)] -= 1
            p *= (weight[part] / len(part))[:, None]
            dbag = (p @ model.out) / number[:, None]
            dvec = np.zeros_like(vec)
            np.add.at(dvec, back, dbag[group])
            dgram = np.repeat(dvec / asize[:, None], asize, axis=0)
            grad = np.stack([np.bincount(agram, weights=dgram[:, j], minlength=BUCKETS) for j in range(DIM)], axis=1)
            step += 1
            now = rate * max(0.02, 1 - step / (each * epochs))
            model.vectors *= 1 - now * decay
            for name, value, g in (("v", model.vectors, grad), ("o", model.out, p.T @ bag), ("b", model.bias, p.sum(axis=0))):
                m, s = state[name]
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                value -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return model


def calibrate(model: Model, texts: list[bytes], labels: np.ndarray, threshold: float = THRESHOLD) -> None:
    """Scale and shift of the logit such that ``threshold`` stands where the share of
    held-back positives missed and that of others taken are least in sum (in the middle
    of the gap, where there is one)."""
    scorer, parts = Scorer(model), []
    for k in range(0, len(texts), 200):
        part = texts[k: k + 200]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        parts.append(scorer.logits(np.frombuffer(b"".join(part), dtype=np.uint8), offsets))
    z = np.concatenate(parts)
    order = np.argsort(z)
    z, y = z[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
    false = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
    cost = missed + false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    k = max(best, key=lambda i: edges[i + 1] - edges[i])
    cut = (edges[k] + edges[k + 1]) / 2
    spread = max(np.median(np.abs(z - cut)), 1e-3)
    model.scale = 3.0 / spread
    model.shift = float(np.log(threshold / (1 - threshold)) - model.scale * cut)


def sample(docs: DataFrame, labels: DataFrame, positive: int, negative: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the first labelled ids by hash, bounded for each class."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, positive), (0, negative))]
    ids = picked[0].unionByName(picked[1]).collect()
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r[0], int(r[1])) for r in ids], "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").where("text IS NOT NULL").select("text", "toxic").toArrow()
    texts = [t.encode() for t in rows["text"].to_pylist()]
    order = sorted(range(len(texts)), key=lambda i: texts[i])  # the order of rows doesn't matter
    y = rows["toxic"].to_numpy()
    return [texts[i] for i in order], y[order].astype(np.int64) if len(order) else np.zeros(0, dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Scorer | None:
    """A scorer learnt from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    texts, y = sample(docs, labels, positive, negative)
    if len(set(y.tolist())) < 2:
        return None
    order = np.random.default_rng(5).permutation(len(texts))
    held, rest = order[: len(order) // 4], order[len(order) // 4:]
    model = train([texts[i] for i in rest], y[rest])
    calibrate(model, [texts[i] for i in held], y[held]) if len(set(y[held].tolist())) == 2 else \
        calibrate(model, texts, y)
    return Scorer(model)


def _score(scorer, batches):
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            s = scorer.value
            p = np.zeros(hi - lo) if s is None else s.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], names=["doc_id", "score"])


def toxicity(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``docs``; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        partial(_score, held), "doc_id long, score double")
