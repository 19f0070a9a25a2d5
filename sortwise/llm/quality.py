"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  They overlap: every
fault that is worth a rejection shows to two of them at least, which is what lets
their agreement tell an accurate labeller from a poor one.
Expectation-maximisation over the counts of vote patterns (all documents; there are
at most 3 to the power of the labellers, 4 MB, so the table is bounded) estimates each
labeller's accuracies and the share of bad documents, and gives each pattern the
posterior probability that its documents are good.  Posterior labels train a hashed
linear scorer (byte 2- and 3-grams, and the votes) on ``SAMPLE`` distinct texts, the
first by hash; copies of a text count once there, so a large group of copies neither
fills the sample nor changes which other texts are in it.  The scorer then reads every
document.  A document is rejected if its score is under ``KEEP``.

A very long text is a slice of its own, its n-grams are read in blocks.  Null and empty texts have no bytes and no words: their labellers vote bad, and their
score is the posterior of their votes.  Repeated rows count and are scored each; an
empty table gives an empty result; a sample of one kind only leaves the posterior of
the votes as the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host_rules import repeated_words
from .scratch import map_rows
from .textvec import WHITE, WHITE_BYTES, mix, slices, span_hashes, tidy, word_spans

#: Distinct texts on whose posterior labels the scorer is trained.
SAMPLE = 6000
#: Bytes of text that are judged together; the n-grams of a slice take thirty times that.
SLICE = 1 << 18
KEEP = 0.5
BUCKETS = 1 << 16

GOOD, BAD, NONE = 1, 0, 2


def _per(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _STOP, _CRY = _table(b"#*$%&|<>"), _table(b".!?"), _table(b"!")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum()))


def _line_share(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, some, again = data.tobytes(), [], []
    edges = offsets.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(WHITE_BYTES)]
        some.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    return np.array(some), np.array(again)


#: What each labeller looks at.
LABELLERS = ("symbols", "letters", "bare_marks", "marked_words", "capitals", "exclamations", "repetition", "variety",
             "lines", "length", "word_length", "sentences")


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of every labeller (columns) on every text."""
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    count = np.bincount(doc, minlength=n)
    w = np.maximum(count, 1)
    ink = ~WHITE[data]
    letter = _LETTER[data]
    letters = np.concatenate([[0], np.cumsum(letter)])
    size = np.maximum(_per(ink, offsets), 1)
    chars = np.maximum(_per(ink & ((data & 0xC0) != 0x80), offsets), 1)
    lines, again = _line_share(data, offsets)
    with np.errstate(over="ignore"):
        own = np.unique(mix(words + mix(doc.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(doc[own], minlength=n)

    def low(share, good, bad, least=0):
        """Good up to one share, bad above another, nothing under so many words."""
        return np.where(count < least, NONE, np.where(share > bad, BAD, np.where(share <= good, GOOD, NONE)))

    length = chars / w
    stops = _per(_STOP[data], offsets) / w
    bare = np.bincount(doc[letters[end] == letters[start]], minlength=n)
    marked = np.bincount(doc[~letter[end - 1]], minlength=n) if len(end) else count
    return np.stack([
        low(_per(_SYMBOL[data], offsets) / w, 0.02, 0.2),
        low(1 - _per(letter, offsets) / size, 0.06, 0.12, 5),
        low(bare / w, 0.03, 0.15, 5),
        low(marked / w, 0.35, 0.6, 5),
        low(_per(_UPPER[data], offsets) / chars, 0.1, 0.4),
        low(_per(_CRY[data], offsets) / w, 0.02, 0.2),
        low(repeated_words(words, doc, n) / w, 0.1, 0.5),
        low(1 - distinct / w, 0.6, 0.75, 50),
        np.where(again >= 3, low(again / np.maximum(lines, 1), 0.1, 0.3), np.where(again == 0, GOOD, NONE)),
        np.where(count < 10, BAD, np.where(count < 30, NONE, GOOD)),
        np.where((length > 14) | (length < 2), BAD, np.where((length > 3) & (length < 9), GOOD, NONE)),
        np.where(count < 60, NONE, np.where((stops < 0.005) | (stops > 0.5), BAD, np.where(stops > 0.02, GOOD, NONE))),
    ], axis=1).astype(np.int64)


_POWERS = 3 ** np.arange(len(LABELLERS))


@tidy
def _patterns(batches):
    held = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), SLICE):
            held += np.bincount(votes(data, offsets) @ _POWERS, minlength=len(held))
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["pattern", "n"])


def pattern_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many documents show each vote pattern; summed on the map side."""
    rows = (docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_patterns, "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
    out[rows["pattern"].to_numpy()] = rows["n"].to_numpy()
    return out


def em(counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" for every pattern, and each labeller's vote probabilities
    (labeller, class, vote).  Texts with two bad votes start out as bad, others as good.
    An abstention is no evidence.  Patterns that no document shows get the posterior of
    the model found."""
    k = len(LABELLERS)
    some = np.flatnonzero(counts)
    vote, weight = (some[:, None] // _POWERS) % 3, counts[some].astype(np.float64)
    p = np.where((vote == BAD).sum(axis=1) >= 2, 0.05, 0.95)
    table, prior = np.ones((k, 2, 3)), 0.9

    def posterior(patterns):
        z = np.full(len(patterns), np.log(prior / (1 - prior)))
        for j in range(k):
            ratio = np.log(table[j, GOOD]) - np.log(table[j, BAD])
            z += ratio[patterns // _POWERS[j] % 3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(rounds):
        prior = np.clip((weight * p).sum() / max(weight.sum(), 1), 0.01, 0.99)
        for j in range(k):
            for c, q in ((BAD, 1 - p), (GOOD, p)):
                # pseudo-counts hold labellers to being right more often than not
                own = np.bincount(vote[:, j], weights=weight * q, minlength=3)[:NONE]
                own = own + np.array([4.0, 1.0] if c == BAD else [1.0, 4.0])
                table[j, c, :NONE] = own / own.sum()
        p = posterior(some)
    return posterior(np.arange(3 ** k)), table


def bucket_sums(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of every text's byte 2-grams and 3-grams, and their number."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets) - 1, 0) + np.maximum(np.diff(offsets) - 2, 0)
    total = np.zeros(n)
    for k in range(0, len(data), SLICE):  # one very long text: block by block
        part = data[k: k + SLICE + 2]
        at, owner = buckets(part, np.clip(offsets - k, 0, len(part)), SLICE)
        total += np.bincount(owner, weights=weight[at], minlength=n)
    return total, size


def buckets(data: np.ndarray, offsets: np.ndarray, begin: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every byte 2-gram and 3-gram that starts before ``begin``."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int32)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    wide = data.astype(np.uint64)
    two = wide[:-1] << np.uint64(8) | wide[1:]
    three = two[:-1] << np.uint64(8) | wide[2:]
    a, b = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    if begin is not None:
        a[begin:], b[begin:] = False, False
    at = np.concatenate([mix(two[a]) >> np.uint64(48), mix(three[b] | np.uint64(1 << 24)) >> np.uint64(48)])
    return at.astype(np.uint16), np.concatenate([owner[:-1][a], owner[:-2][b]])


class LinearScorer:
    """Mean weight of a text's n-grams, shrunk for short texts, and a weight for every
    vote, through a logistic function."""

    #: N-grams that a text's mean is shrunk by.
    SHRINK = 200

    def __init__(self):
        self.weight, self.vote, self.bias = np.zeros(BUCKETS), np.zeros(3 * len(LABELLERS)), 0.0

    def _read(self, data, offsets):
        at, owner = buckets(data, offsets)
        size = np.bincount(owner, minlength=len(offsets) - 1) + self.SHRINK
        cast = votes(data, offsets)
        return at, owner, size, cast

    def _logits(self, grams, size, cast) -> np.ndarray:
        own = self.vote[cast + 3 * np.arange(len(LABELLERS))]
        return grams / size + (own * (cast != NONE)).sum(axis=1) + self.bias

    def logits(self, data, offsets, cast) -> np.ndarray:
        """``cast``: the texts' votes."""
        grams, size = bucket_sums(data, offsets, self.weight)
        return self._logits(grams, size + self.SHRINK, cast)

    def train(self, texts: list[bytes], target: np.ndarray, epochs: int = 8, batch: int = 50, rate: float = 1.0, seed: int = 5):
        rng = np.random.default_rng(seed)
        rates = {"weight": rate, "vote": rate / 20}
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in rates}
        weight = np.where(target < 0.5, 0.5 / max((target < 0.5).mean(), 1e-3), 0.5 / max((target >= 0.5).mean(), 1e-3))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                part = order[k: k + batch]
                offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
                at, owner, size, cast = self._read(np.frombuffer(b"".join([texts[i] for i in part]), dtype=np.uint8), offsets)
                z = self._logits(np.bincount(owner, weights=self.weight[at], minlength=len(size)), size, cast)
                some, column = cast != NONE, cast + 3 * np.arange(len(LABELLERS))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part] / len(part)
                step += 1
                for name, grad in (("weight", np.bincount(at, weights=(err / size)[owner], minlength=BUCKETS)),
                                   ("vote", np.bincount(column.ravel(), weights=(err[:, None] * some).ravel(), minlength=len(self.vote)))):
                    m, s = state[name]
                    m *= 0.9
                    m += 0.1 * grad
                    s *= 0.999
                    s += 0.001 * grad * grad
                    value = getattr(self, name)
                    value -= rates[name] * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-6)
                self.bias -= 0.1 * err.sum()
        return self


class Classifier:
    """Posterior of each vote pattern, and the scorer trained on it (None: votes only)."""

    def __init__(self, posterior: np.ndarray, scorer: LinearScorer | None):
        self.posterior, self.scorer = posterior, scorer

    def judge(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of the votes, score) of every text."""
        cast = votes(data, offsets)
        p = self.posterior[cast @ _POWERS]
        if self.scorer is None:
            return p, p
        score = 1 / (1 + np.exp(-np.clip(self.scorer.logits(data, offsets, cast), -30, 30)))
        return p, np.where(np.diff(offsets) < 2, p, score)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    counts = pattern_counts(docs, text_col)
    posterior, _ = em(counts)
    total = int(counts.sum())
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    if total > sample:  # about ``sample`` texts if all are distinct; order and limit settle the rest
        share = int(sample / total * (1 << 31))
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < share)
    texts = texts.distinct().orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 31)), "text").limit(sample)
    rows = sorted(t.encode() for t in texts.toArrow()["text"].to_pylist())
    if not rows:
        return Classifier(posterior, None)
    target = []
    for k in range(0, len(rows), 100):  # a few texts at a time: the driver is small
        part = rows[k: k + 100]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        target.append(posterior[votes(np.frombuffer(b"".join(part), dtype=np.uint8), offsets) @ _POWERS])
    target = np.concatenate(target)
    if (target < 0.5).all() or (target >= 0.5).all():
        return Classifier(posterior, None)
    return Classifier(posterior, LinearScorer().train(rows, target))


def _judge(model):
    @tidy
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), SLICE):
                p, score = model.value.judge(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array(score), pa.array(score >= KEEP)],
                    names=["doc_id", "posterior", "score", "kept"])
    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior, score, kept of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, sample))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _judge(model), "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, as they are; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, sample))
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at), SLICE):
                _, score = model.value.judge(data, offsets)
                yield batch.slice(lo, hi - lo).filter(pa.array(score >= KEEP))
    return map_rows(docs, run)
