"""Document rules judged with the help of their host.

Every document gets counts (``features``) and rule failures.  Failures are summed by
host (``source``); each host's failure rate is shrunk towards all hosts with a
beta prior fitted to the hosts' own rates (method of moments).  A host whose
shrunk rate reaches ``bad_rate`` is distrusted, and the verdict is joined back:
documents of distrusted hosts must meet the strict limits, all others the usual
ones.  A clean document thus stays wherever it stands, and one bad document does
not condemn a small host.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words and fail the
base rule.  A null host is a host of its own (shown as null).  Repeated rows count
as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .textvec import WHITE_BYTES, mix, slices, windows, word_hashes, WHITE

#: Shrunk failure rate from which a host is distrusted.
BAD_RATE = 0.5
#: Percent of words, lines or characters: (usual, strict).
SYMBOLS = (10, 5)
DUP_LINES = (30, 15)
#: Repeated lines from which their share counts.
LEAST_DUP_LINES = 3
UPPER = (40, 20)
#: Mean word length in code points: usual and strict upper limits, and the lower one.
LONG_WORD = (12, 10)
SHORT_WORD = 2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True

_FEATURES = ("doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, "
             "n_dup_lines long, n_repeat_words long, n_upper long")
_NAMES = [f.split()[0] for f in _FEATURES.split(", ")]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Count of set flags in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 3) -> np.ndarray:
    """Per text, the words that stand in a window of ``size`` words found twice or more."""
    hashes, at = windows(words, doc, size)
    with np.errstate(over="ignore"):
        own = mix(hashes + mix(doc[at].astype(np.uint64)))
    _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    marked = np.zeros(len(words), dtype=bool)
    for k in range(size):
        marked[again + k] = True
    return np.bincount(doc[marked], minlength=n_docs)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Lines with a word, and those equal to an earlier line, per text."""
    raw, some, again = data.tobytes(), [], []
    edges = offsets.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(WHITE_BYTES)]
        some.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    return some, again


def _features(batches):
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            n = hi - lo
            words, doc = word_hashes(data, offsets)
            ink = ~WHITE[data]
            some, again = _lines(data, offsets)
            cols = [np.bincount(doc, minlength=n), _per_text(ink & ((data & 0xC0) != 0x80), offsets),
                    _per_text(_SYMBOL[data], offsets), some, again,
                    repeated_words(words, doc, n), _per_text(_UPPER[data], offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *[pa.array(c, pa.int64()) for c in cols]],
                names=_NAMES)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_features, _FEATURES)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failures(strict: bool):
    """How many of the soft rules a document fails."""
    k = int(strict)
    rules = [100 * F.col("n_symbols") > SYMBOLS[k] * F.col("n_words"),
             (F.col("n_dup_lines") >= LEAST_DUP_LINES) & (100 * F.col("n_dup_lines") > DUP_LINES[k] * F.col("n_lines")),
             100 * F.col("n_upper") > UPPER[k] * F.col("word_chars"),
             F.col("word_chars") > LONG_WORD[k] * F.col("n_words"),
             F.col("word_chars") < SHORT_WORD * F.col("n_words")]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of a beta distribution with the mean of the hosts' rates and their
    variance beyond what binomial counts alone would show.  Its strength a + b stays
    between 1 and 10,000; (1, 1) where there are no hosts.  One aggregated row."""
    rate = F.col("failed") / F.col("docs")
    m, var, noise = hosts.agg(F.avg(rate), F.var_samp(rate), F.avg(rate * (1 - rate) / F.col("docs"))).first()
    if m is None:
        return 1.0, 1.0
    m = min(max(m, 1e-3), 1 - 1e-3)
    spread = max((var or 0.0) - (noise or 0.0), 1e-6)
    strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e4)
    return m * strength, (1 - m) * strength


def host_verdicts(scored: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """host, docs, failed, host_rate (shrunk), host_bad.  Sums combine on the map
    side, so a host with a third of all rows costs one row a task."""
    hosts = materialise(scored.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("fails").cast("long")).alias("failed")), "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_bad", rate >= bad_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          bad_rate: float = BAD_RATE) -> DataFrame:
    """One row per document: its counts, base_failed, host, host_rate, host_bad, kept.

    The join back is an ordinary equi-join on the host; no hint, as hosts grow with
    the data (adaptive execution splits a hot host or broadcasts a small side)."""
    f = features(docs, id_col, text_col, host_col).withColumns({
        "base_failed": base_failed(), "usual": failures(False) > 0, "strict": failures(True) > 0})
    f = materialise(f.withColumn("fails", F.col("base_failed") | F.col("usual")), "features")
    hosts = host_verdicts(f, bad_rate).select(F.coalesce("host", F.lit("")).alias("_h"), F.col("host").isNull().alias("_n"),
                                              "host_rate", "host_bad")
    joined = f.withColumns({"_h": F.coalesce("host", F.lit("")), "_n": F.col("host").isNull()}).join(hosts, ["_h", "_n"])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.when(F.col("host_bad"), F.col("strict")).otherwise(F.col("usual"))).alias("kept"),
        "host", "host_rate", "host_bad")
