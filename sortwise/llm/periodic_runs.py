"""Runs of repeated words, found on a grammar of each text.

A *run* is a stretch of words with smallest period q (words q apart are equal) and at
least ``max(LEAST, TIMES * q)`` words that no neighbouring word extends.  Words are
``[^\\x20\\x09-\\x0D]+``.

1. Windows of ``WINDOW`` words that occur once in their text lie in no run, so only
   stretches of repeated windows go on.  They are found by 64-bit hashes, which may
   keep a stretch too many but never lose one; all that follows compares words exactly.
2. Re-Pair: the most frequent pair of neighbouring symbols of a text's stretches becomes
   a nonterminal (oldest pair first among equals, which keeps the grammar shallow) until
   no pair occurs twice.  A balanced tree over what is left of each stretch completes
   the grammar.
3. Each nonterminal is looked at once: what runs cross the boundary between its two
   parts?  At least two periods of such a run lie on one side of it, so a square that
   starts, or ends, at the boundary gives the period; the run is extended both ways
   within the nonterminal's words.
4. Runs are translated to every place that the nonterminal derives.  A run of the text
   is found whole at the lowest nonterminal that covers it; pieces found at others lie
   inside it and are merged into it.
5. A word is dropped from the text if it stands in a run, behind its first q words.

A text's work and memory grow with its own length only; a table's rows are narrow, no
text leaves its task, nothing is shuffled.  Null and empty texts, and those of white
space, have no words and no runs, and collapse to the empty text.  Repeated rows give a
row each; rows without an id are scanned like others.  An empty table gives an empty
result.  Very long texts are one slice of their own.
"""

from __future__ import annotations

import heapq
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import mix, slices, windows, word_hashes

#: Least number of words of a run, and of its periods.
LEAST, TIMES = 6, 4
#: Words of a window that must repeat: a run of LEAST words or more with TIMES periods
#: holds each of its windows of four words twice.
WINDOW = 4
#: Bytes of a word's number; a text's numbers are one byte string, so stretches are
#: compared and searched by memory operations.
ID = 4
#: Periods up to this many words are tried one by one, longer ones by search.
SHORT = 8

Run = tuple[int, int, int]  # start, length, period


def repeated_stretches(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text: stretches (first word, end) that may hold runs."""
    words, doc = word_hashes(data, offsets)
    n = len(offsets) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    grams, at = windows(words, doc, WINDOW)
    if not len(grams):
        return out
    own = doc[at]
    with np.errstate(over="ignore"):
        keys = mix(grams + mix(own.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    first = np.searchsorted(doc, np.arange(n))
    places = np.flatnonzero(again)
    if not len(places):
        return out
    gap = np.flatnonzero((np.diff(at[places]) != 1) | (own[places[1:]] != own[places[:-1]]))
    lo = np.append(0, gap + 1)
    hi = np.append(gap, len(places) - 1)
    for a, b in zip(places[lo].tolist(), places[hi].tolist(), strict=True):
        start, end = int(at[a]), int(at[b]) + WINDOW
        if end - start >= LEAST:
            d = int(own[a])
            out[d].append((start - int(first[d]), end - int(first[d])))
    return out


class Grammar:
    """Re-Pair grammar of several sequences.  Symbol k < ``terminals`` is a terminal;
    others are nodes with two parts, a length, and the place where they first stand."""

    def __init__(self, sequences: list[list[int]], terminals: int):
        self.terminals = terminals
        self.parts: list[tuple[int, int]] = []
        self.length: list[int] = []
        self.place: list[int] = []
        self.tops: list[tuple[int, int]] = []  # (node or terminal, place) of each sequence
        self._pair(sequences)

    def size(self, symbol: int) -> int:
        return 1 if symbol < self.terminals else self.length[symbol - self.terminals]

    def _node(self, left: int, right: int, place: int) -> int:
        self.parts.append((left, right))
        self.length.append(self.size(left) + self.size(right))
        self.place.append(place)
        return self.terminals + len(self.parts) - 1

    def _pair(self, sequences: list[list[int]]) -> None:
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts, where = [], {}
        for seq in sequences:
            at = len(symbol)
            starts.append(at)
            symbol += seq
            after += [*range(at + 1, at + len(seq)), -1]
            before += [-1, *range(at, at + len(seq) - 1)]
            for i, pair in enumerate(zip(seq, seq[1:]), at):  # noqa: B905
                where.setdefault(pair, []).append(i)
        heap = [(-len(p), k, pair) for k, (pair, p) in enumerate(where.items()) if len(p) > 1]
        heapq.heapify(heap)
        serial = len(heap) + len(where)
        while heap:
            count, _, pair = heapq.heappop(heap)
            left, right = pair
            valid, taken = [], -1
            for p in where.get(pair, ()):
                q = after[p]
                if symbol[p] == left and q >= 0 and symbol[q] == right and p != taken:
                    valid.append(p)
                    taken = q if left == right else -1
            if len(valid) < 2:
                where.pop(pair, None)
                continue
            if len(valid) < -count:  # fewer than when it was queued: queue it anew
                where[pair] = valid if left != right else [p for p in where[pair] if symbol[p] == left]
                serial += 1
                heapq.heappush(heap, (-len(valid), serial, pair))
                continue
            del where[pair]
            node = self._node(left, right, valid[0])
            fresh: dict[tuple[int, int], None] = {}
            for p in valid:
                q = after[p]
                r, o = after[q], before[p]
                symbol[p], symbol[q], after[p] = node, -1, r
                if r >= 0:
                    before[r] = p
                    new = (node, symbol[r])
                    where.setdefault(new, []).append(p)
                    fresh[new] = None
                if o >= 0:
                    new = (symbol[o], node)
                    where.setdefault(new, []).append(o)
                    fresh[new] = None
            for new in fresh:
                if len(where[new]) > 1:
                    if new[0] == new[1]:
                        where[new].sort()
                    serial += 1
                    heapq.heappush(heap, (-len(where[new]), serial, new))
        for start in starts:
            level, p = [], start
            while p >= 0:
                level.append((symbol[p], p))
                p = after[p]
            while len(level) > 1:
                up = [(self._node(a, b, p), p) for (a, p), (b, _) in zip(level[::2], level[1::2])]  # noqa: B905
                level = up + level[len(up) * 2:]
            self.tops.append(level[0])


def _forward(t: bytes, i: int, j: int, end: int) -> int:
    """Bytes for which ``t`` goes on alike from i and from j (whole words), i < j."""
    if t[i: i + ID] != t[j: j + ID]:
        return 0
    n, done, step = end - j, 0, ID
    while done + step <= n and t[i + done: i + done + step] == t[j + done: j + done + step]:
        done += step
        step *= 2
    while step > ID:
        step //= 2
        if done + step <= n and t[i + done: i + done + step] == t[j + done: j + done + step]:
            done += step
    return done


def _backward(t: bytes, i: int, j: int, start: int) -> int:
    """Bytes for which ``t`` is alike before i and before j (whole words), i < j."""
    n, done, step = i - start, 0, ID
    while done + step <= n and t[i - done - step: i - done] == t[j - done - step: j - done]:
        done += step
        step *= 2
    while step > ID:
        step //= 2
        if done + step <= n and t[i - done - step: i - done] == t[j - done - step: j - done]:
            done += step
    return done


def crossing_runs(t: bytes, start: int, middle: int, end: int) -> list[Run]:
    """Runs of ``t[start:end]`` across ``middle`` (bytes), as words from ``start``.

    A square v v at the middle, with v primitive, has a run of period |v|.  The next
    longer primitive square is longer than half of what that run covers, so all
    multiples of a period are stepped over."""
    out: set[Run] = set()
    most = (end - start) // ID // TIMES * ID

    def keep(period: int) -> tuple[int, int]:
        lo = middle - _backward(t, middle, middle + period, start) if middle + period <= end else middle
        hi = middle + period + _forward(t, middle, middle + period, end) if middle + period <= end else end
        return lo, hi

    def add(lo: int, hi: int, period: int) -> None:
        if lo < middle < hi and hi - lo >= max(LEAST * ID, TIMES * period):
            out.add(((lo - start) // ID, (hi - lo) // ID, period // ID))

    def right() -> None:
        limit, period = min(most, (end - middle) // 2 // ID * ID), ID
        while period <= limit:
            if period >= SHORT * ID:
                seed = t[middle: middle + SHORT * ID]
                at = t.find(seed, middle + period, middle + limit + len(seed))
                if at < 0:
                    return
                period = at - middle
                if period % ID:  # a match that begins inside a number
                    period += ID - period % ID
                    continue
            if t[middle: middle + period] == t[middle + period: middle + 2 * period]:
                lo, hi = keep(period)
                add(lo, hi, period)
                period = max(period, (hi - middle) // 2 // ID * ID)
            period += ID

    def left() -> None:
        limit, period = min(most, (middle - start) // 2 // ID * ID), ID
        while period <= limit:
            if period >= SHORT * ID:
                seed = t[middle - SHORT * ID: middle]
                at = t.rfind(seed, middle - limit - len(seed), middle - period)
                if at < 0:
                    return
                period = middle - at - len(seed)
                if period % ID:
                    period += ID - period % ID
                    continue
            if t[middle - period: middle] == t[middle - 2 * period: middle - period]:
                lo = middle - period - _backward(t, middle - period, middle, start)
                hi = middle + _forward(t, middle - period, middle, end)
                add(lo, hi, period)
                period = max(period, (middle - lo) // 2 // ID * ID)
            period += ID

    right()
    left()
    return list(out)


def _merged(pieces: list[tuple[int, int, int]]) -> list[Run]:
    """Runs out of (period, start, end): pieces of one period that share a period's words are one."""
    runs: dict[tuple[int, int], int] = {}
    period, lo, hi = 0, 0, 0
    for q, a, b in [*sorted(pieces), (0, 0, 0)]:
        if q == period and a <= hi - q:
            hi = max(hi, b)
            continue
        if period:
            runs[lo, hi] = min(period, runs.get((lo, hi), period))
        period, lo, hi = q, a, b
    return sorted((a, b - a, q) for (a, b), q in runs.items())


def runs_of(words: list, stretches: list[tuple[int, int]]) -> list[Run]:
    """All runs (start, length, period) of a text's words, by start, then period.
    Every run lies inside one of the ``stretches``."""
    number: dict = {}
    sequences = [[number.setdefault(w, len(number)) for w in words[a:b]] for a, b in stretches]
    grammar = Grammar(sequences, len(number))
    t = np.array([i for s in sequences for i in s], dtype=np.int32).tobytes()
    own: list[list[Run]] = []
    hot: list[bool] = []

    def is_hot(symbol: int) -> bool:
        return symbol >= grammar.terminals and hot[symbol - grammar.terminals]

    for (a, b), size, place in zip(grammar.parts, grammar.length, grammar.place, strict=True):
        found = crossing_runs(t, place * ID, (place + grammar.size(a)) * ID, (place + size) * ID) if size >= LEAST else []
        own.append(found)
        hot.append(bool(found) or is_hot(a) or is_hot(b))
    derived: list[list[int]] = [[] for _ in own]
    for symbol, place in grammar.tops:
        if is_hot(symbol):
            derived[symbol - grammar.terminals].append(place)
    pieces = []
    for k in range(len(own) - 1, -1, -1):
        if not derived[k]:
            continue
        a, b = grammar.parts[k]
        if is_hot(a):
            derived[a - grammar.terminals] += derived[k]
        if is_hot(b):
            derived[b - grammar.terminals] += [p + grammar.size(a) for p in derived[k]]
        pieces += [(q, p + s, p + s + n) for s, n, q in own[k] for p in derived[k]]
        derived[k] = []
    # places count words of the stretches; back to words of the text
    edge = np.cumsum([0, *(b - a for a, b in stretches)])
    out = []
    for s, n, q in _merged(pieces):
        k = int(np.searchsorted(edge, s, side="right")) - 1
        out.append((s - int(edge[k]) + stretches[k][0], n, q))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, then least start, then least period."""
    def order(x: Run, y: Run) -> int:
        less = y[1] * x[2] - x[1] * y[2]  # exact: fractions compared by products
        return less or x[0] - y[0] or x[2] - y[2]
    return min(runs, key=cmp_to_key(order), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that stand in no run behind its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "doc_id long, runs array<{0}>, strongest {0}, collapsed string".format("struct<start:long,length:long,period:long>")


def _find(batches):
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            raw, edges = data.tobytes(), offsets.tolist()
            runs, best, texts = [], [], []
            for d, stretches in enumerate(repeated_stretches(data, offsets)):
                words = raw[edges[d]: edges[d + 1]].split()  # bytes.split() cuts at the same six bytes
                found = runs_of(words, stretches) if stretches else []
                top = strongest(found)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                best.append(None if top is None else dict(zip(("start", "length", "period"), top, strict=True)))
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "strongest", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), strongest (of them, or
    null) and collapsed (the text without repeated periods) of every row."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_find, _OUT)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
