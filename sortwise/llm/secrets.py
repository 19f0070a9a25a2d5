"""Secret scan: fixed patterns, and a character network over every other candidate.

One pass over the texts finds the base spans (``assign``, ``access``, ``hex``) and all
other candidates.  A candidate is a run of ``[A-Za-z0-9+/_=.-]``, or what base spans
leave over of one, with at least ``CANDIDATE`` bytes and one of these: a digit, a
capital right behind a small letter, ``LONG`` bytes, or a word such as ``key`` or
``bearer`` in the ``BEFORE`` bytes ahead of it.  Each keeps windows of bytes that cover
it whole, with what stands around it.

A convolutional network in numpy is trained on labelled findings: the values of base
spans against plain candidates and ordinary words (other runs of ``CANDIDATE`` bytes
whose byte sum is a multiple of ``EVERY``).  A candidate that looks like a secret (small
letters, capitals and digits interleaved, a digit and such a word ahead, or ``LONG``
letters and no digit) may be one of another kind, so it is no negative; it is only
scored.  Every distinct window of the three sorts is learned from.  They are dealt by
hash into shards of about ``SHARD``; in each of ``EPOCHS`` rounds every shard trains a
copy of the network over all its windows in a task of its own, and the mean of the
copies goes on.  A quarter of the texts, by their
checksum, is held out; a window that stands in both parts counts as held out, so no
finding is on both sides.  Base findings are of few shapes, so for each negative there
is also a drawn key: its window with random characters of one of ``ALPHABETS`` in its
place.  All are shown with and without their surroundings.  The scores are calibrated
on the whole held-out part (Platt scaling), and the threshold is the highest that keeps
``RECALL`` of its findings and drawn keys, however low.  Logits count in steps of
1 / ``GRID``, so that what the driver gets for both is an exact count by logit.  Candidates at or above it are
added as spans of kind ``model``; base spans always stay.

Null and empty texts have no spans; a very long text is read whole, on its own.  Spans
are in code points, end exclusive.  Repeated rows give a row each.  An empty table, or
one without findings of both classes in both parts, gives base spans only: there is
nothing to train or to set a threshold on.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .scratch import map_rows, materialise
from .textvec import runs, slices, tidy, tidy_group

KINDS = ("assign", "access", "hex", "model")
#: Bytes of a candidate at least, and of one with no other sign.
CANDIDATE, LONG = 8, 16
#: Windows of a shard, rounds over all of them, steps of a logit and of a weight's mean.
SHARD, EPOCHS, GRID, FINE = 16384, 6, 256, 2 ** 30
RECALL = 0.98
EVERY = 61
#: Bytes of text that are searched together; the places in a slice take thirty times that.
SLICE = 1 << 19
_SMALL, _CAPITAL, _FIGURE = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
ALPHABETS = [_SMALL, _CAPITAL, _SMALL + _CAPITAL, _SMALL + _FIGURE, _SMALL + _CAPITAL + _FIGURE,
             _SMALL + _CAPITAL + _FIGURE + b"+/"]
#: A window: bytes before the candidate, of it, and behind it.
BEFORE, INSIDE, BEHIND = 24, 48, 8
WIDTH = BEFORE + INSIDE + BEHIND

# Fixed patterns of the base findings, over text with A-Z lower-cased where letters
# may be in either case.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_AHEAD = re.compile(rb"key|passw|pwd|secret|token|auth|bearer|credential", re.I)

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, dtype=bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
#: Kinds of bytes: 1 digit, 2 small letter, 3 capital, 0 any other.
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 2, 3

_FOUND = ("doc_id long, base array<struct<kind:int,start:long,end:long>>, "
          "other array<struct<start:long,end:long,plain:boolean,windows:array<binary>>>, labelled array<binary>, "
          "words array<binary>, held boolean")
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_OTHER = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("windows", pa.list_(pa.binary()))])


def windows_of(text: bytes, start: int, end: int) -> list[bytes]:
    """Windows that cover ``text[start:end]`` whole; a byte of each says whether it
    lies inside the candidate.  Zero stands for nothing (before or behind a text)."""
    out = []
    for at in range(start, end, INSIDE):
        a, b = at - BEFORE, at + INSIDE + BEHIND
        chars = b"\0" * max(0, -a) + text[max(0, a): b]
        chars += b"\0" * (WIDTH - len(chars))
        flags = bytes(int(start <= a + i < end) for i in range(WIDTH))
        out.append(chars + flags)
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of assign and access findings, in bytes."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def rests(runs_: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted ``spans`` leave over of ``runs_``, pieces of ``CANDIDATE`` bytes or more."""
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    ends, out = [b for _, b in merged], []
    for at, end in runs_:
        k = bisect_right(ends, at)
        while at < end:
            stop = merged[k][0] if k < len(merged) else end
            if min(stop, end) - at >= CANDIDATE:
                out.append((at, min(stop, end)))
            at = merged[k][1] if k < len(merged) else end
            k += 1
    return out


def _candidates(raw: bytes, data: np.ndarray, offsets: np.ndarray, spans: dict[int, list]):
    """Start, end, text index and plainness of every candidate, and start, end and text index
    of the ordinary words to learn from; ``spans`` by text, all in bytes of ``data``."""
    a, b, d = runs(_RUN[data], offsets)
    long = b - a >= CANDIDATE
    a, b, d = a[long], b[long], d[long]
    cut = np.isin(d, list(spans))
    if cut.any():
        pieces = np.array(rests(list(zip(a[cut].tolist(), b[cut].tolist(), strict=True)),
                                sorted((s, e) for row in spans.values() for s, _, e, _ in row)), dtype=np.int64).reshape(-1, 2)
        a, b = np.concatenate([a[~cut], pieces[:, 0]]), np.concatenate([b[~cut], pieces[:, 1]])
        order = np.argsort(a)
        a, b = a[order], b[order]
        d = np.searchsorted(offsets, a, side="right") - 1
    kind = _CLASS[data]
    left, right = kind[:-1], kind[1:]

    def count(flags, lo, hi):
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[np.maximum(hi, lo)] - sums[lo]

    digit = count(kind == 1, a, b) > 0
    mixed = count((left == 2) & (right == 3), a, b - 1) > 0
    turns = count((left > 0) & (right > 0) & (left != right) & ~((left == 3) & (right == 2)), a, b - 1)
    words = np.array([m.span() for m in _AHEAD.finditer(raw)] or [(-BEFORE - 1, -BEFORE - 1)], dtype=np.int64)
    last = np.maximum(np.searchsorted(words[:, 1], a, side="right") - 1, 0)
    start, end = words[last].T
    near = (end <= a) & (a - end <= BEFORE) & (start >= offsets[d])
    keep = digit | mixed | near | (b - a >= LONG)
    plain = ~((turns >= 3) & (turns * 4 >= b - a)) & ~(near & digit) & (digit | (count(kind >= 2, a, b) < LONG))
    word = ~keep & (count(data, a, b) % EVERY == 0)
    return (a[keep], b[keep], d[keep], plain[keep]), (a[word], b[word], d[word])


def _find(batches):
    names = ["doc_id", "base", "other", "labelled", "words", "held"]
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1), SLICE):
            raw, edges = data.tobytes(), offsets.tolist()
            spans: dict[int, list] = {}
            for i in range(hi - lo):
                at = edges[i]
                got = [(s + at, k, e + at, v + at) for s, k, e, v in base_spans(raw[at: edges[i + 1]])]
                if got:
                    spans[i] = got
            a, b, d = runs(_HEX[data], offsets)
            wide = b - a >= 24
            for x, y, i in zip(a[wide].tolist(), b[wide].tolist(), d[wide].tolist(), strict=True):
                spans.setdefault(i, []).append((x, 2, y, x))
            loose: dict[int, list] = {}
            ordinary: dict[int, list] = {}
            candidates, common = _candidates(raw, data, offsets, spans)
            for x, y, i, plain in zip(*(c.tolist() for c in candidates), strict=True):
                loose.setdefault(i, []).append((x, y, plain))
            for x, y, i in zip(*(c.tolist() for c in common), strict=True):
                ordinary.setdefault(i, []).append((x, y))
            base, other, labelled, words, held = [], [], [], [], []
            for i in range(hi - lo):
                at, found, free = edges[i], sorted(spans.get(i, ())), loose.get(i, ())
                text = raw[at: edges[i + 1]] if found or free or i in ordinary else b""
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
                base.append([{"kind": k, "start": points[s - at], "end": points[e - at]} for s, k, e, _ in found])
                other.append([{"start": points[s - at], "end": points[e - at], "plain": plain,
                               "windows": windows_of(text, s - at, e - at)} for s, e, plain in free])
                labelled.append([w for _, _, e, v in found for w in windows_of(text, v - at, e - at)])
                words.append([w for s, e in ordinary.get(i, ()) for w in windows_of(text, s - at, e - at)])
                held.append(zlib.crc32(text) % 4 == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(base, pa.list_(_SPAN)), pa.array(other, pa.list_(_OTHER)),
                 pa.array(labelled, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.binary())), pa.array(held)], names=names)


class CharNet:
    """Byte embeddings, one convolution, maximum over places, logistic output."""

    #: Windows at a time whose columns stay in a core's cache.
    BLOCK = 32

    def __init__(self, filters: int = 24, size: int = 5, dim: int = 8, seed: int = 7, dtype=np.float64):
        rng = np.random.default_rng(seed)
        self.size, self.dim = size, dim
        self.w = {"e": rng.normal(0, 0.3, (256, dim)), "k": rng.normal(0, 0.15, (size * (dim + 1), filters)),
                  "c": np.zeros(filters), "v": rng.normal(0, 0.2, filters), "b": np.zeros(1)}
        self.w = {k: v.astype(dtype) for k, v in self.w.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Window, place, channels under the filter: a view, as those of a place lie side by side."""
        e = self.w["e"]
        chars = np.empty((len(x), WIDTH, self.dim + 1), dtype=e.dtype)
        chars[:, :, :-1], chars[:, :, -1] = e[x[:, :WIDTH]], x[:, WIDTH:]
        a, b, c = chars.strides
        return np.lib.stride_tricks.as_strided(chars, (len(x), WIDTH - self.size + 1, self.size * (self.dim + 1)), (a, b, c))

    def _forward(self, x, learn: bool = False):
        """Logits; to learn from, also the columns at each filter's best place, those places
        and their values."""
        out = []
        for at in range(0, len(x), self.BLOCK):
            cols = self._columns(x[at: at + self.BLOCK])
            h = (cols.reshape(-1, cols.shape[2]) @ self.w["k"]).reshape(len(cols), -1, len(self.w["c"]))
            top = np.maximum(h.max(axis=1) + self.w["c"], 0)
            part = [top @ self.w["v"] + self.w["b"][0]]
            if learn:
                best = h.argmax(axis=1)
                part += [cols[np.arange(len(cols))[:, None], best], best, top]
            out.append(part)
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0].astype(np.float64) if len(x) else np.zeros(0)

    def on_grid(self, x: np.ndarray) -> np.ndarray:
        """Logits as whole numbers of 1 / ``GRID``."""
        return np.rint(np.clip(self.logits(x), -500, 500) * GRID).astype(np.int64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._probability(self.on_grid(x) / GRID)

    def _probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -500, 500)))

    def weights(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def set_weights(self, flat: np.ndarray) -> CharNet:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at: at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size
        return self

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 5e-3, seed: int = 7):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, dim, dtype = 0, self.dim, self.w["e"].dtype
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                part = order[k: k + batch]
                xb, yb = x[part], y[part]
                z, cols, best, top = self._forward(xb, learn=True)
                dz = ((1 / (1 + np.exp(-np.clip(z, -500, 500))) - yb) / len(part)).astype(dtype)
                g = {"v": top.T @ dz, "b": np.array([dz.sum()], dtype)}
                dh = np.outer(dz, self.w["v"]) * (top > 0)
                g["c"] = dh.sum(axis=0)
                g["k"] = np.einsum("nfd,nf->df", cols, dh)
                dcol = dh[:, :, None] * self.w["k"].T[None]  # sample, filter, place in the window x channel
                dchar = dcol.reshape(len(part), -1, self.size, dim + 1)[..., :dim]
                at = best[:, :, None] + np.arange(self.size)
                bytes_ = np.take_along_axis(xb[:, None, :WIDTH], at, axis=2).astype(np.int64)
                places = bytes_[..., None] * dim + np.arange(dim)
                g["e"] = np.bincount(places.ravel(), dchar.ravel(), self.w["e"].size).reshape(-1, dim).astype(dtype)
                step += 1
                for n, grad in g.items():
                    m[n] = 0.9 * m[n] + 0.1 * grad
                    s[n] = 0.999 * s[n] + 0.001 * grad * grad
                    self.w[n] = self.w[n] - rate * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(s[n] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        self.calibrate_counts(self.on_grid(x), y, np.ones(len(x)), recall)

    def calibrate_counts(self, grid: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold with the wanted recall;
        ``n`` windows of class ``y`` have the logit ``grid`` / ``GRID``."""
        z, ones = grid / GRID, n[y == 1].sum()
        t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n[y == 0].sum() + 2))
        ab = np.array([1.0, 0.0])
        design = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
            hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            ab = ab - np.linalg.solve(hess, design.T @ (n * (p - t)) + 1e-3 * (ab - [1.0, 0.0]))
        self.scale, self.shift = float(ab[0]), float(ab[1])
        found, many = self._probability(z[y == 1]), n[y == 1]
        order = np.argsort(found)
        at = np.searchsorted(np.cumsum(many[order]), int((1 - recall) * ones), side="right")
        self.threshold = float(found[order[at]])


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 2 * WIDTH)


def alone(x: np.ndarray) -> np.ndarray:
    """Windows without what stands around the candidate."""
    out = x.copy()
    out[:, :WIDTH] *= out[:, WIDTH:]
    return out


def drawn_keys(hosts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``hosts`` with a key drawn from one of ``ALPHABETS`` in place of each candidate; what
    stands behind moves up or down.  Keys are long enough to be candidates anywhere."""
    out = np.zeros_like(hosts)
    out[:, :BEFORE] = hosts[:, :BEFORE]
    behind = WIDTH - (hosts[:, :WIDTH - 1:-1] == 1).argmax(axis=1)  # end of the host's candidate
    for i, pick in enumerate(rng.integers(0, len(ALPHABETS), len(hosts))):
        alphabet = np.frombuffer(ALPHABETS[pick], dtype=np.uint8)
        size = rng.integers(LONG if pick < 2 else CANDIDATE, INSIDE + BEHIND)
        at = BEFORE + size
        out[i, BEFORE: at] = alphabet[rng.integers(0, len(alphabet), size)]
        tail = hosts[i, behind[i]: min(WIDTH, behind[i] + WIDTH - at)]
        out[i, at: at + len(tail)] = tail
        out[i, WIDTH + BEFORE: WIDTH + at] = 1
    return out


def labelled_findings(found: DataFrame) -> DataFrame:
    """sort, w, held: every distinct window of base findings (sort 0), plain candidates (1)
    and ordinary words (2), and whether it is held out."""
    plain = F.flatten(F.transform(F.filter("other", lambda c: c["plain"]), lambda c: c["windows"]))

    def of_sort(k, windows):
        return F.transform(windows, lambda w: F.struct(F.lit(k).alias("sort"), w.alias("w")))

    rows = found.select("held", F.explode(F.concat(
        of_sort(0, F.col("labelled")), of_sort(1, plain), of_sort(2, F.col("words")))).alias("r"))
    return rows.groupBy("r.sort", "r.w").agg(F.max("held").alias("held"))


def _examples(table: pa.Table, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a shard in a fixed order, with a drawn key for each negative, all of them
    with and without surroundings; and their classes."""
    rows = sorted(zip(table["sort"].to_pylist(), table["w"].to_pylist(), strict=True))
    x = _matrix([w for _, w in rows])
    secret = np.array([k == 0 for k, _ in rows], dtype=bool)
    plains = x[~secret]
    x = np.concatenate([x[secret], drawn_keys(plains, rng), plains])
    y = np.repeat([1.0, 1.0, 0.0], [secret.sum(), len(plains), len(plains)])
    return np.concatenate([x, alone(x)]), np.tile(y, 2)


def _shards(windows: DataFrame, held: bool, n: int) -> GroupedData:
    """The windows of one part, dealt by hash into shards, which are dealt over tasks by a
    fixed count: they are few bytes but much work, so adaptive merging must not join them."""
    count = -(-n // SHARD)
    tasks = min(count, 4 * windows.sparkSession.sparkContext.defaultParallelism)
    part = windows.where(F.col("held") == held).select("sort", "w", F.pmod(F.xxhash64("w"), F.lit(count)).alias("shard"))
    return part.repartition(tasks, "shard").groupBy("shard")


def _round(state: np.ndarray, epoch: int):
    """One round of a shard: the weights after it as whole numbers of 1 / ``FINE``, whose sum
    is the same in any order."""
    @tidy_group
    def run(key, table):
        shard = key[0].as_py()
        x, y = _examples(table, np.random.default_rng([5, shard]))
        net = CharNet(dtype=np.float32).set_weights(state).train(x, y, epochs=1, seed=[7, epoch, shard])
        return pa.table({"i": np.arange(len(state)), "v": np.rint(net.weights() * FINE).astype(np.int64)})
    return run


def _logits(net: CharNet):
    @tidy_group
    def run(key, table):
        x, y = _examples(table, np.random.default_rng([6, key[0].as_py()]))
        pairs, n = np.unique(np.stack([y.astype(np.int64), net.on_grid(x)]), axis=1, return_counts=True)
        return pa.table({"y": pairs[0], "z": pairs[1], "n": n})
    return run


def train(found: DataFrame, sample: int | None = None, recall: float = RECALL, epochs: int = EPOCHS) -> CharNet | None:
    """The network, trained on every window outside the held-out texts and calibrated on
    every one in them; None where a class is missing in either.  The driver gets a mean of
    weights each round and the counts by logit.  ``sample`` is for trials alone: the
    first so many windows of each sort by hash."""
    windows = labelled_findings(found)
    if sample is not None:
        first = [windows.where(F.col("sort") == k).orderBy(F.xxhash64("w"), "w").limit(sample) for k in range(3)]
        windows = first[0].unionByName(first[1]).unionByName(first[2])
    windows = materialise(windows, "windows")
    count = {(r.held, r.secret): r["count"] for r in
             windows.groupBy("held", (F.col("sort") == 0).alias("secret")).count().collect()}
    if len(count) < 4:
        return None
    fit, held = (_shards(windows, h, count[h, True] + count[h, False]) for h in (False, True))
    net = CharNet(dtype=np.float32)
    for epoch in range(epochs):
        copies = fit.applyInArrow(_round(net.weights(), epoch), "i long, v long")
        mean = copies.groupBy("i").agg(F.sum("v").alias("v"), F.count("v").alias("n")).orderBy("i").collect()
        net.set_weights(np.array([r.v / r.n / FINE for r in mean]))
    counts = held.applyInArrow(_logits(net), "y long, z long, n long").groupBy("y", "z").agg(F.sum("n").alias("n"))
    y, z, n = np.array([tuple(r) for r in counts.orderBy("y", "z").collect()], dtype=np.int64).T
    net.calibrate_counts(z, y, n.astype(float), recall)
    return net


_SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
_OUT = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _score(model):
    def run(batches):
        net = model.value
        for batch in batches:
            base, other = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            spans = [[(s["start"], s["kind"], s["end"], 1.0) for s in row] for row in base]
            owner = [(i, c) for i, row in enumerate(other) for c in row]
            if net is not None and owner:
                count = np.array([len(c["windows"]) for _, c in owner])
                p = net.probability(_matrix([w for _, c in owner for w in c["windows"]]))
                best = np.maximum.reduceat(p, np.cumsum(count) - count)
                for (i, c), score in zip(owner, best.tolist(), strict=True):
                    if score >= net.threshold:
                        spans[i].append((c["start"], 3, c["end"], score))
            out = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(row)] for row in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_OUT))], names=["doc_id", "spans"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None,
         recall: float = RECALL) -> DataFrame:
    """doc_id, spans (kind, start, end, score), by start, then kind as listed."""
    spark = docs.sparkSession
    found = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                    F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidy(_find), _FOUND), "found")
    model = spark.sparkContext.broadcast(train(found, sample, recall))
    return found.select("doc_id", "base", "other").mapInArrow(tidy(_score(model)), _SPANS)


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""
    def shown(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "model")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return spans.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"),
                        shown(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", sample: int | None = None,
         recall: float = RECALL) -> DataFrame:
    """``docs`` with every span's text replaced by ``[kind]`` and ``size_col``, if there is
    one, set anew; other columns as they were.  A span that overlaps one before it is
    merged into it.  The training pass and the masking pass both read ``docs``; no text
    is shuffled."""
    spark = docs.sparkSession
    found = materialise(docs.select(F.lit(None).cast("long").alias("doc_id"),
                                    F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidy(_find), _FOUND), "found")
    model = spark.sparkContext.broadcast(train(found, sample, recall))
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else -1

    @tidy
    def run(batches):
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi, _, _ in slices(b.column(at), SLICE)):
            texts = batch.column(at)
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), texts], names=["doc_id", "text"])
            rows = [r for b in _score(model)(b.select([0, 1, 2]) for b in _find([plain])) for r in b.column(1).to_pylist()]
            out = [_masked(t, r) for t, r in zip(texts.to_pylist(), rows, strict=True)]
            cols = batch.columns
            cols[at] = pa.array(out, texts.type)
            if size_at >= 0:
                new = [old if t is None or not r else len(t)
                       for t, r, old in zip(out, rows, cols[size_at].to_pylist(), strict=True)]
                cols[size_at] = pa.array(new, cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return map_rows(docs, run)


def _masked(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at: s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])

