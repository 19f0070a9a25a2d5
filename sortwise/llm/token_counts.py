"""Edit-aware token counts: a segment tree of pre-tokens for every document.

``build_trees`` cuts a text into pre-tokens, ``LEAF`` a leaf, and keeps two sums at every
node of a complete binary tree over the leaves: tokens and code points.
``apply_edits`` takes edits (start, end, replacement; code points of the old text, in
order, not overlapping) and, for each run of touched leaves, encodes anew only those
leaves with the leaf on either side as boundary context (more leaves, if those hold
fewer than ``CONTEXT`` words).  The context is the proof: if its own pre-tokens do not
come out as they were, the region grows by a leaf on that side.  New
pre-tokens are dealt over the region's own leaves, so no other leaf moves, and only
the sums above touched leaves are set anew.

Texts with a special token's own string, before or after the edits, are one leaf that
is encoded whole.  Null and empty texts have no tokens and an empty leaf.  Repeated
rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder
from .textvec import slices

#: Pre-tokens of a leaf.
LEAF = 64
#: White-space separated words that a region's context has at least on either side.
CONTEXT = 3


def sums(leaves: np.ndarray) -> np.ndarray:
    """Complete binary tree over the leaves: node i sums nodes 2i and 2i + 1; leaves stand
    from len / 2 on."""
    width = 1 << max(0, (len(leaves) - 1).bit_length())
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width: width + len(leaves)] = leaves
    while width > 1:
        tree[width // 2: width] = tree[width: 2 * width].reshape(-1, 2).sum(axis=1)
        width //= 2
    return tree


def set_leaf(tree: np.ndarray, leaf: int, value: int) -> None:
    """Sets a leaf and the sums above it."""
    i = len(tree) // 2 + leaf
    change = value - tree[i]
    while i and change:
        tree[i] += change
        i //= 2


def find_leaf(tree: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds a place counted from 0, and the sum of the leaves before it;
    the last leaf for a place behind all."""
    i, before = 1, 0
    while i < len(tree) // 2:
        left = tree[2 * i]
        if place < before + left or tree[2 * i + 1] == 0:
            i = 2 * i
        else:
            before += int(left)
            i = 2 * i + 1
    return i - len(tree) // 2, before


def before_leaf(tree: np.ndarray, leaf: int) -> int:
    """Sum of the leaves before one."""
    i, total = len(tree) // 2 + leaf, 0
    while i > 1:
        if i & 1:
            total += int(tree[i - 1])
        i //= 2
    return total


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def points_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.array([0, len(text)])


class Document:
    """The texts of a document's leaves and its two trees; ``plain`` is false for a
    text that is encoded whole."""

    def __init__(self, leaves: list[str], tokens: np.ndarray, points: np.ndarray, plain: bool):
        self.leaves, self.tokens, self.points, self.plain = leaves, tokens, points, plain
        self.encoded = 0  # pre-tokens encoded anew

    @classmethod
    def whole(cls, text: str, enc: Encoder) -> Document:
        rows, _ = enc.encode([text])
        doc = cls([text], sums(np.array([enc.count[rows].sum()])), sums(np.array([len(text)])), False)
        doc.encoded = len(rows)
        return doc

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def apply(self, edits: list[tuple[int, int, str]], enc: Encoder) -> None:
        """Apply ordered, disjoint edits, last first: places before a region stay valid."""
        left = len(edits)
        while left:
            if not self.plain:
                new = Document.whole(edited("".join(self.leaves), edits[:left]), enc)
                new.encoded += self.encoded
                self.__dict__.update(new.__dict__)
                return
            start, end, _ = edits[left - 1]
            first = find_leaf(self.points, start)[0]
            last = max(first, find_leaf(self.points, max(end - 1, start))[0])
            used = 1
            while used < left:  # edits in the same leaves or the one before go along
                s, e, _ = edits[left - 1 - used]
                if find_leaf(self.points, max(e - 1, s))[0] < first - 1:
                    break
                first = min(first, find_leaf(self.points, s)[0])
                used += 1
            if self._region(first, last, edits[left - used: left], enc):
                left -= used

    def _lead(self, first: int) -> str:
        """Text in front of a leaf: a leaf, or as many as have the words wanted."""
        out = ""
        while first and len(out.split()) < CONTEXT:
            first -= 1
            out = self.leaves[first] + out
        return out

    def _context(self, last: int) -> str:
        out = ""
        while last < len(self.leaves) - 1 and len(out.split()) < CONTEXT:
            last += 1
            out += self.leaves[last]
        return out

    def _region(self, first: int, last: int, edits, enc: Encoder) -> bool:
        """Encode the leaves ``first`` to ``last`` anew; false if the text holds a special
        token now and must be encoded whole."""
        most = len(self.leaves) - 1
        while True:
            while first and not self.leaves[first - 1]:
                first -= 1
            while last < most and not self.leaves[last + 1]:
                last += 1
            at = before_leaf(self.points, first)
            old = "".join(self.leaves[first: last + 1])
            lead, tail = self._lead(first), self._context(last)
            region = edited(old, [(s - at, e - at, t) for s, e, t in edits])
            joined = lead + region + tail
            if enc.special_in(joined):
                self.plain = False
                return False
            was = enc.pieces(*points_of(lead + old + tail))[0]
            rows, _ = enc.encode([joined])
            begin, end = enc.last_spans
            left, right, moved = len(lead), len(lead) + len(region), len(region) - len(old)
            good_left = np.array_equal(was[was < left], begin[begin < left]) and (
                not first or left == len(joined) or bool((begin == left).any()))
            good_right = np.array_equal(was[was >= right - moved] + moved, begin[begin >= right])
            if good_left and good_right:
                break
            first, last = first - (not good_left and first > 0), last + (not good_right and last < most)
        inside = (begin >= left) & (begin < right)
        rows, begin, end = rows[inside], begin[inside], end[inside]
        self.encoded += len(rows)
        cut = np.linspace(0, len(rows), last - first + 2).astype(np.int64).tolist()
        for k in range(last - first + 1):
            a, b = cut[k], cut[k + 1]
            text = joined[begin[a]: end[b - 1]] if b > a else ""
            self.leaves[first + k] = text
            set_leaf(self.tokens, first + k, int(enc.count[rows[a:b]].sum()))
            set_leaf(self.points, first + k, len(text))
        return True


def build(texts: list[str], enc: Encoder) -> list[Document]:
    """A document with its trees for every text."""
    out: list = [Document.whole(t, enc) if enc.special_in(t) else None for t in texts]
    plain = [t for t, d in zip(texts, out, strict=True) if d is None]
    rows, stops = enc.encode(plain)
    begin, end = enc.last_spans
    count = enc.count[rows]
    made, first, at = [], 0, 0
    for text, last in zip(plain, stops.tolist(), strict=True):
        marks = np.arange(first, last, LEAF)
        if len(marks):
            tokens = np.add.reduceat(count[:last], marks)
            cut = [*(begin[marks] - at).tolist(), len(text)]
        else:
            tokens, cut = np.zeros(1, dtype=np.int64), [0, len(text)]
        leaves = [text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        made.append(Document(leaves, sums(tokens), sums(np.array([len(x) for x in leaves])), True))
        first, at = last, at + len(text)
    rest = iter(made)
    return [next(rest) if d is None else d for d in out]


_DIGITS = re.compile("[0-9]{6,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a cleaning pass: a line with text that equals an earlier line goes, and
    a run of six or more digits elsewhere becomes ``0``."""
    out: list[tuple[int, int, str]] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            out.append((max(at - 1, 0), at + len(line), ""))  # with the line break before it
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "0") for m in _DIGITS.finditer(line)]
        at += len(line) + 1
    return out


_TREES = ("doc_id long, leaves array<string>, tokens array<long>, points array<long>, plain boolean, "
          "edits array<struct<start:long,end:long,text:string>>")
_EDIT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
_COUNTS = ("doc_id long, n_tokens long, n_leaves long, n_edits long, n_encoded long, n_tokens_after long")


def build_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                edits_of=None) -> DataFrame:
    """A row per document with its leaves and trees, and the edits that ``edits_of``
    finds in its text (none without it).  Narrow; the table can be kept and edited later."""
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for lo, hi, _, _ in slices(column):
                texts = ["" if t is None else t for t in column.slice(lo, hi - lo).to_pylist()]
                made = build(texts, enc)
                edits = [[] if edits_of is None else [dict(zip(("start", "end", "text"), e, strict=True)) for e in edits_of(t)]
                         for t in texts]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([d.leaves for d in made], pa.list_(pa.string())),
                     pa.array([d.tokens for d in made], longs), pa.array([d.points for d in made], longs),
                     pa.array([d.plain for d in made]), pa.array(edits, pa.list_(_EDIT))],
                    names=["doc_id", "leaves", "tokens", "points", "plain", "edits"])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, _TREES)


def _edited(batch, vocabulary: str):
    """Documents of a batch of trees with their edits applied: (tokens before, document)."""
    enc = encoder(vocabulary)
    longs = [[np.array(v, dtype=np.int64) for v in batch.column(i).to_pylist()] for i in (2, 3)]
    for leaves, tokens, points, plain, edits in zip(
            batch.column(1).to_pylist(), *longs, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
        doc = Document(leaves, tokens, points, plain)
        before = doc.n_tokens
        doc.apply([(e["start"], e["end"], e["text"]) for e in edits or ()], enc)
        yield before, doc


def apply_edits(trees: DataFrame, vocabulary: str) -> DataFrame:
    """``trees`` after their edits, which are then empty."""
    def run(batches):
        for batch in batches:
            docs = [d for _, d in _edited(batch, vocabulary)]
            cols = [batch.column(0), pa.array([d.leaves for d in docs], pa.list_(pa.string())),
                    *[pa.array([getattr(d, k) for d in docs], pa.list_(pa.int64())) for k in ("tokens", "points")],
                    pa.array([d.plain for d in docs]), pa.array([[]] * len(docs), pa.list_(_EDIT))]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
    return trees.select(*[f.split()[0] for f in _TREES.split(", ")]).mapInArrow(run, _TREES)


def edit_counts(trees: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_leaves, n_edits, n_encoded (pre-tokens that the edits made
    encode anew), n_tokens_after."""
    def run(batches):
        for batch in batches:
            rows = [(b, len(d.leaves), d.encoded, d.n_tokens) for b, d in _edited(batch, vocabulary)]
            b, leaves, anew, after = zip(*rows, strict=True) if rows else ((),) * 4
            edits = [len(e or ()) for e in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (b, leaves, edits, anew, after)]],
                names=[f.split()[0] for f in _COUNTS.split(", ")])
    return trees.select(*[f.split()[0] for f in _TREES.split(", ")]).mapInArrow(run, _COUNTS)
