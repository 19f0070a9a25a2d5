"""Bounded-space online packing of token sequences.

Each task keeps ``windows`` open windows.  A document's ids (then an end id) are
cut into pieces of at most ``length``; whole windows are emitted at once.  The
remaining piece goes to the open window where it leaves the least room (best
fit).  When it fits nowhere, the fullest window is emitted and a new one opened;
if the fullest has at least ``cut`` places free, it is first filled with the head
of that piece.  Windows still open at a task's end are leftovers: they travel as
lists of pieces, not ids, ``fan_in`` tasks' worth at a time, and are merged whole
by best fit, longest first, level by level, until one level has a single group or
no two windows fit together.

A sequence's tokens are counted, never moved: pieces carry the checksum of their
ids.  ``padding`` is what fills a sequence to ``length``; a sequence whose size is a
power of two needs none.  Null and empty texts are the end id alone.  Repeated ids
are packed as documents of their own.  Sequence ids are unique but not dense.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import materialise
from .textvec import slices, tidy

LENGTH = 2048
#: Open windows per task.
WINDOWS = 64
#: Places free from which an emitted window is filled by cutting a piece.
CUT = 64
#: Tasks whose leftovers meet in one group of a merge level.
FAN_IN = 16
#: Bytes of text that are encoded together.
SLICE = 1 << 19
#: Sequence ids of one task or group start at its number times this.
BLOCK = 1 << 36

#: level: 0 for a full window of a task; open: the window is a leftover.
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, sequence_tokens long, part long, open boolean")
_NAMES = [f.split()[0] for f in _PIECES.split(", ")]


class Windows:
    """Open windows of one task, sorted by size."""

    def __init__(self, length: int, windows: int):
        self.length, self.most = length, windows
        self.sizes: list[tuple[int, int]] = []  # (size, number), ascending
        self.number = 0
        self.held: dict[int, list] = {}

    def place(self, piece, size: int) -> bool:
        """Into the fullest window with room for it."""
        at = bisect.bisect_right(self.sizes, (self.length - size, 1 << 62)) - 1
        if at < 0:
            return False
        used, n = self.sizes.pop(at)
        self.held[n].append((piece, used))
        bisect.insort(self.sizes, (used + size, n))
        return True

    def open(self, piece, size: int) -> None:
        self.held[self.number] = [(piece, 0)]
        bisect.insort(self.sizes, (size, self.number))
        self.number += 1

    def fullest(self) -> tuple[int, int]:
        return self.sizes[-1]

    def emit(self) -> tuple[int, list]:
        _, n = self.sizes.pop()
        return n, self.held.pop(n)


def pack_ids(documents, length: int, windows: int, cut: int):
    """Yields (open?, window number, [(piece, offset)]) over ``documents``, an
    iterator of (doc_id, ids); a piece is (doc_id, start, length, crc, doc_tokens)."""
    w = Windows(length, windows)
    for doc_id, ids in documents:
        n = len(ids)
        raw = ids.astype("<u4", copy=False).tobytes()

        def piece(a, b, doc_id=doc_id, raw=raw, n=n):
            return doc_id, a, b - a, zlib.crc32(raw[4 * a: 4 * b]), n

        at = 0
        while n - at >= length:
            yield False, w.number, [(piece(at, at + length), 0)]
            w.number += 1
            at += length
        while at < n:
            size = n - at
            if w.place(piece(at, n), size):
                break
            if len(w.sizes) >= w.most:
                used, number = w.fullest()
                room = length - used
                if cut <= room < size:
                    w.held[number].append((piece(at, at + room), used))
                    at += room
                yield (False, *w.emit())
                if at < n and w.place(piece(at, n), n - at):
                    break
            if len(w.sizes) < w.most:
                w.open(piece(at, n), n - at)
                break
    while w.sizes:
        yield (True, *w.emit())


def _rows(windows, part: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _NAMES]
    for is_open, number, pieces in windows:
        total = pieces[-1][1] + pieces[-1][0][2]
        for (doc_id, start, size, crc, n), offset in pieces:
            for c, v in zip(cols, (doc_id, start, size, crc, n, part * BLOCK + number, offset, total, part, is_open),
                            strict=True):
                c.append(v)
    kinds = [pa.int64()] * (len(_NAMES) - 1) + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)


def _pack_task(vocabulary: str, end_id: int, length: int, windows: int, cut: int):
    def documents(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi, _, _ in slices(texts, SLICE):
                part = ["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()]
                rows, stops = enc.encode(part)
                ids = enc.flat_ids(rows)
                upto = np.concatenate([[0], np.cumsum(enc.count[rows])])[stops]
                first = 0
                for k, last in enumerate(upto.tolist()):
                    yield names[lo + k], np.append(ids[first:last], np.uint32(end_id))
                    first = last

    @tidy
    def run(batches):
        part, held = TaskContext.get().partitionId(), []
        for window in pack_ids(documents(batches), length, windows, cut):
            held.append(window)
            if len(held) >= 2000:
                yield _rows(held, part)
                held = []
        yield _rows(held, part)
    return run


def merge_windows(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """Best fit, longest first: for each window its merged window and offset there."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out: list = [None] * len(sizes)
    bins: list[tuple[int, int]] = []  # (size, number), ascending
    for i in order:
        at = bisect.bisect_right(bins, (length - sizes[i], 1 << 62)) - 1
        used, number = bins.pop(at) if at >= 0 else (0, i)
        out[i] = number, used
        bisect.insort(bins, (used + sizes[i], number))
    return out


def _merge_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        sequence = table["sequence_id"].to_numpy()
        offset = table["offset"].to_numpy()
        size = table["length"].to_numpy()
        windows, which = np.unique(sequence, return_inverse=True)
        filled = np.zeros(len(windows), dtype=np.int64)
        np.maximum.at(filled, which, offset + size)
        put = merge_windows(filled.tolist(), length)
        into = np.array([n for n, _ in put], dtype=np.int64)
        shift = np.array([off for _, off in put], dtype=np.int64)
        total = np.bincount(into, weights=filled, minlength=len(windows)).astype(np.int64)[into]
        new = {"sequence_id": windows[into][which], "offset": offset + shift[which],
               "sequence_tokens": total[which],
               "open": (total * 2 <= length)[which]}  # no two windows over half full can merge
        for name, values in new.items():
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table.select(_NAMES)
    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, windows: int = WINDOWS, cut: int = CUT, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens, padding.

    The first pass is narrow.  Each merge level shuffles at most ``windows`` open
    windows per task; a group holds at most ``windows`` times ``fan_in`` of them."""
    tasks = materialise(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
            .mapInArrow(_pack_task(vocabulary, end_id, length, windows, cut), _PIECES), "windows")
    done, level, span = tasks.where(~F.col("open")), tasks.where("open"), fan_in
    last = level.agg(F.max("part")).first()[0] or 0
    while True:
        level = materialise(level.groupBy(F.floor(F.col("part") / span).alias("_group"))
                            .applyInArrow(_merge_group(length), _PIECES), "merged")
        if last < span:
            break
        done, level, span = done.unionByName(level.where(~F.col("open"))), level.where("open"), span * fan_in
    tokens = F.col("sequence_tokens")
    return done.unionByName(level).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
        F.when(tokens.bitwiseAND(tokens - 1) == 0, F.lit(0).cast("long")).otherwise(length - tokens).alias("padding"))
