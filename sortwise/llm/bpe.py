"""Byte-pair encoding of distinct words, speculated and verified with numpy.

``Vocabulary`` reads a public tokenizer file (JSON with ``vocab`` and ``merges``).
``encode_pieces`` proposes tokens by greedy longest match for many words at once,
tests every adjacent pair of proposed tokens for compatibility, and merges exactly
only the words that fail.  A sequence in which every adjacent pair is compatible
is the exact encoding, because merges run in order of rank and no merge then ever
crosses a token boundary.

``Encoder`` cuts texts into pre-tokens from code-point classes, looks distinct
pre-tokens up in a bounded table, and hands only new ones to ``encode_pieces``.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .textvec import span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Symbols of a piece beyond which it is merged exactly at once.
LONG = 24
#: Entries of an encoder's table before it starts anew; bounds a worker's memory.
TABLE = 250_000
END = 256
NEVER = np.int64(1 << 40)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    text = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[m.start(): m.end()] = kind
    return out


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level files: the
    byte's own Latin-1 character where that is printable, else 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, token parts and a hash table of the tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.suffix = model["end_of_word_suffix"] or ""
        self.words = bool(self.suffix)
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = r, z
            self.rank[z], self.left[z], self.right[z] = r, x, y
        self.formed = np.array([z for _, z in self.merge.values()], dtype=np.int64)
        keys = np.array([x * size + y for x, y in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merge.values()], dtype=np.int64)[order]
        self.pair_seen = np.zeros(1 << 20, dtype=bool)
        self.pair_seen[self._cell(self.pair_keys)] = True
        spelt = [self._symbols(t) for t in vocab]
        flat = np.array([s for t in spelt for s in t], dtype=np.int64)
        ends = np.cumsum([len(t) for t in spelt])
        hashes = span_hashes(flat, ends - [len(t) for t in spelt], ends)
        order = np.argsort(hashes)
        self.token_keys, self.token_ids = hashes[order], np.array(list(vocab.values()), dtype=np.int64)[order]
        self.token_seen = np.zeros(1 << 20, dtype=bool)
        self.token_seen[hashes >> np.uint64(44)] = True
        self.base = {tuple(t): i for t, i in zip(spelt, vocab.values(), strict=True) if len(t) - (t[-1:] == [END]) == 1}

    def _symbols(self, token: str) -> list[int]:
        ends = self.words and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if ends else token
        return [byte_alphabet()[c] for c in body] + [END] * ends

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NEVER where there is none."""
        key = x * self.size + y
        out = np.full(len(key), NEVER)
        some = np.flatnonzero(self.pair_seen[self._cell(key)])
        key = key[some]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        same = self.pair_keys[at] == key
        out[some[same]] = self.pair_ranks[at[same]]
        return out

    @staticmethod
    def _cell(key: np.ndarray) -> np.ndarray:
        """Cell of a pair in the table that tells most absent pairs at once."""
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the boundary between tokens x and y.

        Going back in time, the later-formed of the two tokens at the boundary is
        taken apart; each pair met this way stood at the boundary until one of
        them was merged with its other neighbour (``until``).  A crossing merge
        of smaller rank, or on the right of equal rank (leftmost first), would
        have come first."""
        good = np.ones(len(x), dtype=bool)
        live = np.arange(len(x))
        x, y = x.copy(), y.copy()
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(live):
            m = self.ranks(x, y)
            bad = (m != NEVER) & (m < until_x) & (m <= until_y)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry, until_x, until_y = (v[on] for v in (live, x, y, rx, ry, until_x, until_y))
            of_x = rx > ry
            until_x, until_y = np.where(of_x, rx, until_x), np.where(of_x, until_y, ry)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return good

    def exact(self, piece: bytes) -> list[int]:
        """Merge one piece by rank, leftmost first (heap over a linked list)."""
        if not piece:
            return []
        ids = [self.base[(b,)] for b in piece]
        if self.words:
            ids[-1] = self.base[(piece[-1], END)]
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.merge[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heapq.heapify(heap)
        heap = [(r, i, z, p) for r, z, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, pair = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], nxt[i] = z, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (q := self.merge.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (q[0], a, q[1], (ids[a], ids[b])))
        return [t for t in ids if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[list[np.ndarray], int]:
        """Token ids of each piece; how many failed the check and were merged exactly."""
        out: list = [None] * len(pieces)
        extra = int(self.words)
        length = np.array([len(p) for p in pieces], dtype=np.int64) + extra
        short = np.flatnonzero((length <= LONG) & (length > extra))
        failed = set(np.flatnonzero(length > LONG).tolist())
        for i in np.flatnonzero(length == extra):
            out[i] = np.zeros(0, dtype=np.int64)
        for k in range(0, len(short), 20_000):
            self._speculate(pieces, short[k: k + 20_000], length, out, failed)
        rows = np.array(sorted(i for i in failed if length[i] <= LONG), dtype=np.int64)
        for k in range(0, len(rows), 20_000):
            self._merge_all(pieces, rows[k: k + 20_000], out)
        for i in failed:
            if length[i] > LONG:
                out[i] = np.array(self.exact(pieces[i]), dtype=np.int64)
        return out, len(failed)

    def _merge_all(self, pieces, rows, out) -> None:
        """Exact merging of many short pieces at once: each round merges, in every
        piece, its leftmost pair of least rank."""
        width = max(len(pieces[i]) for i in rows)
        bytes_ = np.zeros((len(rows), width), dtype=np.uint8)
        size = np.array([len(pieces[i]) for i in rows])
        bytes_[np.arange(width) < size[:, None]] = np.frombuffer(b"".join([pieces[i] for i in rows]), dtype=np.uint8)
        plain = np.array([self.base[(b,)] for b in range(256)])
        ids = plain[bytes_]
        if self.words:
            tail = np.array([self.base[(b, END)] for b in range(256)])
            ids[np.arange(len(rows)), size - 1] = tail[bytes_[np.arange(len(rows)), size - 1]]
        rank = np.full((len(rows), max(width - 1, 1)), NEVER)
        r, c = np.nonzero(np.arange(1, width) < size[:, None])
        rank[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        who = rows
        while len(who):
            at = rank.argmin(axis=1)
            line = np.arange(len(who))
            least = rank[line, at]
            ended = least == NEVER
            for j in np.flatnonzero(ended).tolist():
                out[who[j]] = ids[j, : size[j]].copy()
            who, ids, rank, size, at, least = (v[~ended] for v in (who, ids, rank, size, at, least))
            if not len(who):
                break
            line, n = np.arange(len(who)), ids.shape[1]
            cols = np.arange(n - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            ids[line, at] = self.formed[least]
            size = size - 1
            if rank.shape[1] == 1:
                rank = np.full((len(who), 1), NEVER)
                continue
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            near = np.flatnonzero(at > 0)
            rank[near, at[near] - 1] = self.ranks(ids[near, at[near] - 1], ids[near, at[near]])
            near = np.flatnonzero(at + 1 < size)
            rank[near, at[near]] = self.ranks(ids[near, at[near]], ids[near, at[near] + 1])

    def _speculate(self, pieces, rows, length, out, failed) -> None:
        flat = np.frombuffer(b"".join(pieces[i] + b"\0" * self.words for i in rows), dtype=np.uint8).astype(np.int64)
        size = length[rows]
        stop = np.cumsum(size)
        if self.words:
            flat[stop - 1] = END
        at, owner = stop - size, np.arange(len(rows))
        end = stop.copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        dead = np.zeros(len(rows), dtype=bool)
        while len(at):
            most = int((end - at).max())
            reach = np.arange(most, 0, -1)
            to = at[:, None] + reach
            fits = to <= end[:, None]
            if self.words:
                fits &= to != end[:, None] - 1
            r, c = np.nonzero(fits)
            h = span_hashes(flat, at[r], to[r, c])
            some = self.token_seen[h >> np.uint64(44)]
            r, c, h = r[some], c[some], h[some]
            pos = np.minimum(np.searchsorted(self.token_keys, h), len(self.token_keys) - 1)
            hit = self.token_keys[pos] == h
            r, first = np.unique(r[hit], return_index=True)  # reach descends: the longest match
            pick, pos = np.flatnonzero(hit)[first], pos[hit][first]
            moved = np.full(len(at), -1)
            moved[r] = to[r, c[pick]]
            steps.append((owner[r], self.token_ids[pos]))
            dead[owner[moved < 0]] = True
            on = (moved >= 0) & (moved < end)
            at, end, owner = moved[on], end[on], owner[on]
        who = np.concatenate([w for w, _ in steps])
        ids = np.concatenate([t for _, t in steps])
        order = np.argsort(who, kind="stable")
        who, ids = who[order], ids[order]
        inner = np.flatnonzero(who[:-1] == who[1:])
        dead[who[inner[~self.compatible(ids[inner], ids[inner + 1])]]] = True
        cut = np.searchsorted(who, np.arange(len(rows) + 1))
        for j, i in enumerate(rows.tolist()):
            if dead[j]:
                failed.add(i)
            else:
                out[i] = ids[cut[j]: cut[j + 1]]


def _lower(text: str) -> str:
    """Lower case one character at a time, as the tokenizer does (no final-sigma rule)."""
    return text.replace("Σ", "σ").lower()


class Encoder:
    """Encodes texts through a table of distinct pre-tokens."""

    def __init__(self, path: str, render: bool = False):
        self.v = Vocabulary(path)
        self.render = render  # also keep each row's ids and tokens as text
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")") if self.v.special else None
        self.words = self.v.words
        self.failed = self.fresh = 0
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.shown_ids: list[bytes] = []
        self.shown: list[bytes] = []

    def normal(self, text: str) -> str:
        if self.words:
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = _lower(text)
        return text

    def special_in(self, text: str) -> bool:
        return self.marks is not None and "<|" in text and self.marks.search(text) is not None

    def segments(self, text: str) -> list[str | int]:
        """Normalised stretches of text and the ids of special tokens between them."""
        if self.marks is None or "<|" not in text:
            return [self.normal(text)]
        parts = self.marks.split(text)
        return [self.v.special[p] if k % 2 else self.normal(p) for k, p in enumerate(parts)]

    def pieces(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token.  Texts' code points lie end to end."""
        n = len(points)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return z, z
        kind = classes()[points]
        edge = np.zeros(n + 1, dtype=bool)  # a text starts here
        edge[offsets] = True
        start = np.empty(n, dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= edge[:n]
        if self.words:
            start |= kind == NUMBER
        else:
            gap = kind == SPACE  # the last white space before other text stands apart, or leads it if U+0020
            last = np.flatnonzero(gap[:-1] & ~gap[1:] & ~edge[1:n])
            start[last] = True
            start[last[points[last] == 32] + 1] = False
        tick = np.flatnonzero((points == 39) & start)
        tick = tick[tick + 1 < n]
        tick = tick[~edge[tick + 1]]
        if len(tick):
            c1 = points[tick + 1]
            one = np.isin(c1, [115, 116, 109, 100])  # s t m d
            more = tick + 2 < n
            safe = np.minimum(tick + 2, n - 1)
            more &= ~edge[safe]
            c2 = np.where(more, points[safe], 0)
            two = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)  # re ve ll
            for chosen, width in ((one, 2), (two, 3)):
                at = tick[chosen]
                start[at + 1] = False
                rest = at + width
                rest = rest[rest < n]
                start[rest[kind[rest] == LETTER]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        if self.words:
            keep = kind[begin] != SPACE
            begin, end = begin[keep], end[keep]
        return begin, end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table row of every pre-token of ``texts``, and where each text's rows end.

        Rows stay valid until the next call.  Special tokens are rows too."""
        parts: list[str] = []
        insert: list[tuple[int, int]] = []  # a special token before the pre-tokens of part k
        owner: list[int] = []
        for d, t in enumerate(texts):
            for s in self.segments(t):
                if isinstance(s, int):
                    insert.append((len(parts), s))
                    parts.append("")
                else:
                    parts.append(s)
                owner.append(d)
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        offsets = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        begin, end = self.pieces(points, offsets)
        self.last_spans = begin, end  # code points in the joined texts, if none has a special token
        if len(self.keys) > TABLE:
            self._reset()
        uniq, first, inverse = np.unique(span_hashes(points, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        row = np.empty(len(uniq), dtype=np.int64)
        row[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            spans = zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            row[new] = self._add([whole[a:b].encode() for a, b in spans])
            keys = np.concatenate([self.keys, uniq[new]])
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], np.concatenate([self.rows, row[new]])[order]
        rows = row[inverse]
        part_end = np.searchsorted(begin, offsets[1:], side="left")
        if insert:
            where = part_end[[k for k, _ in insert]]
            rows = np.insert(rows, where, self._specials([s for _, s in insert]))
            part_end = part_end + np.cumsum(np.bincount([k for k, _ in insert], minlength=len(parts)))
        last = np.searchsorted(np.array(owner), np.arange(len(texts)), side="right") - 1
        return rows, part_end[last] if len(texts) else np.zeros(0, dtype=np.int64)

    def _store(self, ids: list[np.ndarray]) -> np.ndarray:
        count = np.array([len(x) for x in ids], dtype=np.int64)
        base, first = len(self.ids), len(self.count)
        self.ids = np.concatenate([self.ids, *ids]).astype(np.uint32)
        self.start = np.concatenate([self.start, base + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        if self.render:
            for x in ids:
                each = x.tolist()
                self.shown_ids.append("".join([f" {t}" for t in each]).encode())
                self.shown.append("".join([f" {self.v.token[t]}" for t in each]).encode())
        return np.arange(first, first + len(ids))

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        ids, failed = self.v.encode_pieces(pieces)
        self.failed += failed
        self.fresh += len(pieces)
        return self._store(ids)

    def _specials(self, ids: list[int]) -> np.ndarray:
        kinds = sorted(set(ids))
        rows = dict(zip(kinds, self._store([np.array([i]) for i in kinds]).tolist(), strict=True))
        return np.array([rows[i] for i in ids], dtype=np.int64)

    def flat_ids(self, rows: np.ndarray) -> np.ndarray:
        """Token ids of a run of table rows, end to end."""
        count = self.count[rows]
        total = int(count.sum())
        if not total:
            return np.zeros(0, dtype=np.uint32)
        shift = np.repeat(self.start[rows] - (np.cumsum(count) - count), count)
        return self.ids[np.arange(total) + shift]


@lru_cache(4)
def encoder(path: str, render: bool = False) -> Encoder:
    """One encoder per worker process and file; its table outlives a task."""
    return Encoder(path, render)
