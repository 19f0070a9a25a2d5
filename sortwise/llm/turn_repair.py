"""Repair of conversations by the cheapest edits, found by branch and bound.

A conversation's rows stand in the order of turn (nulls first), then role, then text (its
first ``PREFIX`` characters, then its digest).  A row's fault is the first that holds of:
*blank* (nothing but ``[\\x20\\x09-\\x0D]``), *duplicate* (same role and text earlier in the
conversation), *truncated* (last other character not ``[.!?]``).  Edits of a row: Keep 0,
Rerole to user or assistant 2, Delete 3 (the only one for blank and duplicate rows); an
undeleted truncated row adds 1; an empty user or assistant turn may be Inserted anywhere
for 2.  The roles' initials must come out as ``(s?(ua)+)?``.  The *audit* is the initials of
the edits in order; of the cheapest ones the least in ASCII order is taken.

``search`` is a depth-first branch and bound over (row, state): an explicit stack, the
most promising edit on top; the sum of what the remaining rows must cost at least as the
lower bound; the best (cost, audit) so far as the incumbent; and for every (row, state)
the best (cost, audit) that reached it, so worse prefixes end there.  The stack running
empty proves the incumbent.  Conversations of more than ``SEGMENT`` rows are searched in
segments, once for every state at either end, and segments are joined two by two: costs
add up and audits follow one another, so the join is exact.

Rows are sorted once by a range shuffle, which splits a long conversation over many
tasks, and written to the shared folder.  A conversation whose rows lie together in one
task, as nearly all do, is finished there.  Others (two a task at most) are finished by
pieces: duplicates by an aggregate over (conversation, role, digest of the text), a
table of segment results per piece, one join of pieces per conversation, and a digest
taken from the sorted rows as they stream by.  So no conversation is held as a whole.

Null roles and texts count as one space.  A null conv_id is a conversation of its own;
null turns come first and don't count for gaps.  Repeated rows are duplicates.  An empty
table gives an empty result; conversations of ``ids`` without rows get zeros, an empty
audit and the digest of the empty text.  Very long texts take no part in the search.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Rows of a segment that is searched at once.
SEGMENT = 64
#: Characters of a text that order rows of one turn and role, before its digest.
PREFIX = 64

WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
_NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after an inserted or renamed turn: only one of user and assistant may follow.
_FORCED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW, SOUND_ROW = range(4)


def code(initial: str, fault: int) -> str:
    """A row as the search sees it: ``-`` must go; else the initial (x: no role that may
    stay), a capital for a truncated row."""
    if fault in (BLANK_ROW, DUPLICATE_ROW):
        return "-"
    c = initial if initial in ("s", "u", "a") else "x"
    return c.upper() if fault == TRUNCATED_ROW else c


def suffix_bounds(rows: str) -> list[int]:
    """What rows i, i+1, ... must cost at least.  Rows that must go cost a deletion, each
    other truncated row one.  Two neighbours (but for rows that go) that may not follow
    one another cost at least one more: no edit settles more than two such pairs, and an
    edit costs two or more."""
    out, follow = [0] * (len(rows) + 1), ""
    for i in range(len(rows) - 1, -1, -1):
        c = rows[i].lower()
        if c == "-":
            out[i] = out[i + 1] + DELETE
            continue
        out[i] = out[i + 1] + TRUNCATED * rows[i].isupper() + (follow != "" and c + follow not in LEGAL)
        follow = c
    return out


@lru_cache(1 << 16)
def search(rows: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cheapest (cost, audit) from one state before ``rows`` to one of ``ends`` behind
    them; the least audit of equally cheap ones; None if there is none."""
    bound, n = suffix_bounds(rows), len(rows)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, start)]
    while stack:
        cost, audit, i, state = stack.pop()
        if best is not None:
            least = cost + bound[i]
            if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
                continue
        seen = reached.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        steps = [(cost + INSERT, audit + "I", i, _FORCED[state])]
        if i < n:
            steps.append((cost + DELETE, audit + "D", i + 1, state))
            if rows[i] != "-":
                extra = TRUNCATED * rows[i].isupper()
                kept = _NEXT.get((state, rows[i].lower()))
                if kept is not None:
                    steps.append((cost + KEEP + extra, audit + "K", i + 1, kept))
                if kept != _FORCED[state]:
                    steps.append((cost + REROLE + extra, audit + "R", i + 1, _FORCED[state]))
        steps.sort(key=lambda s: (s[0] + bound[s[2]], s[1]), reverse=True)
        stack += steps
    return best


#: (start, end) -> (cost, audit) of a stretch of rows; what can't be is left out.
Table = dict[tuple[int, int], tuple[int, str]]


def table(rows: str) -> Table:
    found = {(a, b): search(rows, a, (b,)) for a in range(4) for b in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def joined(one: Table, two: Table) -> Table:
    out: Table = {}
    for (a, m), (cost, audit) in one.items():
        for b in range(4):
            more = two.get((m, b))
            if more is not None:
                both = (cost + more[0], audit + more[1])
                if (a, b) not in out or both < out[a, b]:
                    out[a, b] = both
    return out


def joined_all(tables: list[Table]) -> Table:
    """Neighbours two by two, level by level."""
    while len(tables) > 1:
        pairs = [joined(a, b) for a, b in zip(tables[::2], tables[1::2])]  # noqa: B905
        tables = pairs + tables[len(pairs) * 2:]
    return tables[0] if tables else {(a, a): (0, "") for a in range(4)}


def table_of(rows: str) -> Table:
    return joined_all([table(rows[k: k + SEGMENT]) for k in range(0, len(rows), SEGMENT)])


def cheapest(rows: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(rows) <= SEGMENT:
        return search(rows, NONE, ENDS)
    return best_end(table_of(rows))


def best_end(t: Table) -> tuple[int, str]:
    return min(t[NONE, b] for b in ENDS if (NONE, b) in t)


def fault_of(text: str, seen: bool) -> int:
    rest = text.strip(WHITE)
    if not rest:
        return BLANK_ROW
    if seen:
        return DUPLICATE_ROW
    return SOUND_ROW if rest[-1] in ".!?" else TRUNCATED_ROW


def digest(role: str, text: str) -> bytes:
    """Of a role and a text, which tells duplicates."""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).digest()


class Writer:
    """The repaired turns of a conversation, row by row, into a sha256 of ``role:text``
    lines.  Turns are user and assistant by turns, behind a system turn if their number is odd."""

    def __init__(self, odd: bool):
        self.odd, self.place, self.sha = int(odd), 0, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.place else "") + f"{role}:{text}").encode())
        self.place += 1

    def row(self, edits: str, role: str, text: str) -> None:
        for e in edits:
            new = ("user", "assistant")[(self.place - self.odd) % 2]
            if e == "I":
                self._put(new, "")
            elif e == "K":
                self._put(role, text)
            elif e == "R":
                self._put(new, text)


def odd_turns(audit: str) -> bool:
    return (len(audit) - audit.count("D")) % 2 == 1


def edits_by_row(audit: str) -> list[str]:
    """An audit cut into its rows: a row's insertions stand before its own edit, those
    behind the last row go with it.  Without rows there is nothing."""
    out, at = [], 0
    for i, e in enumerate(audit):
        if e != "I":
            out.append(audit[at: i + 1])
            at = i + 1
    if out:
        out[-1] += audit[at:]
    return out


def illegal_pairs(initials: str) -> int:
    """Neighbours that may not follow one another; a role without a character is ``?``."""
    return sum(initials[i: i + 2] not in LEGAL for i in range(len(initials) - 1))


def _pieces(batches):
    """Rows (conv_id, turn, role, text, at, dup) in order, cut where the conversation
    changes or ``at`` skips.  A piece has no more rows than its task reads."""
    held, conv, nxt = [], None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != conv or row[4] != nxt):
                yield held
                held = []
            conv, nxt = row[0], row[4] + 1
            held.append(row)
    if held:
        yield held


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_TURNS = "min_turn long, max_turn long, turns long"


def _faults(rows) -> list[int]:
    """Faults of a piece's rows; where ``dup`` isn't known it is taken from the piece."""
    seen, out = set(), []
    for _, _, role, text, _, dup in rows:
        if dup is None:
            d = digest(role, text)
            dup = d in seen
            seen.add(d)
        out.append(fault_of(text, dup))
    return out


def _counts(rows, faults) -> tuple:
    turns = [r[1] for r in rows if r[1] is not None]
    initials = "".join(r[2][:1] or "?" for r in rows)
    return (faults.count(BLANK_ROW), faults.count(DUPLICATE_ROW), faults.count(TRUNCATED_ROW), illegal_pairs(initials),
            min(turns, default=None), max(turns, default=None), len(set(turns)))


_SOLVED = (f"conv_id long, at long, size long, {_COUNTS}, {_TURNS}, cost long, audit string, repaired_sha256 string")


def _solve(batches):
    """Every piece as if it were a whole conversation."""
    for out in _in_blocks(_solved_piece(p) for p in _pieces(batches)):
        yield _batch(out, _SOLVED)


def _solved_piece(rows) -> tuple:
    faults = _faults(rows)
    cost, audit = cheapest("".join(code(r[2][:1], f) for r, f in zip(rows, faults, strict=True)))
    w = Writer(odd_turns(audit))
    for edits, r in zip(edits_by_row(audit), rows, strict=True):
        w.row(edits, r[2], r[3])
    return (rows[0][0], rows[0][4], len(rows), *_counts(rows, faults), cost, audit, w.sha.hexdigest())


def _in_blocks(items, size: int = 1000):
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
          "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


# -- conversations whose rows lie in several tasks ------------------------------------------

_TABLES = (f"conv_id long, at long, size long, {_COUNTS}, {_TURNS}, first_turn long, last_turn long, first string, last string, "
           "costs array<long>, audits array<string>")


def _tables(batches):
    """A piece's counts and its table, for every state at either end."""
    def one(rows):
        faults = _faults(rows)
        t = table_of("".join(code(r[2][:1], f) for r, f in zip(rows, faults, strict=True)))
        cells = [t.get((a, b)) for a in range(4) for b in range(4)]
        return (rows[0][0], rows[0][4], len(rows), *_counts(rows, faults), rows[0][1], rows[-1][1], rows[0][2][:1] or "?",
                rows[-1][2][:1] or "?", [c and c[0] for c in cells], [c and c[1] for c in cells])

    for out in _in_blocks((one(p) for p in _pieces(batches)), 20):
        yield _batch(out, _TABLES)


_EDITED = f"conv_id long, at long, {_COUNTS}, {_TURNS}, cost long, audit string, edits string, odd boolean"


def _edit_pieces(group):
    """Join the pieces of one conversation (no more than there are tasks): a row a piece
    with its part of the audit; the first one also has the conversation's figures."""
    rows = sorted(group.to_pylist(), key=lambda r: r["at"])
    tables = [{(k // 4, k % 4): (c, r["audits"][k]) for k, c in enumerate(r["costs"]) if c is not None} for r in rows]
    cost, audit = best_end(joined_all(tables))
    total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(rows, rows[1:]):  # noqa: B905
        total["illegal"] += a["last"] + b["first"] not in LEGAL
        total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low = min((r["min_turn"] for r in rows if r["min_turn"] is not None), default=None)
    high = max((r["max_turn"] for r in rows if r["max_turn"] is not None), default=None)
    out, at, odd, parts = [], 0, odd_turns(audit), edits_by_row(audit)
    for k, r in enumerate(rows):
        edits = "".join(parts[at: at + r["size"]])
        at += r["size"]
        figures = (total["blank"], total["duplicate"], total["truncated"], total["illegal"], low, high, total["turns"], cost,
                   audit) if k == 0 else (None,) * 9
        out.append((r["conv_id"], r["at"], *figures, edits, odd))
    return pa.Table.from_batches([_batch(out, _EDITED)])


_ROW_EDITS = "edit_at long, edits string, odd boolean"


def _spread(batches):
    """A piece's edits as one row for every row of the piece."""
    for batch in batches:
        for at, edits, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = edits_by_row(edits)
            for out in _in_blocks(((at + i, e, odd) for i, e in enumerate(parts)), 10_000):
                yield _batch(out, _ROW_EDITS)


def _hash_rows(batches):
    """conv_id and digest of conversations whose rows (conv_id, role, text, edits, odd) come in order."""
    conv, writer = None, None
    for batch in batches:
        done = []
        for row_conv, role, text, edits, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if writer is None or row_conv != conv:
                if writer is not None:
                    done.append((conv, writer.sha.hexdigest()))
                conv, writer = row_conv, Writer(odd)
            writer.row(edits, role, text)
        if done:
            yield _batch(done, "conv_id long, repaired_sha256 string")
    if writer is not None:
        yield _batch([(conv, writer.sha.hexdigest())], "conv_id long, repaired_sha256 string")


def _by_pieces(ordered: DataFrame) -> DataFrame:
    """Conversations of ``ordered`` (conv_id, turn, role, text, at), finished by pieces."""
    mark = F.md5(F.concat_ws(":", F.length("role"), F.concat("role", "text")))
    rows = materialise(ordered.withColumn("mark", mark), "cut")
    first = rows.groupBy("conv_id", "mark").agg(F.min("at").alias("first_at"))
    met = rows.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id"))
                               & (F.col("r.mark") == F.col("f.mark")))
    marked = materialise(met.select("r.conv_id", "turn", "role", "text", "at", (F.col("at") > F.col("first_at")).alias("dup"))
                         .repartitionByRange("at").sortWithinPartitions("at"), "marked")
    tables = marked.mapInArrow(_tables, _TABLES)
    edited = materialise(tables.groupBy("conv_id").applyInArrow(_edit_pieces, _EDITED), "edited")
    edits = edited.select("at", "edits", "odd").repartition("at").mapInArrow(_spread, _ROW_EDITS)
    shas = (marked.join(edits, F.col("at") == F.col("edit_at")).repartition("conv_id").sortWithinPartitions("conv_id", "at")
            .select("conv_id", "role", "text", "edits", "odd").mapInArrow(_hash_rows, "conv_id long, repaired_sha256 string"))
    whole = edited.where("cost IS NOT NULL").drop("at", "edits", "odd")
    s = shas.withColumnRenamed("conv_id", "sha_conv")
    return whole.join(s, F.col("conv_id").eqNullSafe(F.col("sha_conv"))).drop("sha_conv")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    space = F.lit(" ")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    # the last key splits copies of one row over tasks; which copy comes first makes no difference
    keys = ["conv_id", "turn", "role", "head", "mark", "copy"]
    spread = plain.withColumns({"head": F.substring("text", 1, PREFIX), "mark": F.md5("text"),
                                "copy": F.monotonically_increasing_id()})
    ordered = materialise(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("head", "mark", "copy")
                          .withColumn("at", F.monotonically_increasing_id()), "ordered")
    solved = materialise(ordered.withColumn("dup", F.lit(None).cast("boolean")).mapInArrow(_solve, _SOLVED), "solved")
    # a task cuts two conversations at most, its first and its last; the list is broadcast
    cut = materialise(solved.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("cut_id")), "cut_ids")
    same = F.col("conv_id").eqNullSafe(F.col("cut_id"))
    done = solved.join(F.broadcast(cut), same, "left_anti").drop("at", "size")
    both = done.unionByName(_by_pieces(ordered.join(F.broadcast(cut), same, "left_semi")))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    found = both.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        "repaired_sha256")
    if ids is None:
        return found
    empty = hashlib.sha256(b"").hexdigest()
    all_ids = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = all_ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"),
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
