"""Conversation repair against exhaustive search and a plain scan of the damage."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from sortwise.llm import stand_ins
from sortwise.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, faults):
    """(cost, audit, lines) of every sequence of edits with at most one insertion at a place."""
    n = len(rows)
    own = []
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        extra = int(fault == "truncated")
        choices = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            choices += [("K", extra, (role, text)), ("R", 2 + extra, ("user", text)), ("R", 2 + extra, ("assistant", text))]
        own.append(choices)
    ins = [[("", 0, None), ("I", 2, ("user", "")), ("I", 2, ("assistant", ""))]] * (n + 1)
    order = [x for i in range(n) for x in (ins[i], own[i])] + [ins[n]]
    for pick in itertools.product(*order):
        lines = [p[2] for p in pick if p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
            yield sum(p[1] for p in pick), "".join(p[0] for p in pick), lines


def expected(rows, search=all_repairs):
    out = []
    table = damage(rows)
    for conv in sorted({r[0] for r in rows}, key=str):
        mine = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = plain_faults(mine)
        cost, audit, lines = min(search(mine, faults), key=lambda x: x[:2])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost,
                    audit, sha))
    return out


def dynamic(rows, faults):
    """The cheapest repair of a long conversation, by a plain table over rows and roles."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def insert(states):
        for _ in range(3):
            for s, (c, a, x) in list(states.items()):
                for role in ("user", "assistant"):
                    if (s, role[0]) in step:
                        put(states, role[0], (c + 2, a + "I", (*x, (role, ""))))
        return states

    insert(best)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new, extra = {}, int(fault == "truncated")
        for s, (c, a, x) in best.items():
            put(new, s, (c + 3, a + "D", x))
            if fault in ("blank", "duplicate"):
                continue
            if (s, role[:1]) in step:
                put(new, step[s, role[:1]], (c + extra, a + "K", (*x, (role, text))))
            for other in ("user", "assistant"):
                if (s, other[0]) in step:
                    put(new, other[0], (c + 2 + extra, a + "R", (*x, (other, text))))
        best = insert(new)
    return [best[s] for s in ("", "a") if s in best]


def conversation(r, conv, n):
    roles = ["system", "user", "assistant", "tool", "user", "assistant"]
    texts = ["Yes.", "No", "  ", "Why?\n", "So it is! ", "ça ", "again."]
    rows, at = [], r.randint(0, 3)
    for _ in range(n):
        at += r.choice([1, 1, 1, 2])
        rows.append((conv, at, r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"text {r.randint(0, 9)}."))
    return rows


def small_rows():
    r = random.Random(8)
    rows = [x for conv in range(60) for x in conversation(r, conv, r.randint(0, 4))]
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (100, 3, None, "b."), (100, 3, "assistant", None),
             (None, 1, "user", "lost."), (None, None, None, None), (101, 5, "", "c."), (102, 1, "user", "x" * 70_000 + "."),
             (103, 2, "assistant", "b."), (103, 2, "assistant", "a."), (103, 2, "user", "z.")]
    rows += [(conv, 0, "user", "one.") for conv in range(200, 260)]  # some lose their only row
    return rows


def test_search_equals_exhaustive_and_dynamic():
    r = random.Random(1)
    for _ in range(300):
        mine = [(0, i, *x[2:]) for i, x in enumerate(conversation(r, 0, r.randint(0, 4)))]
        faults = plain_faults(mine)
        names = {"blank": T.BLANK_ROW, "duplicate": T.DUPLICATE_ROW, "truncated": T.TRUNCATED_ROW, "": T.SOUND_ROW}
        rows = "".join(T.code(x[2][:1], names[f]) for x, f in zip(mine, faults, strict=True))
        assert T.cheapest(rows) == min(x[:2] for x in all_repairs(mine, faults)) == min(x[:2] for x in dynamic(mine, faults))


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_segments_join_exactly(segment, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", segment)
    r = random.Random(segment)
    for _ in range(40):
        mine = [(0, i, *x[2:]) for i, x in enumerate(conversation(r, 0, r.randint(50, 150)))]
        rows = "".join(r.choice("suaxSUAX-") for _ in mine)
        faults = ["blank" if c == "-" else "truncated" if c.isupper() else "" for c in rows]
        mine = [(0, 0, c.lower(), "t") for c in rows]
        assert T.cheapest(rows) == min(x[:2] for x in dynamic(mine, faults))


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("parts", ["1", "9"])
def test_query_equals_brute_force(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(small_rows(), SCHEMA).selectExpr("*", "'x' AS at", "'y' AS mark", "1 AS dup").repartition(3)
        got = rows_of(T.repair(stand_ins.damaged(df), df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(expected(small_rows()), key=str)
    assert ("", hashlib.sha256(b"").hexdigest()) in {x[-2:] for x in got}


def test_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows, with copies of one row; it is cut into pieces."""
    r = random.Random(3)
    rows = [(7, i // 2, *x[2:]) for i, x in enumerate(conversation(r, 7, 900))] + conversation(r, 8, 5)
    rows += [(7, 100, "user", "copy.")] * 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = rows_of(T.repair(stand_ins.damaged(df), df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(expected(rows, dynamic), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.repair(df, df).count() == 0
