"""Small fixtures shared by the tests of the llm operators."""
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n=80):
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.5) + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n ", "en", "a", 4), (None, "lonely text", "en", "a", 3),
            (None, None, None, None, None), (4, prose(4), "en", "a", 9), (4, prose(4), "en", "a", 9), (5, prose(4), "en", "b", 9),
            (6, prose(6, 30_000), "en", "b", 9), (7, "x" * 50_000, "en", "b", 9), (8, "ção é já 日本 👍 <|endoftext|>", "pt", "b", 9),
            (9, prose(4).replace(" ", "  "), "en", "c", 9)]
    return rows


def frame(spark, rows, clash=True):
    """``documents``-like table; with columns whose names operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in ("kept", "score", "node", "_sha", "_id", "part", "key", "a.b", "_row", "fold", "host"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower_az(text))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(rows):
    """doc index -> least doc_id reachable, by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((row[0], len(sets[i]), min(group) if group else None))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))
