"""Similarity join on word n-grams: prefix, length, positional and suffix filters.

A text's set holds the 64-bit hashes of its distinct 5-word shingles (words
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a text of fewer words is one shingle, one
without words has the empty set and links with nothing.  Two texts link when
100 * intersection >= 80 * union.

1. One pass gives each document its set's size and a 64-bit digest of the set.
   Equal sets are one *node*, so copies are never expanded into pairs.  The pass
   also reports shingles that it meets often (``heavy``).
2. A second pass orders each set rare first (heavy shingles by their count last,
   ties by hash) and emits the prefix that any partner must touch:
   n - ceil(0.8 n) + 1 shingles, each with its position and the sizes of the
   suffix behind it in four classes.  A task emits a node once.
3. Rows are shuffled by shingle.  Very frequent shingles are salted into blocks of
   about ``BLOCK`` rows.  Sorted blocks are streamed: shingles of one node go; every
   other row is paired with its block's leader and its predecessor, if what the
   filters say of any shared shingle allows it, and with nothing else.  So a block of k near copies gives under 2k pairs.
   Of these, pairs that enough of their prefix proposes are verified.
4. Pairs are verified on whole sets, once each; links give components.  The texts of
   all nodes that meet another one are written once, with a bitmap of each set: bit
   ``hash mod 64 k`` is its parity among the set's shingles.
5. Components that meet in blocks are contracted: each pairs with the largest
   component of its blocks, two pairs of documents for a pair of components.
6. Shingles that still connect different components are joined on the shingle,
   all pairs of rows from different components that pass the filters; those not yet
   verified are verified.  Here the suffix filter also compares the bitmaps: where
   they differ, the sets do, so they may differ in no more bits than linked sets in
   shingles.  A bitmap is far longer than a row, so only rows of shingles with more
   than ``CROWD`` of them carry it; other pairs, few a row, meet it once they are
   distinct.  Every pair of linked texts is thus either verified or inside one
   component already, so no link is lost.

Null texts count as empty.  Rows that repeat a doc_id are documents of their own.
A null doc_id takes part, but is never a component's id; a component without any id
has null.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise
from .textvec import LOWER, mix, slices, tidy, windows, word_hashes

SIZE = 5
#: Shingles whose counts are taken together; what one chunk meets once isn't reported.
CHUNK = 4 << 20
#: Most heavy shingles that are broadcast (16 bytes each).  They only set the order.
HEAVY = 1 << 18
#: Rows of a salted block of a frequent shingle.
BLOCK = 20_000
#: Share of a document's prefix that must propose a pair before the last pass.
SUPPORT = 0.15
#: Contractions of components before the last pass, which leaves nothing out in any case.
ROUNDS = 1
#: Rows of a shingle beyond which they carry their bitmaps in the last pass.
CROWD = 16
#: Bytes of text whose shingles are taken together; temporaries take forty times that.
SLICE = 1 << 19
#: Bits of the broadcast filter of nodes whose texts are wanted (1 MB).
FILTER_BITS = 23
#: Bits of a set's bitmap for four of its shingles, at least: a set that differs from
#: another in a quarter of its shingles then shows four fifths of that in its bits.
SPREAD_BITS = 7

_SEED = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, doc = word_hashes(LOWER[data], offsets)
    hashes, at = windows(words, doc, SIZE)
    n = len(offsets) - 1
    cut = np.searchsorted(doc[at], np.arange(n + 1)).tolist()
    first = np.searchsorted(doc, np.arange(n + 1)).tolist()
    out = []
    for d in range(n):
        if cut[d + 1] > cut[d]:
            s = np.sort(hashes[cut[d]: cut[d + 1]])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            few = words[first[d]: first[d + 1]]
            out.append(windows(few, np.zeros(len(few), dtype=np.int64), len(few))[0] if len(few) else few)
    return out


def node_of(shingles: np.ndarray) -> int:
    """Digest of a set as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ _SEED).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """Parity of a set's hashes per bit, as 64-bit words; their number is a power of two, so
    the bitmap of a set in half as many words is the two halves' exclusive or."""
    words = 1 << max(0, ((SPREAD_BITS * len(shingles) + 3) // 4 - 1 >> 6).bit_length())
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _bits_apart_sql(a, b):
    """Bits in which two bitmaps (arrays of long) differ; the longer one is folded."""
    def folded(x, y):
        half = F.size(x) / 2
        return F.when(F.size(x) > F.size(y), F.zip_with(
            F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")),
            lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    apart = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x)


def _sets(batches):
    """Per slice: the ids (first column) and the sets of its texts (last column)."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for lo, hi, data, offsets in slices(texts, SLICE):
            yield batch.slice(lo, hi - lo), shingle_sets(data, offsets)


_SCAN = "doc_id long, n_shingles long, node long, key long, count long"


@tidy
def _scan(batches):
    """Document rows (key null) and rows of shingles met twice or more (key set)."""
    held, size, seen = [], 0, set()

    def frequent():
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        again = count > 1
        none = pa.nulls(int(again.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(keys[again].view(np.int64)), pa.array(count[again])], names=names)

    names = [f.split()[0] for f in _SCAN.split(", ")]
    for batch, sets in _sets(batches):
        nodes = [node_of(s) for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), none, none],
            names=names)
        for node, s in zip(nodes, sets, strict=True):
            if node not in seen and len(s):
                seen.add(node)
                held.append(s)
                size += len(s)
        if size > CHUNK:
            yield frequent()
            held, size, seen = [], 0, set()
    if held:
        yield frequent()


def heavy_shingles(scan: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles, at most ``most``: the
    least power of two is chosen as the bound of the count for which they are no more."""
    counted = materialise(scan.where("key IS NOT NULL").groupBy("key").agg(F.sum("count").alias("count")), "heavy")
    by_size = counted.groupBy(F.floor(F.log2("count")).alias("p")).count().orderBy(F.desc("p")).collect()
    total, least = 0, None
    for p, n in by_size:
        total += n
        if total > most:
            break
        least = 1 << p
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = counted.where(F.col("count") >= least).toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["count"].to_numpy()[order]


_ROWS = "key long, salt int, node long, n int, pos int, suffix long"


def prefix_length(n: int) -> int:
    return n - (8 * n + 9) // 10 + 1


def _prefixes(heavy):
    @tidy
    def run(batches):
        keys, counts = heavy.value
        seen: set[int] = set()
        for _, sets in _sets(batches):
            cols: list[list] = [[] for _ in range(6)]
            for s in sets:
                n = len(s)
                if not n or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[at] == s, counts[at], 0)
                    if often.any():
                        order = np.argsort(often, kind="stable")
                        s, often = s[order], often[order]
                else:
                    often = np.zeros(n, dtype=np.int64)
                p = prefix_length(n)
                kind = (s & np.uint64(3)).astype(np.int64)
                suffix = np.zeros(p, dtype=np.int64)
                for c in range(4):
                    behind = np.cumsum(kind[::-1] == c)[::-1]  # at and behind each place
                    own = np.append(behind[1: p + 1], 0)[:p] if p == n else behind[1: p + 1]
                    suffix |= np.minimum(own, 0x7FFF) << np.int64(16 * c)
                blocks = often[:p] // BLOCK
                cols[0].append(s[:p].view(np.int64))
                cols[1].append(np.where(blocks > 0, 1 + (node & 0xFFFFFF) % (blocks + 1), 0))
                for c, v in ((2, node), (3, n)):
                    cols[c].append(np.full(p, v))
                cols[4].append(np.arange(p))
                cols[5].append(suffix)
            if cols[0]:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)],
                    names=[f.split()[0] for f in _ROWS.split(", ")])
    return run


def allowed(n1, p1, s1, n2, p2, s2):
    """Length, positional and suffix filter of two rows of one shingle (numpy).

    All hold for the first shingle, in the common order, that two linked sets share:
    nothing before it is shared, and class sizes bound what is shared behind it."""
    need = (4 * (n1 + n2) + 8) // 9
    good = (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= need)
    apart = p1 + p2
    for c in range(4):
        apart = apart + np.abs(((s1 >> 16 * c) & 0xFFFF) - ((s2 >> 16 * c) & 0xFFFF))
    return good & (apart <= n1 + n2 - 2 * need)


def possible(n1, p1, s1, n2, p2, s2):
    """What two linked sets meet at any shingle that they share, first or not: length
    filter, and at most the shorter prefix, the shingle and the common part of each
    suffix class can be shared."""
    need = (4 * (n1 + n2) + 8) // 9
    most = np.minimum(p1, p2) + 1
    for c in range(4):
        most = most + np.minimum((s1 >> 16 * c) & 0xFFFF, (s2 >> 16 * c) & 0xFFFF)
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (most >= need)


def _possible_sql(a, b):
    """``possible`` for two row structs."""
    need = F.floor((4 * (a["n"] + b["n"]) + 8) / 9)
    most = F.least(a["pos"], b["pos"]) + 1
    for c in range(4):
        most = most + F.least(F.shiftright(a["suffix"], 16 * c).bitwiseAND(0xFFFF),
                              F.shiftright(b["suffix"], 16 * c).bitwiseAND(0xFFFF))
    return (5 * F.least(a["n"], b["n"]) >= 4 * F.greatest(a["n"], b["n"])) & (most >= need)


def _allowed_sql(a: str, b: str):
    """``allowed`` as a join condition."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    p1, p2, s1, s2 = F.col(f"{a}.pos"), F.col(f"{b}.pos"), F.col(f"{a}.suffix"), F.col(f"{b}.suffix")
    need = F.floor((4 * (n1 + n2) + 8) / 9)
    apart = p1 + p2
    for c in range(4):
        apart = apart + F.abs(F.shiftright(s1, 16 * c).bitwiseAND(0xFFFF) - F.shiftright(s2, 16 * c).bitwiseAND(0xFFFF))
    return ((5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)
            & (apart <= n1 + n2 - 2 * need))


def _alike_sql(n1, bits1, n2, bits2):
    """Whether bitmaps of sets of these sizes differ in no more bits than linked sets may."""
    most = n1 + n2 - 2 * F.floor((4 * (n1 + n2) + 8) / 9)
    return (F.when(F.size(bits1) > 2 * F.size(bits2), False).when(F.size(bits2) > 2 * F.size(bits1), False)
            .otherwise(_bits_apart_sql(bits1, bits2) <= most))


_SHARED = "key long, node long, n int, pos int, suffix long, leader long, before long"


def _met_twice(batches):
    """Columns of the rows whose shingle another node has too, in order.  Input is
    sorted by key, salt, n, node; one row is held back between batches."""
    fields = [f.split()[0] for f in _ROWS.split(", ")]
    held, linked = None, False  # linked: the held row belongs with the row before it
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {f: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(fields)}
        if held is not None:
            cols = {f: np.append(held[f], cols[f]) for f in fields}
        same = (cols["key"][1:] == cols["key"][:-1]) & (cols["salt"][1:] == cols["salt"][:-1])
        fresh = np.append(True, ~(same & (cols["node"][1:] == cols["node"][:-1])))
        cols = {f: v[fresh] for f, v in cols.items()}
        same = (cols["key"][1:] == cols["key"][:-1]) & (cols["salt"][1:] == cols["salt"][:-1])
        after = np.append(linked, same)  # belongs with the row before it
        use = np.flatnonzero(after[:-1] | same | (cols["salt"][:-1] > 0))
        yield {f: v[use] for f, v in cols.items()}
        held, linked = {f: v[-1:] for f, v in cols.items()}, bool(after[-1])
    if held is not None and (linked or held["salt"][0] > 0):
        yield held


@tidy
def _blocks(batches):
    """Rows of shingles of several nodes, each with its block's leader and the row
    before it to pair with (null where the filters rule them out).  A row too long
    for its leader becomes the leader of those behind it."""
    names = [f.split()[0] for f in _SHARED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    block, leader, last = None, None, None
    for cols in _met_twice(batches):
        if not len(cols["key"]):
            continue
        rows = list(zip(*(cols[f].tolist() for f in ("key", "salt", "node", "n", "pos", "suffix")), strict=True))
        lead, before = [], []
        for key, salt, *row in rows:
            if (key, salt) != block:
                block, leader, last = (key, salt), row, row
                lead.append(row)
                before.append(row)
                continue
            lead.append(leader)
            before.append(last)
            if 5 * leader[1] < 4 * row[1]:
                leader = row
            last = row

        def partner(others, cols=cols):
            node, n, pos, suffix = np.array(others, dtype=np.int64).T
            good = (node != cols["node"]) & possible(cols["n"], cols["pos"], cols["suffix"], n, pos, suffix)
            return pa.array(node, mask=~good)

        yield pa.RecordBatch.from_arrays(
            [*[pa.array(cols[f], k) for f, k in zip(names[:5], kinds, strict=True)], partner(lead), partner(before)],
            names=names)


def _enough(support, n):
    """Whether so many shingles are enough of the prefix of a set of size n."""
    return support >= SUPPORT * (n - F.ceil(0.8 * n) + 1)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b out of rows with node, n, leader, before."""
    both = rows.select("node", "n", F.explode(F.array_distinct(F.array("leader", "before"))).alias("other"))
    return (both.where("other IS NOT NULL")
                .groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
                .agg(F.count(F.lit(1)).alias("support"), F.min("n").alias("n"))
                .where(_enough(F.col("support"), F.col("n"))).select("a", "b"))


def _contracted(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify between each component and the largest one that it shares a
    block with: two of those that their blocks propose, if enough do.  All aggregations
    combine on the map side."""
    row = F.struct("node", "n", "pos", "suffix")
    # the join below asks one side alone for a component that isn't null, the other alone for
    # the size: asked of both, they read one shuffle
    known = placed.where("key IS NOT NULL AND component IS NOT NULL")
    per = known.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("size"), F.min_by(row, F.xxhash64("node", "key")).alias("r"))
    lead = (per.groupBy("key").agg(F.max_by(F.struct("component", "r"), F.struct("size", "component")).alias("l"),
                                   F.count(F.lit(1)).alias("parts")).where("parts > 1"))
    met = per.where("size > 0").join(lead, "key").select(
        "component", F.col("l.component").alias("other"), "r", F.col("l.r").alias("o"))
    met = met.where((F.col("component") != F.col("other")) & _possible_sql(F.col("r"), F.col("o")))
    met = met.withColumns({"a": F.least("r.node", "o.node"), "b": F.greatest("r.node", "o.node"), "n": F.col("r.n")})
    pair = F.struct("a", "b")
    best = met.groupBy("component", "other").agg(
        F.count(F.lit(1)).alias("support"), F.min("n").alias("n"),
        F.min_by(pair, F.xxhash64("a", "b")).alias("p"), F.min_by(pair, F.xxhash64("b", "a")).alias("q"))
    chosen = best.where(_enough(F.col("support"), F.col("n"))).select(F.explode(F.array("p", "q")).alias("p"))
    return chosen.select("p.a", "p.b").distinct()


def _wanted(nodes: DataFrame) -> np.ndarray:
    """Bit table of the nodes' top bits; its size doesn't depend on how many there are."""
    cells = nodes.select(F.shiftrightunsigned("node", 64 - FILTER_BITS).alias("cell"))
    words = cells.groupBy(F.expr("cell div 64").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(cell % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


_TEXTS = "node long, text string, bits array<long>"


def _texts(wanted):
    """(node, text, bitmap) of documents whose node may be wanted; a task emits a node once."""
    @tidy
    def run(batches):
        bits, seen = wanted.value, set()
        for batch, sets in _sets(batches):
            pick, nodes, maps = [], [], []
            for i, s in enumerate(sets):
                node = node_of(s)
                if bits[(node & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)] and node not in seen:
                    seen.add(node)
                    pick.append(i)
                    nodes.append(node)
                    maps.append(bitmap_of(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), batch.column(1).take(pa.array(pick, pa.int64())),
                 pa.array(maps, pa.list_(pa.int64()))], names=["node", "text", "bits"])
    return run


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text, bits) of ``nodes`` (node), in one narrow pass over ``docs`` (text column
    last): all of them, and few others; a node may come from several tasks."""
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(nodes))
    return materialise(docs.mapInArrow(_texts(wanted), _TEXTS), "texts")


def _picked(wanted):
    @tidy
    def run(batches):
        bits = wanted.value
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bits[(node >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]))
    return run


@tidy
def _verify(batches):
    """(a, b) of the pairs whose whole sets link."""
    last_node, last_set = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right = batch.column(2), batch.column(3)
        good = []
        for i in range(batch.num_rows):
            if b[i] != last_node:
                last_node, last_set = b[i], _set_of(right[i])
            mine = _set_of(left[i])
            shared = len(np.intersect1d(mine, last_set, assume_unique=True))
            if 100 * shared >= 80 * (len(mine) + len(last_set) - shared):
                good.append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], names=["a", "b"])


def _set_of(text) -> np.ndarray:
    raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]))[0]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that link.  Texts that no pair wants are left out
    before the shuffle; the others meet their pairs in two equi-joins."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = pairs.sparkSession.sparkContext.broadcast(_wanted(nodes))
    some = texts.select("node", "text").mapInArrow(_picked(wanted), "node long, text string").dropDuplicates(["node"])
    one = some.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = some.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return materialise(met.mapInArrow(_verify, "a long, b long"), "links")


def _open_pairs(placed: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) not in ``tried`` of nodes of different components that share a shingle
    and pass all filters."""
    mixed = (placed.groupBy("key")
                   .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"))
                   .where("lo < hi").select("key", (F.col("rows") > CROWD).alias("crowded")))
    rows = materialise(placed.join(mixed, "key"), "open")
    bits = texts.select("node", "bits").dropDuplicates(["node"])

    def met(rows, alike):
        a, b = rows.alias("a"), rows.alias("b")
        apart = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
                       & (F.col("a.component") != F.col("b.component")) & _allowed_sql("a", "b") & alike)
        return apart.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"),
                            F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))

    few = met(rows.where("NOT crowded"), F.lit(True))
    many = met(rows.where("crowded").join(bits, "node"),
               _alike_sql(F.col("a.n"), F.col("a.bits"), F.col("b.n"), F.col("b.bits")))
    pairs = few.unionByName(many).distinct().join(tried, ["a", "b"], "left_anti")
    seen = (pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
                 .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b"))
    alike = _alike_sql(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"))
    return materialise(seen.where(alike).select("a", "b"), "more")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id
    reachable by links, its own included)."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    scan = materialise(source.mapInArrow(_scan, _SCAN), "scan")
    rows = scan.where("key IS NULL").drop("key", "count")
    heavy = spark.sparkContext.broadcast(heavy_shingles(scan))
    shared = materialise(
        source.mapInArrow(_prefixes(heavy), _ROWS).repartition("key", "salt")
              .sortWithinPartitions("key", "salt", "n", "node").mapInArrow(_blocks, _SHARED), "shared")
    texts = texts_of(shared.select("node"), source)
    tried = materialise(_pairs(shared), "pairs")
    links = verified(tried, texts)
    rows_only = shared.drop("leader", "before")

    def place(links):
        return materialise(rows_only.join(components(links), "node", "left")
                           .withColumn("component", F.coalesce("component", "node")), "placed")

    placed = place(links)
    for _ in range(ROUNDS):
        pairs = materialise(_contracted(placed).join(tried, ["a", "b"], "left_anti"), "contracted")
        if pairs.isEmpty():
            break
        found = verified(pairs, texts)
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if found.isEmpty():
            break
        placed = place(links)
    more = _open_pairs(placed, texts, tried)
    found = components(links.unionByName(verified(more, texts)))
    classed = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = materialise(classed, "classed")
    named = classed.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    full = classed.where("n_shingles > 0").join(named, "component").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(classed.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that link, directly or over others, with a row that stays:
    of each component the row with the least id (null ids last); columns as they were.

    Rows are told apart by a number of their own, whatever their ids.  Only numbers are
    joined to the texts, as an anti-join."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    numbered = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    classes = similar_classes(numbered, "row", text_at).select(F.col("doc_id").alias("row"), "component_id")
    ranked = classes.join(numbered.select("row", F.col(id_at).cast("long").alias("id")), "row")
    place = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "row")
    stays = ranked.groupBy("component_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"))
    stays = stays.where("size > 1").select("component_id", F.col("first.row").alias("kept_row"))
    gone = materialise(ranked.join(stays, "component_id").where("row <> kept_row").select("row"), "gone")
    return numbered.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)
