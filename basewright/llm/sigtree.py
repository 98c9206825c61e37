"""N-gram Jaccard join by signature trees.

A signature is a bitmap into which each shingle of a set is hashed to one bit. If two sets share o shingles, then
o <= bits set in both + the lesser of the sets' excess (shingles less bits). A node of a tree holds the OR of its members'
bitmaps, the ranges of their sizes, excesses and components; the same bound holds for any pair of members of two nodes. A pair
of nodes of which no members can overlap enough for their sizes is pruned with all below it: a dual traversal goes from the
roots down, splits both sides in turn and compares full sets only where two leaves are left. No link can be lost.

1. A counting pass: bitmap counters of all shingles' hashes, COUNTERS of them whatever the input's size, added up within tasks
   and then by piece. They order the shingles: those of well-filled counters last, then by hash. Any fixed order is right; this
   one keeps common passages out of the prefixes.
2. A pass over the whole texts makes each row's set of shingles (64-bit hashes), a 128-bit digest of it, its signature and
   its prefix, the first n - ceil(percent * n / 100) + 1 shingles of the order. Sets that link share one of their prefixes, so
   there is a tree for each shingle that stands in two prefixes, and none has to hold the whole corpus.
3. Rows with equal sets are one class and one leaf.
4. A tree's first traversals: its least leaf is met by all others, then its greatest one by those still in another component;
   sizes, counts of shared prefix shingles and signatures prune, and whole texts confirm the rest. This links groups of copies
   without pairs among them.
5. That settles all pairs with an end of a tree. Of the trees with more than one leaf between the ends, those with the same least
   leaf are one, of the leaves between, so that a pair of copies, which share many shingles, meets once. Those whose leaves still
   lie in several components are traversed in blocks inside tasks, against each other where there are
   several; nodes within one component are pruned. Signatures go there first; only the leaves that they leave open with one of
   another component follow with their full sets, to trees of wider bitmaps. A spanning forest of the links found is given out,
   at most one a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.llm.blocks import by_blocks, column, joined_components, open_groups
from basewright.llm.classes import classes_of, confirmed_links, documents_of, near, of_classes, rows_of, sets_of
from basewright.llm.common import checkpointed, freed, swept, table
from basewright.llm.components import connected_components
from basewright.llm.shingles import shingle_set

#: Counters of the first pass (4 bytes each, 1 MB) and their pieces.
COUNTERS, PIECE = 1 << 18, 1 << 13
#: Bits of a signature, by its set's size: the power of 2 from twice the size on, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 17
#: Bits of a tree's bitmaps for each shingle of its largest leaf.
SPREAD = 32
#: Words of bitmaps that are compared at once.
STEP = 1 << 20
#: Bands of sizes in the ratio of two that link.
BANDS = 16
#: Rows up to which the signatures of least and greatest leaves (some hundred bytes each) are broadcast.
BROADCAST_SIGNATURES = 50_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def places(s: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each shingle in a bitmap of a power of 2 bits; in one of half the bits it is the same modulo the half."""
    return (((s ^ (s >> np.uint64(32))) * _MIX) >> np.uint64(40)) & np.uint64(bits - 1)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of uint64 words."""
    out = np.zeros(bits, np.uint8)
    out[places(s, bits)] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def signature_bits(n: int) -> int:
    return min(max(1 << (2 * n - 1).bit_length(), LEAST_BITS), MOST_BITS) if n else LEAST_BITS


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap brought to fewer bits."""
    while 64 * len(words) > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def may_link(both: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int, percent: int):
    """Whether sets of sizes na and nb that share at most `both` can link; right for least sizes of nodes, too."""
    return (100 + percent) * both >= percent * (na + nb)


def signature(s: np.ndarray) -> bytes:
    """The size of a set and its bitmap."""
    return len(s).to_bytes(8, "little") + bitmap(s, signature_bits(len(s))).tobytes()


def parsed(sig: bytes) -> tuple[int, np.ndarray]:
    words = np.frombuffer(sig, "<u8")
    return int(words[0]), words[1:]


def signatures_allow(a: bytes, b: bytes, percent: int) -> bool:
    """The bound for two leaves, from their signatures."""
    (na, x), (nb, y) = parsed(a), parsed(b)
    if 100 * na < percent * nb or 100 * nb < percent * na:
        return False
    bits = 64 * min(len(x), len(y))
    x, y = folded(x, bits), folded(y, bits)
    excess = min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
    return bool(may_link(min(int(np.bitwise_count(x & y).sum()) + excess, na, nb), na, nb, percent))


class Tree:
    """A binary tree over bitmaps, level 0 the leaves in order of size and bitmap; each level's arrays hold its nodes in order."""

    def __init__(self, maps: np.ndarray, size: np.ndarray, components: np.ndarray):
        """order: which of the given each leaf is."""
        self.order = np.lexsort((maps[:, 0], size))
        maps, size, components = maps[self.order], size[self.order], components[self.order]
        excess = size - np.bitwise_count(maps).sum(axis=1).astype(int)
        self.levels = [(maps, size, size, excess, components, components)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex, c_lo, c_hi = self.levels[-1]
            at = np.arange(0, len(m), 2)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), np.minimum.reduceat(c_lo, at), np.maximum.reduceat(c_hi, at)))

    def split(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes' children a level below, and which of `nodes` each is of."""
        below = np.concatenate([2 * nodes, 2 * nodes + 1])
        of = np.concatenate([np.arange(len(nodes))] * 2)
        there = below < len(self.levels[level - 1][0])
        return below[there], of[there]


def _open(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the node pairs (i of x, j of y) may hold a link between two components."""
    keep = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])
    keep &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
    step = max(STEP // x[0].shape[1], 1)
    for at in range(0, len(i), step):
        part = at + np.flatnonzero(keep[at : at + step])
        a, b = i[part], j[part]
        both = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1).astype(int) + np.minimum(x[3][a], y[3][b])
        keep[part] = may_link(np.minimum(both, np.minimum(x[2][a], y[2][b])), x[1][a], y[1][b], percent)
    return keep


def leaf_pairs(left: Tree, right: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The dual traversal: pairs of leaves that the bounds leave open."""
    a, b = len(left.levels) - 1, len(right.levels) - 1
    i, j = np.zeros(1, int), np.zeros(1, int)
    while True:
        keep = _open(left.levels[a], i, right.levels[b], j, percent)
        i, j = i[keep], j[keep]
        if not len(i) or a == b == 0:
            return i, j
        if a >= b:
            i, of = left.split(a, i)
            j, a = j[of], a - 1
        else:
            j, of = right.split(b, j)
            i, b = i[of], b - 1


def set_tree(sets: list[np.ndarray], components: np.ndarray, bits: int) -> Tree:
    return Tree(np.array([bitmap(s, bits) for s in sets]), np.array([len(s) for s in sets]), components)


def hopeful(percent: int):
    """Rows of two blocks with signatures -> (key, node) of the leaves left open with one of another component.

    Signatures of one length are a tree; it meets that of as long ones, and the folded ones of twice the length, as sets that link
    are no further apart."""

    def decide(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        sides = []
        for rows in (left, right):
            by: dict[int, list[int]] = {}
            sigs = [parsed(r[6]) for r in rows]
            for k, (_, words) in enumerate(sigs):
                by.setdefault(64 * len(words), []).append(k)
            sides.append((rows, sigs, by, np.zeros(len(rows), bool)))

        def tree(side: tuple, of: int, bits: int) -> Tree:
            rows, sigs, by, _ = side
            at = by[of]
            return Tree(np.array([folded(sigs[k][1], bits) for k in at]), np.array([sigs[k][0] for k in at]), np.array([rows[k][5] for k in at], np.int64))

        for a in sides[0][2]:
            for b in (a // 2, a, 2 * a):
                if b in sides[1][2]:
                    x, y = tree(sides[0], a, min(a, b)), tree(sides[1], b, min(a, b))
                    i, j = leaf_pairs(x, y, percent)
                    sides[0][3][np.array(sides[0][2][a])[x.order[i]]] = True
                    sides[1][3][np.array(sides[1][2][b])[y.order[j]]] = True
        nodes = np.unique([rows[k][4] for rows, _, _, on in sides for k in np.flatnonzero(on)]).astype(np.int64)
        return np.full(len(nodes), left[0][0]), nodes
    return decide


def spanning_links(percent: int):
    """Rows of two blocks with full sets -> component pairs of a spanning forest of the links between rows of different components."""

    def decide(left: list[tuple], right: list[tuple]) -> tuple[list[int], list[int]]:
        sides = [[np.frombuffer(r[6], np.uint64) for r in x] for x in (left, right)]
        most = max(len(s) for x in sides for s in x)
        bits = max(min(1 << (SPREAD * most - 1).bit_length(), MOST_BITS), LEAST_BITS)
        of = [column(x, 5) for x in (left, right)]
        a, b = (set_tree(x, c, bits) for x, c in zip(sides, of, strict=True))
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        u, v = [], []
        for i, j in zip(*leaf_pairs(a, b, percent), strict=True):
            i, j = a.order[i], b.order[j]
            x, y = root(int(of[0][i])), root(int(of[1][j]))
            if x != y:
                both = len(np.intersect1d(sides[0][i], sides[1][j], assume_unique=True))
                if may_link(both, len(sides[0][i]), len(sides[1][j]), percent):
                    up[max(x, y)] = min(x, y)
                    u.append(x)
                    v.append(y)
        return u, v
    return decide


def _counting(k: int):
    """(text) -> (piece, counts) of all shingles by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), k) for t in batch.column(0).slice(at, 500)]
                seen += np.bincount(np.concatenate(sets).astype(np.int64) & (COUNTERS - 1), minlength=COUNTERS)
        if seen.any():
            pieces = [seen[at : at + PIECE].tobytes() for at in range(0, COUNTERS, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "counts"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, counts) -> one row for each piece: what this task holds of it, added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_py(), np.int64)
            total[piece] = total[piece] + x if piece in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])


def levels_of(texts: DataFrame, k: int) -> np.ndarray:
    """A byte for each counter: 0 up to the mean, then sixteen steps for each doubling. COUNTERS bytes go to the executors, whatever the input."""
    parts = texts.select("text").mapInArrow(freed(_counting(k)), "piece int, counts binary")
    parts = parts.repartition(COUNTERS // PIECE, "piece").mapInArrow(_added, "piece int, counts binary")
    seen = np.zeros(COUNTERS, np.int64)
    for r in parts.collect():  # COUNTERS numbers
        seen[r.piece * PIECE : (r.piece + 1) * PIECE] += np.frombuffer(r.counts, np.int64)
    share = np.maximum(seen, 1) / max(seen.mean(), 1)
    return np.clip(np.round(16 * np.log2(share)), 0, 255).astype(np.uint8)


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set, in order of (level, hash): so many that sets that link share one."""
    n = len(s)
    first = n - -(-percent * n // 100) + 1 if n else 0
    return s[np.argsort(levels[s.astype(np.int64) & (len(levels) - 1)], kind="stable")[:first]]


_FEATURES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _features(k: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                sets = [shingle_set(t.as_py(), k) for t in piece.column(2)]
                keys = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]
                firsts = [prefix(s, levels, percent).view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, firsts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts)))
                columns = [[len(s) for s in sets], [x[0] for x in keys], [x[1] for x in keys], [signature(s) for s in sets]]
                arrays = [pa.array(x, f.type) for x, f in zip(columns, list(_FEATURES)[2:6], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *arrays, lists], schema=_FEATURES)
    return run


def _allowed(percent: int):
    """Rows (p, d, sp, sd) -> the pairs (p, d) whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [signatures_allow(a.as_py(), b.as_py(), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _of_near_sizes(groups: DataFrame, percent: int) -> DataFrame:
    """groups (key, c, n_shingles, inner, ...) without the rows that no row of another component in their group may link with, by
    their sizes and the prefix shingles they can share: at most `inner`, the trees in which they stand between the ends.

    Two sets of sizes m <= n that share so many link only if (100 + percent) * (inner + percent * n / 100) > percent * (m + n), see
    _possible. So a row has partners in two ranges of sizes, which are taken by bands; rows of two bands that want each other stay."""
    step = F.log(F.lit(101.0 / percent)) / BANDS
    band = lambda n: F.floor(F.log(n.cast("double")) / step)
    n, shares = F.col("n_shingles"), F.col("inner") * (100 + percent) / percent
    larger = F.sequence(band(F.greatest(n, F.floor((n - shares) * 100 / percent))), band(F.floor(n * 100 / percent)))
    smaller = F.sequence(band(F.greatest(F.floor(n * percent / 100), F.lit(1))), band(F.least(n, F.ceil(n * percent / 100 + shares))))
    rows = groups.withColumn("own", band(n))
    wanted = rows.withColumn("other", F.explode(F.array_union(smaller, larger))).withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    found = wanted.groupBy("key", "a", "b").agg(F.min("c").alias("v"), F.max("c").alias("w"), F.min("own").alias("x"), F.max("own").alias("y"))
    kept = found.where("v <> w AND x = a AND y = b").select("key", "a", "b")
    return wanted.join(kept, ["key", "a", "b"], "left_semi").select(groups.columns).distinct()


def _possible(pairs: DataFrame, own: DataFrame, end: str, percent: int) -> DataFrame:
    """pairs (p, d, c), p the `end` (lo or hi) of c trees that d stands in -> the pairs (p, d) that sizes and shared prefixes allow.

    own (node, n_shingles, trees, lo, hi, ...): the trees that a node stands in, and is the least and greatest leaf of. If p's prefix ends
    first in the order, what p and d share is in both prefixes or behind p's; and likewise for d. So they share no more than their
    prefixes do, and the larger of the sets' rests: that many are ceil(percent * n / 100) - 1 of a set of n."""
    of = lambda x: near(own.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("trees").alias(f"t{x}"), F.col(end).alias(f"e{x}")))
    rest = F.ceil(F.greatest("np", "nd") * percent / 100) - 1
    both = F.least(F.col("c") + F.col("tp") - F.col("ep"), "tp", "td") + rest
    return pairs.join(of("p"), "p").join(of("d"), "d").where(may_link(F.least(both, "np", "nd"), F.col("np"), F.col("nd"), percent)).select("p", "d")


def _sigs_of(sigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sigs (node, sig), with a row for each row that repeats a class -> those of the nodes in wanted (node), once each."""
    return sigs.join(near(checkpointed(wanted.distinct())), "node").dropDuplicates(["node"])


def _met(rows: DataFrame, nodes: DataFrame, sigs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (p, d), each once, of many d with few p -> their links (u, v): signatures first, whole texts of the pairs they allow."""
    ends = checkpointed(_sigs_of(sigs, pairs.select(F.col("p").alias("node"))).select(F.col("node").alias("p"), F.col("sig").alias("sp")))
    with_d = pairs.join(_sigs_of(sigs, pairs.select(F.col("d").alias("node"))).select(F.col("node").alias("d"), F.col("sig").alias("sd")), "d")
    both = with_d.join(near(ends, BROADCAST_SIGNATURES), "p").select("p", "d", "sp", "sd")
    allowed = checkpointed(both.mapInArrow(freed(_allowed(percent)), "p long, d long"))
    return confirmed_links(rows, nodes, allowed, k, percent)


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, version, n_shingles, component_id, first: a row for each row of documents; see classes.documents_of.

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles (ASCII white space between words,
    A-Z lower-cased). Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; a text of fewer than
    k words is one shingle; ties need no order; a doc_id that stands on several texts has the links of all of them, and each of its
    rows is returned; a null doc_id is never linked and gives component_id null; an empty table gives no rows; further columns are
    ignored.
    """
    rows = rows_of(documents)
    levels = levels_of(rows, k)
    schema = "doc_id long, version long, n_shingles long, k1 long, k2 long, sig binary, prefix array<long>"
    f = checkpointed(rows.mapInArrow(freed(_features(k, percent, levels)), schema))
    nodes = classes_of(f)
    leaves = of_classes(f, nodes, ["n_shingles", "sig", "prefix"])
    at = leaves.select("node", F.explode("prefix").alias("bucket"))
    tree = Window.partitionBy("bucket")
    # all prefixes are exchanged once; the rows of a tree are numbers, which Spark spills
    ends = at.withColumn("lo", F.min("node").over(tree)).withColumn("hi", F.max("node").over(tree)).where("lo <> hi")
    within = F.when((F.col("node") != F.col("lo")) & (F.col("node") != F.col("hi")), F.col("node"))
    between = ends.withColumn("first", F.min(within).over(tree)).withColumn("last", F.max(within).over(tree))
    shared = checkpointed(between.select("node", "lo", "hi", F.coalesce(within.isNotNull() & (F.col("first") < F.col("last")), F.lit(False)).alias("inner")))
    swept(documents.sparkSession)  # the shuffle of all prefixes
    sizes = leaves.select("node", "n_shingles").distinct()
    own = shared.groupBy("node").agg(F.count("*").alias("trees"), F.count_if(F.expr("node = lo")).alias("lo"), F.count_if(F.expr("node = hi")).alias("hi"), F.count_if("inner").alias("inner"))
    own = checkpointed(own.join(sizes, "node"))
    low = shared.where("node <> lo").groupBy(F.col("lo").alias("p"), F.col("node").alias("d")).agg(F.count("*").alias("c"))
    sigs = checkpointed(leaves.select("node", "sig"))
    links = _met(rows, nodes, sigs, checkpointed(_possible(low, own, "lo", percent)), k, percent)
    comps = checkpointed(connected_components(links))
    high = shared.where("node <> hi").groupBy(F.col("hi").alias("p"), F.col("node").alias("d")).agg(F.count("*").alias("c"), F.bool_or(F.expr("node <> lo")).alias("new")).where("new")
    of = lambda end: comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    high = high.join(near(of("p")), "p", "left").join(near(of("d")), "d", "left").where("coalesce(cp, p) <> coalesce(cd, d)").select("p", "d", "c")
    high = _possible(high, own, "hi", percent)
    more = _met(rows, nodes, sigs, checkpointed(high), k, percent)
    inner = checkpointed(shared.where("inner").select(F.col("lo").alias("bucket"), "node").distinct())
    shared = low = high = None  # spent
    swept(documents.sparkSession)
    if not more.isEmpty():
        comps = checkpointed(connected_components(links.unionByName(more)))
    placed = inner.join(near(comps), "node", "left")
    groups = open_groups(checkpointed(placed.select("bucket", "node", F.coalesce("component", "node").alias("c"))))
    groups = checkpointed(_of_near_sizes(checkpointed(groups.join(near(own.select("node", "n_shingles", "inner")), "node")), percent))
    inner = placed = None  # spent
    swept(documents.sparkSession)
    left = checkpointed(by_blocks(groups.select("key", "main", "node", "c"), _sigs_of(sigs, groups.select("node")).withColumnRenamed("sig", "data"), hopeful(percent)).toDF("key", "node"))
    if not left.isEmpty():
        groups = checkpointed(groups.join(left, ["key", "node"]))
        data = sets_of(rows, nodes, groups.select("node").distinct(), k)
        more = checkpointed(by_blocks(groups, data, spanning_links(percent), F.col("n_shingles")))
        comps = checkpointed(joined_components(comps, more))
    return documents_of(f, nodes, comps)


def op13_sigtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
