"""Near duplicates by minima and by signature trees against brute force, and rows that share a doc_id."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.llm import blocks, classes, minhash, sigtree
from basewright.llm.shingles import shingle_set

ROW = "doc_id long, text string, node long, k1 string, version int"
JOINS = {"minhash": minhash.near_components, "sigtree": sigtree.jaccard_components}


def table(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x", 3) for d, t in rows], ROW)


def shingles(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def links(a, b, percent=80):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def united(nodes, pairs):
    """node -> least node reachable."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, k):
    """(doc_id -> component_id, texts' components: (doc_id, text) -> least row)."""
    rows = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    sets = {r: shingles(r[1], k) for r in rows}
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if links(sets[a], sets[b])]
    return united({d for d, _ in rows}, [(a[0], b[0]) for a, b in pairs]), united(rows, pairs)


def random_corpus(n, seed, base_share=0.4):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for i in range(n):
        if out and rng.random() < base_share:
            words = out[int(rng.integers(len(out)))][1].split()
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = vocab[int(rng.integers(500))]
        else:
            words = [vocab[int(x)] for x in rng.integers(0, 500, int(rng.integers(1, 150)))]
        out.append((i, " ".join(words)))
    return out


def around_a_base(n=120, seed=1):
    """Copies at many distances from a base: least and greatest members alone don't find all links."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(1, n):
        words = list(base)
        for at in rng.choice(100, int(rng.integers(0, 12)), replace=False):
            words[at] = f"x{rng.integers(4)}"
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("name", JOINS)
@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, name, k):
    rows = random_corpus(200, k)
    want, _ = brute(rows, k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JOINS[name](table(spark, rows), k).collect()}
    assert got == {d: (len(shingles(t, k)), want[d]) for d, t in rows} and len(set(want.values())) < 180


@pytest.mark.parametrize("name", JOINS)
def test_group_around_a_base(spark, monkeypatch, name):
    """Small blocks, so that pairs cross them."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "LARGE", 16)
    rows = around_a_base()
    want, _ = brute(rows, 4)
    got = {r.doc_id: r.component_id for r in JOINS[name](table(spark, rows), 4).collect()}
    assert got == want and 1 < len(set(want.values())) < len(want)


A = " ".join(f"a{i}" for i in range(60))
NEAR_A = A.replace("a30", "other")
B = " ".join(f"b{i}" for i in range(50))


@pytest.mark.parametrize("name", JOINS)
def test_ids_on_several_texts(spark, name):
    """A doc_id has the links of all its texts; only linked texts count as copies; whatever the rows' order."""
    cases = [
        ([(1, A), (2, B), (2, NEAR_A)], {1: 1, 2: 1}, {(1, A), (2, B)}),
        ([(1, B), (2, B), (2, NEAR_A), (3, A)], {1: 1, 2: 1, 3: 1}, None),
        ([(5, A), (5, B), (5, A), (6, "c d e f g h"), (None, A), (7, None), (8, "")], {5: 5, 6: 6, None: None, 7: 7, 8: 8}, {(5, A), (5, B), (6, "c d e f g h"), (None, A), (7, None), (8, "")}),
    ]
    for rows, want, kept in cases:
        orders = list(itertools.permutations(rows)) if len(rows) < 4 else [rows, rows[::-1], rows[1:] + rows[:1]]
        for order in orders[:: 2 if len(orders) > 3 else 1]:
            out = JOINS[name](table(spark, order)).collect()
            assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == want
            if name == "minhash" and kept:
                left = minhash.without_near_duplicates(table(spark, order))
                assert left.columns == table(spark, order).columns and {(r.doc_id, r.text) for r in left.collect()} == kept


def test_repeated_ids_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 60)), t) for _, t in random_corpus(100, 9, 0.5)]
    want, texts = brute(rows, 5)
    for name, join in JOINS.items():
        out = join(table(spark, rows)).collect()
        assert {r.doc_id: r.component_id for r in out} == want, name
        first = {(r.doc_id, r.version) for r in out if r.first}
        assert len(first) == len(set(texts.values()))
    left = {(r.doc_id, r.text) for r in minhash.without_near_duplicates(table(spark, rows)).collect()}
    version = {(r.doc_id, r.text): r.v for r in table(spark, rows).withColumn("v", classes.version_of(F.col("text"))).collect()}
    groups: dict = {}
    for r, c in texts.items():
        groups.setdefault(c, []).append(r)
    assert left == {min(g, key=lambda r: (r[0], version[r])) for g in groups.values()}


@pytest.mark.parametrize("name", JOINS)
def test_odd_texts(spark, name):
    long = "word " * 30_000 + " ".join(f"v{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (None, long), (8, long), (9, long + " end"), (10, "É x"), (11, "é x"), (8, long)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JOINS[name](table(spark, rows)).collect()}
    n = len(shingles(long, 5))
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), None: (n, None), 8: (n, 8), 9: (n + 1, 8), 10: (1, 10), 11: (1, 11)}
    assert JOINS[name](table(spark, rows[:0])).count() == 0


def test_passage_in_many_documents(spark):
    """Documents that share a long common passage: those that are little else are linked, the others aren't."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(int(rng.choice([3, 6, 9, 40, 80]))))) for i in range(150)]
    want, _ = brute(rows, 5)
    got = {r.doc_id: r.component_id for r in sigtree.jaccard_components(table(spark, rows)).collect()}
    assert got == want and 40 < len(set(want.values())) < 140


def test_bounds_hold():
    """No bound of signatures, leaves or nodes is below what their sets share; folding keeps it."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, m, both = (int(x) for x in rng.integers(1, 300, 3))
        base = rng.integers(0, 2**63, both, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base, rng.integers(0, 2**63, x, dtype=np.uint64)])) for x in (n, m))
        linked = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert not linked or sigtree.signatures_allow(sigtree.signature(a), sigtree.signature(b), 80)
    x = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    assert (sigtree.folded(sigtree.bitmap(x, 1 << 14), 1 << 10) == sigtree.bitmap(x, 1 << 10)).all()


def test_traversal_equals_all_pairs_and_prunes():
    rows = random_corpus(160, 8, 0.6)
    sets = [shingle_set(t.encode(), 5) for _, t in rows]
    ids = np.arange(len(sets))
    left, right = sigtree.set_tree(sets[:90], ids[:90], 4096), sigtree.set_tree(sets[90:], ids[90:], 4096)
    i, j = sigtree.leaf_pairs(left, right, 80)
    found = {(int(left.order[a]), 90 + int(right.order[b])) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(90) for b in range(90, 160) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert want <= found and want and len(found) < 90 * 70 / 10
    same = sigtree.set_tree(sets, np.zeros(len(sets), int), 4096)
    assert not len(sigtree.leaf_pairs(same, same, 80)[0])


def test_leaves_left_open_hold_all_links():
    """Signatures of several lengths: every leaf with a link to another component is left open, most others aren't."""
    rng = np.random.default_rng(12)
    sets = [shingle_set(t.encode(), 5) for _, t in random_corpus(120, 8, 0.6)]
    for n in (60, 64, 70, 127, 129, 140, 1000, 1100):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base, rng.integers(0, 2**63, int(m), dtype=np.uint64)])) for m in (0, n // 10, n // 5, n // 4)]
    rows = [(7, 0, 1, int(i % 2), i, i, sigtree.signature(s)) for i, s in enumerate(sets)]
    key, nodes = sigtree.hopeful(80)([r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1])
    linked = {x for a in range(0, len(sets), 2) for b in range(1, len(sets), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for x in (a, b)}
    assert linked <= set(nodes.tolist()) and (key == 7).all() and len(linked) > 20 and len(nodes) < len(sets) * 0.8


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(7)
    levels = rng.integers(0, 5, sigtree.COUNTERS).astype(np.uint8)
    for _ in range(500):
        base = rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base[int(rng.integers(0, 4)) :], rng.integers(0, 2**63, int(rng.integers(0, 5)), dtype=np.uint64)])) for _ in range(2))
        if len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert len(np.intersect1d(sigtree.prefix(a, levels, 80), sigtree.prefix(b, levels, 80)))


def test_counters_count_all(spark):
    rows = random_corpus(50, 2)
    seen = np.zeros(sigtree.COUNTERS, np.int64)
    for _, t in rows:
        np.add.at(seen, shingle_set(t.encode(), 5).astype(np.int64) & (sigtree.COUNTERS - 1), 1)
    share = np.maximum(seen, 1) / max(seen.mean(), 1)
    want = np.clip(np.round(16 * np.log2(share)), 0, 255).astype(np.uint8)
    assert (sigtree.levels_of(classes.rows_of(table(spark, rows)).repartition(5), 5) == want).all()


def test_a_shared_phrase_is_no_pair(spark, monkeypatch):
    """Documents of one size with a phrase in common share too little of their prefixes: no signature is fetched for them.
    Shingles are ordered by hash alone, so that some of the phrases are in prefixes."""
    monkeypatch.setattr(sigtree, "levels_of", lambda texts, k: np.zeros(sigtree.COUNTERS, np.uint8))
    met, groups, real_met, real_blocks = [], [], sigtree._met, sigtree.by_blocks
    monkeypatch.setattr(sigtree, "_met", lambda r, n, s, pairs, *a: met.append(pairs.count()) or real_met(r, n, s, pairs, *a))
    monkeypatch.setattr(sigtree, "by_blocks", lambda rows, *a: groups.append(rows.count()) or real_blocks(rows, *a))
    rows = [(i, f"a phrase of five words{i // 5} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(150)]
    assert {(r.doc_id, r.component_id) for r in sigtree.jaccard_components(table(spark, rows)).collect()} == {(i, i) for i in range(150)}
    assert met == [0, 0] and groups == [0]


def test_supersets_at_the_bound(spark):
    """Links of exactly 80 % between texts of unlike sizes, which may share a single prefix shingle, among others with common phrases."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(40):
        n = int(rng.integers(4, 17)) * 4
        base = [f"b{i}w{j}" for j in range(n + 4)]  # n shingles
        for more in (0, n // 4, n // 4 + 1):  # exactly 80 %, then just below
            at = int(rng.integers(2))
            extra = [f"e{i}x{more}y{j}" for j in range(more)]
            rows.append((int(rng.integers(10**6)), " ".join(extra * at + base + extra * (1 - at))))
    rows += [(10**6 + i, " ".join(f"b{i % 40}w{j}" for j in range(5 + i % 3)) + " " + " ".join(f"o{i}p{j}" for j in range(int(rng.integers(5, 60))))) for i in range(160)]
    want, _ = brute(rows, 5)
    assert {r.doc_id: r.component_id for r in sigtree.jaccard_components(table(spark, rows)).collect()} == want
    assert 30 < len(rows) - len(set(want.values())) < 100


def test_sizes_keep_all_that_may_link(spark):
    rng = np.random.default_rng(22)
    rows = [(k, side, 2 * k + side, int(n), int(t)) for k in range(2000) for m in [int(rng.integers(1, 900))] for side, n, t in ((0, m, rng.integers(1, 30)), (1, max(1, m * rng.uniform(0.75, 1.3)), rng.integers(1, 30)))]
    got = {r.node for r in sigtree._of_near_sizes(spark.createDataFrame(rows, "key long, c long, node long, n_shingles long, inner long"), 80).collect()}
    want = set()
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        lo, hi = sorted((a[3], b[3]))
        if 180 * min(min(a[4], b[4]) - (-80 * hi // 100) - 1, lo) >= 80 * (lo + hi):
            want |= {a[2], b[2]}
    assert want <= got and len(want) > 400 and len(got) < 1.3 * len(want)
