"""The conversation trie against a plain one, and in odd cases."""

import hashlib
import zlib

import numpy as np
import pytest

from basewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, pos long, depth int"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], SCHEMA)


def plain(rows, group=20, shared=4):
    """The same by a dictionary of prefixes."""
    turns: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members: dict = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - int(np.fmod(c, group))
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole) == d))
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = {q[:-1] for q in members if q}
        words = lambda q: len(q[-1][1].encode().split()) if q else 0
        ends = ",".join(str(c) for c, end in sorted(m) if end)
        out.append((
            min(c for c, _ in m), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
            sum(q not in kids for q in below), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows, **more):
    return sorted((tuple(r[f] for f in FIELDS) for r in trie.conversation_trie(table(spark, rows), **more).collect()), key=str)


def conversations(n, seed, choices=3, most=9):
    rng = np.random.default_rng(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.integers(choices)} of turn") for c in range(n) for t in range(int(rng.integers(1, most)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_trie(spark, monkeypatch, seed):
    """Small chunks and pieces, so that keys and digests cross them."""
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = conversations(90, seed, choices=1 + seed)
    want = plain(rows)
    assert got(spark, rows) == want and len(want) > 40


def test_odd_rows(spark):
    rows = [
        (40, 1, "u", "b"), (40, None, "u", "a"), (40, None, None, None), (41, 3, "u", " two\twords\n"), (41, 3, "u", " two\twords\n"), (43, 0, "a", "x" * 70), (43, 0, "a", "x" * 70),
        (None, 1, "u", "lost"), (None, None, None, None), (65, 2, "u", "c"), (66, 0, None, "a"), (66, 1, "u", ""), (67, 5, "é", "ß x"), (-3, 0, "u", "neg"), (-20, 0, "u", "neg"), (0, 0, "u", "neg"),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "u", "x")]) == []


def test_turnless_conversations_belong_to_the_root(spark):
    """Conversations that lose all turns: no first of the group to take from, and h of their own or fewer."""
    rows = [(c, 0, "u", f"only {c}") for c in range(21, 40)]
    want = plain(rows)
    lost = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    root = next(x for x in want if x[1] == 0)
    assert got(spark, rows) == want and root[3] == 19 and root[7] == hashlib.sha256(",".join(map(str, lost)).encode()).hexdigest()


def test_a_long_and_a_frequent_conversation(spark):
    """One conversation of 700 turns, whose doubling rounds and chunks are many, and 300 copies of a short one."""
    rows = [(100, t, "u", f"turn {t % 5}") for t in range(700)] + [(c, t, "u", f"same {t}") for c in range(200, 500) for t in range(4)]
    rows += [(c, t, "u", f"turn {t % 5}") for c in (120, 121) for t in range(350)]
    out = {(r[1], r[0]): r for r in got(spark, rows)}
    assert max(d for d, _ in out) == 700
    root = out[(0, 100)]
    assert root[3] == 303 and root == next(x for x in plain([r for r in rows if r[0] >= 200] + [r for r in rows if r[0] < 200 and r[1] < 8]) if x[1] == 0)[:5] + root[5:]
    deep = out[(700, 100)]
    assert deep[3:7] == (1, 0, 1, 0)
    whole = {c: tuple(f"turn {t % 5}" for t in range(n)) for c, n in ((100, 700), (120, 350), (121, 350))}
    assert out[(350, 100)][3] == sum(w[:350] == whole[100][:350] for w in whole.values())


def test_pieces_of_a_digest():
    """Ids in pieces over batches and partitions hash as one text."""
    import pyarrow as pa
    ids = {"a": list(range(7, 400, 3)), "b": [5], "c": [-4, 12]}
    rows = [(n, i) for n, x in ids.items() for i in x]
    batches = lambda part: (pa.RecordBatch.from_arrays([pa.array([r[0] for r in part[k : k + 11]]), pa.array([r[1] for r in part[k : k + 11]], pa.int64())], names=["node", "conv_id"]) for k in range(0, len(part), 11))
    before, trie.PIECE = trie.PIECE, 9
    try:
        pieces = [r for part in (rows[:50], rows[50:]) for b in trie._pieces(batches(part)) for r in b.to_pylist()]
    finally:
        trie.PIECE = before
    assert max(p["ids"].count(",") for p in pieces) == 8
    pieces.sort(key=lambda p: (p["node"], p["first"]))
    whole = [pa.RecordBatch.from_pylist(pieces[k : k + 4], schema=trie._PIECES) for k in range(0, len(pieces), 4)]
    out = {r["node"]: r["sha"] for b in trie._hashed(iter(whole)) for r in b.to_pylist()}
    assert out == {n: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for n, x in ids.items()}


def test_sums_over_any_forest(spark):
    """Doubling over random parents equals adding up along every path."""
    rng = np.random.default_rng(3)
    up = {0: None} | {i: int(rng.integers(max(0, i - 4), i)) if i % 17 else None for i in range(1, 150)}
    value = {i: int(rng.integers(0, 9)) for i in up}
    want = dict.fromkeys(up, 0)
    for i in up:
        at = i
        while at is not None:
            want[at] += value[i]
            at = up[at]
    rows = spark.createDataFrame([(str(i), None if p is None else str(p), value[i]) for i, p in up.items()], "node string, parent string, v long")
    assert {int(r.node): r.v for r in trie.rolled_up(rows, ["v"]).collect()} == want
