"""Importance resampling against a plain version, and in odd cases."""

import hashlib
import math
import re
import zlib

import numpy as np

from basewright.llm import resample

SCHEMA = "doc_id long, text string, score string, rank int, bucket long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)


def runs(text, longest=3):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5, least=20, k=10_000):
    """(doc_id, n_features, weight, score, rank), sorted."""
    bucket = lambda f: zlib.crc32(f.encode()) % k
    s, t = np.zeros(k, int), np.zeros(k, int)
    for seen, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in runs(x)[1]:
                seen[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + k) / ((int(a) + 1) * (int(t.sum()) + k)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, x in rows:
        n, feats = runs(x)
        weight = sum(gain[bucket(f)] for f in feats)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(spark, rows, target, **more):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(table(spark, rows), table(spark, enumerate(target)), **more).collect()), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocab = ["Word", "été", "中文", "x1", "a-b", "THE", "of", "don't", "\x7f", "café!", *(f"v{i}" for i in range(60))]
    return [(i, " ".join(vocab[int(x)] for x in rng.integers(0, len(vocab), int(rng.integers(0, 90))))) for i in range(n)]


def test_equals_a_plain_version(spark):
    rows = corpus(300, 1)
    target = [t for _, t in corpus(20, 2)]
    want = plain(rows, target)
    assert got(spark, rows, target) == want and sum(r[4] is not None for r in want) > 8
    assert got(spark, rows, target, percent=50) == plain(rows, target, 50)


def test_odd_rows(spark):
    text = corpus(1, 5)[0][1] + " more words so that there are twenty of them at least in this text of a row " * 2
    rows = [(1, None), (2, ""), (3, " -- \n"), (None, text), (None, text), (4, text), (4, text), (4, text + " end"), (5, "one"), (6, "One, two"), (7, "x " * 50_000)]
    for target in (["one two three", None, ""], []):
        assert got(spark, rows, target, percent=60) == plain(rows, target, 60)
    assert got(spark, [], ["one"]) == []


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    """Ids of equal noise and weight: with the draw by two values only, ties are many."""
    rows = [(i, "the same text " * 8) for i in range(40, 0, -1)]
    want = plain(rows, ["text"], 30)
    assert got(spark, rows, ["text"], percent=30) == want
    noise = {resample.draw_of(i) for i in range(1, 41)}
    assert len(noise) > 30 and resample.draw_of(None) == resample.draw_of(None) != resample.draw_of(0)


def test_ring_equals_joined_runs(monkeypatch):
    """States over pieces of a text, and rings of other lengths."""
    text = corpus(40, 9)
    for longest in (1, 2, 3, 5):
        for piece in (1, 7, 1 << 20):
            monkeypatch.setattr(resample, "PIECE", piece)
            for _, t in text:
                found = [int(b) for _, part in resample.scanned(t.encode(), longest, 997) for b in part]
                n, want = runs(t, longest)
                assert sorted(found) == sorted(zlib.crc32(f.encode()) % 997 for f in want) and sum(k for k, _ in resample.scanned(t.encode(), longest, 997)) == n
    assert list(resample.scanned(None, 3, 10)) == []


def test_ranks_run_over_partitions(spark):
    """More partitions than rows in some, equal scores across them: numbers run on without gaps."""
    from pyspark.sql import functions as F

    from basewright.llm.common import numbered
    rows = [(int(x),) for x in np.random.default_rng(4).integers(0, 7, 500)]
    out, total = numbered(spark.createDataFrame(rows, "v long"), [F.col("v").desc()], 40)
    got = sorted((r.ordinal, r.v) for r in out.collect())
    assert total == 500 and [o for o, _ in got] == list(range(1, 501)) and [v for _, v in got] == sorted((v for (v,) in rows), reverse=True)
