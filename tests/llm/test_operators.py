"""The operators against brute force, and in odd cases."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.llm import blocks, decontaminate, linededup, lmscore, media, minhash, packing, pii, preference, quality, toxicity
from basewright.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, p long, words string, sig string, _doc long, size long, removed string"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, "y", "z", 3, 4, "w") for i, t in rows], schema)


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["w" + str(i) for i in range(400)]
    out = []
    for i in range(n):
        if i % 4 == 3:
            words = list(out[int(rng.integers(len(out)))][1].split())
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = vocab[int(rng.integers(400))]
        else:
            words = [vocab[int(k)] for k in rng.integers(0, 400, int(rng.integers(5, 120)))]
        out.append((i, " ".join(words)))
    return out


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (4, "one"), (None, "one two three four five six seven eight nine ten eleven"), (5, "ÄÖ é 中文 x" * 3), (6, "long " * 60_000), (7, "\x00\x01 a")]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, None)], LABELS)


def calls(spark, labels):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "?!"), (4, "one")], "item_id long, text string")
    return {
        "quality": lambda d: quality.quality(d, labels, d.source, d.lang),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "media": media.audio_digests,
        "tensors": media.audio_tensors,
        "lmscore": lambda d: lmscore.score_documents(d, lmscore.vocabulary_path()),
        "pii": pii.with_surrogates,
        "minhash": minhash.near_duplicates,
        "linededup": linededup.line_dedup,
        "packing": lambda d: packing.pack_documents(d, packing.tokenizer_path()),
    }


@pytest.mark.parametrize("name", ["quality", "decontaminate", "toxicity", "media", "tensors", "lmscore", "pii", "minhash", "linededup", "packing"])
def test_odd_and_empty(spark, labels, name):
    f = calls(spark, labels)[name]
    n = f(docs(spark, ODD)).count()
    assert n == {"tensors": n, "packing": n}.get(name, len(ODD)) and n
    assert f(docs(spark, ODD[:0])).count() == 0


def test_decontaminate_equals_brute_force(spark):
    rows = corpus()
    items = [(i, " ".join(rows[i][1].split()[3 : 3 + n])) for i, n in ((0, 10), (1, 14), (2, 4), (4, 1), (5, 2))]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    wins = {(tuple(t.split()[i : i + 10]), k) for k, t in items if t for i in range(max(1, len(t.split()) - 9))}
    for d, t in rows:
        w, hit, who = t.split(), set(), set()
        for g, k in wins:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    who.add(k)
        assert got[d] == (len(w), len(hit), len(who))


def test_decontaminate_tells_rows_apart(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, f"so {text}"), (None, "clean"), (1, text), (1, "also clean"), (2, text), (2, text), (3, None)]
    bench = spark.createDataFrame([(1, text, 5)], "item_id long, text string, version int")
    d = docs(spark, rows)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.decontaminate(d, bench).collect())
    assert got == [(0, 1, 0), (0, 11, 10), (1, 2, 0), (1, 10, 10), (2, 10, 10), (2, 10, 10), (3, 0, 0)]
    left = decontaminate.without_contaminated(d, bench)
    assert left.columns == d.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "clean"), (1, "also clean"), (3, "")]


def test_decontaminate_by_shuffle_and_repetitions(spark, monkeypatch):
    """No broadcast; a text in which the prefix occurs many times, and at its ends."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    rows = [(0, "a b c a b c a b c a b c a b"), (1, "b c a b c a b c a b"), (2, "c a b c a b c a b"), (3, "a b c a b c a b c")]
    items = [(1, "a b c a b c a b c a"), (2, "b c a b c a b c a b"), (3, "c a")]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {0: (14, 3), 1: (10, 2), 2: (6, 1), 3: (4, 1)}


def test_shingles_split_a_text_once(spark):
    rows = docs(spark, [(0, "a b c d"), (1, "a b"), (2, ""), (3, None)])
    out = decontaminate._shingled(rows.select("doc_id", decontaminate.words(F.col("text")).alias("words")), ["doc_id"], 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    whole = out.dropna(subset=["w0", "w1", "w2"])
    assert sorted((r.doc_id, r.n, r.pos, r.w0 + r.w1 + r.w2) for r in whole.collect()) == [(0, 4, 0, "abc"), (0, 4, 1, "bcd")]


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_minhash_equals_brute_force(spark):
    rows = corpus(160)
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))} for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()} and links


def test_minhash_group_around_a_base(spark, monkeypatch):
    """Copies at many distances from a base: the pivots alone don't find all links. Small blocks, so that pairs cross them."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "LARGE", 16)
    rng = np.random.default_rng(1)
    base = ["b" + str(i) for i in range(100)]
    rows = []
    for d in range(1, 120):
        words = list(base)
        for at in rng.choice(100, int(rng.integers(0, 12)), replace=False):
            words[at] = f"x{rng.integers(4)}"
        rows.append((d, " ".join(words)))
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(97)} for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == want and 1 < len(set(want.values())) < len(want)


def test_blocks_decide_over_all_pairs_of_two_components():
    import pyarrow as pa
    sig = np.zeros(minhash.MINIMA, "<u2").tobytes()
    other = np.arange(1, minhash.MINIMA + 1, dtype="<u2").tobytes()
    rows = [(7, 0, 0, 0, d, c, s) for d, c, s in ((1, 1, sig), (2, 2, other), (3, 3, other), (4, 4, sig), (5, 5, other[2:] + other[:2]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcdefg"))
    out = [tuple(r.values()) for b in blocks.pairs_of_blocks(minhash._with_partner)(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert sorted(out) == [(7, 1), (7, 2), (7, 3), (7, 4)]


def test_spanning_links_equal_brute_force(monkeypatch):
    monkeypatch.setattr(minhash, "WIDTH", 16)
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[: int(n)], rng.integers(0, 2**63, int(m), dtype=np.uint64)])) for n, m in zip(rng.integers(0, 100, 60), rng.integers(0, 20, 60), strict=True)]
    assert (minhash._common(sets[:25], sets[25:]) == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()
    rows = [(0, 0, 0, 0, i, i // 2, s.tobytes()) for i, s in enumerate(sets)]
    u, v = minhash._spanning(80)(rows, rows)
    linked = [(a // 2, b // 2) for a in range(60) for b in range(a) if a // 2 != b // 2 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert components_of(range(30), list(zip(u, v, strict=True))) == components_of(range(30), linked) and linked and len(u) <= 120


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 230)] + [(None, 3)]
    want = components_of({n for e in edges[:-1] for n in e}, edges[:-1])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))


def test_packing(spark):
    rng = np.random.default_rng(6)
    for lengths in (rng.integers(1, 4097, 500), rng.integers(1000, 2100, 300), np.full(30, 2049)):
        lengths = sorted(map(int, lengths), reverse=True)
        bins = packing.best_fit_decreasing(lengths, 4096)
        fill = Counter()
        for b, n in zip(bins, lengths, strict=True):
            fill[b] += n
        assert max(fill.values()) <= 4096 and packing.lower_bound(Counter(lengths), 4096) <= len(fill)
    assert packing.lower_bound({2049: 30}, 4096) == 30
    rows = [(i, "lorem ipsum " * int(k)) for i, k in enumerate(rng.integers(0, 3000, 40))]
    out = packing.pack_documents(docs(spark, rows), packing.tokenizer_path()).toPandas().sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= 4096
    import tokenizers
    tok = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    for d, t in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(zip(out[out.doc_id == d].start, out[out.doc_id == d].ids_crc32)) == [(s, zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]


def test_packing_in_many_partitions(spark, monkeypatch):
    """Small partitions, so that rounds exchange pieces: every piece once, no overfull bin, near the bound, no task over its share."""
    monkeypatch.setattr(packing, "PER_PARTITION", 40)
    monkeypatch.setattr(packing, "LAST", 20)
    rng = np.random.default_rng(16)
    rows = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(300, 1400, 400))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(rows).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(out.doc_id) == list(range(400)) and (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 4096 and out.sequence_id.nunique() <= 1.1 * packing.lower_bound(Counter(out.length), 4096)


def test_packing_odd_rows(spark):
    out = packing.pack_documents(docs(spark, [(1, None), (2, ""), (None, "a b"), (4, "x"), (4, "x")]), packing.tokenizer_path()).collect()
    ends = zlib.crc32(np.array([1], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in out) == [(0, 0, 0, 3), (1, 0, 0, 1), (2, 0, 0, 1), (4, 0, 0, 2), (4, 0, 0, 2)] and sum(r.ids_crc32 == ends for r in out) == 2


def test_encoder_equals_tokenizer():
    import tokenizers
    tok, e = tokenizers.Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    for s in ["ΑΣ ΣΑΣ. x", "İstanbul Éa é", "it's can't.. don't,", "a\x0bb\x0cc\x1cd", "<|endoftext|> hi", "A1b22 3.4!", "e ́x", "中文 字。", "ß ẞ", " ", "a\xa0b x\x85y \xadz ª ¼ ²3", "éà’s ÿŸ"]:
        assert e.encode(s) == np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_works_on_distinct_parts(monkeypatch):
    """Words beside changing signs are looked up and merged once each, not once for each chunk that they stand in."""
    import itertools

    import pyarrow as pa
    sought, miss = [], packing._Recent.miss
    monkeypatch.setattr(packing._Recent, "miss", lambda self, key: sought.append(key) or miss(self, key))
    monkeypatch.setattr(packing, "_encoders", {})
    words, signs = [f"word{'x' * i}" for i in range(1, 21)], ["", ".", ",", "'s", "(", "9", "|"]
    texts = [" ".join(a + w + b for w in words) for a, b in itertools.product(signs, signs)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces(packing.tokenizer_path(), 4096, 1)(iter([batch]))) == len(texts)
    assert len(sought) == len(set(sought)) <= len(words) + len(signs)


def test_encoder_equals_tokenizer_on_many_texts_at_once(monkeypatch):
    """Texts of many kinds, in slices of any size."""
    import random

    import tokenizers
    tok, e = tokenizers.Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    rng, signs = random.Random(4), [*"abstmdrevlSTRE''' \n\t\r01.,-\x00\x0b\x1c\x7f\xa0\xad́", *"é É İ ß ǅ ² ª ¼ 中 Σ σ € ’ 😀 ɏ ɐ Ⱥ".split(), "<|endoftext|>"]
    texts = ["", " ", *("".join(rng.choices(signs[: rng.choice((24, len(signs)))], k=rng.randrange(50))) for _ in range(2000))]
    want = [np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in texts]
    for size in (1 << 20, 40, 5):
        monkeypatch.setattr(packing, "SLICE", size)
        assert list(e.encode_all(texts)) == want


def test_lattice_equals_sum_over_segmentations():
    lat = lmscore.vocabulary(lmscore.vocabulary_path())
    at = {p: i for i, p in enumerate(lat.pieces[:-1])}

    def total(s, i=0):
        out = []
        for j in range(i + 1, len(s) + 1):
            k = at.get(s[i:j])
            if k is not None:
                out.append(lat.logend[k] if j == len(s) else lat.loggo[k] + total(s, j))
        return np.logaddexp.reduce(out) if out else -math.inf
    for w in (b"the", b"therou,", "éà".encode(), b"x", b"\xff"):
        assert abs(lat.scores([w])[0] - total(b" " + w)) < 1e-9


def test_long_words_in_blocks(monkeypatch):
    """The block recursion equals the lattice by rows, and the expected uses too; a word of a megabyte is no trouble."""
    import time
    lat, rng = lmscore.vocabulary(lmscore.vocabulary_path()), np.random.default_rng(3)
    words = [b"the" * 40, bytes(rng.integers(33, 127, 300).tolist()), "éà中".encode() * 30]
    short, uses = lat.scores(words), lat.expected(words)
    monkeypatch.setattr(lmscore, "STEP", 64)
    monkeypatch.setattr(lmscore, "LONG", 8)
    assert np.abs(lat.scores(words) - short).max() < 1e-6 and np.abs(lat.expected(words) - uses).max() < 1e-6
    monkeypatch.undo()
    start = time.time()
    assert lat.scores([bytes(rng.integers(97, 123, 1_000_000).tolist())])[0] < -1e6 and time.time() - start < 120


def test_frequent_words_are_bounded(spark):
    rows = spark.createDataFrame([(str(i).encode(), 1 + i % 50, 0.0, 0.0) for i in range(1000)], "word binary, n long, lp double, fit double")
    got = lmscore._frequent(rows, 300)
    least = min(r.n for r in got)
    assert 0 < len(got) <= 300 and len(got) == sum(1 + i % 50 >= least for i in range(1000))


def test_lm_rows_are_all_scored(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "other text"), (None, "one two"), (2, None), (None, None)]
    got = Counter((r.doc_id, r.held_out, r.n_tokens, round(r.score, 6)) for r in lmscore.score_documents(docs(spark, rows), lmscore.vocabulary_path()).collect())
    assert sum(got.values()) == 6 and sorted(got.values()) == [1, 1, 1, 1, 2]
    by = {(d, n): s for d, _, n, s in got}
    assert by[(None, 3)] in {s for d, _, n, s in got if d == 1 and n == 3} and by[(2, 1)] == by[(None, 1)]


def test_lm_base_score(spark):
    rows = corpus(50)
    c = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update([*t.split(), None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lmscore.score_documents(docs(spark, rows), lmscore.vocabulary_path()).collect()}
    for d, t in rows:
        w = [*t.split(), None]
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(got[d].base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 and got[d].score < 0


def test_lm_scores_held_out_texts_near_the_base(spark):
    """Words of syllables, most of them in no training text: the base gives each of them the same share, the model has to spell them."""
    rng = np.random.default_rng(5)
    parts = ["the", "er", "an", "tion", "ing", "re", "ou", "sh", "be", "en", "ly", "st"]
    rows = [(i, " ".join("".join(parts[int(k)] for k in rng.integers(0, 12, int(rng.integers(1, 5)))) for _ in range(40))) for i in range(300)]
    got = [r for r in lmscore.score_documents(docs(spark, rows), lmscore.vocabulary_path()).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert len(got) > 20 and all(math.isfinite(r.score) for r in got)
    assert sum(r.score - r.base_score for r in got) / tokens > -0.75


def test_urn_equals_its_draws(spark, monkeypatch):
    """score by closed forms, of frequent words and of the others, equals the draws word by word; held-out texts of one word give each word's share."""
    held = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 7 == 2]
    alone = dict(zip(("", "one", "two", "three", "four", "rareword"), held, strict=False))
    seen = {i: ["one", "two", "three", "two", *["rareword"] * (i % 40), "four"] for i in range(40)}
    rows = [(i, " ".join(w)) for i, w in seen.items()] + [(i, w) for w, i in alone.items()]
    train = [w for i, w in seen.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    end = len(train) / (len(train) + sum(map(len, train)))
    for hot in (lmscore.HOT, 0):
        monkeypatch.setattr(lmscore, "HOT", hot)
        got = {r.doc_id: r for r in lmscore.score_documents(docs(spark, rows), lmscore.vocabulary_path()).collect()}
        p = {w: 10 ** (got[i].fitted_score - math.log10(end)) for w, i in alone.items()}
        assert abs(p[""] - 1) < 1e-9
        for i, words in seen.items():
            before, total = Counter(), math.log10(end)
            for n, w in enumerate(words):
                total += math.log10((lmscore.URN * p[w] + before[w] * (1 - end)) / (lmscore.URN + n))
                before[w] += 1
            assert abs(total - got[i].score) < 1e-6


def test_toxicity_learns_terms_and_exceptions(spark):
    rng = np.random.default_rng(7)
    vocab = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows, lab = [], []
    for i in range(400):
        words, bad, safe = [vocab[int(k)] for k in rng.integers(0, 200, 30)], i % 8 == 0, i % 24 == 1
        if bad:
            words[5] = "vil3nasty"
        if safe:
            words[5:7] = ["vilenasty", "flower"]
        rows.append((i, " ".join(words)))
        lab.append((i, 1, int(bad)))
    d, lex = docs(spark, rows), None
    lex = toxicity.fit(d, spark.createDataFrame(lab, LABELS))
    assert lex.score("some VІLЕNASTY text") >= 0.5 > lex.score("a vilenasty flower here") and lex.score("") < 0.5
    got = {r.doc_id: r.score for r in toxicity.score(d, lex).collect()}
    assert all((got[i] >= 0.5) == (t == 1) for i, _, t in lab)
    assert toxicity.keep_clean(d, lex).count() == 350


def test_folding():
    for text, want in (("a$$hole", "asshole"), ("@ss", "ass"), ("cra$", "cras"), ("2024 1000 $5 @", ""), ("a\u2014b", "a b"), ("ba\u200bd", "bad"), ("ba\u0301d, bád", "bad bad"), ("VІLЕ", "vile"), ("Ｖｉｌｅ", "vile"), ("b4d 1diot", "bad idiot"), ("x-y_z", "x y z")):
        assert toxicity.fold(text).strip() == want


def test_folding_of_disguises():
    for text, want in (("ki11 a11", "kill all"), ("i.d.i.o.t!", "idiot"), ("f*u*c*k", "fuck"), ("fuuuuck soooo", "fuck so"), ("ıdıot ӏdiot", "idiot idiot"), ("e.g. a.m. U.S.A.", "e g a m usa"), ("book wheel", "book wheel")):
        assert toxicity.fold(text).strip() == want, text


def test_matching_equals_naive_scan():
    rng = np.random.default_rng(12)
    word = lambda: "".join("ab"[int(k)] for k in rng.integers(0, 2, int(rng.integers(1, 5))))
    for _ in range(200):
        terms = {f" {word()}" + (" " if rng.integers(2) else ""): 1.0 for _ in range(4)}
        safe = [f" {word()} {word()} " for _ in range(6)]
        text = f" {' '.join(word() for _ in range(12))} "
        at = lambda t: [i for i in range(len(text)) if text.startswith(t, i)]
        spans = [(i, i + len(t)) for t in safe if t not in terms for i in at(t)]
        want = sorted((i, t) for t in terms for i in at(t) if not any(a <= i and i + len(t) <= b for a, b in spans))
        assert sorted(toxicity.Lexicon(terms, safe, [0.0] * 5).found(text)) == want


@pytest.mark.parametrize("up,down", [(1, 2), (3, 4), (3, 2), (2, 3)])
def test_resampling_equals_direct_convolution(up, down):
    x, m = np.random.default_rng(8).normal(size=999).astype(np.float32), max(up, down)
    n = np.arange(-10 * m, 10 * m + 1)
    z = np.zeros(len(x) * up)
    z[::up] = x
    want = np.convolve(z, np.sinc(n / m) / m * np.kaiser(len(n), 5.0) * up)[10 * m :][::down][: -(-len(x) * up // down)]
    assert np.abs(media.resample(x, up, down) - want).max() < 1e-4


def test_media_round_trip():
    for n in (0, 1, 575, 576, 577, 200_000):
        p = media.payload_of(bytes(i % 256 for i in range(n)))
        assert len(p) % 576 == 0 and len(p) > 0 and media.from_wav(media.to_wav(p)) == p
        t, active, spans = media.features(p)
        assert t.shape[1:] == (media.FRAMES, media.MELS) and len(spans) == len(t) and all(a < b for a, b in active)
        back = media.restore(media.store(t, active, spans))
        assert (back[0] == t).all() and back[1] == active and back[2] == spans


def test_log_mel_and_segments_equal_direct_loops():
    y = np.random.default_rng(15).normal(size=4000).astype(np.float32) * np.repeat([0.01, 1, 0.02, 0.5], 1000).astype(np.float32)
    got = media.log_mel(y)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top, bottom = 2595 * math.log10(1 + media.OUT_RATE / 2 / 700), 2595 * math.log10(1 + 20 / 700)
    edges = [hz(bottom + (top - bottom) * i / (media.MELS + 1)) for i in range(media.MELS + 2)]
    for f in (0, 5, len(got) - 1):
        part = np.zeros(media.SIZE)
        piece = y[f * media.HOP : f * media.HOP + media.SIZE]
        part[: len(piece)] = piece
        part *= [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.SIZE - 1)) for i in range(media.SIZE)]
        t = np.arange(media.SIZE)
        power = [abs(sum(part * np.exp(-2j * math.pi * k * t / media.FFT))) ** 2 for k in range(media.FFT // 2 + 1)]
        for m in range(media.MELS):
            total = 0.0
            for k, p in enumerate(power):
                x = k * media.OUT_RATE / media.FFT
                total += p * max(0.0, min((x - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - x) / (edges[m + 2] - edges[m + 1])))
            assert abs(got[f, m] - math.log(total + 1e-6)) < 1e-2
    assert len(got) == 1 + -(-(4000 - media.SIZE) // media.HOP)
    e = [float(np.mean(r, dtype=np.float64)) for r in got]
    mean, sd = sum(e) / len(e), (sum((x - sum(e) / len(e)) ** 2 for x in e) / len(e)) ** 0.5
    on, start, want = False, 0, []
    for i, x in enumerate(e):
        z = (x - mean) / sd
        if not on and z > 0.5:
            on, start = True, i
        elif on and z < 0.0:
            on = False
            want.append((start, i))
    if on:
        want.append((start, len(e)))
    assert media.segments(got) == want and len(want) > 1


def test_media_contract(spark):
    import hashlib
    rows = [(1, "é" * 400), (2, None), (3, ""), (4, "x" * 576), (4, "x" * 576), (None, "y" * 9000)]
    out = media.audio_digests(docs(spark, rows)).collect()
    for (d, text), r in zip(sorted(rows, key=lambda r: r[0] or 0), sorted(out, key=lambda r: r.doc_id or 0), strict=True):
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, math.ceil(len(data) / 576) * 576) - len(data))
        wav = media.to_wav(payload)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest()) and r.feature == media.summary(*media.restore(bytes(r.tensors)))
    import io
    import wave
    with wave.open(io.BytesIO(wav)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())) == (1, 1, media.RATE, payload)


def test_preference(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, None, None), (2, 0, "user", "z"), (None, 0, "user", "n")]
    c = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, None), (2, 0, 0)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preference.preference_pairs(c, pairs).collect()}
    assert got[0].n_prompt == 1 and got[0].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[0].rejected_mask == "1,0" and got[0].chosen_mask == "1"
    assert (got[1].prompt, got[1].rejected) == ("", "") and got[1].chosen and got[2].n_prompt == 2 and got[2].chosen == got[2].rejected == ""
    assert preference.preference_pairs(c.limit(0), pairs.limit(0)).count() == 0
    assert [(r.pair_id, r.chosen_id) for r in preference.opening_ids(preference.conversation_turns(c)).collect()] == [(1, 0)]


def test_preference_spans_and_retries(spark):
    """Spans cut the text to learn from out of a completion, whatever it holds; a retry's prompt is all before its last answer."""
    turns = [(5, 0, "system", "s"), (5, 1, "assistant", "first"), (5, 2, "user", "x"), (5, 3, "assistant", "a<|im_end|>\n<|im_start|>user\n é"), (5, 4, "user", "bye"), (6, 0, "assistant", "one")]
    c = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = preference.retry_pairs(preference.conversation_turns(c)).collect()
    assert len(r) == 1 and r[0].n_prompt == 3 and r[0].prompt.endswith("x<|im_end|>\n")
    cut = lambda text, spans: [text[int(a) : int(b)] for a, b in (x.split(":") for x in spans.split(","))]
    assert cut(r[0].chosen, r[0].chosen_spans) == [turns[3][3]] and cut(r[0].rejected, r[0].rejected_spans) == ["first"]
    one = preference.preference_pairs(c, spark.createDataFrame([(1, 5, 6)], "pair_id long, chosen_id long, rejected_id long")).first()
    assert one.n_prompt == 0 and cut(one.chosen, one.chosen_spans) == ["first", turns[3][3]] and one.chosen_mask == "0,1,0,1,0"


def test_surrogates(spark):
    text = "Mary Brown, a.b12@mail7.example.com and A.B12@MAIL7.example.com, +1 (017) 555-7713, 43.21.141.162, 4111 1111 1111 1111, token = \"4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e\" Анна Петрова"
    out = {r.doc_id: r for r in pii.with_surrogates(docs(spark, [(1, text), (2, "x " + text), (3, "plain")])).collect()}
    new = out[1].text
    assert out[1].n_entities == 8 and out[3].text == "plain" and out[2].text == "x " + new
    kinds = lambda t: [k for _, _, k, _ in pii.entities(t)]
    assert kinds(new).count("mail") == 2 and "4111" not in new and "4d44c79e" not in new and "Mary" not in new and "43.21.141.162" not in new
    forms = [f for _, _, k, f in pii.entities(new) if k == "mail"]
    assert forms[0] == forms[1]
    card = next(f for _, _, k, f in pii.entities(new) if k == "card")
    assert pii._luhn(card) == 0
    given = new.split(" ")[0].lower()
    assert pii._KIND[given] == ("f", "latin")


def test_surrogates_stay_distinct(spark):
    ips = [("ip", f"1.2.{a}.{b}") for a in range(10) for b in range(10)]
    found = spark.createDataFrame(ips, "kind string, form string")
    turns = defaultdict(int, {(r.kind, r.form): r.turn for r in pii.drawn_again(found).collect()})
    new = {pii.surrogate(k, f, turns[(k, f)]) for k, f in ips}
    assert len(new) == 100 and not new & {f for _, f in ips}


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "good plain words here and more of them " * 5 if i % 2 else "#$% &&& *** " * 20, "en", "big" if i < 300 else f"s{i}") for i in range(310)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300)], LABELS)
    out = quality.quality(d, lab, d.source, d.lang).toPandas()
    assert (out.keep == (out.doc_id % 2 == 1)).all() and out.site_rate.between(0.3, 0.7).all()


def test_strengths_know_noise_from_spread(spark):
    """Simulated groups: the strength is near the true ratio of variances, and large where groups differ by chance alone."""
    rng = np.random.default_rng(13)
    for between, path_sd in ((0.2, 0.1), (0.0, 0.0)):
        rows = []
        for site in range(300):
            mean = 0.5 + between * rng.normal()
            for path in range(3):
                m = mean + path_sd * rng.normal()
                rows += [(f"s{site}", f"p{path}", float(m + 0.2 * rng.normal())) for _ in range(int(rng.integers(2, 7)))]
        d = spark.createDataFrame(rows, "site string, path string, e double")
        agg = lambda *k: d.groupBy(*k).agg(F.sum("e").alias("s"), F.count("*").alias("n"), F.sum(F.col("e") ** 2).alias("q"))
        sites = agg("site")
        paths = agg("site", "path").join(sites.select("site", F.col("s").alias("ss"), F.col("n").alias("sn")), "site")
        a, b = quality.strengths(sites, paths, float(np.mean([r[2] for r in rows])))
        if between:
            assert 0.5 * 0.04 / 0.04 < a < 2 * 0.05 / 0.04 and 2.5 < b < 6.5
        else:
            assert a > 15 and b > 15


def test_quality_equals_direct_formulas(spark):
    """Posterior rates and scores recomputed row by row from the evidence."""
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(["good"] * int(rng.integers(1, 40)) + ["#x&"] * int(rng.integers(0, 20))), "ab"[i % 2], f"s{int(rng.integers(6))}") for i in range(200)] + [(None, None, None, None), (7, "again", "a", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)], LABELS)
    out = quality.quality(d, lab, d.source, d.lang).toPandas()
    e, rate = out.evidence.to_numpy(), float(out.evidence.mean())
    def sums(keys):
        g = out.groupby(keys).evidence
        return g.sum(), g.count(), (out.evidence**2).groupby([out[k] for k in keys]).sum()
    (ss, sn, sq), (ps, pn, pq) = sums(["site"]), sums(["site", "path"])
    within_s, within_p = (sq - ss**2 / sn).sum() / (len(out) - len(sn)), (pq - ps**2 / pn).sum() / (len(out) - len(pn))
    of = ps.index.get_level_values(0)
    between_s, between_p = (sn * (ss / sn - rate) ** 2).sum(), (pn * (ps / pn - (ss / sn).loc[of].to_numpy()) ** 2).sum()
    a = quality._worth(between_s, within_s, len(sn) - 1, len(out), len(out) - (sn**2).sum() / len(out))
    b = quality._worth(between_p, within_p, len(pn) - len(sn), len(out), len(out) - (pn**2 / sn.loc[of].to_numpy()).sum())
    clip = lambda x: min(0.999, max(0.001, x))
    for r in out.itertuples():
        site = clip((ss[r.site] - r.evidence + a * rate) / (sn[r.site] - 1 + a))
        path = clip((ps[(r.site, r.path)] - r.evidence + b * site) / (pn[(r.site, r.path)] - 1 + b))
        z = math.log(r.evidence / (1 - r.evidence)) + 0.5 * (math.log(path / (1 - path)) - math.log(rate / (1 - rate)))
        assert abs(r.site_rate - site) < 1e-6 and abs(r.path_rate - path) < 1e-6 and abs(r.quality - 1 / (1 + math.exp(-z))) < 1e-6
    assert len(out) == 202 and len(e)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    ids = set(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().doc_id)
    assert set(out.doc_id) <= ids and 0.6 * len(ids) < out.doc_id.nunique() < len(ids) and out.groupby("sequence_id").length.sum().max() <= 4096
