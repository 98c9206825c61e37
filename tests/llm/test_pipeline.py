"""The pipeline against plain Python stages on a small corpus with planted cases."""

import math
import zlib
from collections import Counter

import numpy as np
import tokenizers

import corpus_pipeline
from basewright.llm import packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, removed long, _b_id long"
VOCAB = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("la", "mi", "ro", "tan")]


def fixture():
    """Rows with a bad word, passages, copies of lines and of texts, benchmark windows and odd rows; labels; benchmark items."""
    rng = np.random.default_rng(20)
    some = lambda n: " ".join(VOCAB[int(k)] for k in rng.integers(0, len(VOCAB), n))
    items = [(1, some(14)), (2, some(10)), (3, None)]
    passage = f"{some(12)}\n{some(15)}"
    rows, labels = [], []
    for i in range(160):
        text, bad = f"{some(30)}\n{some(20)}", i % 10 == 3
        if bad:
            text = text.replace(" ", " vilenasty ", 1)
        elif i % 10 == 5:
            text = f"{some(8)}\n{passage}\n{some(9)}"
        elif i % 10 == 7:
            words = rows[i - 1][1].split(" ")
            words[4] = "changed"
            text = " ".join(words).replace("\n", " ")
        elif i % 20 == 9:
            text = f"{some(5)} {' '.join(items[i // 20 % 2][1].split()[:10]).upper()}, {some(7)}"
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(200, None), (201, ""), (202, " \n "), (None, some(20)), (None, f"x {items[1][1]}"), (203, rows[0][1]), (20, rows[20][1]), (204, passage), (205, f"\n{passage}\n \n\n")]
    return rows, labels, items


def plain(rows, lexicon, items):
    """(doc_id, text) that packing gets, by enumeration."""
    rows = [(d, t) for d, t in rows if lexicon.score(t) < 0.5]
    known = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    lines = {k: [x.strip() for x in k[1].split("\n")] for k in known}
    first, runs = {}, []
    for k in known:
        for a in range(len(lines[k])):
            for e in range(a + 1, len(lines[k]) + 1):
                if sum(len(x.split()) for x in lines[k][a:e]) >= 10:
                    runs.append((k, a, e))
                    first.setdefault(tuple(lines[k][a:e]), (k, a))
    cut = {k: set() for k in known}
    for k, a, e in runs:
        if first[tuple(lines[k][a:e])] != (k, a):
            cut[k].update(range(a, e))
    kept = []
    for d, t in rows:
        c = cut.get((d, t))
        new = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in c) if c else t
        if not c or new.strip():
            kept.append((d, new))
    sets = {}
    for d, t in kept:
        w = (t or "").lower().split()
        if d is not None and w:
            sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    up = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and up[a] != up[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(up[a], up[b])
                    up = {d: low if c in (up[a], up[b]) else c for d, c in up.items()}
                    changed = True
    kept = [(d, t) for d, t in kept if up.get(d, d) == d]
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in t or "").split()
    wins = {tuple(words(t)[i : i + 10]) for _, t in items if t for i in range(max(1, len(words(t)) - 9))}
    return [(d, t) for d, t in kept if not any(tuple(words(t)[i : i + len(w)]) == w for w in wins for i in range(len(words(t))))]


def write(spark, folder, rows, labels, items):
    spark.createDataFrame([(d, t, "en", "s", len(t) if t else None, "v", 7, 8) for d, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, labels, items = fixture()
    write(spark, str(tmp_path), rows, labels, items)
    lexicon = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert lexicon.terms
    want = plain(rows, lexicon, items)
    gone = {d for d, _ in rows} - {d for d, _ in want}
    assert {i for i in range(160) if i % 10 == 3} <= gone and {i for i in range(160) if i % 20 == 9 and i // 20 % 2 < 2} <= gone and {203, 204, 205} <= gone and 20 not in gone
    tok, pieces = tokenizers.Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for d, t in want:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for i, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            pieces[(d, i, s, len(part), zlib.crc32(part.tobytes()))] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    fill: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096 and len(fill) == math.ceil(sum(fill.values()) / 4096)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, labels, items = fixture()
    write(spark, str(tmp_path / "a"), rows, labels, items)
    write(spark, str(tmp_path / "b"), [], [], [])
    for folder, some in ((tmp_path / "a", True), (tmp_path / "b", False)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(folder))
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            got = out.collect()
            assert bool(got) == some and all((r.version, r.removed, r._b_id) == ("v", 7, 8) for r in got)
        assert bool(corpus_pipeline.packed(spark, docs, str(folder)).count()) == some
