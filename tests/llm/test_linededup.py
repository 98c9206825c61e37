"""Line dedup against plain enumeration of repeated runs."""

import re
import sys

import numpy as np

from basewright.llm import linededup


def enumerated(rows, least=10):
    """doc_id -> lines in any run of `least` words or more that also stands at an earlier place."""
    lines = {d: [x.strip() for x in t.split("\n")] for d, t in sorted(rows)}
    runs = [(d, s, e) for d, x in lines.items() for s in range(len(x)) for e in range(s + 1, len(x) + 1) if sum(len(y.split()) for y in x[s:e]) >= least]
    first = {}
    for d, s, e in runs:
        first.setdefault(tuple(lines[d][s:e]), (d, s))
    cut = {d: set() for d in lines}
    for d, s, e in runs:
        if first[tuple(lines[d][s:e])] != (d, s):
            cut[d].update(range(s, e))
    return {d: sorted(c) for d, c in cut.items()}


def removed(spark, rows):
    return {r.doc_id: list(r.removed) for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_run_whose_lines_stand_elsewhere_first(spark):
    """Each line's first place has other neighbours; the run's first place is a later one."""
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(i, f"{a}\n{i} more words stand here") for i in range(20)] + [(20 + i, f"{i} more words stood there\n{b}") for i in range(20)]
    got = removed(spark, [*rows, (50, f"{a}\n{b}"), (51, f"new\n{a}\n{b}"), (52, f"{b}\n{a}")])
    assert {d: c for d, c in got.items() if c} == {51: [1, 2]}


def test_equals_enumeration(spark):
    rng = np.random.default_rng(9)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 50, int(rng.integers(1, 14)))) for _ in range(12)]
    rows = [(i, "\n".join(lines[int(k)] for k in rng.integers(0, 12, int(rng.integers(1, 12))))) for i in range(60)]
    want = enumerated(rows)
    assert removed(spark, rows) == want and sum(map(len, want.values())) > 100


def test_passages_with_empty_lines(spark):
    """Copies among other neighbours are found whichever line has the least hash; the empty lines at their ends repeat too."""
    passages = [f"\n{i} one two three four five\n\n{i} six seven eight nine ten\n" for i in range(60)]
    rows = [(100 * side + i, f"start {i} {side}\n{p}\nend {i} {side}") for side in range(2) for i, p in enumerate(passages)]
    assert removed(spark, rows) == {d: [1, 2, 3, 4, 5] if d >= 100 else [] for d, _ in rows}


def test_empty_lines_equal_enumeration(spark):
    rng = np.random.default_rng(10)
    lines = ["", "  ", "\t", *(" ".join(f"w{k}" for k in rng.integers(0, 50, int(rng.integers(1, 9)))) for _ in range(5))]
    rows = [(i, "\n".join(lines[int(k)] for k in rng.integers(0, 8, int(rng.integers(1, 14))))) for i in range(60)]
    want = enumerated(rows)
    assert removed(spark, rows) == want and sum(map(len, want.values())) > 100


def test_many_empty_lines_cost_in_proportion(spark):
    n = 50_000
    text = "one two three four five" + "\n" * n + "six seven eight nine ten" + "\n" * n
    got = removed(spark, [(1, f"a\n{text}b"), (2, f"c\n{text}d"), (3, "\n" * n)])
    assert got == {1: [], 2: list(range(1, 2 * n + 1)), 3: []}


def test_run_whose_minimum_stands_first_elsewhere(spark):
    """The shared line stands in another context before the run's first copy, whichever of the lines has the least hash."""
    for at in range(3):
        a, b, c = (f"{x}{at} b{at} c{at} d{at}" for x in "xyz")
        rows = [(1, f"p q r s\n{b}\nt u v w"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}")]
        assert [len(x) for x in removed(spark, rows).values()] == [0, 0, 3]


def some_lines(n, seed):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join(f"w{k}" for k in rng.integers(0, 40, int(m))) for m in rng.integers(0, 8, n))


def test_each_window_holds_its_least_unit():
    hashes, weights = linededup.line_hashes(some_lines(80, 11))
    units = linededup.units(hashes, weights, 5)
    assert all(weights[i] and sum(weights[i:e]) >= 5 > sum(weights[i : e - 1]) for i, (e, _) in units.items())
    found = linededup.fingerprints(hashes, weights)
    chosen = {(f, e): (pos, unit) for pos, (unit, contexts) in found.items() for f, e, _ in contexts if sum(weights[f:e]) >= 10}
    assert sorted(chosen) == linededup.windows(weights)
    for (first, end), (pos, unit) in chosen.items():
        inside = [h for i, (e, h) in units.items() if first <= i and e <= end]
        assert unit == units[pos][1] == min(inside)


def test_fewer_fingerprints_than_lines():
    hashes, weights = linededup.line_hashes(some_lines(4000, 12))
    assert len(linededup.fingerprints(hashes, weights)) < 0.7 * sum(w > 0 for w in weights)


def test_any_choice_of_units_finds_the_same_runs(spark, monkeypatch):
    """Other rules keep other, and more, fingerprints; the lines that go are the same."""
    rng = np.random.default_rng(13)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 50, int(rng.integers(0, 9)))) for _ in range(14)]
    rows = [(i, "\n".join(lines[int(k)] for k in rng.integers(0, 14, int(rng.integers(1, 14))))) for i in range(50)]
    kept = lambda: sum(len(linededup.fingerprints(*linededup.line_hashes(t))) for _, t in rows)
    want, n = enumerated(rows), kept()
    assert removed(spark, rows) == want
    for rule in (lambda found: max(found)[1], lambda found: min(i for _, i in found)):
        monkeypatch.setattr(linededup, "lowest", rule)
        hashes = [linededup.fingerprints(*linededup.line_hashes(t)) for _, t in rows]
        cut = {}
        first: dict = {}
        for (d, _), found in sorted(zip(rows, hashes, strict=True), key=lambda x: x[0][0]):
            for a, e, key in sorted(c for _, contexts in found.values() for c in contexts):
                cut.setdefault(d, set())
                if first.setdefault(key, (d, a)) != (d, a):
                    cut[d].update(range(a, e))
        assert {d: sorted(cut.get(d, ())) for d, _ in rows} == want
    assert kept() > n  # every window's first unit


def test_a_frequent_unit_meets_equal_neighbours_only(spark):
    """A unit in 400 places: its contexts part it, and only the place with an equal neighbour is matched."""
    rows = [(i, f"share this page with friends\nno {i} of all the pages {i}") for i in range(400)]
    rows += [(500, "x\nshare this page with friends\nno 7 of all the pages 7\ny")]
    assert {d: c for d, c in removed(spark, rows).items() if c} == {500: [1, 2]}


def test_nothing_but_blank_lines_left(spark):
    """A document of which every line with words goes, goes whole, whatever blank lines it keeps; others keep theirs."""
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a), (2, f"\n\n{a}\n \n\t\n"), (3, f"\n{a}\nmore"), (4, " \n"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in linededup.without_repeats(d).collect()} == {(1, a), (3, "more"), (4, " \n"), (5, None)}


def test_white_space_is_pythons():
    solid = re.compile(linededup.SOLID)
    assert [c for c in map(chr, range(sys.maxunicode + 1)) if bool(solid.match(c)) == c.isspace()] == []


def test_blank_lines_of_any_white_space(spark):
    a = "one two three four five six seven eight nine ten"
    blank = "".join(c for c in map(chr, range(0x4000)) if c.isspace() and c != "\n")
    rows = [(1, a), (2, f"{blank}\n{a}\n{blank}"), *((3 + i, f"{c}\n{a}\n{c}") for i, c in enumerate("\u200b\U0001f600x\0"))]
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.without_repeats(spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: (a, len(a))} | {3 + i: (f"{c}\n{c}", 3) for i, c in enumerate("\u200b\U0001f600x\0")}


def test_one_python_step_deletes_lines(spark):
    """Each step of a task has a Python worker of its own, which then stays: with three, an executor's workers doubled."""
    a = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, a, 48), (2, f"x\n{a}", 50)], "doc_id long, text string, n_chars long")
    for out in (linededup.without_repeats(d), linededup.line_dedup(d)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("ArrowEvalPython|BatchEvalPython|MapInArrow", plan)) == 1, plan


def test_very_long_texts(spark):
    """Many short lines, and one line of many words."""
    many = "\n".join(f"line {i} has few words" for i in range(30_000))
    wide = "word " * 200_000
    got = removed(spark, [(1, many), (2, f"new\n{many}"), (3, wide), (4, f"{wide}\nend of it")])
    assert got == {1: [], 2: list(range(1, 30_001)), 3: [], 4: [0]}


def test_repeated_rows_and_ids(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a), (1, a), (2, f"x\n{a}"), (2, f"y\n{a}"), (None, a), (3, None), (4, "")]
    out = spark.createDataFrame([(d, t, 7, "v") for d, t in rows], "doc_id long, text string, cut long, version string")
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed, r.cut, r.version) for r in linededup.line_dedup(out).collect())
    assert got == [(0, a, 0, 7, "v"), (1, a, 0, 7, "v"), (1, a, 0, 7, "v"), (2, "x", 1, 7, "v"), (2, "y", 1, 7, "v"), (3, "", 0, 7, "v"), (4, "", 0, 7, "v")]
