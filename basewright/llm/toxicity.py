"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, drops accents and invisible characters, maps look-alike letters, and digits and signs beside a letter to
the letters they stand for (1 an i, 11 two of l), joins single letters parted by a dot or star each, and takes a letter repeated
three times or more as one; all else that is not a letter becomes a space, numbers too.
The lexicon is learned from labelled training rows: whole words and word beginnings of PREFIX letters, weighted by their
log odds; of nested terms the most telling is kept. Phrases of a term and its neighbour that clean training texts have and toxic ones don't
are exceptions: matches inside them don't count. A small logistic model turns the weight sum, its density over the text's
length and the length into a score.

The fit uses at most about TRAIN_ROWS labelled rows, drawn by hash of their id, equal texts once. A term must stand in LEAST_DOCS toxic
texts of them (a third of the toxic ones, if that is less) and in one of LEAST_SHARE toxic ones, be SURPLUS deviations more frequent there than by chance, and weigh
LEAST_WEIGHT (log odds) at least; an exception must stand in LEAST_SAFE clean texts and no toxic one. Rarer ones are no evidence at
this size of sample, and are left out. Scoring covers every row, whole texts.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import crc_mod, freed, table

TRAIN_ROWS, LEAST_DOCS, SURPLUS, LEAST_WEIGHT, LEAST_SAFE, LEAST_SHARE = 12_000, 4, 3.5, 2.0, 3, 150
PREFIX = range(4, 10)
#: Cyrillic and Greek letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ӏ": "i", "ı": "i", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ʏ": "y"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_STAND_INS = re.compile(r"(?<=[^\W\d_])[0-9$@]+|[0-9$@]+(?=[^\W\d_])")
#: Single letters parted by one of these signs each, three at least.
_PARTED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.*·][^\W\d_]){2,}(?![^\W_])")
_SIGNS = str.maketrans("", "", ".*·")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_BLANK = str.maketrans("0123456789$@", " " * 12)
_LETTERS = str.maketrans(DIGITS | {"2": " ", "6": " ", "$": "s", "@": "a"})


class _Fold(dict):
    """Character -> what it folds to: itself or its Latin look-alike for letters, nothing for marks and invisible ones, else a space."""

    def __missing__(self, at: int) -> str | None:
        c = chr(at)
        kind = unicodedata.category(c)
        self[at] = HOMOGLYPHS.get(c, c) if kind[0] == "L" else None if kind in ("Mn", "Me", "Cf") else c if c in "0123456789$@" else " "
        return self[at]


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Lower-case words of letters, each with one space on either side; empty for no words."""
    low = (text or "").lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
    if _PARTED.search(low):
        low = _PARTED.sub(lambda m: m[0].translate(_SIGNS), low)
    low = low.translate(_FOLD)
    if _STAND_INS.search(low):
        low = _STAND_INS.sub(lambda m: m[0].replace("11", "ll").translate(_LETTERS), low)
    if _REPEATED.search(low):
        low = _REPEATED.sub(r"\1", low)
    words = low.translate(_BLANK).split()
    return f" {' '.join(words)} " if words else ""


def terms_of(folded: str) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIX if n <= len(w))
    return out


class Lexicon:
    """terms: term -> weight; exceptions: phrases; coef: of the logistic model."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], coef: list[float]):
        self.terms, self.exceptions, self.coef, self._machine = dict(terms), list(exceptions), list(coef), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def found(self, folded: str) -> list[tuple[int, str]]:
        """(start, term) of matches outside exception phrases."""
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for t in self.terms:
                self._machine.add_word(t, (t, False))
            for t in self.exceptions:
                if t not in self.terms:
                    self._machine.add_word(t, (t, True))
            if len(self._machine):
                self._machine.make_automaton()
        if not len(self._machine):
            return []
        hits, safe = [], []
        for end, (t, excepted) in self._machine.iter(folded):
            (safe if excepted else hits).append((end - len(t) + 1, t))
        if not safe or not hits:
            return hits
        safe.sort()
        starts, reach = [s for s, _ in safe], list(accumulate((s + len(t) for s, t in safe), max))
        # of the exceptions that begin no later than the match, the farthest end tells whether one holds it
        return [h for h in hits if not (k := bisect.bisect_right(starts, h[0])) or reach[k - 1] < h[0] + len(h[1])]

    def features(self, folded: str) -> list[float]:
        total, n = sum(self.terms[t] for _, t in self.found(folded)), folded.count(" ")
        return [1.0, float(total > 0), math.log1p(total), 100 * total / (n + 100), math.log1p(n)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.coef, self.features(fold(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(terms_of(fold(text.as_py())))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])


def _contexts(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                f, got = fold(text.as_py()), set()
                for at, _ in lexicon.found(f):
                    end = f.index(" ", at + 1)
                    before, after = f[: at].rpartition(" ")[2], f[end + 1 :].partition(" ")[0]
                    got |= {f" {before}{f[at:end + 1]}"} if before else set()
                    got |= {f"{f[at:end + 1]}{after} "} if after else set()
                rows += [(g, int(toxic)) for g in got]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "toxic"])
    return run


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[float(v) for v in lexicon.features(fold(t.as_py()))] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method; the ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, held_out_of: int = 5) -> Lexicon:
    """Learn from labelled rows whose crc32(doc_id as text) modulo held_out_of is not 0; without any, nothing is toxic. A row labelled twice counts as toxic if one label says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc_mod(F.col("doc_id"), held_out_of) != 0).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Lexicon({}, [], [-3.0, 0, 0, 0, 0])
    share = min(1.0, train_rows / n)
    known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).cache()
    rows = documents.select("doc_id", "text").join(F.broadcast(known) if known.count() <= 4 * train_rows else known, "doc_id").select("text", "toxic").dropDuplicates(["text"]).cache()
    try:
        sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        p_all, n_all = sizes.get(1, 0), sizes.get(0, 0)
        if not p_all:
            return Lexicon({}, [], [-3.0, 0, 0, 0, 0])
        count = lambda kind: rows.where(F.col("toxic") == kind).select("text").mapInArrow(freed(_candidates), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        pos = count(1).where(F.col("n") >= max(min(LEAST_DOCS, max(1, p_all // 3)), p_all // LEAST_SHARE)).withColumnRenamed("n", "a")
        both = pos.join(count(0).withColumnRenamed("n", "b"), "term", "left").fillna(0, ["b"])
        a, b = F.col("a"), F.col("b")
        expected = (a + b) * p_all / (p_all + n_all)
        surplus = (a - expected) / F.sqrt(expected + 0.25)
        weight = F.log((a + 0.5) / (p_all + 1)) - F.log((b + 0.5) / (n_all + 1))
        telling = both.where((a / p_all > 4 * b / max(n_all, 1)) & (surplus > SURPLUS) & (weight > LEAST_WEIGHT)).select(surplus.alias("surplus"), "term", weight.alias("weight"))
        scored = [(r.surplus, r.term[-1] == " ", len(r.term), r.term, r.weight) for r in telling.collect()]  # bounded by the rows of the fit
        chosen: dict[str, float] = {}
        begun: set[str] = set()  # beginnings of chosen terms
        for _, _, _, t, weight in sorted(scored, reverse=True):
            stem = t.rstrip()
            if stem not in begun and not any(stem[:i] in chosen for i in range(2, len(stem) + 1)):
                chosen[t] = weight
                begun.update(stem[:i] for i in range(2, len(stem) + 1))
        lexicon = Lexicon(chosen, [], [0.0] * 5)
        ctx = rows.mapInArrow(freed(_contexts(lexicon)), "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where(f"p = 0 AND n >= {LEAST_SAFE}")
        lexicon = Lexicon(chosen, sorted(r.term for r in ctx.collect()), [0.0] * 5)
        got = rows.mapInArrow(freed(_measured(lexicon)), "toxic long, x array<double>").collect()
        x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
        return Lexicon(chosen, lexicon.exceptions, _logistic(x, y))
    finally:
        rows.unpersist()
        known.unpersist()


def _scored(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [lexicon.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return run


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score of each row. Null and empty texts score as texts without matches; repeated rows score alike; null ids stay; extra columns are ignored."""
    return documents.select("doc_id", "text").mapInArrow(freed(_scored(lexicon)), "doc_id long, score double")


def _clean(lexicon: Lexicon, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))
    return run


def keep_clean(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of documents, with all their columns, that score under 0.5."""
    return documents.mapInArrow(freed(_clean(lexicon, documents.columns.index("text"))), documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
