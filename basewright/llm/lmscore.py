"""Document scores of a subword lattice model.

Every word is a lattice of all its segmentations into the pieces of an existing vocabulary, over bytes, so that byte pieces
cover what no other piece does. A word's first piece is drawn from those with a leading mark, the others from the rest. After
each piece the word ends or goes on with a probability of that piece. The forward recursion in log space sums all
segmentations: the marginal probability of the word.

Learned from the training texts are the pieces' shares and how often a word ends after each (ROUNDS expectation steps over
distinct words, which begin at the vocabulary's own scores and keep them as a prior of PRIOR uses); how often a text ends; the
counts of the base score; and an edge over each whole training word, with its count less an absolute discount, beside its
lattice. fitted_score is a text's log probability by these words and an end, each drawn alone.

`score` is that of an urn: a text's word is drawn from the same words with weight URN, or is one of the words before it in the
text, each with weight 1. It's a distribution, and the order of words doesn't matter, so a document's number of words and the
uses of each are enough. URN was chosen with another seventh of the documents held out (remainder 3).

1. Word counts of the whole corpus, added up within tasks and then by word.
2. Expectation steps over the distinct training words; only vectors as long as the vocabulary come to the driver.
3. Lattice scores of all distinct words, once each. Words over LONG bytes are worked on in blocks of STEP bytes by a recursion
   that holds only the last ends, with the same result.
4. A pass over the texts: at most HOT of the most frequent words, those over a count that a histogram of counts gives, are
   looked up in a broadcast table, so no frequent word is ever shuffled by document; the rest is counted per document and
   joined by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, crc_mod, table

HOT, FLUSH, LONG, STEP = 50_000, 200_000, 512, 16_384
ROUNDS, PRIOR, URN = 2, 1_000, 2_000
MARK = b" "
_P = np.uint64(0x9E3779B97F4A7C15)
LOG10 = math.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Lattice:
    """pieces: byte strings (a leading space marks a word's start), the last is the end of a text; weight: their scores' shares."""

    def __init__(self, pieces: list[bytes], weight: np.ndarray):
        self.pieces, self.first = pieces, np.array([p[:1] == MARK or not p for p in pieces])
        weight = np.asarray(weight, np.float64)
        self.logp = np.log(weight / np.where(self.first, weight[self.first].sum(), weight[~self.first].sum()))
        self.prior = np.exp(self.logp)
        self.learn_stops(np.zeros(len(pieces)), np.zeros(len(pieces)))
        real = [p for p in pieces if p]
        hashes = self._hash_all(real)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array([i for i, p in enumerate(pieces) if p])[order]
        self.longest = max(map(len, real))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.begun = np.zeros(1 << 22, bool)
        self.begun[self._hash_all(list({p[:n] for p in real for n in range(1, len(p) + 1)})) >> np.uint64(42)] = True
        single = np.full(256, -1)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                single[p[0]] = i
        self.single = single

    def learn_stops(self, uses: np.ndarray, stops: np.ndarray) -> None:
        """How often a word ends after each piece, smoothed by one use at the mean rate; one half where nothing is known."""
        rate = min(max(stops.sum() / uses.sum(), 1e-6), 1 - 1e-6) if uses.sum() else 0.5
        p = (stops + rate) / (uses + 1)
        self.logend, self.loggo = self.logp + np.log(p), self.logp + np.log1p(-np.minimum(p, 1 - 1e-9))

    def learn(self, uses: np.ndarray, stops: np.ndarray) -> None:
        """Shares of the pieces by their uses and the first weights' shares of PRIOR uses, and how often a word ends after each."""
        for group in (self.first, ~self.first):
            n = uses[group] + PRIOR * self.prior[group]
            self.logp[group] = np.log(n / n.sum())
        self.learn_stops(uses, stops)

    @staticmethod
    def _hash_all(pieces: list[bytes]) -> np.ndarray:
        out = []
        for p in pieces:
            h = 0
            for b in p:
                h = (h * int(_P) + b + 1) & (2**64 - 1)
            out.append((h ^ h >> 31) * 0xBF58476D1CE4E5B9 & (2**64 - 1))
        return np.array(out, np.uint64)

    def edges(self, m: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """m: words of equal length as bytes, by row. For each end: (start, rows, piece ids) of the pieces that match."""
        rows, n = m.shape
        h = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            h[i + 1] = h[i] * _P + m[:, i] + np.uint64(1)
        out: list[list] = [[] for _ in range(n + 1)]
        everyone = np.arange(rows)
        powers = [np.uint64(pow(int(_P), size, 2**64)) for size in range(min(n, self.longest) + 1)]
        for i in range(n):
            out[i + 1].append((i, everyone, self.single[m[:, i]]))
            r, before = everyone, h[i]
            for size in range(2, min(n - i, self.longest) + 1):
                x = h[i + size][r] - before * powers[size]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                on = self.begun[x >> np.uint64(42)]  # the others begin no longer piece either
                r, before, x = r[on], before[on], x[on]
                if not len(r):
                    break
                maybe = np.flatnonzero(self.maybe[x >> np.uint64(44)])
                at = np.searchsorted(self.keys, x[maybe])
                good = self.keys[np.minimum(at, len(self.keys) - 1)] == x[maybe]
                if good.any():
                    out[i + size].append((i, r[maybe[good]], self.ids[at[good]]))
        return out

    @staticmethod
    def _add(into: np.ndarray, rows: np.ndarray, value: np.ndarray) -> None:
        into[rows] = np.logaddexp(into[rows], value)

    def forward(self, m: np.ndarray, edges: list) -> np.ndarray:
        a = np.full((m.shape[1] + 1, m.shape[0]), -np.inf)
        a[0] = 0
        for j in range(1, m.shape[1] + 1):
            w = self.logend if j == m.shape[1] else self.loggo
            for i, rows, ids in edges[j]:
                self._add(a[j], rows, a[i][rows] + w[ids])
        return a

    def matches(self, m: np.ndarray) -> np.ndarray:
        """m: bytes as uint64 -> piece ids by (start, length - 1), -1 for none."""
        n, sizes = len(m), min(len(m), self.longest)
        out = np.full((n, sizes), -1, np.int32)
        out[:, 0] = self.single[m]
        h = m + np.uint64(1)  # of the substrings of one more byte in each turn
        for size in range(2, sizes + 1):
            h = h[:-1] * _P + m[size - 1 :] + np.uint64(1)
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            maybe = np.flatnonzero(self.maybe[x >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, x[maybe]), len(self.keys) - 1)
            good = self.keys[at] == x[maybe]
            out[maybe[good], size - 1] = self.ids[at[good]]
        return out

    def _sweep(self, text: np.ndarray, go: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log sums of all segmentations up to each end, for one word that may be long; of the edges only a block is held."""
        n = len(text)
        a = np.full(n + 1, -np.inf)
        a[0] = 0
        for at in range(0, n, STEP):
            block = text[at : at + STEP + self.longest - 1]
            ids = self.matches(block)
            for i in range(at, min(at + STEP, n)):
                row = ids[i - at]
                size = np.flatnonzero(row >= 0)
                size = size[size < n - i]
                to = i + 1 + size
                w = np.where(to == n, end[row[size]], go[row[size]])
                a[to] = np.logaddexp(a[to], a[i] + w)
        return a

    def long_score(self, word: bytes) -> float:
        """As scores, for a word of any length."""
        return float(self._sweep(np.frombuffer(MARK + word, np.uint8).astype(np.uint64), self.loggo, self.logend)[-1])

    def long_expected(self, word: bytes) -> np.ndarray:
        """As expected, for one word of any length: the sums from the end on are those of the turned-round recursion."""
        text = np.frombuffer(MARK + word, np.uint8).astype(np.uint64)
        n, total = len(text), np.zeros((2, len(self.pieces)))
        a, b = self._sweep(text, self.loggo, self.logend), np.full(n + 1, -np.inf)
        b[n] = 0
        for at in reversed(range(0, n, STEP)):
            ids = self.matches(text[at : at + STEP + self.longest - 1])
            for i in reversed(range(at, min(at + STEP, n))):
                row = ids[i - at]
                size = np.flatnonzero(row >= 0)
                size = size[size < n - i]
                to, piece = i + 1 + size, row[size]
                w = np.where(to == n, self.logend[piece], self.loggo[piece]) + b[to]
                b[i] = np.logaddexp.reduce(w)
                uses = np.exp(a[i] + w - a[n])
                total[0, piece] += uses
                total[1, piece[to == n]] += uses[to == n]
        return total

    def grouped(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of words, their bytes by row), of equal length and a bounded size; words over LONG bytes are left out."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= LONG:
                by.setdefault(len(w), []).append(i)
        for n, idx in by.items():
            step = max(1, 400_000 // (n + 1))
            for s in range(0, len(idx), step):
                part = idx[s : s + step]
                yield np.array(part), np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8).reshape(-1, n + 1).astype(np.uint64)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for idx, m in self.grouped(words):
            out[idx] = self.forward(m, self.edges(m))[-1]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long_score(w)
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece in the words, and how often a word ends there."""
        total = np.zeros((2, len(self.pieces)))
        for idx, m in self.grouped(words):
            edges = self.edges(m)
            a = self.forward(m, edges)
            n = m.shape[1]
            b = np.full_like(a, -np.inf)
            b[n] = 0
            for j in range(n, 0, -1):
                for i, rows, ids in edges[j]:
                    w = (self.logend if j == n else self.loggo)[ids] + b[j][rows]
                    self._add(b[i], rows, w)
                    uses = np.bincount(ids, np.exp(a[i][rows] + w - a[n][rows]), len(self.pieces))
                    total[0] += uses
                    if j == n:
                        total[1] += uses
        for w in words:
            if len(w) > LONG:
                total += self.long_expected(w)
        return total


def vocabulary(path: str) -> Lattice:
    """Pieces and first weights of a vocabulary file; its scores are negative ranks there, taken as a Zipf law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            p = sp.id_to_piece(i).replace("▁", " ").encode()
            if p.strip() and b" " not in p[1:] or p == MARK:
                score = sp.get_score(i)
                weight[p] = max(weight.get(p, 0), math.exp(score) if score > -1 else 1 / (20 - score) if score > -1e6 else 1e-9)
    for b in range(256):
        weight.setdefault(bytes([b]), 1e-7)
    pieces = [*sorted(weight), b""]
    w = np.array([weight[p] for p in pieces[:-1]] + [1e-3])
    return Lattice(pieces, w)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 100_000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, as words are worked on by length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most or sum(b.nbytes for b in held) >= most_bytes:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_COUNTED = "word binary, n long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) -> (word, uses in training texts); words of other texts come with 0."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.as_py())
            if train:
                seen.update(words)
            else:
                for w in set(words):
                    seen[w] += 0
            if len(seen) >= FLUSH:
                yield flush()
    yield flush()


def _expected(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(lattice.pieces)))
        for batch in _gathered(batches):
            total += lattice.expected(batch.column(0).to_pylist())
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[0][used], pa.float64()), pa.array(total[1][used], pa.float64())], names=["piece", "n", "e"])
    return run


def _word_scores(lattice: Lattice, words: int, distinct: int, discount: float, word_share: float):
    """words, distinct: training tokens and types without ends; word_share: the probability that the text goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            lp, n = lattice.scores(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype(float)
            fit = lp
            if words:
                own = np.log(np.maximum(n - discount, 1e-300) / words)
                fit = np.logaddexp(np.where(n > 0, own, -np.inf), lp + math.log(discount * distinct / words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((fit + math.log(word_share)) / LOG10, pa.float64())], names=["word", "n", "fit"])
    return run


def _again(fit: float, tf: int, word_share: float) -> float:
    """log10 of what the urn gives for the uses of a word after its first, over the urn's sizes: sum of log10(URN * p + k * word_share) for k from 1 to tf - 1."""
    a = URN * 10**fit / word_share
    return ((tf - 1) * math.log(word_share) + math.lgamma(a + tf) - math.lgamma(a + 1)) / LOG10


def _again_column(fit: Column, tf: Column, word_share: float, terms: int = 15) -> Column:
    """As _again: so many terms one by one, the others by the difference of two Stirling series."""
    a = F.lit(float(URN)) * F.pow(F.lit(10.0), fit) / word_share
    series = lambda x: (x - 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    first = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(tf - 1, F.lit(terms))), F.lit(0.0), lambda t, k: t + F.log(a + k))
    rest = F.when(tf - 1 > terms, series(a + tf) - series(a + terms + 1)).otherwise(0.0)
    return F.when(tf > 1, ((tf - 1) * math.log(word_share) + first + rest) / LOG10).otherwise(0.0)


_PARTS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("fit", pa.float64()), ("urn", pa.float64())])


def _parts(hot, word_share: float):
    """(doc_id, text) -> a row with the document's sums over hot words, and a row for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                cols: list[list] = [[] for _ in _PARTS]

                def put(*row, cols=cols):
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)

                for d, text in zip(piece.column(0).to_pylist(), piece.column(1), strict=True):
                    text = text.as_py() or b""
                    words, version = words_of(text), xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    n_known, base, fit, urn = 0, 0.0, 0.0, 0.0
                    for w, tf in Counter(words).items():
                        got = known.get(w)
                        if got is None:
                            put(d, version, w, tf, 0, 0, 0, 0.0, 0.0, 0.0)
                        else:
                            n_known += tf
                            base += tf * got[0]
                            fit += tf * got[1]
                            urn += math.log10(URN) + got[1] + (_again(got[1], tf, word_share) if tf > 1 else 0.0)
                    put(d, version, None, 0, 1, len(words), n_known, base, fit, urn + (math.lgamma(URN) - math.lgamma(URN + len(words))) / LOG10)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PARTS, strict=True)], schema=_PARTS)
    return run


def _frequent(scored: DataFrame, most: int) -> list:
    """All words of at least some count: the least count that a histogram shows to leave at most so many of them."""
    step = F.floor(F.log2("n") * 8).cast("int")
    have = {r.s: r.k for r in scored.where("n > 0").groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()}  # 512 rows at most
    total, cut = 0, None
    for s in sorted(have, reverse=True):
        total += have[s]
        if total > most:
            break
        cut = s
    return [] if cut is None else scored.where("n > 0").where(step >= cut).collect()


def score_documents(documents: DataFrame, path: str, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, fitted_score: a row for each row of documents.

    Learned from the texts whose crc32(doc_id as text) modulo held_out_of is not held_out. Defined cases: null and empty texts
    are their end alone; repeated rows count as often as they occur and score alike; rows that repeat a doc_id with another
    text score by their own; a null doc_id is scored like any other and isn't learned from (held_out is null); with no training
    texts all counts are 0 and the vocabulary alone scores; an empty table gives no rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    train = F.coalesce(crc_mod(F.col("doc_id"), held_out_of) != held_out, F.lit(False))
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"), train.alias("train"))
    counted = docs.select("text", "train").mapInArrow(_counts, _COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    ends = docs.where("train").count()
    times = lambda c: F.sum(F.when(c, 1).otherwise(0))
    row = counted.agg(F.sum("n").alias("n"), times(F.col("n") > 0).alias("v"), times(F.col("n") == 1).alias("n1"), times(F.col("n") == 2).alias("n2")).first()
    words, distinct = row.n or 0, row.v or 0
    n, v = words + ends, distinct + (1 if ends else 0)
    discount = min(0.95, max(0.3, row.n1 / (row.n1 + 2 * row.n2))) if row.n1 else 0.5
    end_share = min(ends / n, 0.5) if n else 0.5
    lattice = vocabulary(path)
    for _ in range(ROUNDS):
        uses, stops = np.zeros(len(lattice.pieces)), np.zeros(len(lattice.pieces))
        got = counted.where("n > 0").mapInArrow(_expected(lattice), "piece long, n double, e double").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
        for r in got.collect():  # a row a piece
            uses[r.piece], stops[r.piece] = r.n, r.e
        lattice.learn(uses, stops)
    word_share = 1 - end_share
    scored = checkpointed(counted.mapInArrow(_word_scores(lattice, words, distinct, discount, word_share), "word binary, n long, fit double"))
    hot = spark.sparkContext.broadcast({bytes(r.word): (math.log10(r.n + 1), r.fit) for r in _frequent(scored, HOT)})
    parts = docs.select("doc_id", "text").mapInArrow(_parts(hot, word_share), "doc_id long, version long, word binary, tf long, copies long, n_tokens long, n_known long, base double, fit double, urn double")
    parts = checkpointed(parts)
    none = F.lit(0).cast("long")
    rare = parts.where("word IS NOT NULL").select("doc_id", "version", "word", "tf").join(scored.withColumnRenamed("fit", "each"), "word").select(
        "doc_id", "version", none.alias("copies"), none.alias("n_tokens"), F.when(F.col("n") > 0, F.col("tf")).otherwise(0).alias("n_known"),
        (F.col("tf") * F.log10(F.col("n") + 1)).alias("base"), (F.col("tf") * F.col("each")).alias("fit"),
        (math.log10(URN) + F.col("each") + _again_column(F.col("each"), F.col("tf"), word_share)).alias("urn"))  # not fit: a lambda would take the new column
    sums = parts.where("word IS NULL").drop("word", "tf").unionByName(rare)
    sums = sums.groupBy("doc_id", "version").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "fit", "urn")])
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    mean = lambda c: F.col(c) / F.col("copies")  # noqa: E731  each repeated row adds the same
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long")
    end_known, end_base = int(ends > 0), math.log10(ends + 1)
    return sums.select(
        "doc_id", (crc_mod(F.col("doc_id"), held_out_of) == held_out).alias("held_out"), (whole("n_tokens") + 1).alias("n_tokens"), (whole("n_known") + end_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (mean("base") + end_base - (whole("n_tokens") + 1) * math.log10(n + v + 1)).alias("base_score"),
        (mean("urn") + math.log10(end_share)).alias("score"), (mean("fit") + math.log10(end_share)).alias("fitted_score"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), vocabulary_path())
