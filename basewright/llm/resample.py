"""Importance resampling toward a target's distribution of hashed word runs, by a ring of running CRC states.

A feature is a run of 1 to `longest` consecutive words joined by one space; its bucket is the unsigned crc32 of its UTF-8 bytes
modulo `buckets`. One scan over a document keeps the zlib states of the runs that begin at the last `longest` words. Each word
extends every state by a space and the word, starts one of its own and drops the oldest, so a feature's bytes are never put
together and each word costs `longest` short updates.

1. Both tables are scanned for counts by bucket, added up within a task first: a task gives `buckets` rows at most.
2. The gains, one for each bucket, are the only thing that goes through the driver; their number is a parameter.
3. A second scan adds up each document's gains. A document's draw is Gumbel noise from its doc_id, so the highest scores are a
   sample without replacement by weight.
4. Ranks: a range sort over all executors, whose partitions are numbered on from each other; no task sees more than its range.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, freed, numbered, shuffle_partitions, table

LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
PIECE = 1 << 20
#: What stands between words, as blanks; all other bytes as they are, A-Z in lower case.
_BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of about PIECE bytes; no word is cut."""
    text = (text or b"").translate(_BLANKED)
    at = 0
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def ring_buckets(words: list[bytes], ring: list[int], longest: int, buckets: int) -> np.ndarray:
    """The buckets of all runs that end in these words. ring holds the states of the runs that end before them and is moved on."""
    out, crc32 = array("I"), zlib.crc32
    for w in words:
        if len(ring) == longest:
            del ring[0]
        spaced = b" " + w
        ring[:] = [crc32(spaced, state) for state in ring]
        ring.append(crc32(w))
        out.extend(ring)
    return np.frombuffer(out, np.uint32) % np.uint32(buckets) if out else np.empty(0, np.uint32)


def scanned(text: bytes | None, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets) of a text, piece by piece: one scan, in memory of a piece."""
    ring: list[int] = []
    for words in word_lists(text):
        yield len(words), ring_buckets(words, ring, longest, buckets)


def _counting(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in scanned(text.as_py(), longest, buckets):
                    seen += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column text each bucket holds, over all rows."""
    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(freed(_counting(longest, buckets)), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    k, t_all, s_all = len(target), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def draw_of(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of Gumbel noise that belong to a doc_id, rounded down; a null id draws as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def _weighing(gain: np.ndarray, longest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_words = n = weight = 0
                for k, found in scanned(text.as_py(), longest, len(gain)):
                    n_words, n, weight = n_words + k, n + len(found), weight + int(gain[found].sum())
                rows.append((doc_id, n_words, n, weight, weight + draw_of(doc_id, seed)))
            cols = zip(*rows, strict=True) if rows else [[] for _ in _WEIGHED]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_WEIGHED)
    return run


def resample(documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: a row for each row of documents; rank is null where it isn't drawn.

    Of the N documents with at least least_words words, the floor(percent * N / 100) highest scores are drawn. Defined cases: null,
    empty and wordless texts have no features and weight 0, in either table; ties go to the smaller doc_id (a null one first), then
    to the smaller weight and the fewer features; repeated rows are documents of their own, with ranks of their own; rows that
    repeat a doc_id have the same noise; an empty documents gives no rows, an empty target the gains of its smoothing alone; long
    texts are scanned in pieces; further columns are ignored.
    """
    gain = gains(bucket_counts(target, longest, buckets), bucket_counts(documents, longest, buckets))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = checkpointed(texts.mapInArrow(freed(_weighing(gain, longest, seed)), "doc_id long, n_words long, n_features long, weight long, score long"))
    able = rows.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features")]
    able, total = numbered(able, order, shuffle_partitions(documents.sparkSession))
    drawn = percent * total // 100
    ranked = able.withColumn("rank", F.when(F.col("ordinal") <= drawn, F.col("ordinal"))).drop("ordinal")
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB. The table of crc32 is worked out from its polynomial; a feature's bytes are read from its hex form.
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
runs AS (SELECT side, id, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
counted AS (SELECT side, id, g, count(*) AS n FROM runs GROUP BY ALL),
names AS (SELECT g, hex(g) AS h FROM (SELECT DISTINCT g FROM counted)),
bytes AS (SELECT g, list_transform(range(1, len(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM names),
bucket AS (SELECT g, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, tab),
held AS (SELECT side, id, k, sum(n) AS n FROM counted JOIN bucket USING (g) GROUP BY ALL),
shares AS (SELECT k, coalesce(sum(n) FILTER (side = 'b'), 0) AS t, coalesce(sum(n) FILTER (side = 'd'), 0) AS s FROM held GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM shares) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM shares) + 10000) AS DOUBLE))) AS BIGINT) AS g FROM shares),
weights AS (SELECT id, sum(n) AS n, sum(n * gain.g) AS weight FROM held JOIN gain USING (k) WHERE side = 'd' GROUP BY id),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w.w) AS n_words,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
           FROM documents JOIN w ON w.side = 'd' AND w.id = doc_id LEFT JOIN weights ON weights.id = doc_id),
ranked AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * total // 100 THEN place END AS rank FROM ranked
"""
