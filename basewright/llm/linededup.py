"""Line deduplication by winnowing.

Lines are compared without outer white space; lines without words carry no weight and are never deleted alone.

1. Units: from each line with words on, the shortest run of lines with half of WORDS words. Windows: the shortest runs of WORDS
   words, from any line with words on or up to any such line; each holds a unit, and each longer run holds a window.
2. Fingerprints: of each window's units only the one of the least hash is kept (the last of equals), with its position. Windows
   that share their least unit share the fingerprint, so there are fewer of them than lines, and a copy of a run has the same ones.
3. Positions of equal fingerprints are joined. Most stand once in the corpus and go; of a unit that stands in several places
   each place is taken on by the windows that chose it, grown from the unit line by line both ways: a frequent unit then meets
   only places whose neighbours agree as far as the window reaches, and one join to the first such place loses none. A wordless
   line before or after a window grows it by that line.
4. A match is a run with an equal one at a strictly earlier place, in order of (doc_id, text hash, line). A run of WORDS words or more
   is the union of its windows and the wordless lines around them, so no repeated run is missed, and what is deleted always has
   an earlier copy that stays or whose own first copy does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewright.llm.common import checkpointed, freed, table, unused

WORDS, MOST_CONTEXTS = 10, 100_000
#: A fixed value: a character that isn't white space to Python's strip() and split().
SOLID = r"[^\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """Of each line: a signed 64-bit hash, the number of words. A null text has no lines."""
    if text is None:
        return [], []
    lines = [x.strip() for x in text.split("\n")]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines], [len(x.split()) for x in lines]


def windows(weights: list[int], least: int = WORDS) -> list[tuple[int, int]]:
    """The shortest (first, end) of `least` words or more from each line with words on, and those up to each such line: together
    they cover every run of so many words but for wordless lines at its ends, and whether a window is one of them depends on
    its own lines alone. A line is in 2 * `least` windows at most."""
    out: set[tuple[int, int]] = set()
    start, total = 0, 0
    for i, w in enumerate(weights):
        total += w
        while total >= least:
            if weights[start]:
                out.add((start, i + 1))
            total -= weights[start]
            start += 1
        if start and w:  # the last start from which `least` words were reached
            out.add((start - 1, i + 1))
    return sorted(out)


def mixed(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def units(hashes: list[int], weights: list[int], least: int) -> dict[int, tuple[int, int]]:
    """first -> (end, hash) of the shortest run of `least` words or more from each line with words on."""
    packed, out, end, total = np.array(hashes, np.int64).tobytes(), {}, 0, 0
    for first, w in enumerate(weights):
        while end < len(weights) and total < least:
            total += weights[end]
            end += 1
        if w and total >= least:
            out[first] = end, mixed(packed[8 * first : 8 * end])
        total -= w
    return out


def lowest(found: list[tuple[int, int]]) -> int:
    """Winnowing's choice among a window's units (hash, first): the least hash, the last of equals."""
    return min(found, key=lambda x: (x[0], -x[1]))[1]


def fingerprints(hashes: list[int], weights: list[int], least: int = WORDS) -> dict[int, tuple[int, list[tuple[int, int, int]]]]:
    """position -> (unit's hash, contexts) of the units that windows choose. A context is (first, end, key): lines that are a repeat
    if the key, a hash of all lines of the window that chose the unit, stands at an earlier place; of a wordless line before or
    after a window, that line with the key of the window grown up to it."""
    packed, starts = np.array(hashes, np.int64).tobytes(), units(hashes, weights, -(-least // 2))
    out: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}
    onward: dict[int, tuple[int, int]] = {}
    upto: dict[int, tuple[int, int]] = {}
    for first, end in windows(weights, least):  # in order: of each first line the shortest comes first, of each end last
        at = lowest([(starts[i][1], i) for i in range(first, end) if i in starts and starts[i][0] <= end])
        key = mixed(packed[8 * first : 8 * end])
        out.setdefault(at, (starts[at][1], []))[1].append((first, end, key))
        onward.setdefault(first, (at, key))
        upto[end] = at, key
    empty = [i for i, w in enumerate(weights) if not w]
    for i in empty:
        if i in upto:
            at, key = upto[i]
            upto[i + 1] = at, mixed(key.to_bytes(8, "little", signed=True) + b">")
            out[at][1].append((i, i + 1, upto[i + 1][1]))
    for i in reversed(empty):
        if i + 1 in onward:
            at, key = onward[i + 1]
            onward[i] = at, mixed(key.to_bytes(8, "little", signed=True) + b"<")
            out[at][1].append((i, i + 1, onward[i][1]))
    return out


_CONTEXT = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("key", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("unit", pa.int64()), ("contexts", pa.list_(_CONTEXT))])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, version, text) -> each document's fingerprints, in batches of about MOST_CONTEXTS of contexts."""
    def batch_of(rows):
        ends = np.cumsum([0, *(len(r[4]) for r in rows)])
        flat = np.array([c for r in rows for c in r[4]], np.int64).reshape(-1, 3)
        contexts = pa.StructArray.from_arrays([pa.array(flat[:, k], f.type) for k, f in enumerate(_CONTEXT)], fields=list(_CONTEXT))
        return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], _FOUND.field(k).type) for k in range(4)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), contexts)], schema=_FOUND)

    for batch in batches:
        rows: list[tuple] = []
        many = 0
        for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for pos, (unit, contexts) in fingerprints(*line_hashes(text.as_py())).items():
                rows.append((doc, version, pos, unit, contexts))
                many += len(contexts)
            if many >= MOST_CONTEXTS:
                yield batch_of(rows)
                rows, many = [], 0
        yield batch_of(rows)


def _rest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, cut) -> the text without the cut lines; null for a null text or cut."""
    def one(t, c):
        if t is None or c is None:
            return None
        gone = set(c)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    for texts, cuts in batches:
        yield pa.array([one(t.as_py(), c.as_py()) for t, c in zip(texts, cuts, strict=True)], pa.string())


#: Called nondeterministic so that a filter on what it gives isn't pushed below it, which would run it again in workers of its own.
_without = F.arrow_udf(freed(_rest), T.StringType()).asNondeterministic()


def repeated_runs(documents: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), cut: the lines of each document that repeat earlier ones. Rows with a null doc_id take no part."""
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")
    context = "array<struct<first:int,end:int,key:long>>"
    found = checkpointed(texts.mapInArrow(freed(_fingerprints), f"doc_id long, version long, pos int, unit long, contexts {context}"))
    place = F.struct("doc_id", "version", "pos")
    often = checkpointed(found.groupBy("unit").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("unit"))
    at = found.join(often, "unit").select("doc_id", "version", F.explode("contexts").alias("c")).select("doc_id", "version", "c.first", "c.end", "c.key")
    at = checkpointed(at)
    place = F.struct("doc_id", "version", "first")
    firsts = at.groupBy("key").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("key", "f")
    later = at.join(checkpointed(firsts), "key").where(place != F.col("f"))
    later = later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "end")).alias("at"))  # a document's windows at most
    lines = F.flatten(F.transform("at", lambda r: F.sequence(r["first"], r["end"] - 1)))
    return later.select("doc_id", "version", F.array_sort(F.array_distinct(lines)).alias("cut"))


def _with_cuts(documents: DataFrame) -> tuple[DataFrame, str]:
    """documents with a further column that holds the lines to delete, and that column's name."""
    cut, version, doc_id = unused(documents.columns, "cut", "version", "cut_id")
    runs = checkpointed(repeated_runs(documents)).withColumnsRenamed({"cut": cut, "version": version, "doc_id": doc_id})
    same = (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(version))
    return documents.join(runs, same, "left").drop(version, doc_id), cut


def without_repeats(documents: DataFrame) -> DataFrame:
    """As line_dedup, with the columns of documents alone; documents of which every line with words goes, go as well. n_chars, if there is one, is that of a changed text."""
    out, cut = _with_cuts(documents)
    (new,) = unused(out.columns, "left")
    changed = F.col(cut).isNotNull()
    out = out.withColumn(new, _without(F.when(changed, F.col("text")), cut)).where(~changed | F.col(new).rlike(SOLID))
    n_chars = F.when(changed, F.length(new).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in documents.columns else None
    instead = {"text": F.when(changed, F.col(new)).otherwise(F.col("text")), "n_chars": n_chars}
    return out.select(*[instead[c].alias(c) if c in instead else F.col(f"`{c}`") for c in documents.columns])


def line_dedup(documents: DataFrame) -> DataFrame:
    """The rows and columns of documents, with repeated runs of lines deleted from text; n_lines, n_removed and removed (lines' numbers from 0) follow.

    Defined cases: null text stays null, with no lines; a text of which every line is a repeat becomes empty; texts under
    WORDS words are never changed; null doc_ids and their texts stay as they are; ties of order cannot occur, as a place is
    (doc_id, text hash, line); repeated rows are one document, and each of them loses the same lines; rows that repeat a doc_id
    with another text are documents of their own; input columns named n_lines, n_removed or removed are replaced.
    """
    out, cut = _with_cuts(documents)
    changed = F.col(cut).isNotNull()
    text = F.when(changed, _without(F.when(changed, F.col("text")), cut)).otherwise(F.col("text"))
    cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns if c not in ("n_lines", "n_removed", "removed")]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    n_removed = F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut))
    return out.select(*cols, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.coalesce(cut, F.array().cast("array<int>")).alias("removed"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed, text_sha256 (of the text that stays) and the text itself, for every document."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
