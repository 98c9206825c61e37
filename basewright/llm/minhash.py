"""MinHash near-duplicate detection: universal hash minima, banding, signature and exact verification, star components.

1. A pass over the whole texts makes, for each row, the set of its distinct word shingles (64-bit hashes), a 128-bit
   digest of that set, MINIMA minima of universal hashes and a key for each of BANDS bands of ROWS minima.
2. Rows with equal sets are one class; only its least row goes on, so exact copies cost a count, not pairs, and take
   their class's component at the end.
3. Buckets with the same members are one. In each, every member is paired with one pivot, never with all others. Signatures
   drop pairs that agree in fewer than AGREE of the minima (chance of dropping a pair of similarity 0.8: about 4e-7).
4. Whole texts of the pairs left are dealt by (pivot, salt), and the exact Jaccard similarity of the full sets confirms each
   link.
5. Components of the confirmed links. In a bucket whose members still lie in several components the pivot may have hidden a
   link. Such buckets of over LARGE members are put together by their largest component, so that a document that misses
   the component's pivots meets it once and not once a bucket. Signatures of such a group are compared in blocks of about
   BLOCK rows, inside a task; those of the largest component meet only the others. Only the members that agree with one of
   another component go on, not the pairs.
6. Full sets of those members are dealt to the same kind of blocks, and all intersections of a block pair are counted as
   matrix products. A spanning forest of the links found is given out, at most one a row, and joins the components.

A pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8**4)**32, about 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.blocks import by_blocks, column, joined_components, open_groups
from basewright.llm.classes import classes_of, confirmed_links, documents_of, near, of_classes, rows_of, sets_of, version_of
from basewright.llm.common import checkpointed, freed, swept, table, unused
from basewright.llm.components import connected_components
from basewright.llm.shingles import shingle_set

ROWS, BANDS = 4, 32
MINIMA = ROWS * BANDS
AGREE = 80
WIDTH, STEP = 2048, 250_000
#: Rows up to which pivots' signatures (280 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SIGNATURES = 50_000
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima, as the upper 32 bits of a * x + b modulo 2**64; in blocks, so that memory is bounded."""
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(s), 4096):
        x = s[i : i + 4096]
        low = np.empty((MINIMA, len(x)), np.uint64)
        np.multiply(_A[:, None], x[None, :], out=low)
        low += _B[:, None]
        np.minimum(out, (low.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


_FEATURES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                piece = batch.slice(part, 1000)
                n, keys, sigs, bands = [], [], [], []
                for text in piece.column(2):
                    s = shingle_set(text.as_py(), k)
                    n.append(len(s))
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    keys.append(np.frombuffer(digest, "<i8"))
                    if len(s):
                        sig = signature(s)
                        sigs.append(sig.astype("<u2").tobytes())
                        rows = sig.astype("<u4").reshape(BANDS, ROWS)
                        bands.append([np.int64(np.uint64(xxhash.xxh3_64_intdigest(r.tobytes(), seed=i)).astype(np.int64)) for i, r in enumerate(rows)])
                    else:
                        sigs.append(b"")
                        bands.append([])
                found = [n, [x[0] for x in keys], [x[1] for x in keys], sigs, bands]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *[pa.array(x, f.type) for x, f in zip(found, list(_FEATURES)[2:], strict=True)]], schema=_FEATURES)
    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (p, d) of which the signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, MINIMA) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= AGREE)
            yield batch.select([0, 1]).filter(keep)


def _with_partner(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the rows whose signature agrees with one of another component."""
    sa, sb = (np.frombuffer(b"".join(r[6] for r in x), "<u2").reshape(-1, MINIMA) for x in (left, right))
    ca, cb = column(left, 5), column(right, 5)
    x, y = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for at in range(0, len(left), 64):
        agree = (sa[at : at + 64, None, :] == sb[None, :, :]).sum(axis=2, dtype=np.uint8) >= AGREE
        agree &= ca[at : at + 64, None] != cb[None, :]
        x[at : at + 64] |= agree.any(axis=1)
        y |= agree.any(axis=0)
    docs = np.unique(np.concatenate([column(left, 4)[x], column(right, 4)[y]]))
    return np.full(len(docs), left[0][0]), docs


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of either side, as products of 0/1 matrices over WIDTH shared shingles at a time.

    The hashes are taken by ranges of about STEP of them, so that sorting them needs little memory.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    steps = -(-sum(map(len, (*left, *right))) // STEP)
    bounds = np.array([2**64 * i // steps for i in range(1, steps)], np.uint64)
    cuts = [[[0, *np.searchsorted(s, bounds), len(s)] for s in sets] for sets in (left, right)]
    for step in range(steps):
        sides = [[s[c[step] : c[step + 1]] for s, c in zip(sets, cut, strict=True)] for sets, cut in zip((left, right), cuts, strict=True)]
        shared = np.intersect1d(*map(np.concatenate, sides))
        for at in range(0, len(shared), WIDTH):
            part = shared[at : at + WIDTH]
            ones = []
            for sets in sides:
                m = np.zeros((len(sets), len(part)), np.float32)
                for row, s in zip(m, sets, strict=True):
                    s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                    k = np.searchsorted(part, s)
                    row[k[part[k] == s]] = 1
                ones.append(m)
            out += ones[0] @ ones[1].T
    return out


def _spanning(percent: int):
    """Component pairs of a spanning forest of the links between rows of different components: at most one a row."""

    def decide(left: list[tuple], right: list[tuple]) -> tuple[list[int], list[int]]:
        a, b = ([np.frombuffer(r[6], np.uint64) for r in x] for x in (left, right))
        both = _common(a, b)
        na, nb = (np.array([len(s) for s in x], np.float32) for x in (a, b))
        ca, cb = column(left, 5), column(right, 5)
        link = (100 * both.astype(np.float64) >= percent * (na[:, None] + nb[None, :] - both).astype(np.float64)) & (ca[:, None] != cb[None, :])
        u, v = [], []
        new_a, new_b = np.ones(len(left), bool), np.ones(len(right), bool)
        for start in np.flatnonzero(link.any(axis=1)):
            todo = [(True, start)] if new_a[start] else []
            new_a[start] = False
            while todo:
                is_left, at = todo.pop()
                new, own, other = (new_b, ca, cb) if is_left else (new_a, cb, ca)
                found = np.flatnonzero((link[at] if is_left else link[:, at]) & new)
                new[found] = False
                u.extend([own[at]] * len(found))
                v.extend(other[found])
                todo.extend((not is_left, x) for x in found)
        return u, v
    return decide


def _agreed(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (p, d), each once -> those whose signatures agree. A hot pivot's signature is broadcast, or joined where Spark splits it."""
    of_pivots = checkpointed(sigs.join(near(checkpointed(pairs.select(F.col("p").alias("node")).distinct())), "node").select(F.col("node").alias("p"), F.col("sig").alias("sp")))
    with_d = pairs.join(sigs.select(F.col("node").alias("d"), F.col("sig").alias("sd")), "d")
    both = with_d.join(near(of_pivots, BROADCAST_SIGNATURES), "p")
    return checkpointed(both.select("p", "d", "sd", "sp").mapInArrow(freed(_agreeing), "p long, d long").distinct())


def near_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, version, n_shingles, component_id, first: a row for each row of documents, as in near_duplicates and documents_of."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 or more")
    texts = rows_of(documents)
    f = checkpointed(texts.mapInArrow(freed(_features(k)), "doc_id long, version long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"))
    nodes = classes_of(f)
    sigs = checkpointed(of_classes(f, nodes, ["n_shingles", "sig", "bands"]))
    buckets = sigs.select("node", F.explode("bands").alias("bucket")).distinct()
    held = buckets.groupBy("bucket").agg(F.min("node").alias("p"), F.max("node").alias("q"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).where("p <> q")
    pivots = checkpointed(held.groupBy("p", "q", "n", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "p"))
    shared = checkpointed(buckets.join(pivots, "bucket").select("bucket", "node", "p"))
    pairs = _agreed(sigs.select("node", "sig"), shared.where("node <> p").select("p", F.col("node").alias("d")).distinct())
    links = confirmed_links(texts, nodes, pairs, k, percent)
    swept(documents.sparkSession)
    comps = checkpointed(connected_components(links))
    placed = shared.where("node <> p").join(comps, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    groups = checkpointed(open_groups(checkpointed(placed)))
    hopeful = checkpointed(by_blocks(groups, sigs.select("node", F.col("sig").alias("data")), _with_partner).toDF("key", "node"))
    swept(documents.sparkSession)
    if not hopeful.isEmpty():
        groups = checkpointed(groups.join(hopeful, ["key", "node"]).join(sigs.select("node", "n_shingles").distinct(), "node"))
        data = sets_of(texts, nodes, groups.select("node").distinct(), k)
        comps = checkpointed(joined_components(comps, by_blocks(groups, data, _spanning(percent), F.col("n_shingles"))))
    return documents_of(f, nodes, comps)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of documents.

    Links join documents whose sets of k-word shingles (ASCII white space between words, A-Z lower-cased) have
    100 * intersection >= percent * union; component_id is the least doc_id reachable. percent below 80 is refused, as the
    bands are laid out for 80. Defined cases: null, empty and wordless texts have no shingles and are linked with nothing;
    a text of fewer than k words is one shingle; ties need no order; a doc_id that stands on several texts has the links of
    all of them, and each of its rows is returned; a null doc_id is never linked and gives component_id null, kept true; an
    empty table gives no rows; extra columns are ignored.
    """
    out = near_components(documents, k, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of documents, but for the rows whose text is linked, directly or through others, with that of a lesser
    (doc_id, version). A doc_id that stands on several texts loses only the linked ones; equal rows stay or go together."""
    gone_id, version = unused(documents.columns, "gone_id", "gone_version")
    gone = near_components(documents, k, percent).where("NOT first").select(F.col("doc_id").alias(gone_id), F.col("version").alias(version)).distinct()
    same = (F.col("doc_id") == F.col(gone_id)) & (version_of(F.col("text")) == F.col(version))
    return documents.join(checkpointed(gone), same, "left_anti")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
