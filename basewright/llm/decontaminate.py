"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of WINDOW consecutive words; an item of fewer words, but not none, is one window.
A window is a set of positioned shingles of three words (fewer in shorter windows). To hold the window a text must hold all
of them, so in any order of the shingles a prefix of one is necessary. The order is by rarity in the corpus.

1. A counting pass over the texts: how often each benchmark shingle occurs (exact words, added up within tasks). A window
   with a shingle that never occurs goes; of the others the rarest shingle is the prefix.
2. A second pass joins prefix shingles alone. Each occurrence gives a candidate start, kept if position and length bounds
   allow: the window must begin in the text and end in it.
3. Texts with candidates are verified exactly: the words at the start, as many as the window has, must be the window's.

The benchmark's side of a join is broadcast if its strings have at most BROADCAST_BYTES; a larger one is joined by shuffle.

Defined cases: a null or empty text, or one without words, has no words, hits or items; rows with a null doc_id get their own
answers; rows that repeat a doc_id are told apart by a hash of the text, equal rows give equal rows; null or wordless items
have no window; an empty benchmark or table gives no hits or no rows; extra columns of the inputs are ignored here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import ascii_lower, checkpointed, string_bytes, table, unused

WINDOW, SHINGLE = 10, 3
BROADCAST_BYTES = 64 << 20
#: What stands between words in lower-cased text, and in text as it is.
BREAKS, RAW_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")


def word_count(text):
    return F.coalesce(F.size(F.array_remove(F.split(text, RAW_BREAKS), "")), F.lit(0)).cast("long")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window (its words): each distinct window of each item."""
    w = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("window")).distinct()


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if string_bytes(df) <= BROADCAST_BYTES else df


def _shingled(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows (keys, words) -> keys, n (words), pos, w0 ...: a row for each of the k-word shingles, and some with nulls where the words end.

    Filters on the words, posexplode's own on the array's size among them, would be pushed below and split the text again.
    """
    n = F.size("words")
    columns = [(F.slice("words", i + 1, F.greatest(n - i, F.lit(0))) if i else F.col("words")).alias(f"w{i}") for i in range(k)]
    named = rows.select(*keys, n.alias("n"), *columns)
    pairs = named.select(*keys, "n", F.posexplode_outer(F.arrays_zip(*[F.col(f"w{i}") for i in range(k)])).alias("pos", "g"))
    return pairs.select(*keys, "n", "pos", *[f"g.w{i}" for i in range(k)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ROW = ["doc_id", "version"]


def _join_rows(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a and b (ROW and others) joined by row, null ids too; of b's row columns none stay."""
    b = b.withColumnsRenamed({"doc_id": "_b_id", "version": "_b_version"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("_b_id")) & (F.col("version") == F.col("_b_version")), how).drop("_b_id", "_b_version")


def spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, window_id, start, length) of every window occurrence, each once, and (window_id, item_id). version is xxhash64(text)."""
    items = windows_of(benchmark, window)
    key = F.sha2(F.to_json("window"), 256)
    owners = checkpointed(items.select(key.alias("window_id"), "item_id"))
    ids = checkpointed(items.select("window").distinct().select(key.alias("window_id"), "window", F.size("window").alias("length")))
    sizes = [r.k for r in ids.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()]  # SHINGLE rows at most
    if not sizes:
        return owners.sparkSession.createDataFrame([], "doc_id long, version long, window_id string, start int, length int"), owners
    texts = documents.select("doc_id", F.xxhash64("text").alias("version"), "text")
    docs = texts.select(*ROW, words(F.col("text")).alias("words"))
    name = lambda k: F.sha2(F.to_json(F.array(*[f"w{i}" for i in range(k)])), 256).alias("shingle")
    own, seen = {}, []
    for k in sizes:
        rows = ids.where(F.least("length", F.lit(SHINGLE)) == k).select("window_id", "length", F.col("window").alias("words"))
        cols = [f"w{i}" for i in range(k)]
        own[k] = checkpointed(_shingled(rows, ["window_id", "length"], k).dropna(subset=cols).select("window_id", "length", F.col("pos").alias("offset"), name(k), *cols))
        count = _shingled(docs, [], k).join(_near(own[k].select(*cols).distinct()), cols).groupBy(*cols).agg(F.count("*").alias("seen"))
        seen.append(count.select(name(k), "seen"))
    rarity = checkpointed(_union(seen))
    each = _union([own[k].select("window_id", "length", "offset", "shingle") for k in sizes]).join(rarity, "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("p")
    prefix = each.groupBy("window_id", "length").agg(rarest).where("p.seen > 0").select("window_id", "length", "p.shingle", "p.offset")
    prefix = checkpointed(prefix)
    found = []
    for k in sizes:
        cols = [f"w{i}" for i in range(k)]
        wanted = own[k].join(prefix, ["window_id", "length", "shingle", "offset"]).select("window_id", "length", "offset", *cols)
        start = F.col("pos") - F.col("offset")
        at = _shingled(docs, ROW, k).join(_near(wanted), cols).where((start >= 0) & (start + F.col("length") <= F.col("n")))
        found.append(at.select(*ROW, F.struct("window_id", start.alias("start"), "length").alias("c")))
    cand = checkpointed(_union(found).groupBy(*ROW).agg(F.collect_set("c").alias("c")))
    small = string_bytes(cand.select("doc_id", F.to_json("c").alias("c"))) <= BROADCAST_BYTES
    held = _join_rows(texts, F.broadcast(cand) if small else cand, "inner").select(*ROW, "c", words(F.col("text")).alias("words"))
    got = held.select(*ROW, F.inline_outer(F.transform("c", lambda c: F.struct(c["window_id"].alias("window_id"), c["start"].alias("start"), c["length"].alias("length"), F.slice("words", c["start"] + 1, c["length"]).alias("window")))))
    return got.join(_near(ids.select("window_id", "window")), ["window_id", "window"]).select(*ROW, "window_id", "start", "length").distinct(), owners


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of documents."""
    hit, owners = spans(documents, benchmark, window)
    hit = checkpointed(hit)
    at = hit.select(*ROW, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    covered = at.groupBy(*ROW).agg(F.count("*").alias("n_hit"))
    held = hit.select(*ROW, "window_id").distinct().join(owners, "window_id").select(*ROW, F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy(*ROW).agg(F.sort_array(F.collect_list("item")).alias("items"))
    got = _join_rows(covered, held, "left")
    base = documents.select("doc_id", F.xxhash64("text").alias("version"), word_count(F.col("text")).alias("n_words"))
    out = _join_rows(base, got, "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of documents that hold no window; cases as above."""
    hit_id, version = unused(documents.columns, "hit_id", "hit_version")
    hit = checkpointed(spans(documents, benchmark, window)[0].select(*ROW).distinct()).toDF(hit_id, version)
    return documents.join(hit, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(version)), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
