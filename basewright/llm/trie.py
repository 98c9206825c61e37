"""The prefix trie of conversations, rolled up by pointer jumping.

A node is a sequence of first turns that some conversation begins with. Its key is a digest made of one digest for each of its
(place, role, text), combined by exclusive or: the places make the turns of a sequence distinct, so equal keys mean equal
sequences but for chance (240 bits are combined, 128 kept), and the key of a prefix is a running combination, which needs neither
the turns before it nor a pass for each depth. The parent's key is the node's without its last turn.

1. Turns are numbered by a range sort over all executors, so that a conversation of any length is spread over tasks.
2. Keys: running combinations within CHUNK turns, and over the chunks' totals.
3. Nodes: one aggregation by key. What hangs on a node's members is added up within tasks first.
4. Pointer jumping: each node holds the sums over its descendants nearer than 2**k and a pointer to its ancestor 2**k above.
   A round adds each node's sums to its pointer's node and follows that node's pointer, so a trie of depth d takes
   log2(d) + 1 rounds, each of one aggregation and two joins, whatever its width.
5. The members that end in a node are hashed in order: sorted over all executors, joined to texts of up to PIECE ids, and the
   pieces of a node streamed through one SHA-256, which holds no more than a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.llm.common import checkpointed, freed, numbered, shuffle_partitions, swept, table

GROUP, SHARED, CHUNK, PIECE, HEAD = 20, 4, 256, 50_000, 64
LANES = ["a", "b", "c", "d"]


def turns_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, n_words) of every turn, pos from 1, and (conv_id, n) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, HEAD).alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n_words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]
    rows, _ = numbered(rows, order, shuffle_partitions(conversations.sparkSession))
    rows = rows.select("conv_id", "ordinal", "digest", "n_words")
    sizes = checkpointed(rows.groupBy("conv_id").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")))
    placed = rows.join(sizes.select("conv_id", "first"), "conv_id").select("conv_id", (F.col("ordinal") - F.col("first") + 1).alias("pos"), "digest", "n_words")
    return placed, sizes.select("conv_id", "n")


def rebuilt(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv_id, n) of the conversations in which each begins as the first of its group: its first h turns, fewer if it has
    fewer, then the conversation's own after its first h; h is crc32 of the decimal conv_id modulo `shared`."""
    turns, sizes = turns_of(conversations)
    turns = checkpointed(turns)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("h")
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(heads, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")
    known = checkpointed(known.select("conv_id", "base", "n", "h", taken))
    opening = turns.where(F.col("pos") < shared).withColumnRenamed("conv_id", "base").join(known.where("taken > 0").select("conv_id", "base", "taken"), "base")
    opening = opening.where("pos <= taken").select("conv_id", "pos", "digest", "n_words")
    own = turns.join(known.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_words")
    total = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return opening.unionByName(own), known.select("conv_id", total.alias("n"))


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes]))


#: The key of no turns.
ROOT = hashlib.md5(b"0,0,0,0,0", usedforsecurity=False).hexdigest()


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, digest, n_words) -> conv_id, depth, node, parent, n_words (of the last turn)."""
    mark = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest"), 256)
    own = turns.select("conv_id", "pos", "n_words", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), mark.alias("mark"))
    own = own.select("*", *[F.conv(F.substring("mark", 15 * i + 1, 15), 16, 10).cast("long").alias(x) for i, x in enumerate(LANES)]).drop("mark")
    within = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    run = own.select("conv_id", "pos", "n_words", "chunk", *LANES, *[F.bit_xor(x).over(within).alias(f"r{x}") for x in LANES])
    run = checkpointed(run)
    totals = run.where((F.col("pos") % CHUNK == 0)).select("conv_id", (F.col("chunk") + 1).alias("chunk"), *[F.col(f"r{x}").alias(x) for x in LANES])
    upto = Window.partitionBy("conv_id").orderBy("chunk")  # a row for each CHUNK turns
    before = totals.select("conv_id", "chunk", *[F.bit_xor(x).over(upto).alias(f"b{x}") for x in LANES])
    run = run.join(before, ["conv_id", "chunk"], "left")
    at = [F.col(f"r{x}").bitwiseXOR(F.coalesce(f"b{x}", F.lit(0))) for x in LANES]
    up = [a.bitwiseXOR(F.col(x)) for a, x in zip(at, LANES, strict=True)]
    return run.select("conv_id", F.col("pos").alias("depth"), _key(F.col("pos"), at).alias("node"), _key(F.col("pos") - 1, up).alias("parent"), "n_words")


_PIECES = pa.schema([("node", pa.string()), ("first", pa.int64()), ("ids", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) -> (node, first id, ids joined by commas), PIECE ids in each at most."""
    now, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((now, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def emit() -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [[] for _ in _PIECES]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES, strict=True)], schema=_PIECES)
        out.clear()
        return batch

    for batch in batches:
        for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now or len(ids) == PIECE:
                close()
                now = node
            ids.append(conv_id)
        yield emit()
    close()
    yield emit()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (node, first id) -> (node, sha)."""
    now, sha = None, None
    for batch in batches:
        out = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["node", "sha"])
    last = [(now, sha.hexdigest())] if now is not None else []
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in last], pa.string()) for i in (0, 1)], names=["node", "sha"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends (node, conv_id), each once -> node, sha: of the ids in ascending order, in decimal, joined by commas."""
    n = shuffle_partitions(ends.sparkSession)
    pieces = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(freed(_pieces), "node string, first long, ids string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(freed(_hashed), "node string, sha string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (node, parent, values) -> node and the values summed over its subtree, in rounds that double the distance covered."""
    state = checkpointed(nodes.select("node", F.col("parent").alias("ptr"), *values))
    while True:
        moving = state.where("ptr IS NOT NULL")
        if moving.isEmpty():
            return state.drop("ptr")
        sums = moving.groupBy(F.col("ptr").alias("node")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        hops = moving.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        jumped = state.join(hops, "ptr", "left").select("node", F.col("next").alias("ptr"), *values).join(sums, "node", "left")
        state = checkpointed(jumped.select("node", "ptr", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]))
        moving = sums = hops = jumped = None  # spent
        swept(nodes.sparkSession)


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The trie of conversations given as turns (conv_id, pos, digest, n_words) and sizes (conv_id, n), n turns each, none left out.

    node, parent, conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    at = prefixes(turns).unionByName(sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("n_words")))
    at = checkpointed(at)
    nodes = at.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"))
    nodes = checkpointed(nodes)
    ends = at.join(sizes.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("n"))).select("node", "conv_id")
    children = checkpointed(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = checkpointed(nodes.join(ends_digests(ends), "node", "left"))
    own = nodes.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"))
    sums = rolled_up(own, ["n_leaves", "saved_tokens"])
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(sums, "node")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """The trie of the rebuilt conversations, with the columns of prefix_trie.

    Defined cases: a null role or text is an empty one; null turns come first; ties of turn are ordered by role, then by the text's
    first HEAD characters, then by digest, so that equal rows are turns of their own; rows with a null conv_id are no conversation's
    and are left out; a conversation left without turns is a member of the root alone; an empty table has no nodes, not even a root;
    negative ids are grouped by the remainder that has their sign; long texts take part whole; further columns are ignored.
    """
    return prefix_trie(*rebuilt(conversations, group, shared))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: DuckDB. A prefix is the text of its turns' digests; every ancestor of a node is a prefix of the node's least member.
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
          sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words
          FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
convs AS (SELECT c, c - c % 20 AS base, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x))),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM sizes, tab),
built AS (SELECT convs.c, pos, x, n_words FROM convs JOIN turns ON turns.c = base AND pos <= h
          UNION ALL SELECT c, pos - h + least(h, coalesce(b.n, 0)), x, n_words FROM turns JOIN convs USING (c) LEFT JOIN (SELECT c AS base, n FROM convs) b USING (base) WHERE pos > h),
paths AS (SELECT c, list(x ORDER BY pos) AS xs, list(n_words ORDER BY pos) AS ws FROM built GROUP BY c),
whole AS (SELECT c, coalesce(xs, []) AS xs, coalesce(ws, []) AS ws FROM convs LEFT JOIN paths USING (c)),
steps AS (SELECT c, d, len(xs) AS n, md5(array_to_string(xs[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(xs[1:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS n_words
       FROM (SELECT c, xs, ws, unnest(range(0, len(xs) + 1)) AS d FROM whole)),
nodes AS (SELECT node, d, min(c) AS c, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(n_words) AS own,
          sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM steps GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT a.node, sum(u.own) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves FROM nodes u JOIN steps a ON a.c = u.c AND a.d <= u.d LEFT JOIN kids k ON k.node = u.node GROUP BY a.node)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node
"""
