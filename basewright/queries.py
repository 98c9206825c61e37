"""Queries over the driver tables, one for each operator, and the SQL that gives the same rows.

embeddings stand in for intensities: 16 cycles of 4 channels, shifted by 0.6; vec_id is the cluster, and gives its location.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.functions import expr as E
from basewright.operators import blocks, estimate, quality, spatial, train
from basewright.operators.blocks import block_plan
from basewright.operators.state import shared_folder
from basewright.operators.tensor import tensor_of
from basewright.sources import formats
from basewright.sources.files import write_files

#: Clusters of a chunk that a kernel takes at once, and of a tile.
SHIFT, CHUNK, TILE = 0.6, 128, 250
#: Pairs of neighbours whose signals are side by side at once.
EDGES_AT_ONCE = 1_000


def signals(spark: SparkSession, sf_dir: str, shift: float = SHIFT) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cycles = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: F.transform(F.slice("embedding", c * 4 + 1, 4), lambda x: x.cast("double") + F.lit(shift)))
    return t.select(F.lit("t").alias("tile"), F.lit(0).alias("end_id"), F.col("vec_id").cast("int").alias("cluster"), cycles.alias("signal"))


def tiles(spark: SparkSession, sf_dir: str, shift: float = SHIFT) -> DataFrame:
    """The same signals as tiles of TILE clusters, so that there are more with the table."""
    k = F.col("cluster")
    return signals(spark, sf_dir, shift).select(F.concat(F.lit("t"), F.floor(k / TILE).cast("string")).alias("tile"), "end_id", (k % TILE).alias("cluster"), "signal")


def cycles(spark: SparkSession, sf_dir: str, shift: float = SHIFT) -> DataFrame:
    return signals(spark, sf_dir, shift).select("cluster", F.posexplode("signal").alias("cycle", "v"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("t").alias("tile"), v.cast("int").alias("cluster"), ((v * v * 31 + v * 7919) % 499).cast("double").alias("x"), ((v * v * 17 + v * 10473) % 97).cast("double").alias("y"))


#: DuckDB: the same relations as above.
_C = "c AS (SELECT CAST(vec_id AS INTEGER) AS cluster, i AS cycle, list_transform(embedding[i * 4 + 1:i * 4 + 4], lambda x: CAST(x AS DOUBLE) + {shift}) AS v FROM (SELECT *, CAST(unnest(range(16)) AS INTEGER) AS i FROM embeddings))"
_T = "c AS (SELECT 't' || CAST(vec_id // 250 AS VARCHAR) AS tile, CAST(vec_id % 250 AS INTEGER) AS cluster, i AS cycle, list_transform(embedding[i * 4 + 1:i * 4 + 4], lambda x: CAST(x AS DOUBLE) + {shift}) AS v FROM (SELECT *, CAST(unnest(range(16)) AS INTEGER) AS i FROM embeddings))"
T, T0 = _T.format(shift="0.6"), _T.format(shift="0.0")
CH = "CAST(cluster // 128 AS INTEGER)"
C, C0 = _C.format(shift="0.6"), _C.format(shift="0.0")
XY = "xy AS (SELECT CAST(vec_id AS INTEGER) AS cluster, CAST((vec_id * vec_id * 31 + vec_id * 7919) % 499 AS DOUBLE) AS x, CAST((vec_id * vec_id * 17 + vec_id * 10473) % 97 AS DOUBLE) AS y FROM embeddings)"
CALL = "CAST(list_position(v, list_max(v)) - 1 AS INTEGER)"
ABS = "list_transform(v, lambda x: abs(x))"
#: cycles with call, gap, runner-up rank and the read's statistics
S = f"""{C}, s0 AS (SELECT *, {CALL} AS call, list_sort(v, 'DESC')[1] - list_sort(v, 'DESC')[2] AS gap, list_max(v) AS top FROM c),
s1 AS (SELECT *, list_transform(range(1, 5), lambda i: CASE WHEN i = call + 1 THEN -100000.0 ELSE v[i] END) AS rest FROM s0),
s2 AS (SELECT *, CAST(list_position(rest, list_max(rest)) - 1 AS INTEGER) AS second FROM s1),
s AS (SELECT *, second - CASE WHEN second > call THEN 1 ELSE 0 END AS rank, lag(call) OVER o AS prev, avg(gap) OVER r AS tsr, var_pop(gap) OVER r AS var, avg(top) OVER r AS sig, count(*) OVER r AS n
      FROM s2 WINDOW r AS (PARTITION BY cluster), o AS (PARTITION BY cluster ORDER BY cycle))"""
HAT = """h0 AS (SELECT *, least(5 * gap, 19.5) AS sc FROM s), h1 AS (SELECT *, CAST(least(CASE WHEN sc >= 8 THEN floor((sc + 1) / 3 + 2) WHEN sc >= 2 THEN floor(sc / 2 + 1) ELSE floor(sc) END, 7) AS INTEGER) AS bin FROM h0),
h AS (SELECT *, 1 - (sc - [0,1,2,4,6,8,11,14,17][bin + 1]) / ([0,1,2,4,6,8,11,14,17][bin + 2] - [0,1,2,4,6,8,11,14,17][bin + 1]) AS beta FROM h1)"""
W = "list_transform(range(1, 71), lambda i: ((i * 37) % 19 - 9) / 10.0)"
Z = f"""z AS (SELECT *, w[bin + 1] * beta + w[bin + 2] * (1 - beta) + w[10] / (0.02 + sqrt(least(var, 1))) + w[11] * ln(0.02 + least(var, 1)) + w[12] / (0.01 + greatest(least(sig, 3), 0)) + w[13] / (n - cycle)
  + w[14] * CASE WHEN cycle = 0 THEN greatest(least(sig, 30), 3) ELSE 3 END + w[70] + CASE WHEN cycle <= 6 THEN w[cycle + 15] ELSE 0 END + CASE WHEN cycle > 0 THEN w[prev * 12 + call * 3 + rank + 22] ELSE 0 END AS z
  FROM (SELECT *, {W} AS w FROM h)),
q AS (SELECT *, CAST(greatest(floor(10 * log10(1 + exp(least(z, 12)))), 0) AS INTEGER) AS q FROM z)"""
SNAP = f"""{XY}, box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM xy),
g0 AS (SELECT cluster, floor(x - trunc(lx) + 0.5) AS a, floor(y - trunc(ly) + 0.5) AS b, floor(hx - trunc(lx) + 0.5) + 1 AS ea, floor(hy - trunc(ly) + 0.5) + 2 AS eb FROM xy, box),
g AS (SELECT cluster, CAST(CASE WHEN ea < eb THEN b ELSE a END AS INTEGER) AS gx, CAST(CASE WHEN ea < eb THEN a ELSE b END AS INTEGER) AS gy, CAST(greatest(ea, eb) AS INTEGER) AS extent FROM g0)"""

R = 6
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def rnd(c, digits: int = R):
    return F.round(c, digits)


@query(f"WITH {C} SELECT cluster, cycle, CAST(ch AS INTEGER) AS ch, round(v[ch + 1], 6) AS v FROM (SELECT *, unnest(range(4)) AS ch FROM c)")
def tensor_explode(spark, d):
    return cycles(spark, d).select("cluster", "cycle", F.posexplode("v").alias("ch", "v")).withColumn("v", rnd("v"))


@query(f"WITH {C} SELECT cluster, CAST(cycle - 4 AS INTEGER) AS cycle, round(v[1], 6) AS v0 FROM c WHERE cycle BETWEEN 4 AND 9")
def cycle_slice(spark, d):
    return signals(spark, d).select("cluster", F.posexplode(F.slice("signal", 5, 6)).alias("cycle", "v")).select("cluster", "cycle", rnd(F.col("v")[0]).alias("v0"))


@query(f"WITH {C0} SELECT cluster, cycle, substr('ACGT', {CALL} + 1, 1) AS base FROM c")
def call_base(spark, d):
    return cycles(spark, d, 0.0).select("cluster", "cycle", E.base(E.call(F.col("v"))).alias("base"))


@query(f"WITH {C0} SELECT cluster, cycle, CASE WHEN list_max(v) > 0 THEN {CALL} ELSE 0 END AS idx, round(greatest(list_max(v) / greatest(list_sum({ABS}), 1e-6), 0), 6) AS purity FROM c")
def purity_argmax(spark, d):
    return cycles(spark, d, 0.0).select("cluster", "cycle", E.positive_call(F.col("v")).alias("idx"), rnd(E.purity(F.col("v"))).alias("purity"))


@query(f"WITH {S} SELECT cluster, cycle, second, rank, round(gap, 6) AS gap FROM s")
def runner_up_gap(spark, d):
    return quality.scored_cycles(signals(spark, d), ["cluster"]).select("cluster", "cycle", "second", "rank", rnd("gap").alias("gap"))


@query(f"WITH {S} SELECT cluster, round(avg(gap), 6) AS tsr, round(var_pop(gap), 6) AS tsr2, round(avg(top), 6) AS sig FROM s GROUP BY cluster")
def read_stats(spark, d):
    return quality.with_scores(signals(spark, d), ["cluster"]).select("cluster", rnd("tsr").alias("tsr"), rnd("var").alias("tsr2"), rnd("sig").alias("sig"))


@query(f"WITH {C} SELECT cluster, string_agg(substr('ACGT', {CALL} + 1, 1), '' ORDER BY cycle) AS seq FROM c GROUP BY cluster")
def read_string(spark, d):
    return signals(spark, d).select("cluster", F.array_join(F.transform("signal", lambda v: E.base(E.call(v))), "").alias("seq"))


def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clusters and their lines as cycles, up to 7: a tensor that grows with the tables. One shuffle, by order, serves both groupings."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    v = F.array(*[F.round(x, 10) for x in (F.avg("l_quantity") / 50, F.avg("l_extendedprice") / 100_000, F.avg("l_discount") * 10, F.avg("l_tax") * 12)])
    lines = t.groupBy("l_orderkey", "l_linenumber").agg(v.alias("v"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "v"))).alias("r"))
    return rows.select(F.col("l_orderkey").alias("cluster"), F.col("r.v").alias("signal"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, [round(avg(l_quantity) / 50, 10), round(avg(l_extendedprice) / 100000, 10), round(avg(l_discount) * 10, 10), round(avg(l_tax) * 12, 10)] AS v FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey AS cluster, string_agg(substr('ACGT', CAST(list_position(v, list_max(v)) AS INTEGER), 1), '' ORDER BY l_linenumber) AS seq FROM l GROUP BY l_orderkey""")
def line_reads(spark, d):
    rows = quality.with_scores(line_signals(spark, d), ["cluster"])
    return rows.select("cluster", F.array_join(F.transform("cycles", lambda x: E.base(x["call"])), "").alias("seq"))


@query(f"WITH {S}, {HAT} SELECT cluster, cycle, bin, round(beta, 6) AS beta FROM h")
def hat_basis(spark, d):
    s = F.least(5 * E.gap(F.col("v")), F.lit(19.5))
    return cycles(spark, d).select("cluster", "cycle", E.hat_bin(s).alias("bin"), rnd(E.hat_beta(s, E.hat_bin(s))).alias("beta"))


def _scored(spark, d):
    w = F.array(*[F.lit(x) for x in quality.synthetic_weights()])
    return quality.scored_cycles(signals(spark, d), ["cluster"]).withColumn("z", quality.log_odds(w)).withColumn("q", E.phred(F.col("z")))


@query(f"WITH {S}, {HAT}, {Z} SELECT cluster, cycle, round(z, 6) AS z FROM q")
def feature_vector(spark, d):
    return _scored(spark, d).select("cluster", "cycle", rnd("z").alias("z"))


@query(f"WITH {S}, {HAT}, {Z} SELECT cluster, cycle, q FROM q")
def phred(spark, d):
    return quality.phreds(signals(spark, d), ["cluster"], quality.synthetic_weights())


@query(f"WITH {S}, {HAT}, {Z} SELECT q, count(*) AS n FROM q GROUP BY q")
def quality_histogram(spark, d):
    return quality.phreds(signals(spark, d), [], quality.synthetic_weights()).groupBy("q").agg(F.count("*").alias("n"))


@query(f"WITH {S}, {HAT}, {Z} SELECT cluster, '@Cluster_t_' || CAST(cluster + 1 AS VARCHAR) || chr(10) || string_agg(substr('ACGT', call + 1, 1), '' ORDER BY cycle) || chr(10) || '+' || chr(10) || string_agg(chr(q + 33), '' ORDER BY cycle) || chr(10) AS record FROM q GROUP BY cluster")
def fastq_record(spark, d):
    return quality.fastq(quality.reads(signals(spark, d), ["tile", "cluster"], quality.synthetic_weights())).select("cluster", "record")


@query(f"WITH {C} SELECT cluster, string_agg(chr(21 + 33), '' ORDER BY cycle) AS qual FROM c GROUP BY cluster")
def constant_quality(spark, d):
    return quality.reads(signals(spark, d), ["cluster"], quality.synthetic_weights(), constant=True).select("cluster", "qual")


@query(f"WITH {C0} SELECT cluster, cycle, CAST(ch AS INTEGER) AS ch, CAST(greatest(trunc(least(v[ch + 1] * 4000, 32767) + 0.5), -32768) AS INTEGER) AS q FROM (SELECT *, unnest(range(4)) AS ch FROM c)")
def cif_quantise(spark, d):
    return cycles(spark, d, 0.0).select("cluster", "cycle", F.posexplode("v").alias("ch", "x")).select("cluster", "cycle", "ch", E.quantise(F.col("x"), 4000.0).alias("q"))


@query(f"WITH {C} SELECT count(*) AS n, sum(CASE WHEN abs(x) > 10 THEN 1 ELSE 0 END) < 0.5 * count(*) AS multiscale FROM (SELECT unnest(v) AS x FROM c)")
def autoscale_flag(spark, d):
    x = cycles(spark, d).select(F.explode("v").alias("x"))
    big = F.sum(F.when(F.abs("x") > 10, 1).otherwise(0))
    return x.agg(F.count("*").alias("n"), (big < 0.5 * F.count("*")).alias("multiscale"))


@query("""WITH p AS (SELECT cycles, CAST(ceil(cycles / 14.0) AS INTEGER) AS nb FROM (SELECT DISTINCT CAST(n_chars % 150 + 1 AS INTEGER) AS cycles FROM documents)), b AS (SELECT *, unnest(range(nb)) AS block FROM p),
l AS (SELECT *, cycles // nb + CASE WHEN block < cycles % nb THEN 1 ELSE 0 END AS len FROM b), s AS (SELECT *, sum(len) OVER (PARTITION BY cycles ORDER BY block) - len AS start FROM l)
SELECT CAST(cycles AS INTEGER) AS cycles, CAST(block AS INTEGER) AS block, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, CAST(greatest(start - 6, 0) AS INTEGER) AS buf_start, CAST(least(start + len + 6, cycles) - greatest(start - 6, 0) AS INTEGER) AS buf_len FROM s""")
def cycle_blocks(spark, d):
    """The blocks of runs of as many cycles as documents have characters, modulo 150."""
    return blocks.cycle_blocks(spark.read.parquet(f"{d}/documents.parquet").select((F.col("n_chars") % 150 + 1).cast("int").alias("cycles")).distinct())


@query("WITH t AS (SELECT count(*) AS n FROM embeddings) SELECT CAST(k AS INTEGER) AS chunk, count(*) AS clusters FROM (SELECT (vec_id >= floor(n / 3.0 * 1 + 0.5))::INT + (vec_id >= floor(n / 3.0 * 2 + 0.5))::INT AS k FROM embeddings, t) GROUP BY k")
def chunk_bounds(spark, d):
    s = signals(spark, d)
    total = s.agg(F.count("*").alias("total"))
    return s.join(F.broadcast(total)).groupBy(blocks.chunk_of(F.col("cluster"), F.col("total"), 3).alias("chunk")).agg(F.count("*").alias("clusters"))


# ---- estimation: the engine's kernels on the table as one chunk, with parameters fixed here and in the SQL

#: Mixing and background, and the share of the own, the last and the next cycle, of the light before and of a constant.
COLOR = [[1.0, 0.4, 0.0, 0.0, 0.05], [0.5, 1.0, 0.0, 0.0, 0.04], [0.0, 0.0, 1.0, 0.3, 0.03], [0.0, 0.0, 0.2, 1.0, 0.02]]
OWN, LAST, NEXT, BEFORE, CONST = 0.9, 0.06, 0.04, 0.01, 0.02
CYCLES = 16


def _band() -> np.ndarray:
    return OWN * np.eye(CYCLES) + LAST * np.eye(CYCLES, k=-1) + NEXT * np.eye(CYCLES, k=1)


def _chunk(x: np.ndarray) -> estimate.Chunk:
    """A chunk with the fixed parameters, and the raw signals' calls."""
    plan, band = block_plan(x.shape[1]), _band()
    phase = [np.hstack([band[s : s + n, lo : lo + size], np.full((n, 1), BEFORE), np.full((n, 1), CONST)]) for _, s, n, lo, size in plan]
    chunk = estimate.Chunk(x, estimate.Params([np.array(COLOR) for _ in plan], phase))
    chunk.calls = estimate.calls_of(x)
    return chunk


def _on_chunk(spark: SparkSession, d: str, f, schema: str, chunk: bool = False) -> DataFrame:
    """f(numpy signals, clusters) of each CHUNK clusters, as rows; with their chunk's number if it is asked for."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster")
        out = f(tensor_of(rows.column("signal")), rows.column("cluster").to_numpy())
        out = out.assign(chunk=key[0].as_py()) if chunk else out
        return pa.Table.from_pandas(out.astype({c: np.int32 for c in out if out[c].dtype == np.int64}), preserve_index=False)

    groups = signals(spark, d).groupBy(F.floor(F.col("cluster") / CHUNK).cast("int").alias("chunk"))
    return groups.applyInArrow(run, schema + ", chunk int" * chunk)


def _long(values: np.ndarray, **names) -> pd.DataFrame:
    """An array as rows: names give the labels of each axis, in order; the last column is v, rounded."""
    axes = np.meshgrid(*names.values(), indexing="ij")
    return pd.DataFrame({n: a.ravel() for n, a in zip(names, axes, strict=True)} | {"v": np.round(values.ravel(), R) + 0.0})


def _in_blocks(chunk: estimate.Chunk, f) -> np.ndarray:
    """n x cycles x 4 from f(block)."""
    return np.concatenate([f(b) for b in range(len(chunk.plan))], axis=1)


_N16, _N4 = range(CYCLES), range(4)
_CC = "[" + ", ".join(f"[{', '.join(map(str, r[:4]))}]" for r in COLOR) + "]"
_BG = "[" + ", ".join(str(r[4]) for r in COLOR) + "]"
_H = f"{C}, u AS (SELECT *, CASE WHEN list_max(v) > 0 THEN {CALL} ELSE 0 END AS call FROM c)"
#: sources after phasing (g: 4 bases a cycle), predicted signals (h), previous light by block (pv), signals less constants (y), and less all but the background (yb)
_M = f"""{_H}, k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS k), g0 AS (SELECT a.cluster, a.cycle, k, sum(CASE WHEN b.call <> k THEN 0 WHEN b.cycle = a.cycle THEN {OWN} WHEN b.cycle = a.cycle - 1 THEN {LAST} ELSE {NEXT} END) AS g
  FROM u a JOIN u b ON a.cluster = b.cluster AND abs(a.cycle - b.cycle) <= 1, k GROUP BY a.cluster, a.cycle, k),
g AS (SELECT cluster, cycle, list(g ORDER BY k) AS g FROM g0 GROUP BY cluster, cycle),
h AS (SELECT cluster, cycle, list_transform({_CC}, lambda r: r[1] * g[1] + r[2] * g[2] + r[3] * g[3] + r[4] * g[4]) AS h FROM g),
pv AS (SELECT cluster, 0 AS block, [0.0, 0.0, 0.0, 0.0] AS p FROM u WHERE cycle = 0 UNION ALL SELECT cluster, 1, list_transform(range(1, 5), lambda i: (a[i] + b[i]) / 5) FROM (SELECT cluster, max(v) FILTER (cycle = 0) AS a, max(v) FILTER (cycle = 1) AS b FROM u GROUP BY cluster)),
yb AS (SELECT u.cluster, u.cycle, u.cycle // 8 AS block, u.call, u.v, p, list_transform(range(1, 5), lambda i: u.v[i] - {BEFORE} * p[i] - {CONST}) AS yb FROM u JOIN pv ON pv.cluster = u.cluster AND pv.block = u.cycle // 8),
y AS (SELECT *, list_transform(range(1, 5), lambda i: yb[i] - {_BG}[i]) AS y FROM yb)"""
_OUT = "CAST(unnest(range(4)) AS INTEGER)"


@query(f"WITH {_M} SELECT cluster, CAST(block AS INTEGER) AS block, ch, round(p[ch + 1], 6) AS v FROM (SELECT *, {_OUT} AS ch FROM pv)")
def previous_mean(spark, d):
    f = lambda x, c: _long(np.stack(_chunk(x).previous, axis=1), cluster=c, block=range(2), ch=_N4)
    return _on_chunk(spark, d, f, "cluster int, block int, ch int, v double")


@query(f"WITH {_H} SELECT cluster, cycle, ch, CASE WHEN ch = call THEN 1.0 ELSE 0.0 END AS v FROM (SELECT *, {_OUT} AS ch FROM u)")
def one_hot_source(spark, d):
    def f(x, c):
        chunk = _chunk(x)
        return _long(_in_blocks(chunk, lambda b: chunk.source(b)[:, 8 * b - chunk.plan[b][3] :][:, :8]), cluster=c, cycle=_N16, ch=_N4)
    return _on_chunk(spark, d, f, "cluster int, cycle int, ch int, v double")


@query(f"WITH {_M} SELECT cluster, cycle, ch, round(h[ch + 1], 6) AS v FROM (SELECT *, {_OUT} AS ch FROM h)")
def predicted_signal(spark, d):
    def f(x, c):
        chunk = _chunk(x)
        return _long(_in_blocks(chunk, chunk.predicted), cluster=c, cycle=_N16, ch=_N4)
    return _on_chunk(spark, d, f, "cluster int, cycle int, ch int, v double")


@query(f"WITH {_M} SELECT cluster, cycle, ch, round(y[ch + 1], 6) AS v FROM (SELECT *, {_OUT} AS ch FROM y)")
def minus_constant(spark, d):
    def f(x, c):
        chunk = _chunk(x)
        return _long(_in_blocks(chunk, lambda b: chunk.own(b) - chunk.constants(b, True)), cluster=c, cycle=_N16, ch=_N4)
    return _on_chunk(spark, d, f, "cluster int, cycle int, ch int, v double")


_K = "k4 AS (SELECT * FROM (VALUES (0, [3300.0, 3300.0, 0.0, 0.0]), (1, [600.0, 2800.0, 0.0, 0.0]), (2, [0.0, 0.0, 2800.0, 2600.0]), (3, [0.0, 0.0, 0.0, 3300.0])) AS t(k, c))"
_F = f"{C}, f0 AS (SELECT cluster, {CH} AS chunk, v, sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS norm FROM c WHERE cycle = 0), f AS (SELECT * EXCLUDE (mean) FROM (SELECT *, avg(norm) OVER (PARTITION BY chunk) AS mean FROM f0) WHERE norm > mean / 2)"
_A = f"""{_F}, {_K}, cs AS (SELECT cluster, chunk, v, norm, list((v[1]*c[1]+v[2]*c[2]+v[3]*c[3]+v[4]*c[4]) / norm / sqrt(c[1]*c[1]+c[2]*c[2]+c[3]*c[3]+c[4]*c[4]) ORDER BY k) AS cos FROM f, k4 GROUP BY cluster, chunk, v, norm),
a AS (SELECT *, CASE WHEN list_max(cos) > 0 THEN CAST(list_position(cos, list_max(cos)) - 1 AS INTEGER) ELSE 0 END AS cls FROM cs),
ck AS (SELECT DISTINCT chunk FROM a),
c1 AS (SELECT ck.chunk, k, coalesce(m, c) AS c FROM k4 CROSS JOIN ck LEFT JOIN (SELECT chunk, cls, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS m FROM a GROUP BY chunk, cls) x ON cls = k AND x.chunk = ck.chunk)"""


def _trim(before: str, after: str, limit: float) -> str:
    cos = "(v[1]*c[1]+v[2]*c[2]+v[3]*c[3]+v[4]*c[4]) / norm / sqrt(c[1]*c[1]+c[2]*c[2]+c[3]*c[3]+c[4]*c[4])"
    return f"""{after} AS (SELECT b.chunk, b.k, CASE WHEN n > 2 THEN list_transform(range(1, 5), lambda i: b.c[i] + 1.25 * (m[i] - b.c[i])) ELSE b.c END AS c FROM {before} b
 LEFT JOIN (SELECT a.chunk, cls, count(*) AS n, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS m FROM a JOIN {before} o ON o.k = cls AND o.chunk = a.chunk WHERE 1 - {cos} < {limit} GROUP BY a.chunk, cls) x ON cls = b.k AND x.chunk = b.chunk)"""


@query(f"WITH {_F} SELECT cluster, round(norm, 6) AS norm FROM f")
def color_norm_filter(spark, d):
    f = lambda x, c: pd.DataFrame({"cluster": c, "norm": np.round(np.linalg.norm(x[:, 0], axis=1), R)})[estimate.bright(x[:, 0])]
    return _on_chunk(spark, d, f, "cluster int, norm double")


@query(f"WITH {_A} SELECT cluster, cls FROM a")
def color_assign(spark, d):
    def f(x, c):
        on = estimate.bright(x[:, 0])
        return pd.DataFrame({"cluster": c[on], "cls": estimate.nearest(x[on, 0], estimate.CENTROIDS)[0]})
    return _on_chunk(spark, d, f, "cluster int, cls int")


def _centroids(x: np.ndarray, trim: bool) -> np.ndarray:
    x = x[estimate.bright(x[:, 0]), 0]
    k, _ = estimate.nearest(x, estimate.CENTROIDS)
    c = estimate.centroids_of(x, k, estimate.CENTROIDS)
    return np.array([estimate.trimmed(x[k == j], c[j]) for j in range(4)]) if trim else c


@query(f"WITH {_A} SELECT chunk, CAST(k AS INTEGER) AS cls, ch, round(c[ch + 1], 6) AS v FROM (SELECT *, {_OUT} AS ch FROM c1)")
def color_means(spark, d):
    return _on_chunk(spark, d, lambda x, c: _long(_centroids(x, False), cls=_N4, ch=_N4), "cls int, ch int, v double", True)


_TR = f"{_A}, {_trim('c1', 'c2', 0.2)}, {_trim('c2', 'c3', 0.12)}"


@query(f"WITH {_TR} SELECT chunk, CAST(k AS INTEGER) AS cls, ch, round(c[ch + 1], 6) AS v FROM (SELECT *, {_OUT} AS ch FROM c3)")
def color_trim(spark, d):
    return _on_chunk(spark, d, lambda x, c: _long(_centroids(x, True), cls=_N4, ch=_N4), "cls int, ch int, v double", True)


@query(f"""WITH {_TR}, bg AS (SELECT chunk, ch, avg(c[ch + 1]) AS b FROM c3, (SELECT {_OUT} AS ch) WHERE (ch < 2) = (k >= 2) GROUP BY chunk, ch)
SELECT chunk, ch, CAST(k AS INTEGER) AS base, round(c[ch + 1] - b, 6) AS v FROM c3 JOIN bg USING (chunk) UNION ALL SELECT chunk, ch, 4, round(b, 6) FROM bg""")
def color_background(spark, d):
    return _on_chunk(spark, d, lambda x, c: _long(estimate.with_background(_centroids(x, True)), ch=_N4, base=range(5)), "ch int, base int, v double", True)


_TW = 0.05


@query(f"""WITH {_M}, x AS (SELECT {CH} AS chunk, block, list_concat(g, [1.0]) AS r, yb AS y FROM yb JOIN g USING (cluster, cycle) WHERE cycle % 8 = cluster % 8),
t AS (SELECT chunk, block, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(CASE WHEN j < 5 THEN r[i + 1] * r[least(j, 4) + 1] ELSE r[i + 1] * y[greatest(j, 5) - 4] END) AS s, {_TW} * count(*) AS tw FROM x, range(5) AS a(i), range(9) AS b(j) GROUP BY ALL)
SELECT chunk, CAST(block AS INTEGER) AS block, i, j, round(s + tw * CASE WHEN j = i THEN CASE WHEN i = 4 THEN 3 ELSE 1 END WHEN j < 5 THEN 0 WHEN i = 4 THEN {_BG}[greatest(j, 5) - 4] ELSE {_CC}[greatest(j, 5) - 4][least(i, 3) + 1] END, 6) AS v FROM t""")
def gram_color(spark, d):
    """The normal equations of both blocks' color fit, right sides (4 channels) after the 5 x 5 matrix."""
    def f(x, c):
        chunk = _chunk(x)
        return _long(np.array([np.hstack(chunk.color_normal(b, _TW, 2)) for b in range(2)]), block=range(2), i=range(5), j=range(9))
    return _on_chunk(spark, d, f, "block int, i int, j int, v double", True)


@query(f"""WITH {_M}, x AS (SELECT cluster, block, any_value(p)[cluster % 4 + 1] AS pv, list(yb.v[cluster % 4 + 1] - {_BG}[cluster % 4 + 1] ORDER BY cycle) AS y FROM yb GROUP BY cluster, block),
cl AS (SELECT cluster, list({_CC}[cluster % 4 + 1][call + 1] ORDER BY cycle) AS s FROM u GROUP BY cluster),
r AS (SELECT {CH} AS chunk, block, list_concat(s[CASE WHEN block = 0 THEN 1 ELSE 3 END:CASE WHEN block = 0 THEN 14 ELSE 16 END], [pv, 1.0]) AS r, y FROM x JOIN cl USING (cluster)),
t AS (SELECT chunk, block, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(CASE WHEN j < 16 THEN r[i + 1] * r[least(j, 15) + 1] ELSE r[i + 1] * y[greatest(j, 16) - 15] END) AS s, {_TW} * count(*) AS tw FROM r, range(16) AS a(i), range(24) AS b(j) GROUP BY ALL)
SELECT chunk, CAST(block AS INTEGER) AS block, i, j, round(s + tw * CASE WHEN j = i THEN CASE WHEN i = 15 THEN 3 ELSE 1 END WHEN j < 16 THEN 0 WHEN i = 14 THEN {BEFORE} WHEN i = 15 THEN {CONST}
  ELSE CASE i + 2 * block - (j - 16 + 8 * block) WHEN 0 THEN {OWN} WHEN -1 THEN {LAST} WHEN 1 THEN {NEXT} ELSE 0 END END, 6) AS v FROM t""")
def gram_phasing(spark, d):
    """The normal equations of both blocks' phasing fit, right sides (8 cycles) after the 16 x 16 matrix; the fixed color has a scale of 1."""
    def f(x, c):
        chunk = _chunk(x)
        return _long(np.array([np.hstack(chunk.phase_normal(b, _TW, 2)) for b in range(2)]), block=range(2), i=range(16), j=range(24))
    return _on_chunk(spark, d, f, "block int, i int, j int, v double", True)


_L = f"""{_M}, e AS (SELECT cluster, block, list_sum(list(h[1] * y[1] + h[2] * y[2] + h[3] * y[3] + h[4] * y[4])) AS hy, list_sum(list(h[1] * h[1] + h[2] * h[2] + h[3] * h[3] + h[4] * h[4])) AS hh FROM y JOIN h USING (cluster, cycle) GROUP BY cluster, block),
sc AS (SELECT cluster, block, greatest(0.2, least(5, hy / hh)) AS scale FROM e)"""


def _weighed(x: np.ndarray) -> estimate.Chunk:
    chunk = _chunk(x)
    for b in range(2):
        chunk.weigh(b, 30.0)
    return chunk


@query(f"WITH {_L} SELECT cluster, CAST(block AS INTEGER) AS block, round(scale / avg(scale) OVER (PARTITION BY block, {CH}), 6) AS v FROM sc")
def lambda_scale(spark, d):
    return _on_chunk(spark, d, lambda x, c: _long(_weighed(x).lam.T, cluster=c, block=range(2)), "cluster int, block int, v double")


@query(f"WITH {_L} SELECT cluster, CAST(block AS INTEGER) AS block, round(exp(-30 * sum((scale * h[1] - y[1]) ** 2 + (scale * h[2] - y[2]) ** 2 + (scale * h[3] - y[3]) ** 2 + (scale * h[4] - y[4]) ** 2) / 32), 6) AS v FROM y JOIN h USING (cluster, cycle) JOIN sc USING (cluster, block) GROUP BY cluster, block")
def robust_weight(spark, d):
    return _on_chunk(spark, d, lambda x, c: _long(_weighed(x).w.T, cluster=c, block=range(2)), "cluster int, block int, v double")


@query(f"""WITH {_H}, p AS (SELECT CAST(a.cluster // 128 AS INTEGER) AS chunk, a.call AS prev, b.call AS call, list_max(b.v) AS top FROM u a JOIN u b ON a.cluster = b.cluster AND a.cycle = 0 AND b.cycle = 1), m AS (SELECT chunk, avg(top) AS mean FROM p GROUP BY chunk),
s AS (SELECT chunk, prev, call, sum(top) AS s, count(*) AS n FROM p JOIN m USING (chunk) WHERE top > mean / 2 AND top < 2 * mean GROUP BY chunk, prev, call)
SELECT m.chunk, CAST(a.i AS INTEGER) AS prev, CAST(b.i AS INTEGER) AS call, round(0.1 + 0.9 * (mean + coalesce(s, 0)) / (1 + coalesce(n, 0)), 6) AS v FROM range(4) AS a(i), range(4) AS b(i), m LEFT JOIN s ON prev = a.i AND call = b.i AND s.chunk = m.chunk""")
def neighbour_factor(spark, d):
    f = lambda x, c: _long(estimate.neighbour_ratios(x, estimate.calls_of(x), np.ones((2, len(x)))), prev=_N4, call=_N4)
    return _on_chunk(spark, d, f, "prev int, call int, v double", True)


def _sql_matrix(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in m) + "]"


def _deconvolved(side: int) -> str:
    """SQL: signals less constants, times the inverses of mixing and of the band over each block's reach."""
    spans = [(0, 8) if side < 0 else (0, 14) if side > 0 else (0, 8), (8, 16) if side < 0 else (2, 16)]
    full = np.zeros((CYCLES, CYCLES))
    for b, (lo, hi) in enumerate(spans):
        full[8 * b : 8 * b + 8, lo:hi] = np.linalg.inv(_band()[lo:hi, lo:hi])[8 * b - lo : 8 * b - lo + 8]
    mix = _sql_matrix(np.linalg.inv(np.array(COLOR)[:, :4]))
    return f"""WITH {_M}, z AS (SELECT cluster, cycle, list_transform({mix}, lambda r: r[1] * y[1] + r[2] * y[2] + r[3] * y[3] + r[4] * y[4]) AS z FROM y),
    l AS (SELECT cluster, t, ch, list_sum(list({_sql_matrix(full)}[t + 1][cycle + 1] * z[ch + 1] ORDER BY cycle)) AS v FROM z, (SELECT CAST(unnest(range({CYCLES})) AS INTEGER) AS t), (SELECT {_OUT} AS ch) GROUP BY cluster, t, ch)
    SELECT cluster, t AS cycle, ch, round(v, 6) AS v FROM l"""


def _deconvolve(side: int):
    def f(x, c):
        chunk = _chunk(x)
        return _long(_in_blocks(chunk, lambda b: chunk.deconvolve(b, side)), cluster=c, cycle=_N16, ch=_N4)
    return lambda spark, d: _on_chunk(spark, d, f, "cluster int, cycle int, ch int, v double")


for _name, _side in (("deconvolve_own", -1), ("deconvolve_left", 0), ("deconvolve_both", 1)):
    QUERIES[_name], SQL[_name] = _deconvolve(_side), _deconvolved(_side)


@query("""WITH RECURSIVE a(t, r) AS (SELECT 0, list_transform(range(14), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  UNION ALL SELECT t + 1, list_transform(range(1, 15), lambda i: 0.997 * (0.002 * r[i] + 0.996 * CASE WHEN i > 1 THEN r[i - 1] ELSE 0 END + 0.002 * CASE WHEN i > 2 THEN r[i - 2] ELSE 0 END)) FROM a WHERE t < 7),
q AS (SELECT r[9] / r[8] / 8 AS pre, r[7] / r[8] / 8 AS pha, (list_sum(r) + 7) / 8 AS dim, list_concat(r[3:14], [0.0, 0.0]) AS up FROM a WHERE t = 7),
b(t, r) AS (SELECT -1, up FROM q
  UNION ALL SELECT t + 1, list_transform(range(1, 15), lambda i: dim * (pha * r[i] + (1 - pha - pre) * CASE WHEN i > 1 THEN r[i - 1] ELSE 0 END + pre * CASE WHEN i > 2 THEN r[i - 2] ELSE 0 END)) FROM b, q WHERE t < 7),
p AS (SELECT 0 AS block, t, list_concat(r, [CASE WHEN t = 0 THEN 0 ELSE 0.001 END, 0.0]) AS r FROM a UNION ALL SELECT 1, t, list_concat(r, [0.001 * 7 / 8, 0.0]) FROM b WHERE t >= 0)
SELECT chunk, CAST(block AS INTEGER) AS block, CAST(t AS INTEGER) AS t, CAST(s AS INTEGER) AS s, round(r[s + 1], 6) AS v FROM p, range(16) AS x(s), (SELECT DISTINCT CAST(vec_id // 128 AS INTEGER) AS chunk FROM embeddings)""")
def phasing_init(spark, d):
    """The phasing bands that each chunk would start from: 14 cycles, the light before, and a constant a row."""
    f = lambda x, c: _long(np.array(estimate.phase_seed(block_plan(x.shape[1]))), block=range(2), t=range(8), s=range(16))
    return _on_chunk(spark, d, f, "block int, t int, s int, v double", True)


@query("""WITH RECURSIVE k AS (SELECT chunk, fast FROM (SELECT DISTINCT CAST(vec_id // 64 AS INTEGER) AS chunk FROM embeddings), (VALUES (0), (1)) AS b(fast)),
n AS (SELECT *, CASE WHEN chunk = 0 THEN 5 - fast WHEN chunk < 2 OR chunk < 4 AND fast = 0 THEN 2 ELSE 1 END AS n FROM k),
r AS (SELECT chunk, fast, n, 0 AS i, CASE WHEN chunk = 0 THEN 0.05 ELSE 0.01 END::DOUBLE AS stein, CASE WHEN chunk = 0 THEN 30.0 ELSE 40.0 END::DOUBLE AS wl FROM n WHERE NOT (fast = 1 AND n = 1 AND chunk % 4 <> 0)
  UNION ALL SELECT chunk, fast, n, i + 1, CASE WHEN stein > 0.02 THEN stein - 0.0162 ELSE stein / 1.5 END, 10.0 * (i + 4) FROM r WHERE i + 1 < n)
SELECT chunk, CAST(fast AS INTEGER) AS fast, CAST(i AS INTEGER) AS i, round(stein, 6) AS stein, wl, CAST(CASE WHEN n > 1 THEN n - i + 1 - CASE WHEN i > 0 THEN 2 ELSE 0 END ELSE 0 END AS INTEGER) AS extra FROM r""")
def round_schedule(spark, d):
    """The rounds of each chunk of 64 clusters, slow and fast."""
    def f(batches):
        for b in batches:
            rows = [(k, fast, i, round(r.stein, R), float(r.wl), int(r.extra)) for k in b["chunk"] for fast in (0, 1) for i, r in enumerate(estimate.schedule(k, 3 if fast else 4, bool(fast)))]
            yield pd.DataFrame(rows, columns=["chunk", "fast", "i", "stein", "wl", "extra"])
    chunks = signals(spark, d).select(F.floor(F.col("cluster") / 64).cast("int").alias("chunk")).distinct()
    return chunks.mapInPandas(f, "chunk int, fast int, i int, stein double, wl double, extra int")


@query(f"WITH {SNAP} SELECT cluster, gx, gy, extent FROM g")
def grid_snap(spark, d):
    return spatial.grid_snap(locations(spark, d)).select("cluster", "gx", "gy", "extent")


@query(f"""WITH {SNAP}, n AS (SELECT *, greatest(CAST(ceil(extent / 250.0) AS INTEGER), 1) AS n FROM g), x AS (SELECT *, unnest(range(n)) AS stripe FROM n),
y AS (SELECT *, 250 * stripe - 15 AS lo, CASE WHEN stripe = n - 1 THEN 1000000000 ELSE 250 * stripe + 235 END AS hi FROM x)
SELECT cluster, CAST(stripe AS INTEGER) AS stripe, gx >= lo AND gx < hi AS in_core FROM y WHERE gx >= lo - 15 AND gx < hi + 15""")
def stripe_halo(spark, d):
    return blocks.stripes(spatial.grid_snap(locations(spark, d)), F.col("extent")).select("cluster", "stripe", "in_core")


@query(f"WITH {C}, a AS (SELECT cluster, cycle, list_sort({ABS}, 'DESC') AS s FROM c) SELECT cluster, round(min(s[1] - s[2]) / max(s[1]), 6) AS qd FROM a GROUP BY cluster")
def cluster_quality(spark, d):
    return spatial.cluster_quality(signals(spark, d)).select("cluster", rnd("qd").alias("qd"))


_WD = f"{C}, a AS (SELECT cluster, cycle, list_sort({ABS}) AS s FROM c), w AS (SELECT cycle, count(*) / sum(s[2]) AS width, avg(s[4]) AS top FROM a GROUP BY cycle)"


@query(f"WITH {_WD} SELECT cycle, round(width, 6) AS width, round(top, 6) AS top FROM w")
def cycle_width(spark, d):
    return spatial.cycle_width(signals(spark, d), ["tile"]).select("cycle", rnd("width").alias("width"), rnd("top").alias("top"))


@query(f"WITH {_WD} SELECT round((1.5 * 0.7 - 0.75) * sum(width) * avg(top), 6) AS thr FROM w")
def acc_threshold(spark, d):
    return spatial.threshold(spatial.cycle_width(signals(spark, d), ["tile"]), ["tile"]).select(rnd("thr").alias("thr"))


_NB = f"{SNAP}, nb AS (SELECT a.cluster AS i, b.cluster AS j FROM g a JOIN g b ON a.cluster <> b.cluster AND abs(a.gx - b.gx) <= 4 AND abs(a.gy - b.gy) <= 4)"


def _near(spark, d):
    return spatial.neighbours(spatial.grid_snap(locations(spark, d)).select("tile", "cluster", "gx", "gy"), ["tile"])


@query(f"WITH {_NB} SELECT i, j FROM nb")
def neighbour_pairs(spark, d):
    return _near(spark, d).select("i", "j")


@query(f"WITH {_NB} SELECT i, count(*) AS n FROM nb GROUP BY i")
def neighbour_count(spark, d):
    return _near(spark, d).groupBy("i").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {SNAP}, o AS (SELECT gx, row_number() OVER (PARTITION BY gx ORDER BY cluster) AS n, cluster, gy FROM g),
p(gx, n, cluster, row, taken) AS (SELECT gx, n, cluster, gy, [gy] FROM o WHERE n = 1
  UNION ALL SELECT gx, n, cluster, row, list_append(taken, row) FROM (SELECT o.gx, o.n, o.cluster, taken, list_min(list_filter(range(o.gy, o.gy + len(taken) + 1), lambda y: NOT list_contains(taken, y))) AS row FROM p JOIN o ON o.gx = p.gx AND o.n = p.n + 1))
SELECT cluster, CAST(row AS INTEGER) AS gy FROM p""")
def pixel_rows(spark, d):
    """Rows in the pixel map, column by column: a cluster's row is the first free one from its own on, after all clusters before it."""
    def f(p: pa.Table) -> pa.Table:
        p = p.sort_by("cluster")
        return pa.table({"cluster": p.column("cluster"), "gy": pa.array(spatial.occupied(p.column("gx").to_numpy(), p.column("gy").to_numpy()), pa.int32())})
    return spatial.grid_snap(locations(spark, d)).select("tile", "cluster", "gx", "gy").groupBy("tile", "gx").applyInArrow(f, "cluster int, gy int")


_PX = f"""{C}, {_NB}, a AS (SELECT cluster, cycle, list_sort({ABS}) AS s FROM c), w AS (SELECT cycle, count(*) / sum(s[2]) AS width, avg(s[4]) AS top FROM a GROUP BY cycle),
x AS (SELECT cluster, flatten(list(v ORDER BY cycle)) AS x FROM c GROUP BY cluster), ws AS (SELECT list(width ORDER BY cycle) AS ws, 0.3 * sum(width) * avg(top) AS thr FROM w),
px AS (SELECT i, j, a.x AS x, b.x AS y, ws, thr FROM nb JOIN x a ON a.cluster = i JOIN x b ON b.cluster = j, ws)"""
_OBJ = "list_sum(list_transform(range(16), lambda t: ws[t + 1] * (list_sum(list_transform(x[4 * t + 1:4 * t + 4], lambda e, n: abs(e - ({m}) * y[4 * t + n]))) - abs(list_max(list_transform(x[4 * t + 1:4 * t + 4], lambda e, n: e - ({m}) * y[4 * t + n]))))))"


def _per_edge(spark, d, f):
    """f(x, y, width, thr) for each pair (i, j) of neighbours. Signals go once to each cell that they reach, and are paired there, some rows at a time."""
    s = signals(spark, d)
    ws = spatial.threshold(spatial.cycle_width(s, ["tile"]), ["tile"])
    at = spatial.in_cells(spatial.grid_snap(locations(spark, d)).select("tile", "cluster", "gx", "gy"))
    by = ["tile", "cx", "cy"]
    limits = at.select(*by).distinct().join(F.broadcast(ws), "tile").select(*[F.col(c).alias(c) for c in by], "w", "thr")
    groups = [df.groupBy(*by) for df in (at.join(s.select("tile", "cluster", "signal"), ["tile", "cluster"]), limits)]

    def run(p: pa.Table, w: pa.Table) -> pa.Table:
        x, cluster, gx, gy = tensor_of(p.column("signal")), *(p.column(c).to_numpy() for c in ("cluster", "gx", "gy"))
        width, thr = np.array([[v["width"] for v in w.column("w")[0].as_py()]]), w.column("thr")[0].as_py()
        i, j = spatial.pixels_within(gx, gy, of=np.flatnonzero(p.column("own").to_numpy(zero_copy_only=False)))
        v = np.empty(len(i))
        for a in range(0, len(i), EDGES_AT_ONCE):
            k = slice(a, a + EDGES_AT_ONCE)
            v[k] = f(x[i[k]], x[j[k]], width, np.full(len(i[k]), thr))
        return pa.table({"i": cluster[i], "j": cluster[j], "v": np.round(v, R)})

    return groups[0].cogroup(groups[1]).applyInArrow(run, "i int, j int, v double")


@query(f"WITH {_PX} SELECT i, j, round({_OBJ.format(m='0.25')}, 6) AS v FROM px")
def edge_objective(spark, d):
    """The weighted light beside the main channel after a quarter of the neighbour is taken out."""
    return _per_edge(spark, d, lambda x, y, w, thr: spatial.objective(x - 0.25 * y, w))


@query(f"""WITH RECURSIVE {_PX}, lo(i, j, x, y, ws, thr, l, h) AS (SELECT i, j, x, y, ws, thr, 0.0::DOUBLE, 0.98::DOUBLE FROM px
  UNION ALL SELECT i, j, x, y, ws, thr, CASE WHEN up THEN m ELSE l END, CASE WHEN up THEN h ELSE m END FROM (SELECT *, {_OBJ.format(m='m')} - {_OBJ.format(m='m + 0.001')} > thr * 0.001 AS up FROM (SELECT *, 0.618 * l + 0.382 * h AS m FROM lo WHERE h - l > 0.001)))
SELECT i, j, round(l, 6) AS v FROM lo WHERE h - l <= 0.001""")
def edge_share(spark, d):
    """The share of each neighbour that pays to take out."""
    return _per_edge(spark, d, spatial.edge_coefficients)


@query(f"""WITH RECURSIVE {C}, {_NB}, e AS (SELECT i, j, ((i * 7 + j * 3) % 10) / 100.0 AS coef FROM nb), t(k, cluster, v) AS (SELECT 0, cluster, v[1]::DOUBLE FROM c WHERE cycle = 0
  UNION ALL SELECT t.k + 1, e.i, -sum(e.coef * t.v) FROM t JOIN e ON e.j = t.cluster WHERE t.k < 80 GROUP BY t.k, e.i)
SELECT cluster, round(sum(v), 6) AS v FROM t GROUP BY cluster""")
def acc_solve(spark, d):
    """(I + shares) x = first values over all clusters, as the series of the inverse, up to its power 80.

    A share hangs on the last digits of both numbers alone, and is 0 for equal ones, so clusters of one pixel and digit differ by their
    own values alone. The series is summed over those groups: their number is bounded by the grid, whatever the number of clusters.
    """
    placed = spatial.grid_snap(locations(spark, d)).select("tile", "cluster", "gx", "gy", (F.col("cluster") % 10).alias("digit")).join(signals(spark, d).select("tile", "cluster", F.col("signal")[0][0].alias("z")), ["tile", "cluster"])
    by = ["tile", "gx", "gy", "digit"]
    taken = placed.groupBy(*by).agg(F.count("*").alias("n"), F.sum("z").alias("z")).groupBy("tile").applyInArrow(_light_of_digits, "tile string, gx int, gy int, digit int, v double")
    return placed.join(taken, by).select("cluster", rnd(F.col("z") - F.col("v")).alias("v"))


def _light_of_digits(t: pa.Table) -> pa.Table:
    """n and z, the number of clusters and the sum of their values, by pixel and digit -> v: what the series takes off each of them."""
    gx, gy, digit = (t.column(c).to_numpy() for c in ("gx", "gy", "digit"))
    pixels, at = np.unique(np.stack([gx, gy], axis=1), axis=0, return_inverse=True)
    at = at.reshape(-1)
    n, z = np.zeros((2, len(pixels), 10))
    n[at, digit], z[at, digit] = t.column("n").to_numpy(), t.column("z").to_numpy()
    share = np.array([[(i * 7 + j * 3) % 10 / 100 for j in range(10)] for i in range(10)])
    i, j = spatial.pixels_within(pixels[:, 0], pixels[:, 1])
    near = spatial.Edges(len(pixels), i, j, np.ones(len(i)))  # times() adds the pixel itself
    x = z
    for _ in range(80):
        taken = near.times(x) @ share.T
        x = z - n * taken
    return pa.table({"tile": t.column("tile"), "gx": t.column("gx"), "gy": t.column("gy"), "digit": t.column("digit"), "v": taken[at, digit]})


@query(f"WITH {C}, {_NB}, v AS (SELECT cluster, v[1] AS v FROM c WHERE cycle = 0), e AS (SELECT i, sum(((i * 7 + j * 3) % 10) / 100.0 * v.v) AS d FROM nb JOIN v ON v.cluster = j GROUP BY i) SELECT v.cluster, round(v.v - coalesce(d, 0), 6) AS v FROM v LEFT JOIN e ON e.i = v.cluster")
def acc_jacobi_1(spark, d):
    values = signals(spark, d).select("tile", "cluster", F.col("signal")[0][0].alias("v"))
    edges = _near(spark, d).withColumn("coef", (F.col("i") * 7 + F.col("j") * 3) % 10 / 100.0)
    return spatial.jacobi(values, edges).select("cluster", rnd("v").alias("v"))


_MD = "md AS (SELECT vec_id AS k, CAST(vec_id % 9 + 1 AS VARCHAR) || substr('ACGT', CAST(vec_id % 4 AS INTEGER) + 1, 1) || CAST(9 - vec_id % 9 AS VARCHAR) || CASE WHEN vec_id % 5 = 0 THEN '^AC3' ELSE '' END AS md FROM embeddings)"


def _md(spark, d, what="flags"):
    k = F.col("vec_id")
    md = F.concat((k % 9 + 1).cast("string"), F.lit("ACGT").substr((k % 4 + 1).cast("int"), F.lit(1)), (9 - k % 9).cast("string"), F.when(k % 5 == 0, "^AC3").otherwise(""))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(k.alias("k"), (E.md_flags(md) if what == "flags" else md).alias(what))


_FL = f"{_MD}, fl AS (SELECT k, flatten(list_transform(regexp_extract_all(md, '\\d+|\\^[A-Z]+|[A-Z]'), lambda t: CASE WHEN regexp_full_match(t, '\\d+') THEN list_transform(range(CAST(CASE WHEN regexp_full_match(t, '\\d+') THEN t ELSE '0' END AS BIGINT)), lambda x: 2) WHEN starts_with(t, '^') THEN [] ELSE [1] END)) AS f FROM md)"


@query(f"WITH {_FL} SELECT k, array_to_string(f, '') AS flags FROM fl")
def md_match_flags(spark, d):
    return _md(spark, d).select("k", F.array_join(F.transform("flags", lambda x: x.cast("string")), "").alias("flags"))


@query(f"WITH {_FL} SELECT CAST(i - 1 AS INTEGER) AS cycle, count(*) AS n, round(avg(CASE WHEN f[i] = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT f, unnest(range(1, len(f) + 1)) AS i FROM fl) GROUP BY i")
def mismatch_rate_by_cycle(spark, d):
    x = _md(spark, d).select(F.posexplode("flags").alias("cycle", "f"))
    return x.groupBy("cycle").agg(F.count("*").alias("n"), rnd(F.avg(F.when(F.col("f") == 1, 1.0).otherwise(0.0))).alias("rate"))


@query(f"WITH {C} SELECT cluster, CAST(ch AS INTEGER) AS ch, cycle, round(v[ch + 1], 6) AS v FROM c, range(4) AS r(ch)")
def tensor_rotate(spark, d):
    rows = signals(spark, d).select("cluster", F.posexplode(E.rotated(F.col("signal"))).alias("ch", "x"))
    return rows.select("cluster", "ch", F.posexplode("x").alias("cycle", "v")).withColumn("v", rnd("v"))


@query(f"WITH {C} SELECT cluster, cycle, CASE WHEN cycle = 3 THEN 7.0 ELSE round(v[2], 6) END AS v FROM c")
def slice_assign(spark, d):
    new = E.assigned(F.col("signal"), 3, F.array_repeat(F.lit(7.0), 4))
    return signals(spark, d).select("cluster", F.posexplode(new).alias("cycle", "v")).select("cluster", "cycle", rnd(F.col("v")[1]).alias("v"))


@query(f"WITH {C} SELECT cluster, cycle, CAST(ch AS INTEGER) AS ch, round(m[1] * v[1] + m[2] * v[2] + m[3] * v[3] + m[4] * v[4], 6) AS v FROM (SELECT *, {_CC}[ch + 1] AS m FROM c, range(4) AS r(ch))")
def axis_product(spark, d):
    new = E.multiplied(F.col("signal"), [r[:4] for r in COLOR])
    return signals(spark, d).select("cluster", F.posexplode(new).alias("cycle", "v")).select("cluster", "cycle", F.posexplode("v").alias("ch", "v")).withColumn("v", rnd("v"))


@query(f"WITH {C} SELECT cluster, CAST(n AS INTEGER) AS n, round(v0, 6) AS v FROM (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY cycle) - 1 AS n, v[1] AS v0 FROM c WHERE v[1] > 0.6)")
def masked_pick(spark, d):
    mask = F.transform("signal", lambda v: v[0] > 0.6)
    return signals(spark, d).select("cluster", F.posexplode(E.picked(F.col("signal"), mask)).alias("n", "v")).select("cluster", "n", rnd(F.col("v")[0]).alias("v"))


@query(f"WITH {C} SELECT cluster, CAST(n - 1 AS INTEGER) AS n, round(v[1], 6) AS v FROM c JOIN (VALUES (1, 5), (2, 0), (3, 15), (4, 5)) AS t(n, p) ON p = cycle")
def index_gather(spark, d):
    at = F.array(*[F.lit(i) for i in (5, 0, 15, 5)])
    return signals(spark, d).select("cluster", F.posexplode(E.gathered(F.col("signal"), at)).alias("n", "v")).select("cluster", "n", rnd(F.col("v")[0]).alias("v"))


@query(f"WITH {C} SELECT cluster, round(min(list_min(v)), 6) AS low, round(max(list_max(v)), 6) AS high FROM c GROUP BY cluster")
def value_range(spark, d):
    flat = F.flatten("signal")
    return signals(spark, d).select("cluster", rnd(F.array_min(flat)).alias("low"), rnd(F.array_max(flat)).alias("high"))


def _aligned(spark, d):
    """An alignment for each cluster: the tags above, every third reverse."""
    k = F.col("k")
    return _md(spark, d, "md").select(F.lit("t").alias("tile"), k.cast("int").alias("cluster"), F.when(k % 3 == 0, 16).otherwise(0).alias("flag"), "md")


_AL = f"{S}, {_FL}, l AS (SELECT CAST(k AS INTEGER) AS cluster, CASE WHEN k % 3 = 0 THEN list_reverse(f) ELSE f END AS f FROM fl), lb AS (SELECT s.*, f[cycle + 1] - 1 AS label FROM s JOIN l USING (cluster))"


@query(f"WITH {_AL} SELECT cluster, cycle, CAST(label AS INTEGER) AS label FROM lb WHERE label IS NOT NULL")
def train_labels(spark, d):
    return train.labelled(signals(spark, d), _aligned(spark, d)).select("cluster", "cycle", "label")


@query(f"WITH {_AL} SELECT round(avg(least(5 * gap, 19.5)), 6) AS mean_s, round(stddev_pop(least(5 * gap, 19.5)), 6) AS sd_s, count(*) FILTER (label = 0) AS mismatches FROM lb")
def train_diagnostics(spark, d):
    return train.diagnostics(signals(spark, d), _aligned(spark, d)).select(rnd("mean_s").alias("mean_s"), rnd("sd_s").alias("sd_s"), "mismatches")


@query(f"""WITH {_AL}, h0 AS (SELECT *, least(5 * gap, 19.5) AS sc FROM lb WHERE label IS NOT NULL), h1 AS (SELECT *, CAST(least(CASE WHEN sc >= 8 THEN floor((sc + 1) / 3 + 2) WHEN sc >= 2 THEN floor(sc / 2 + 1) ELSE floor(sc) END, 7) AS INTEGER) AS bin FROM h0),
h AS (SELECT *, 1 - (sc - [0,1,2,4,6,8,11,14,17][bin + 1]) / ([0,1,2,4,6,8,11,14,17][bin + 2] - [0,1,2,4,6,8,11,14,17][bin + 1]) AS beta FROM h1),
x AS (SELECT bin AS i, beta AS v FROM h UNION ALL SELECT bin + 1, 1 - beta FROM h UNION ALL SELECT 9, 1 / (0.02 + sqrt(least(var, 1))) FROM h UNION ALL SELECT 10, ln(0.02 + least(var, 1)) FROM h UNION ALL SELECT 11, 1 / (0.01 + greatest(least(sig, 3), 0)) FROM h
 UNION ALL SELECT 12, 1.0 / (n - cycle) FROM h UNION ALL SELECT 13, 3.0 FROM h UNION ALL SELECT 69, 1.0 FROM h UNION ALL SELECT cycle + 14, 1.0 FROM h WHERE cycle <= 6 UNION ALL SELECT prev * 12 + call * 3 + rank + 21, 1.0 FROM h WHERE cycle > 0)
SELECT CAST(i AS INTEGER) AS i, count(*) AS n, round(sum(v), 4) AS v FROM x GROUP BY i""")
def train_features(spark, d):
    x = train.features(train.labelled(signals(spark, d), _aligned(spark, d))).select(F.explode("x").alias("x"))
    return x.groupBy("x.i").agg(F.count("*").alias("n"), rnd(F.sum("x.v"), 4).alias("v"))


# ---- files: written to a new folder beside the checkpoints and read back


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_QU = "CAST(greatest(trunc(least(v[ch + 1] * 4000, 32767) + 0.5), -32768) AS DOUBLE)"


@query(f"WITH {T0} SELECT 'p_' || tile || '_q' AS tile, cluster, cycle, CAST(ch AS INTEGER) AS ch, {_QU} AS v FROM c, range(4) AS r(ch)")
def cif_file(spark, d):
    to = _folder(spark)
    formats.write_cif(tiles(spark, d, 0.0), to, "p_", "_q")
    back = formats.read_cif(spark, to).select("tile", "cluster", F.posexplode("signal").alias("cycle", "v"))
    return back.select("tile", "cluster", "cycle", F.posexplode("v").alias("ch", "v"))


@query(f"WITH {T0} SELECT tile, cluster, CAST(cycle - 4 AS INTEGER) AS cycle, CAST(ch AS INTEGER) AS ch, {_QU} AS v FROM c, range(4) AS r(ch) WHERE cycle BETWEEN 4 AND 9")
def cif_ranges(spark, d):
    """Cycles 5 to 10 of each file, read by ranges of clusters."""
    to = _folder(spark)
    formats.write_cif(tiles(spark, d, 0.0), to)
    back = formats.read_cif_ranges(spark, to, 64, (5, 10)).select("tile", "cluster", F.posexplode("signal").alias("cycle", "v"))
    return back.select("tile", "cluster", "cycle", F.posexplode("v").alias("ch", "v"))


@query(f"WITH {T0} SELECT tile, cluster, cycle + 1 AS cycle, CAST(ch AS INTEGER) AS ch, {_QU} AS v FROM c, range(4) AS r(ch) WHERE cycle BETWEEN 2 AND 8 AND cluster >= 17 AND cluster < 140 AND tile <> 't1' AND v[1] <> 0")
def intensity_cycles(spark, d):
    """The data source by cycles: cycles and clusters are filtered in the files, the rest by Spark."""
    to = _folder(spark)
    formats.write_cif(tiles(spark, d, 0.0), to)
    rows = formats.read_intensities(spark, to, layout="cycles", partitionClusters="50")
    rows = rows.where("cycle > 2 AND cycle <= 9 AND cluster >= 17 AND cluster < 140 AND tile <> 't1' AND tile LIKE 't%'")
    first = tiles(spark, d, 0.0).where("signal IS NOT NULL").select("tile", "cluster", F.posexplode("signal").alias("cycle", "s")).where("s[0] <> 0").select("tile", "cluster", (F.col("cycle") + 1).alias("cycle"))
    return rows.join(first, ["tile", "cluster", "cycle"]).select("tile", "cluster", "cycle", F.posexplode("v").alias("ch", "v"))


@query(f"WITH {T0}, k AS (SELECT tile, count(DISTINCT cluster) AS clusters, CAST(substr(tile, 2) AS INTEGER) % 2 = 1 AS bad FROM c GROUP BY tile) SELECT tile, CASE WHEN bad THEN 0 ELSE clusters END AS clusters, bad FROM k")
def intensity_outcomes(spark, d):
    """Every second tile's file is cut short; the others' clusters are all there, and the bad ones are listed."""
    whole, to = _folder(spark), _folder(spark)
    formats.write_cif(tiles(spark, d, 0.0), whole)
    data = spark.read.format("binaryFile").load(whole).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    cut = F.regexp_extract("name", r"(\d+)\.cif$", 1).cast("int") % 2 == 1
    write_files(data.select("name", F.when(cut, F.expr("substring(content, 1, length(content) - 5)")).otherwise(F.col("content")).alias("data")), to)
    rows = formats.read_intensities(spark, to, mode="PERMISSIVE")
    return rows.groupBy("tile").agg(F.count("cluster").alias("clusters"), F.max(F.col("error").isNotNull()).alias("bad"))


@query(f"WITH {T0} SELECT tile, cluster, cycle, CAST(ch AS INTEGER) AS ch, {_QU} AS v FROM c, range(4) AS r(ch) UNION ALL SELECT tile, cluster, 16, CAST(ch AS INTEGER), 0.0 FROM c, range(4) AS r(ch) WHERE cycle = 0")
def cif_folders(spark, d):
    """A folder for each cycle; one more cycle is asked for than there are files."""
    to = _folder(spark)
    formats.write_cif(tiles(spark, d, 0.0), to, first=2, folders=True)
    back = formats.read_intensities(spark, to, (3, 19), folders=True).select("tile", "cluster", F.posexplode("signal").alias("cycle", "v"))
    return back.select("tile", "cluster", "cycle", F.posexplode("v").alias("ch", "v"))


@query(f"WITH {XY} SELECT 't' || CAST(cluster // 250 AS VARCHAR) AS tile, CAST(cluster % 250 AS INTEGER) AS cluster, x + 0.25 AS x, y / 4 AS y FROM xy")
def location_files(spark, d):
    """.locs files converted to _pos.txt, and read."""
    a, b = _folder(spark), _folder(spark)
    k = F.col("cluster")
    formats.write_locs(locations(spark, d).select(F.concat(F.lit("t"), F.floor(k / TILE).cast("string")).alias("tile"), (k % TILE).alias("cluster"), (F.col("x") + 0.25).alias("x"), (F.col("y") / 4).alias("y")), a)
    formats.convert_locations(spark, a, b)
    return formats.read_locations(spark, b, "_pos.txt").select("tile", "cluster", "x", "y")


@query("SELECT CAST(vec_id % 70 + 1 AS INTEGER) AS i, sum(vec_id // 70 * 7 + vec_id % 70) % 1000 / 10.0 AS w FROM embeddings GROUP BY vec_id % 70")
def model_file(spark, d):
    """Weights from the table, in a model file, read again."""
    k = F.col("vec_id")
    t = spark.read.parquet(f"{d}/embeddings.parquet").groupBy((k % 70).alias("i")).agg((F.sum(F.floor(k / 70) * 7 + k % 70) % 1000 / 10.0).alias("w"))
    to = _folder(spark) + "/a.model"
    formats.write_model([r.w for r in t.orderBy("i").collect()], to)  # 70 weights
    return spark.createDataFrame(list(enumerate(formats.read_model(spark, to), 1)), "i int, w double")


@query(f"WITH {S}, {HAT}, {Z}, r AS (SELECT cluster, '@Cluster_t' || CAST(cluster // 250 AS VARCHAR) || '_' || CAST(cluster % 250 + 1 AS VARCHAR) || chr(10) || string_agg(substr('ACGT', call + 1, 1), '' ORDER BY cycle) || chr(10) || '+' || chr(10) || string_agg(chr(q + 33), '' ORDER BY cycle) AS record FROM q GROUP BY cluster) SELECT 't' || CAST(cluster // 250 AS VARCHAR) || '_q.fastq' AS name, string_agg(record || chr(10), '' ORDER BY cluster) AS content FROM r GROUP BY cluster // 250")
def fastq_files(spark, d):
    """A file of reads for each tile, whole."""
    to = _folder(spark)
    formats.write_fastq_files(quality.fastq(quality.reads(tiles(spark, d), ["tile", "cluster"], quality.synthetic_weights())), to, suffix="_q")
    return spark.read.format("binaryFile").load(to).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").cast("string").alias("content"))


@query(f"WITH {S}, {HAT}, {Z}, r AS (SELECT cluster, unnest(['@Cluster_t_' || CAST(cluster + 1 AS VARCHAR), string_agg(substr('ACGT', call + 1, 1), '' ORDER BY cycle), '+', string_agg(chr(q + 33), '' ORDER BY cycle)]) AS line FROM q GROUP BY cluster) SELECT line FROM r")
def fastq_file(spark, d):
    to = _folder(spark)
    formats.write_fastq(quality.fastq(quality.reads(signals(spark, d), ["tile", "cluster"], quality.synthetic_weights())), to)
    return spark.read.text(to).withColumnRenamed("value", "line")


@query(f"WITH {_MD} SELECT CAST(k AS INTEGER) AS cluster, CASE WHEN k % 3 = 0 THEN 16 ELSE 0 END AS flag, md FROM md WHERE k % 7 <> 0 AND k % 11 <> 0")
def sam_file(spark, d):
    """Unmapped reads and those with gaps stay out."""
    to = _folder(spark)
    k = F.col("cluster")
    line = F.concat_ws("\t", F.concat(F.lit("Cluster_t_"), (k + 1).cast("string")), F.col("flag").cast("string"), F.when(k % 7 == 0, "*").otherwise("ref"), F.lit("1"), F.lit("9"), F.when(k % 11 == 0, "5M1D5M").otherwise("10M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTACGTAC"), F.lit("IIIIIIIIII"), F.concat(F.lit("MD:Z:"), F.col("md")))
    _aligned(spark, d).select(line.alias("value")).write.text(to)
    return formats.read_sam(spark, to).select("cluster", "flag", "md")


@query(f"WITH {_MD}, r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS row FROM md WHERE k % 13 <> 5) SELECT CAST(row AS INTEGER) AS cluster, CASE WHEN k % 3 = 0 THEN 16 ELSE 0 END AS flag, md FROM r WHERE k % 7 <> 0 AND k % 11 <> 0")
def sam_rows(spark, d):
    """Alignments pair by their place: names say nothing, some lines are empty or header lines, rejected ones keep their number."""
    to = _folder(spark)
    _sam_lines(spark, d, F.lit("read")).write.text(to)
    return formats.read_sam(spark, to, "row").select("cluster", "flag", "md")


def _sam_lines(spark, d, name) -> DataFrame:
    """Lines in order of their number; every 13th cluster's is an empty or a header line."""
    k = F.col("cluster")
    line = F.concat_ws("\t", name, F.col("flag").cast("string"), F.when(k % 7 == 0, "*").otherwise("ref"), F.lit("1"), F.lit("9"), F.when(k % 11 == 0, "5M1D5M").otherwise("10M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTACGTAC"), F.lit("IIIIIIIIII"), F.concat(F.lit("MD:Z:"), F.col("md")))
    line = F.when(k % 13 != 5, line).otherwise(F.when(k % 2 == 0, "@CO").otherwise(""))
    return _aligned(spark, d).repartitionByRange(4, "cluster").sortWithinPartitions("cluster").select(line.alias("value"))


@query(f"WITH {_MD}, r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS row FROM md WHERE k % 13 <> 5), a AS (SELECT row FROM r WHERE k % 7 <> 0 AND k % 11 <> 0), c AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 1) SELECT (SELECT count(*) FROM c) AS clusters, (SELECT count(*) FROM a) AS aligned, (SELECT count(*) FROM a JOIN c ON row = vec_id) AS paired, (SELECT count(*) FROM c ANTI JOIN a ON row = vec_id) AS unpaired_clusters, (SELECT count(*) FROM a ANTI JOIN c ON row = vec_id) AS unpaired_reads")
def sam_pairing(spark, d):
    """How many alignments and clusters find each other by place."""
    to = _folder(spark)
    _sam_lines(spark, d, F.lit("read")).write.text(to)
    return train.pairing(signals(spark, d).where("cluster % 3 <> 1"), formats.read_sam(spark, to, "row").withColumn("tile", F.lit("t")))


@query("SELECT page_id, url FROM pages WHERE ends_with(split_part(split_part(url, '?', 1), '#', 1), '5') AND (url LIKE 'http://%' OR url LIKE 'https://m.%')")
def tile_filter(spark, d):
    from basewright.plans.tiles import matching

    stem = F.regexp_extract("url", r"^[^?#]*", 0)
    return spark.read.parquet(f"{d}/pages.parquet").where(stem.endswith("5") & matching(F.col("url"), ["http://+", "https://m.+"])).select("page_id", "url")


@query(None)
def deconvolve_full(spark, d):
    return estimate.basecall(tiles(spark, d), most=100).select("tile", "cluster", F.posexplode("signal").alias("cycle", "v")).select("tile", "cluster", "cycle", E.base(E.positive_call(F.col("v"))).alias("base"))


@query(None)
def acc_full(spark, d):
    s = signals(spark, d)
    return spatial.correct_acc(s, s, locations(spark, d)).select("cluster", F.array_join(F.transform("signal", lambda v: E.base(E.call(v))), "").alias("seq"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
