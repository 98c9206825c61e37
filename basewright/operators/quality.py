"""Score features, base qualities and FASTQ rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.functions import expr as E

FEATURES = 70


def synthetic_weights() -> list[float]:
    """Weights by formula, for tests and oracle queries."""
    return [((i * 37) % 19 - 9) / 10 for i in range(1, FEATURES + 1)]


def with_scores(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cycles, tsr, var, sig, n: cycles is an array with v, call, gap, top, second, rank (of the runner-up among the other channels) and prev of each cycle; the others are the read's, 0 for a read without cycles and null for a null signal. All in the row, without a shuffle."""
    t = signals.select(*keys, "signal")
    one = lambda v: F.struct(v.alias("v"), E.call(v).alias("call"), E.gap(v).alias("gap"), F.array_max(v).alias("top"), E.runner_up(v).alias("second"))
    t = t.select(*keys, F.transform("signal", one).alias("c"), F.size("signal").cast("long").alias("n"))
    before = F.transform("c", lambda x, i: F.struct(*[x[f].alias(f) for f in ("v", "call", "gap", "top", "second")], (x["second"] - (x["second"] > x["call"]).cast("int")).alias("rank"), F.when(i > 0, F.try_element_at("c", i)["call"]).alias("prev")))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda a, x: a + f(x)) / F.greatest("n", F.lit(1))
    t = t.withColumn("tsr", total(lambda x: x["gap"]))
    return t.select(*keys, before.alias("cycles"), "tsr", total(lambda x: (x["gap"] - F.col("tsr")) ** 2).alias("var"), total(lambda x: x["top"]).alias("sig"), "n")


def scored_cycles(signals: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each cycle: keys, cycle, v, call, gap, top, second, rank, prev, and the read's tsr, var, sig, n."""
    # the plain posexplode makes a filter of the array's size, which is pushed below and works out all of it once more for each cycle
    long = with_scores(signals, keys).select(*keys, F.posexplode_outer("cycles").alias("cycle", "c"), "tsr", "var", "sig", "n").where("c IS NOT NULL")
    return long.select(*keys, "cycle", *[f"c.{f}" for f in ("v", "call", "gap", "top", "second", "rank", "prev")], "tsr", "var", "sig", "n")


def _bare(name: str) -> Column:
    return F.col(name)


def log_odds(weights: Column, compat: bool = True, of=_bare) -> Column:
    """The score of a cycle; of gives its gap, var, sig, n, cycle, prev, call and rank by name, as scored_cycles has them. compat keeps feature 14's larger clamp at the first cycle."""
    w = lambda i: F.element_at(weights, i if isinstance(i, Column) else F.lit(i))
    s = F.least(5 * of("gap"), F.lit(19.5))
    b = E.hat_bin(s)
    beta = E.hat_beta(s, b)
    var = F.least(of("var"), F.lit(1.0))
    sig = F.greatest(F.least(of("sig"), F.lit(3.0)), F.lit(0.0))
    first = F.greatest(F.least(of("sig"), F.lit(30.0)), F.lit(3.0)) if compat else F.lit(3.0)
    z = w(b + 1) * beta + w(b + 2) * (1 - beta) + w(10) / (0.02 + F.sqrt(var)) + w(11) * F.log(0.02 + var) + w(12) / (0.01 + sig)
    z += w(13) / (of("n") - of("cycle")) + w(14) * F.when(of("cycle") == 0, first).otherwise(3.0) + w(70)
    z += F.when(of("cycle") <= 6, w(F.least(of("cycle"), F.lit(6)) + 15)).otherwise(0.0)
    return z + F.when(of("cycle") > 0, w(F.coalesce(of("prev"), F.lit(0)) * 12 + of("call") * 3 + of("rank") + 22)).otherwise(0.0)


def _phred(constant: bool):
    """The quality of a cycle of with_scores, given weights as the column w."""

    def of(x: Column, i: Column) -> Column:
        read = {n: F.col(n) for n in ("var", "sig", "n")} | {"cycle": i}
        return E.phred(F.lit(5.0) if constant else log_odds(F.col("w"), of=lambda name: read[name] if name in read else x[name]))
    return of


def _weighed(signals: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    return with_scores(signals, keys).withColumn("w", F.array(*[F.lit(float(w)) for w in weights]))


def phreds(signals: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    """keys, cycle, q: scores stay in the read's row, and only their qualities are exploded."""
    q = _weighed(signals, keys, weights).select(*keys, F.transform("cycles", _phred(False)).alias("q"))
    return q.select(*keys, F.posexplode_outer("q").alias("cycle", "q")).where("q IS NOT NULL")  # as in scored_cycles


def reads(signals: DataFrame, keys: list[str], weights: list[float], constant: bool = False) -> DataFrame:
    """keys, seq, qual; constant: every quality is that of a log odds of 5. Each read stays in its row."""
    q = _phred(constant)
    t = _weighed(signals, keys, weights)
    return t.select(*keys, F.array_join(F.transform("cycles", lambda x: E.base(x["call"])), "").alias("seq"), F.array_join(F.transform("cycles", lambda x, i: E.quality_char(q(x, i))), "").alias("qual"))


def fastq(rows: DataFrame) -> DataFrame:
    """rows (tile, cluster, seq, qual) with their record text; clusters are numbered from 1."""
    return rows.withColumn("record", F.concat(F.lit("@Cluster_"), "tile", F.lit("_"), (F.col("cluster") + 1).cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual", F.lit("\n")))
