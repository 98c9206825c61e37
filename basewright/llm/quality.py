"""Quality by hierarchical empirical Bayes.

1. A logistic classifier on features of the text (length, word shapes, signs, repetition) gives each document's evidence; it is fit on at
   most about TRAIN_ROWS labelled rows, drawn by hash of the id.
2. The evidence of all documents, added up by site (host) and by path of it, gives their posterior rates: a site's rate is
   shrunk toward the global rate, a path's toward its site's. Each strength, in documents, is the variance within groups over
   that between the groups' true means (method of moments, with the sampling noise of the means taken off), sites around the
   global rate and paths around their site. Sparse sites so stay near the prior.
3. A document's posterior adds its own log odds and its path's, relative to the global rate. Its own share is left out of its site's and path's sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, small_enough, table

TRAIN_ROWS, BROADCAST_ROWS, SITE_WEIGHT = 20_000, 100_000, 0.5


def text_features(text: str | None) -> list[float]:
    """Numbers that any text has, bounded in size; null counts as empty."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    lines = text.split("\n")
    if not n:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    seen = Counter(words)
    letters = sum(map(str.isalpha, text)) / chars
    upper = sum(map(str.isupper, words)) / n
    signs = sum(w[-1] in "#$%&*!|" for w in words) / n
    digits = sum(w[0].isdigit() for w in words) / n
    distinct, top = len(seen) / n, seen.most_common(1)[0][1] / n
    again = 1 - len(set(lines)) / len(lines)
    return [1.0, math.log1p(n) / 10, min(chars / n, 30) / 10, letters, upper, signs, digits, distinct, top, again, float(n < 20)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [text_features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["quality", "x"])


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x[:, 1:] ** 2, x[:, 7:8] * x[:, 1:2]], axis=1)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[float]:
    """Weights of the classifier; with labels of one kind or none, its prior alone."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) < int(min(1.0, train_rows / max(n, 1)) * 1_000_000))
    rows = documents.select("doc_id", "text").join(F.broadcast(known) if small_enough(known, 4 * train_rows) else known, "doc_id").select("quality", "text")
    got = rows.mapInArrow(_features, "quality long, x array<double>").collect()
    size = 2 * len(text_features(None))
    y = np.array([r.quality for r in got], float)
    if not len(y) or y.min() == y.max():
        return [2.0 if not len(y) or y.max() else -2.0] + [0.0] * (size - 1)
    return _newton(_expand(np.array([r.x for r in got])), y).tolist()


def _evidence(weights: list[float]):
    w = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([text_features(t.as_py()) for t in batch.column(3)])
                p = 1 / (1 + np.exp(-np.clip(_expand(x) @ w, -12, 12)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["doc_id", "site", "path", "evidence"])
    return run


def _worth(between: float, within: float, groups: int, rows: float, spread_rows: float) -> float:
    """Documents' worth of prior by the method of moments for unbalanced groups: the variance within groups over that between
    their true means. `between` is the weighted sum of squares of the group means; what sampling alone makes of it,
    `groups` times the variance within, is taken off. Groups that differ no more than by chance give 1e6."""
    if rows <= 0 or groups <= 0 or spread_rows <= 0 or within <= 0:
        return 1e6
    true = (between - groups * within) / spread_rows
    return min(1e6, max(0.01, within / true)) if true > 0 else 1e6


def strengths(sites: DataFrame, paths: DataFrame, rate: float) -> tuple[float, float]:
    """(of the global rate for sites, of a site's rate for its paths); sites and paths (s, n, q): sums, numbers and sums of squares; paths have their site's ss, sn.

    Nested: sites spread around the global rate, paths around their site's mean, documents around their path's.
    """
    n, mean = F.col("n"), F.col("s") / F.col("n")
    p = paths.agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.sum(F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0))).alias("rest"),
        F.sum(n * (mean - F.col("ss") / F.col("sn")) ** 2).alias("between"), F.sum(n * n / F.col("sn")).alias("own")).first()
    s = sites.agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.sum(F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0))).alias("rest"),
        F.sum(n * (mean - F.lit(rate)) ** 2).alias("between"), F.sum(n * n).alias("own")).first()
    if not s.rows:
        return 1e6, 1e6
    of_site = _worth(s.between, s.rest / max(s.rows - s.groups, 1), s.groups - 1, s.rows, s.rows - s.own / s.rows)
    of_path = _worth(p.between, p.rest / max(p.rows - p.groups, 1), p.groups - s.groups, p.rows, p.rows - p.own)
    return of_site, of_path


def quality(documents: DataFrame, labels: DataFrame, site: Column, path: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, site, path, evidence, site_rate, path_rate, quality, keep: a row for each row of documents.

    Null texts count as empty; null sites and paths are each a group of their own; null ids stay; repeated rows score alike
    and count as often as they occur; without labels the prior keeps all; an empty table gives no rows; extra columns are ignored.
    """
    rows = documents.select("doc_id", F.coalesce(site, F.lit("")).alias("site"), F.coalesce(path, F.lit("")).alias("path"), "text")
    scored = checkpointed(rows.mapInArrow(_evidence(fit(documents, labels, train_rows)), "doc_id long, site string, path string, evidence double"))
    paths = scored.groupBy("site", "path").agg(F.sum("evidence").alias("s"), F.count("*").alias("n"), F.sum(F.col("evidence") ** 2).alias("q"))
    paths = checkpointed(paths)
    sites = checkpointed(paths.groupBy("site").agg(*[F.sum(c).alias(c) for c in "snq"]))
    row = sites.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    rate = min(0.999, max(0.001, row.s / row.n)) if row.n else 0.5
    groups = checkpointed(paths.join(sites.select("site", F.col("s").alias("ss"), F.col("n").alias("sn")), "site"))
    a, b = strengths(sites, groups, rate)
    groups = groups.drop("q")
    if small_enough(groups, BROADCAST_ROWS):
        groups = F.broadcast(groups)
    e = F.col("evidence")
    site_rate = (F.col("ss") - e + a * rate) / (F.col("sn") - 1 + a)
    path_rate = (F.col("s") - e + b * F.col("site_rate")) / (F.col("n") - 1 + b)
    logit = lambda p: F.log(p / (1 - p))
    clip = lambda p: F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))
    out = scored.join(groups, ["site", "path"]).withColumn("site_rate", clip(site_rate)).withColumn("path_rate", clip(path_rate))
    z = logit(e) + SITE_WEIGHT * (logit(F.col("path_rate")) - math.log(rate / (1 - rate)))
    out = out.withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "site", "path", "evidence", "site_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("keep"))


def url_site(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)", 1))


def url_path(url: Column) -> Column:
    """The first directory of a URL's path."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/([^/?#]*)/", 1)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no URL: their source stands for the host and their language for the path."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
