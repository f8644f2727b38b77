"""Quality classifier: hierarchical empirical Bayes.

Method: a document's evidence is the log likelihood ratio of a logistic classifier on its text. Its prior
is the posterior rate of good documents at its path, which is shrunk towards its host, which is shrunk
towards the global rate, all from grouped counts of labelled documents; so a sparse site adds little and a
well-known one much. In ``documents``, the host is the source and the path is the language within it.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from parcelworks.llm.empirical_bayes import global_mean, shrunk
from parcelworks.llm.shared import labelled_sample, small_batches, stash, table
from parcelworks.llm.text_stats import SYMBOLS

N_FEATURES = 9


def text_features(text: str | None) -> list[float]:
    """Shares of symbols, exclamation marks, capitals, bars and digits in the bytes of words; shares of words
    that repeat the word before and of lines that repeat a line; mean word length; length."""
    data = (text or "").encode()
    words = data.split()
    solid = b"".join(words)
    n = max(1, len(solid))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        (len(solid) - len(solid.translate(None, SYMBOLS))) / n,
        solid.count(b"!") / n,
        (len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n,
        solid.count(b"|") / n,
        (len(solid) - len(solid.translate(None, b"0123456789"))) / n,
        sum(map(operator.eq, words, words[1:])) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(20.0, len(solid) / max(1, len(words))) / 20,
        min(10.0, float(np.log1p(len(words)))) / 10,
    ]


class Evidence:
    """Logistic model on standardised features; its value is the log likelihood ratio of good to bad."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50):
        self.mean, self.spread = x.mean(0), x.std(0)
        self.spread[self.spread < 1e-6] = 1.0  # a feature that does not vary
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.spread]
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)  # equal priors: the site's prior comes later
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        for _ in range(steps):  # Newton
            p = 1 / (1 + np.exp(-z @ self.w))
            grad = z.T @ (weight * (y - p)) - ridge * self.w
            bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(bend, grad)
            self.w += step
            if np.abs(step).max() < 1e-9:
                break

    def __call__(self, features: list[list[float]]) -> np.ndarray:
        z = (np.asarray(features).reshape(-1, N_FEATURES) - self.mean) / self.spread
        return np.clip(z @ self.w[1:] + self.w[0], -30, 30)


def fit_evidence(docs: DataFrame, labels: DataFrame, max_docs: int = 8000) -> Evidence | None:
    """Fits on at most ``max_docs`` labelled documents, half of either label; of several rows of one id the one of the smallest text hash
    counts. Features are made on the executors and only they reach the driver, a row an id. None without labels of both kinds."""
    make = F.pandas_udf(lambda texts: pd.Series([text_features(t) for t in texts]), ArrayType(DoubleType()))
    sample = docs.join(F.broadcast(labelled_sample(labels, "quality", max_docs)), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sample.select("doc_id", make("text").alias("x"), "label").orderBy("doc_id").collect()
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return Evidence(np.array([r.x for r in rows]), y)


def evidence_column(model: Evidence | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.0)
    return F.pandas_udf(lambda texts: pd.Series(model([text_features(t) for t in texts])), DoubleType())(text)


def site_rates(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, host_rate, path_rate) of every site with a document; the global rate). Counts are
    pre-aggregated by (host, path), so a hot host is a few rows when it is shuffled again."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    paths = docs.join(known, "doc_id", "left").groupBy("host", "path").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("hits"))
    paths = stash(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    mean = global_mean(hosts)
    hosts, _ = shrunk(hosts.withColumn("mean", F.lit(mean)))
    up = hosts.select(F.col("host").alias("__h"), F.col("posterior").alias("mean"))
    paths, _ = shrunk(paths.join(up, F.equal_null(paths["host"], up["__h"])).drop("__h"))
    return paths.select("host", "path", F.col("mean").alias("host_rate"), F.col("posterior").alias("path_rate")), mean


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = 0.5,
    max_docs: int = 8000,
) -> DataFrame:
    """``docs`` with five more columns: evidence (log likelihood ratio of good to bad), host_rate, path_rate,
    p_good and kept (p_good of at least ``threshold``); existing columns of these names are replaced.

    Defined cases: a null or empty text has the features of an empty one; a null host or path is a site of its own;
    several labels of one document count as their majority; a null id has no label. Without labels of both
    kinds all evidence is 0 and the rates decide. Repeated rows are judged alike. Texts are not shuffled
    unless the site table outgrows Spark's broadcast limit."""
    new = ("evidence", "host_rate", "path_rate", "p_good", "kept")
    rows = small_batches(docs).select(*[c for c in docs.columns if c not in new])
    sites = rows.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    texts = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_evidence(texts, labels, max_docs)
    rates, _ = site_rates(sites, labels)
    rates = stash(rates.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "host_rate", "path_rate"), "site-rates")  # of known size, so that a small one is broadcast
    scored = rows.withColumn("evidence", evidence_column(model, F.col(text_col)))
    joined = scored.join(rates, F.equal_null(F.col(host_col), F.col("__host")) & F.equal_null(F.col(path_col), F.col("__path"))).drop("__host", "__path")
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return joined.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("p_good") >= threshold)


def op8_quality(spark, sf_dir):
    """Every document's evidence, site rates and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text", "source", "lang")
