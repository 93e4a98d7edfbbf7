"""Quality by hierarchical empirical Bayes: a text classifier's evidence over host and path posteriors.

A logistic classifier reads the text alone and gives each document's evidence (log-odds beyond the
global prior). Hosts and, within them, paths hold Beta posteriors of the good share, gathered by grouped
sums over all documents; a sparse host shrinks to the global prior and a sparse path to its host, with
prior strengths estimated from the spread between sites. A document's own evidence is left out of its
site's posterior before the two are added.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, materialise, small_batches, whole_row
from .toxicity import training_rows

#: The fit's sample of labelled rows, the score from which a document is kept, and the largest broadcast table of sites.
SAMPLE_ROWS, THRESHOLD, SITES = 10_000, 0.5, 100_000
#: Strength of a site's prior, in documents, is held between these.
STRENGTH = (2.0, 10_000.0)

_LETTERS = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80))
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_DIGIT = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)
_NOT_SPACE = bytes(b for b in range(256) if b not in b" \t\n\r\x0b\x0c")
_NOT_PLAIN = bytes(b for b in range(256) if b not in b".,;:'\"()-?")
N_FEATURES = 14


def features(text: bytes) -> list[float]:
    """Shape of a whole text: its letters, marks, words, lines and repeats."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    words = text.split()
    nw = max(1, len(words))
    letters = len(text.translate(None, _LETTERS))
    upper = len(text.translate(None, _NOT_UPPER))
    digits = len(text.translate(None, _NOT_DIGIT))
    space = len(text.translate(None, _NOT_SPACE))
    plain = len(text.translate(None, _NOT_PLAIN))
    marks = n - letters - digits - space - plain
    counts = Counter(words)
    most = counts.most_common(1)[0][1] if counts else 0
    lines = text.split(b"\n")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    return [
        math.log(nw), upper / max(1, letters), digits / n, marks / n, plain / n, n / nw / 10,
        len(counts) / nw, math.sqrt(len(counts)) / math.sqrt(nw), most / nw, runs / nw,
        counts[b"|"] / nw, 1 - len(set(lines)) / len(lines), math.log(nw / len(lines)), stops / nw,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the expanded features, the bias first
    prior: float  # log-odds of the good share in the sample


def expand(z: np.ndarray) -> np.ndarray:
    """Bias, standardised features, their squares and products."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)


def fit(rows: Iterable[tuple[bytes, int]]) -> Model:
    """Ridge logistic regression by Newton's method; of each text only its features are held."""
    seen = [(features(t), y) for t, y in rows]
    x = np.array([f for f, _ in seen], dtype=np.float64).reshape(-1, N_FEATURES)
    y = np.array([v for _, v in seen], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(1 + N_FEATURES + N_FEATURES * (N_FEATURES + 1) // 2), 2.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = expand(np.clip((x - mean) / scale, -8, 8))
    w = np.zeros(a.shape[1])
    prior = math.log(y.mean() / (1 - y.mean()))
    w[0] = prior
    ridge = np.full(a.shape[1], 2.0)
    ridge[0] = 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - ridge * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, prior)


def probability(texts: Sequence[bytes], model: Model) -> np.ndarray:
    x = np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)
    z = expand(np.clip((x - model.mean) / model.scale, -8, 8)) @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def probability_column(spark, model: Model, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)
    small_batches(spark)

    @F.pandas_udf("double")
    def p(texts: pd.Series) -> pd.Series:
        return pd.Series(probability([(t or "").encode() for t in texts], held.value), dtype="float64")

    return p(text)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(sites: DataFrame, mean: str) -> float:
    """Prior strength by moments: how far the sites' shares spread about `mean` beyond what their sizes explain."""
    m = F.col(mean)
    var = m * (1 - m)
    r = sites.where(F.col("n") > 1).agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - m, 2)).alias("between"),
        F.sum("within").alias("within"),
        F.sum(var * F.col("n")).alias("total"),
        F.sum("n").alias("n"),
    ).first()
    if not r["n"] or not r["total"]:
        return STRENGTH[1]
    # E[between] = (spread within a site) per site + n * variance of true shares
    true = max(0.0, (r["between"] - r["within"]) / r["n"])
    return STRENGTH[1] if true <= 0 else min(STRENGTH[1], max(STRENGTH[0], r["total"] / r["n"] / true - 1))


def posteriors(scored: DataFrame, prior: float) -> tuple[DataFrame, float, float]:
    """Host and path sums with prior means: (_host, _path, path_good, path_n, host_good, host_n), and both strengths.

    scored: _host, _path, _p. Sums are combined before the shuffle, so a host with a third of all rows is
    a few partial sums.
    """
    stats = (F.count("*").alias("n"), F.sum("_p").alias("good"), F.coalesce(F.var_samp("_p"), F.lit(0.0)).alias("within"))
    m0 = 1 / (1 + math.exp(-prior))
    paths = scored.groupBy("_host", "_path").agg(*stats)
    paths = materialise(paths, "quality-paths")
    hosts = paths.groupBy("_host").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.avg("within").alias("within")
    ).withColumn("m0", F.lit(m0))
    overall = hosts.agg((F.sum("good") / F.sum("n")).alias("m")).first()["m"]
    m = min(max(overall, 1e-3), 1 - 1e-3) if overall is not None else m0
    k_host = strength(hosts.withColumn("m", F.lit(m)), "m")
    host = hosts.select("_host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), F.lit(m).alias("global_mean"))
    both = paths.join(host, "_host").withColumn("host_mean", (F.col("host_good") + k_host * F.col("global_mean")) / (F.col("host_n") + k_host))
    k_path = strength(both, "host_mean")
    table = both.select("_host", "_path", F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good", "global_mean")
    return table, k_host, k_path


def site_name(c: Column) -> Column:
    """A null host or path is a site of its own, apart from the empty name."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def with_quality(documents: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """`row` (the whole input row, if keep_row), doc_id, evidence, host_posterior, path_posterior, score."""
    spark = documents.sparkSession
    model = fit(training_rows(documents, labels, "quality", id_col, text_col, SAMPLE_ROWS))
    cols = [whole_row(documents)] if keep_row else []
    scored = materialise(
        documents.select(
            *cols,
            F.col(id_col).cast("long").alias("doc_id"),
            site_name(F.col(host_col)).alias("_host"),
            site_name(F.col(path_col)).alias("_path"),
            probability_column(spark, model, F.col(text_col)).alias("_p"),
        ),
        "quality-scored",
    )
    table, k_host, k_path = posteriors(scored, model.prior)
    joined = join_sized(scored, table, ["_host", "_path"], SITES)
    host = (F.col("host_good") - F.col("_p") + k_host * F.col("global_mean")) / (F.col("host_n") - 1 + k_host)
    path = (F.col("path_good") - F.col("_p") + k_path * F.col("host_posterior")) / (F.col("path_n") - 1 + k_path)
    held = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    return (
        joined.withColumn("host_posterior", held(host))
        .withColumn("path_posterior", held(path))
        .withColumn("evidence", logit(F.col("_p")) - F.lit(model.prior))
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_posterior"))))))
        .select(*(["row"] if keep_row else []), "doc_id", "evidence", "host_posterior", "path_posterior", "score")
    )


def quality(documents: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score (0 to 1), predicted (1 from THRESHOLD on), one row a document.

    The classifier is fitted on at most SAMPLE_ROWS labelled rows whose crc32(id as text) mod 3 is not
    1; site sums are over all documents.

    Defined cases: a null or empty text has the features of no text; a null host or path is a site of its
    own; null and repeated ids are kept; without labels of both kinds every text has the same evidence;
    an empty table gives no rows; other columns are not looked at.
    """
    out = with_quality(documents, labels, host_col, path_col, id_col, text_col)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score from `threshold` on, with all their columns as they were.

    Defined cases: as for quality(); rows stay or go each by itself, repeated ids and equal rows too; an empty table gives no
    rows; columns of any name pass through.
    """
    out = with_quality(documents, labels, host_col, path_col, id_col, text_col, keep_row=True)
    return out.where(F.col("score") >= threshold).select("row.*")
