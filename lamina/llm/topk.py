"""Exact top-k search by exhaustive term-at-a-time accumulation over sparse integer rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, clean_vectors, fit_width, most_of_each, search_blocks

#: Quantised components and scores are below this magnitude, or the query fails.
LARGEST = 1 << 63
#: A term that one row in so many has is accumulated over all rows.
COMMON = 4
#: Rows of a block that a query's list takes in unsorted at most.
MOST_HITS = 64


def postings_of(m: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term (dimension) the rows that have it and their weights; None for all rows."""
    out = []
    for term in np.ascontiguousarray(m.T):
        at = np.flatnonzero(term)
        out.append((None, term) if len(at) == len(term) else (at, term[at]))
    return out


def accumulate(query: np.ndarray, postings: list, n: int) -> np.ndarray:
    """Scatter each term's weighted postings of one sparse query into a dense score array."""
    scores = np.zeros(n, dtype=query.dtype)
    for term in np.flatnonzero(query):
        at, weight = postings[term]
        if at is None:
            scores += query[term] * weight
        else:
            scores[at] += query[term] * weight  # a row stands once in a posting list
    return scores


def terms_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """The terms that most rows have and their weights, a row a term; and of each other term its number, rows and weights."""
    common = np.count_nonzero(m, axis=0) * COMMON >= len(m)
    rare = [(t, *p) for t, p in zip(np.flatnonzero(~common), postings_of(m[:, ~common]), strict=True)]
    return common, np.ascontiguousarray(m[:, common].T), rare


def accumulate_all(queries: np.ndarray, common: np.ndarray, weights: np.ndarray, rare: list) -> np.ndarray:
    """accumulate() for several queries at once: a row of scores each.

    Each common term adds the product of its weights in the queries and in all rows to the whole array, one term after another within
    a matrix product; a rare term is scattered to the rows that have it. All sums must be exact in the kind of the arrays.
    """
    scores = queries[:, common] @ weights
    for term, at, weight in rare:
        if queries[:, term].any():
            scores[:, slice(None) if at is None else at] += queries[:, [term]] * weight
    return scores


def whole(m: np.ndarray) -> np.ndarray:
    """Whole numbers as longs where all of them fit, else as Python's unbounded integers."""
    return m.astype(np.int64) if np.abs(m).max(initial=0.0) < LARGEST else np.frompyfunc(int, 1, 1)(m)


def exact_topk(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query.

    vectors: vec_id, embedding. Each component x becomes floor(scale * x). Queries
    are the rows whose id is divisible by query_every; candidates are all rows with another id.
    A component or a score that fits no long fails the query.

    Defined cases: rows with a null id, a null vector or a null or non-finite component take no part;
    an empty vector scores 0; of vectors of unlike lengths the shorter is padded with zeros; ties go to
    the smaller id; an id in several rows is one query (its smallest quantised vector) and, as a candidate,
    stands once in a result, with its best score, so that every query gets its k best ids; an empty table gives no rows; other
    columns are not looked at.
    """

    def quantised(x: Column) -> Column:
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(float(LARGEST)), F.floor(y).cast("double")).otherwise(F.raise_error(F.lit("a component fits no long")).cast("double"))

    clean = clean_vectors(vectors).select("vec_id", F.transform("v", quantised).alias("v"))

    def prepare(ids: np.ndarray, m: np.ndarray) -> tuple:
        return m, np.abs(m).max(initial=0.0), {}

    def kernel(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, prepared: tuple, least: np.ndarray) -> tuple:
        m, largest, made = prepared
        # What one side has beyond the other's width meets zeros.
        q = fit_width(q, m.shape[1])
        sums = np.abs(q).sum(axis=1).max(initial=0.0) * largest
        for bits, kind in ((24, np.float32), (53, np.float64)):
            if sums < 1 << bits:  # every sum on the way is a whole number that the kind holds, in whatever order
                if kind not in made:
                    made[kind] = terms_of(m.astype(kind))
                scores = accumulate_all(q.astype(kind), *made[kind])
                qi, ci = most_of_each(scores, ids, qids, least.astype(kind), max(k, MOST_HITS))
                return qi, ci, scores[qi, ci].astype(np.int64)
        columns = whole(m)
        if sums < LARGEST / 2:
            rows, postings = whole(q), postings_of(columns)
        else:  # a sum of products could leave the longs
            exact = np.frompyfunc(int, 1, 1)
            rows, postings = exact(q), postings_of(exact(columns))
        got = []
        for i, row in enumerate(rows):
            scores = accumulate(row, postings, len(ids))
            others = np.flatnonzero(ids != qids[i])
            if scores.dtype == object:
                scores[ids == qids[i]] = 0
            # Unbounded sums that fit no long raise OverflowError here.
            scores = scores.astype(np.int64)
            at = others[best(scores[others], ids[others], k)]
            got.append((np.full(len(at), i), at, scores[at]))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    queries = clean.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    return search_blocks(queries, clean, prepare, kernel, k, "long").withColumn("rank", F.col("rank").cast("int"))
