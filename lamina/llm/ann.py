"""Approximate nearest neighbours by additive quantisation of unit vectors.

A code is one codeword from each of M full-dimensional codebooks; their sum approximates the vector.
Codebooks start from residual k-means, codes come from beam search, and codebooks can be solved
for jointly by least squares. Scanning adds M table entries a candidate and divides by the stored norm;
the best of a block are reranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import clean_vectors, fit_width, most_of_each, search_blocks

#: The fit's sample: at most so many vectors, those of the smallest hashed ids, and at most so many numbers (but 256 vectors).
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 1 << 21
#: Rows of the sample whose scans of each other give the margin; candidates of which `rerank` are scored exactly at most; pairs scored at a time.
MARGIN_ROWS, RERANK_ROWS, PAIRS = 2_048, 4_096, 1 << 15
#: Candidates that are scanned at a time.
SCAN_ROWS = 2_048


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # M x K x d


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so that squares cannot overflow."""
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), np.finfo(np.float64).tiny) if m.size else m
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), np.finfo(np.float64).tiny)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rule; an empty cluster takes a random row."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def encode(x: np.ndarray, books: Codebooks, beam: int) -> np.ndarray:
    """Beam search: keep the `beam` partial sums nearest to each vector, extend by each codebook in turn."""
    x = x.astype(np.float32)
    n, k = len(x), books.words.shape[1]
    rest = x[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.int64)
    errors = np.zeros((n, 1), dtype=np.float32)  # |x - sum|^2 - |x|^2
    every = np.arange(n)
    for words in books.words.astype(np.float32):
        total = rest @ (-2 * words.T)
        total += (words * words).sum(axis=1)
        total += errors[:, :, None]
        total = total.reshape(n, -1)
        keep = min(beam, total.shape[1])
        top, errors = np.empty((n, keep), dtype=np.int64), np.empty((n, keep), dtype=np.float32)
        for b in range(keep):  # a few passes for the least cost less than a partition
            top[:, b] = total.argmin(axis=1)
            errors[:, b] = total[every, top[:, b]]
            total[every, top[:, b]] = np.inf
        codes = np.concatenate([np.take_along_axis(codes, (top // k)[:, :, None], axis=1), (top % k)[:, :, None]], axis=2)
        rest = np.take_along_axis(rest, (top // k)[:, :, None], axis=1) - words[top % k]
    return codes[every, errors.argmin(axis=1)]


def fit(sample: np.ndarray, books: int = 16, words: int = 256, beam: int = 4, rounds: int = 0, seed: int = 7) -> Codebooks:
    """Residual k-means, then rounds of beam encoding and a joint least-squares solution of all codebooks.

    A round holds several (books * words) squared matrices on the driver, so none is run by default."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(sample)))
    rest, made = sample.copy(), []
    for _ in range(books):
        c = k_means(rest, words, rng)
        made.append(c)
        rest = rest - c[(rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)]

    out = Codebooks(np.stack(made))
    for _ in range(rounds):
        codes = np.concatenate([encode(part, out, beam) for part in np.array_split(sample, max(1, len(sample) // 1024))])
        place = codes + np.arange(books) * words
        normal = np.zeros((books * words, books * words))
        for a in range(books):
            for b in range(books):
                np.add.at(normal, (place[:, a], place[:, b]), 1.0)
        right = np.zeros((books * words, sample.shape[1]))
        for a in range(books):
            np.add.at(right, place[:, a], sample)
        ridge = 1e-3 * len(sample) / words
        start = out.words.reshape(-1, sample.shape[1])
        solved = np.linalg.solve(normal + ridge * np.eye(len(normal)), right + ridge * start)
        out = Codebooks(solved.reshape(books, words, -1))
    return out


def sampled(clean: DataFrame, n: int, most: int) -> list:
    """At most so many rows, those of the smallest hashes of id and vector. Rows that cannot be among them are left out where they are
    read: of n rows about twice as many are looked at, so what reaches the driver does not grow with the tasks."""
    place = (F.xxhash64("vec_id", "v").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    part = 2.0 * most / max(n, 1)
    while True:
        some = clean.where(place < part) if part < 1 else clean
        rows = some.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).collect()
        if len(rows) >= 256 or part >= 1:
            return rows
        part *= 16  # one row repeated takes up most of the table


def coded(x: np.ndarray, books: Codebooks, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: codes, one byte a codebook, and the norms of what they stand for."""
    d = books.words.shape[2]
    codes = np.concatenate([encode(p[:, :d], books, beam) for p in np.array_split(x, max(1, len(x) // 512))])
    approx = sum(books.words[j][codes[:, j]] for j in range(len(books.words)))
    return codes.astype(np.uint8), np.maximum(np.sqrt((approx * approx).sum(axis=1)), 1e-12)


def scanned(uq: np.ndarray, books: Codebooks, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Approximate cosines, a row a query: of each code its entry in the query's table, added up codebook by codebook. Tables lie with
    the queries side by side, so that one look-up serves all of them."""
    n_books, n_words, d = books.words.shape
    tables = (books.words.reshape(-1, d).astype(np.float32) @ np.ascontiguousarray(uq[:, :d].T, dtype=np.float32)).reshape(n_books, n_words, len(uq))
    near = np.empty((len(uq), len(norm)), dtype=np.float32)
    for a in range(0, len(norm), SCAN_ROWS):
        part = codes[:, a : a + SCAN_ROWS]
        total = tables[0].take(part[0], axis=0)
        entry = np.empty_like(total)
        for j in range(1, n_books):
            tables[j].take(part[j], axis=0, out=entry, mode="clip")
            total += entry
        total /= norm[a : a + SCAN_ROWS, None]
        near[:, a : a + SCAN_ROWS] = total.T
    return near


def margin_of(sample: np.ndarray, books: Codebooks, beam: int) -> float:
    """The most that a scan of the sample for its own vectors misses a cosine by."""
    codes, norm = coded(sample, books, beam)
    return float(np.abs(scanned(sample, books, np.ascontiguousarray(codes.T), norm.astype(np.float32)) - sample @ sample.T).max(initial=0.0)) + 1e-6


def additive_search(
    vectors: DataFrame, k: int = 5, query_every: int = 50, books: int = 16, words: int = 256, beam: int = 4, rerank: int = 64
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine, scores exact in double precision.

    vectors: vec_id, embedding. Queries are the rows whose id is divisible by query_every; candidates
    all rows with another id. words is at most 256, so that a code is a byte. Codebooks are fitted on at most SAMPLE_ROWS vectors and SAMPLE_NUMBERS numbers; every vector is
    encoded, scanned and may be reranked (`rerank` of each 4,096 candidates).

    Defined cases: rows with a null id, a null, empty or zero vector or a null or non-finite component
    take no part; shorter vectors are padded with zeros; ties go to the smaller id; an id in several
    rows is one query (its smallest vector) and, as a candidate, stands once in a result, with its best score; an empty table
    gives no rows; other columns are not looked at.

    A block's vectors are encoded once, scanned for all queries and reranked on the spot. Once a query has its k, only what the
    scan puts within a margin of the worst of them is reranked; the margin is the largest error of a scan seen on the sample.
    """
    clean = clean_vectors(vectors, nonzero=True)
    n, width = clean.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    rows = sampled(clean, n, max(256, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width)))
    sample = unit(np.array([r.v + [0.0] * (width - len(r.v)) for r in rows], dtype=np.float64).reshape(len(rows), width))
    fitted = fit(sample, books, words, beam) if rows else None
    model = clean.sparkSession.sparkContext.broadcast((fitted, margin_of(sample[:MARGIN_ROWS], fitted, beam))) if rows else None

    def prepare(ids: np.ndarray, m: np.ndarray) -> tuple:
        """Original and unit vectors, their lengths, codes a row a codebook, norms of their approximations, whether an id stands twice."""
        m = fit_width(m, max(m.shape[1], width))
        x = unit(m)
        codes, norm = coded(x, model.value[0], beam)
        return m, x, np.sqrt((m * m).sum(axis=1)), np.ascontiguousarray(codes.T), norm.astype(np.float32), bool((ids[1:] == ids[:-1]).any())

    def kernel(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, prepared: tuple, least: np.ndarray) -> tuple:
        m, x, length, codes, norm, several = prepared
        books_, margin = model.value
        w = max(q.shape[1], m.shape[1])
        q, m, x = fit_width(q, w), fit_width(m, w), fit_width(x, w)
        uq = unit(q)
        near = scanned(uq, books_, codes, norm)
        qi, ci = most_of_each(near, ids, qids, (least - margin).astype(np.float32), rerank * math.ceil(len(ids) / RERANK_ROWS))
        if several:  # every row of the ids found is scored
            found = np.unique(np.stack([qi, np.searchsorted(ids, ids[ci])], axis=1), axis=0) if len(qi) else np.zeros((0, 2), dtype=np.int64)
            rows_ = np.searchsorted(ids, ids[found[:, 1]], side="right") - found[:, 1]
            qi = np.repeat(found[:, 0], rows_)
            ci = np.repeat(found[:, 1] - np.cumsum(rows_) + rows_, rows_) + np.arange(rows_.sum())
        own = np.sqrt((q * q).sum(axis=1))
        exact = np.empty(len(qi))
        for a in range(0, len(qi), PAIRS):
            r, c = qi[a : a + PAIRS], ci[a : a + PAIRS]
            odd = (own[r] > 1e150) | (own[r] < 1e-150) | ~np.isfinite(length[c]) | (length[c] < 1e-150)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                some = (m[c] * q[r]).sum(axis=1) / (length[c] * own[r])
            if odd.any():
                some[odd] = (x[c[odd]] * uq[r[odd]]).sum(axis=1)
            exact[a : a + PAIRS] = some
        better = exact >= least[qi]
        return qi[better], ci[better], exact[better]

    queries = clean.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    return search_blocks(queries, clean, prepare, kernel, k, "double").withColumn("rank", F.col("rank").cast("int"))
