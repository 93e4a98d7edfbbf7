"""Vectors in blocks: a batch of queries meets the candidates where they lie, block by block, so each task sees bounded matrices."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_batches, materialise

#: Rows and numbers of a block of candidates at most, and rows of a task's first one, whose scores are all looked at; queries that meet it at a time.
CANDIDATE_ROWS, CANDIDATE_NUMBERS, FIRST_ROWS, QUERY_ROWS = 16_384, 1 << 20, 1_024, 64
#: Numbers (8 bytes each) of the queries that are sent to the tasks at once; more queries are searched batch after batch.
SENT_NUMBERS = 1 << 22
#: Tasks a core at most: each starts its best lists anew.
TASKS_PER_CORE = 4


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part; with nonzero
    set, nor do vectors of zeros (the empty vector included).
    """
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    return out.where(F.exists("v", lambda x: x != 0)) if nonzero else out


def blocks_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of (vec_id, v), in order of id within a block; shorter vectors are padded with zeros. Blocks grow fourfold."""
    held, rows, numbers, most = [], 0, 0, min(FIRST_ROWS, CANDIDATE_ROWS)
    for batch in it:
        at = 0
        while at < batch.num_rows:
            ids, m = unpack(part := batch.slice(at, most - rows))
            held.append((ids, m))
            at, rows, numbers = at + part.num_rows, rows + part.num_rows, max(numbers, m.shape[1])
            if rows >= most or rows * numbers >= CANDIDATE_NUMBERS:
                yield joined(held)
                held, rows, numbers, most = [], 0, 0, min(4 * most, CANDIDATE_ROWS)
    if held:
        yield joined(held)


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix; shorter vectors are padded with zeros."""
    col = batch.column("v")
    n, v = np.asarray(col.value_lengths()), np.asarray(col.flatten(), dtype=np.float64)
    width = int(n.max()) if len(n) else 0
    if len(v) == len(n) * width:
        m = v.reshape(len(n), width)
    else:
        m = np.zeros((len(n), width))
        m[np.arange(width)[None, :] < n[:, None]] = v
    return np.asarray(batch.column("vec_id"), dtype=np.int64), m


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as one, in order of id."""
    width = max(m.shape[1] for _, m in parts)
    ids, m = np.concatenate([i for i, _ in parts]), np.concatenate([fit_width(m, width) for _, m in parts])
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def fit_width(m: np.ndarray, width: int) -> np.ndarray:
    """The matrix with exactly so many columns, zeros added or the last ones left out."""
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of different ids, ties to the smaller id: partition selection, then an order of what is left.

    Where an id stands in several rows its best one counts; the selection grows until it holds k ids.
    """
    if k <= 0 or not len(scores):
        return np.zeros(0, dtype=np.int64)
    wanted = k
    while True:
        if wanted < len(scores):
            least = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
            at = np.flatnonzero(scores >= least)
        else:
            at = np.arange(len(scores))
        at = at[np.lexsort((ids[at], -scores[at]))]
        first = np.sort(np.unique(ids[at], return_index=True)[1])
        if len(first) >= k or wanted >= len(scores):
            return at[first[:k]]
        wanted *= 4


def most_of_each(near: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the scores (a row a query) that reach the query's least, its own id left out.

    ids are in order. Where more than k reach it, those of the k best ids, ties to the smaller.
    """
    n = near.shape[1]
    reach = (near >= least[:, None]).ravel()
    if len(reach) % 8 == 0:  # few do: eight are looked at in one
        at = (np.flatnonzero(reach.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        at = at[reach[at]]
    else:
        at = np.flatnonzero(reach)
    qi, ci = np.divmod(at, n)
    kept = ids[ci] != own[qi]
    qi, ci = qi[kept], ci[kept]
    counts = np.bincount(qi, minlength=len(near))
    if (counts <= k).all():
        return qi, ci
    starts = np.concatenate([[0], np.cumsum(counts)])
    out_q, out_c = [], []
    for i in np.flatnonzero(counts):
        at = ci[starts[i] : starts[i + 1]]
        if len(at) > k:
            at = at[best(near[i, at], ids[at], k)]
        out_q.append(np.full(len(at), i))
        out_c.append(at)
    return np.concatenate(out_q), np.concatenate(out_c)


class BestLists:
    """The k best ids of each query so far, an id once, with its best score; least: what a score must reach to change a list."""

    def __init__(self, n: int, k: int, dtype: type) -> None:
        lowest = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self.k, self.count, self.least = k, np.zeros(n, dtype=np.int64), np.full(n, lowest, dtype=dtype)
        self.ids, self.scores = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=dtype)

    def add(self, qi: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(qi):
            return
        rows = np.unique(qi)
        r, c = np.nonzero(np.arange(self.k) < self.count[rows][:, None])
        q = np.concatenate([rows[r], qi])
        i = np.concatenate([self.ids[rows[r], c], ids])
        s = np.concatenate([self.scores[rows[r], c], scores.astype(self.scores.dtype)])
        # Ascending by score, so that no score is negated (the least long has no negative); read from behind.
        order = np.lexsort((s, -i, q))[::-1]
        q, i, s = q[order], i[order], s[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])
        q, i, s = q[once], i[once], s[once]
        order = np.lexsort((-i, s, q))[::-1]
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]])))
        kept = place < self.k
        q, i, s, place = q[kept], i[kept], s[kept], place[kept]
        self.ids[q, place], self.scores[q, place] = i, s
        self.count[rows] = np.bincount(q, minlength=len(self.count))[rows]
        full = rows[self.count[rows] == self.k]
        self.least[full] = self.scores[full, self.k - 1]


def dealt(candidates: DataFrame) -> DataFrame:
    """The candidates in tasks that are not many for the cluster; dealt anew only if a few tasks hold most of the rows."""
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    of = candidates.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    r = of.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("tasks")).first()
    if r["tasks"] and r["most"] > max(CANDIDATE_ROWS, 2 * r["n"] / cores):
        return candidates.repartition(TASKS_PER_CORE * cores)
    return candidates.coalesce(TASKS_PER_CORE * cores) if r["tasks"] > TASKS_PER_CORE * cores else candidates


def search_blocks(queries: DataFrame, candidates: DataFrame, prepare: Callable, kernel: Callable, k: int, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query over all candidates.

    prepare(candidate ids, matrix) makes of a block, whose ids are in order, what the kernel needs, once for all queries;
    kernel(query ids, query matrix, candidate ids, prepared, least) gives (query index, candidate index, score) of all candidates that
    may be among the k best ids and whose score reaches the query's `least`, the query's own id left out. An id that stands in several rows is one
    query (its smallest vector) and one candidate (with its best score).

    Candidates stay where they are. Queries are sent to the tasks, at most SENT_NUMBERS numbers at once; further batches are searched
    after that, each written before the next is sent. A task keeps k rows a query of all its blocks, and what they hold spares later blocks most
    of the work. So nothing but k rows a query, task and batch is moved.
    """
    own = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    r = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    batches = max(1, math.ceil(r["n"] * max(r["width"] or 1, 1) / SENT_NUMBERS))
    candidates = dealt(candidates).select("vec_id", "v")
    score_of = np.int64 if score_type == "long" else np.float64

    def one(part: DataFrame) -> tuple[DataFrame, object]:
        rows = part.toArrow().combine_chunks().to_batches()
        ids, m = joined([unpack(b) for b in rows]) if rows and rows[0].num_rows else (np.zeros(0, dtype=np.int64), np.zeros((0, 0)))
        held = part.sparkSession.sparkContext.broadcast((ids, m))

        def score(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            qids, q = held.value
            lists = BestLists(len(qids), k, score_of)
            for ids, m in blocks_of(it):
                ready = prepare(ids, m)
                for a in range(0, len(qids), QUERY_ROWS):
                    b = min(a + QUERY_ROWS, len(qids))
                    qi, ci, s = kernel(qids[a:b], q[a:b], ids, ready, lists.least[a:b])
                    lists.add(qi + a, ids[ci], s)
            for a in range(0, len(qids), 10_000):
                r, c = np.nonzero(np.arange(k) < lists.count[a : a + 10_000, None])
                yield {"query_id": qids[a + r], "vec_id": lists.ids[a + r, c], "score": lists.scores[a + r, c]}

        found = map_batches(candidates, score, f"query_id long, vec_id long, score {score_type}")
        first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score"), held

    if batches == 1:
        return one(own)[0]
    out = None
    for b in range(batches):
        found, held = one(own.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == b))
        found = materialise(found, "nearest")
        held.destroy()
        out = found if out is None else out.unionByName(found)
    return out
