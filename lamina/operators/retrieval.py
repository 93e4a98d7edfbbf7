"""Exact per-size top-k search for a batch of queries, rank fusion, and the closure of ancestors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreUnavailable, ValidationError
from ..grid import DEFAULT_GRID, Grid
from ..sources.shared import few, materialise
from .slicing import KEY

#: Queries whose vectors are sent to every task at most; more of them meet the points block by block in a join.
MOST_QUERIES = 4_096
#: Points and queries of a block in that join; groups that query blocks are copied to, at least and for each core.
POINT_ROWS, QUERY_ROWS, GROUPS, GROUPS_PER_CORE = 8_192, 1_024, 256, 4
#: Rows of finds (keys and a score) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: What the rounding of a matrix product can move a cosine by, at most; pairs whose products are added up in order at a time.
MARGIN, PAIRS = 1e-9, 1 << 18


def left_fold(m: np.ndarray) -> np.ndarray:
    """Row sums added from left to right, as a fold over an array column does."""
    out = np.zeros(len(m))
    for col in np.ascontiguousarray(m.T):
        out += col
    return out


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as a matrix; lists of unlike lengths are an error."""
    lengths = np.asarray(vectors.value_lengths())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of unlike lengths")
    return np.asarray(vectors.flatten()).reshape(len(lengths), -1 if len(lengths) else 0)


def exact_cosines(q: np.ndarray, m: np.ndarray, qi: np.ndarray, mi: np.ndarray, q_norm: np.ndarray, m_norm: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (qi, mi), products added from left to right; 0 where either is zero. Equal rows give equal numbers."""
    out = np.empty(len(qi))
    for a in range(0, len(qi), PAIRS):
        x, y = qi[a : a + PAIRS], mi[a : a + PAIRS]
        norm = m_norm[y] * q_norm[x]
        dots = left_fold(m[y] * q[x])
        with np.errstate(divide="ignore", invalid="ignore"):
            out[a : a + PAIRS] = np.where(norm == 0, 0.0, dots / norm)
    return out


def near_pairs(q: np.ndarray, m: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of all pairs that may be among a query's k best: by a matrix product, with a margin for its rounding.

    own: query x point, pairs that are left out.
    """
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(np.float64).tiny)
    near = unit(q) @ unit(m).T
    if own is not None:
        near[own] = -np.inf
    if k < near.shape[1]:
        near = np.where(near < np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]] - MARGIN, -np.inf, near)
    return np.nonzero(near > -np.inf)


def k_best(q: np.ndarray, m: np.ndarray, ties: np.ndarray, groups: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score): for each query and group the k points of largest cosine, ties to the smaller tie."""
    q_norm, m_norm = np.sqrt(left_fold(q * q)), np.sqrt(left_fold(m * m))
    found = []
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        qi, mi = near_pairs(q, m[at], k, None if own is None else own[:, at])
        mi = at[mi]
        s = exact_cosines(q, m, qi, mi, q_norm, m_norm)
        order = np.lexsort((ties[mi], -s, qi))
        qi, mi, s = qi[order], mi[order], s[order]
        starts = np.searchsorted(qi, np.arange(len(q)))
        kept = np.arange(len(qi)) - starts[qi] < k
        found.append((qi[kept], mi[kept], s[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(
    queries: DataFrame, points: DataFrame, k: int = 10, *, groups: tuple[str, ...] = ("size",), tie: str = "point_id", keep: tuple[str, ...] = (), exclude_same: str | None = None
) -> DataFrame:
    """query_id, *groups, *keep, tie, score, rank: the k points of largest cosine, for each query and group.

    queries: query_id, vector. points: *groups, *keep, tie, vector. Up to MOST_QUERIES queries are sent to every task and points
    stay where they are; a larger batch is cut into blocks that are dealt, as the points' blocks are, to groups of a join, so no
    task or driver holds them all. Either way a block of points gives its own k best, so at most k rows a query and group
    leave it; a window over these picks the k of all. Order: score descending, tie ascending; rank from 0.
    """
    if k < 1:
        raise ValidationError("k is at least 1")
    spark = queries.sparkSession
    q_type = queries.schema["query_id"].dataType
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    named = [*groups, *keep, tie]
    own = points.select(*named, F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("query_id", q_type), *(own.schema[c] for c in named), T.StructField("score", T.DoubleType())])

    def score(q_ids: pa.Array, q: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        m = matrix(batch.column("vector"))
        if len(q) and m.shape[1] != q.shape[1]:
            raise ValueError("vectors of unlike lengths")
        ties = batch.column(tie)
        ties = np.array(ties.to_pylist(), dtype=str) if pa.types.is_string(ties.type) else np.asarray(ties)
        codes = np.zeros(len(m), dtype=np.int64)
        for g in groups:
            _, code = np.unique(np.asarray(batch.column(g).to_pandas()), return_inverse=True)
            codes = codes * (code.max() + 1) + code
        same = np.asarray(q_ids.to_pandas())[:, None] == np.asarray(batch.column(exclude_same).to_pandas())[None, :] if exclude_same else None
        qi, mi, s = k_best(q, m, ties, codes, k, same)
        cols = [q_ids.take(pa.array(qi)), *(batch.column(c).take(pa.array(mi)) for c in named), pa.array(s)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    first = asked.limit(MOST_QUERIES + 1).collect()
    if len(first) <= MOST_QUERIES:
        ids = [r["query_id"] for r in first]
        held = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in first], dtype=np.float64)))

        def among(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            ids, q = held.value
            for batch in it:
                if batch.num_rows and ids:
                    yield score(pa.array(ids, to_arrow_type(q_type)), q, batch)

        found = own.mapInArrow(among, schema)
    else:
        found = block_join(asked, own, score, schema)
    order = W.partitionBy("query_id", *groups).orderBy(F.desc("score"), F.asc(tie))
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def in_blocks(df: DataFrame, rows: int) -> DataFrame:
    """(block): the rows as Arrow streams of at most so many rows each."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(a, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return df.mapInArrow(pack, "block binary")


def opened(block: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(block)))


def block_join(queries: DataFrame, points: DataFrame, score: Callable, schema: T.StructType) -> DataFrame:
    """score() of every block of queries with every block of points: point blocks are dealt over groups, query blocks copied to each.

    The groups are bounded by the cluster's size, so what is copied is too. A point block's pairs follow one another, and it is opened once.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(math.ceil(points.count() / POINT_ROWS), max(GROUPS, GROUPS_PER_CORE * cores)))
    dealt = in_blocks(points, POINT_ROWS).withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    copied = in_blocks(queries, QUERY_ROWS).select(F.col("block").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch = None, None
        for pairs in it:
            for p, a in zip(pairs.column("block"), pairs.column("asked"), strict=True):
                if last is None or not p.as_buffer().equals(last):
                    last, batch = p.as_buffer(), opened(p.as_py())
                q = opened(a.as_py())
                yield score(q.column("query_id"), matrix(q.column("vector")), batch)

    return dealt.join(copied, "g").select("block", "asked").mapInArrow(meet, schema)


def attach(found: DataFrame, slices: DataFrame) -> DataFrame:
    """Found keys with all columns of their slices but the vector. The finds (written, k a query and size) are sent to the slices
    if they are few."""
    return slices.drop("vector").join(F.broadcast(found) if few(found, BROADCAST_ROWS) else found, [*KEY, "point_id"])


def search_sizes(
    queries: DataFrame, points: DataFrame, sizes: tuple[int, ...], k: int, *, keep: tuple[str, ...] = ("document_id", "codepoint_offset"), timeout: float | None = None
) -> tuple[DataFrame, dict[int, str]]:
    """(finds, written; size -> why it could not be searched).

    All sizes are searched in one job. If that fails, or a time limit (seconds a size) is set, each size is a job of its own, all at
    once, and those that fail or take too long are named instead of failing the rest. No size at all is an error.
    """
    spark = queries.sparkSession

    def one(some: tuple[int, ...]) -> DataFrame:
        return materialise(search(queries, points.where(F.col("size").isin(*some)), k, keep=keep), "found")

    if timeout is None:
        try:
            return one(sizes), {}
        except ValidationError:
            raise
        except Exception:  # found out size by size below
            pass

    def alone(size: int) -> DataFrame:
        spark.sparkContext.setJobGroup(f"lamina-search-{id(points)}-{size}", f"search of size {size}", True)
        return one((size,))

    found, errors = [], {}
    pool = ThreadPoolExecutor(len(sizes))
    waiting = {s: pool.submit(inheritable_thread_target(alone), s) for s in sizes}
    for s, job in waiting.items():
        try:
            found.append(job.result(timeout))
        except TooLate:
            spark.sparkContext.cancelJobGroup(f"lamina-search-{id(points)}-{s}")
            errors[s] = f"no answer within {timeout} s"
        except Exception as e:
            errors[s] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    pool.shutdown(wait=False)
    if not found:
        raise StoreUnavailable("no size of the corpus can be searched: " + "; ".join(f"{s}: {e}" for s, e in errors.items()))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, errors


def fan_out(queries: DataFrame, sizes: tuple[int, ...], found: DataFrame, errors: dict[int, str] | None = None) -> DataFrame:
    """query_id, size, status, hits, error for each query and asked size; raises if no size could be searched."""
    errors = errors or {}
    if all(s in errors for s in sizes):
        raise StoreUnavailable("no size of the corpus can be searched")
    rows = [(s, "error" if s in errors else "ok", errors.get(s)) for s in sizes]
    asked = F.broadcast(queries.sparkSession.createDataFrame(rows, "size int, status string, error string"))
    counted = found.groupBy("query_id", "size").agg(F.count("*").alias("hits"))
    each = queries.select("query_id", F.explode(F.array(*(F.lit(s) for s in sizes))).alias("size")).join(asked, "size")
    return each.join(counted, ["query_id", "size"], "left").select("query_id", "size", "status", F.coalesce("hits", F.lit(0)).alias("hits"), "error")


def resolve_sizes(grid: Grid, asked: list[int] | None) -> tuple[tuple[int, ...], list[str]]:
    """Sizes in grid order and warnings; nothing known means all sizes."""
    if asked is None:
        return grid.sizes, []
    warnings = [f"size {s} is not in the grid" for s in asked if s not in grid]
    kept = tuple(s for s in grid.sizes if s in asked)
    if not kept:
        return grid.sizes, [*warnings, "no asked size is in the grid; all sizes are searched"]
    return kept, warnings


def cap_budget(budget: int | None, most: int) -> tuple[int | None, list[str]]:
    if budget is None:
        return None, []
    return (most, [f"budget {budget} held to {most}"]) if budget > most else (budget, [])


def tier_interleave(hits: DataFrame) -> DataFrame:
    """Adds fused_rank: the best of each size, then the second of each, and so on; scores are never compared across sizes."""
    tier = F.row_number().over(W.partitionBy("query_id", "size").orderBy(F.col("score").desc_nulls_last(), "point_id"))
    place = W.partitionBy("query_id").orderBy("tier", *[c for c in ("size", "document_id", "codepoint_offset")])
    return hits.withColumn("tier", tier).withColumn("fused_rank", F.row_number().over(place) - 1).drop("tier")


def raw_score_pool(hits: DataFrame) -> DataFrame:
    """Adds fused_rank by raw score over all sizes (experimental)."""
    place = W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "size", "document_id", "codepoint_offset")
    return hits.withColumn("fused_rank", F.row_number().over(place) - 1)


FUSIONS = {"tier_interleave": tier_interleave, "raw_score_pool": raw_score_pool}


def closure_keys(hits: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """(query_id, document_id, size, codepoint_offset) of all grid ancestors of hits that are no hits themselves."""
    own = hits.select("query_id", *KEY)
    up = own.select("query_id", "document_id", F.explode(grid.ancestors_column(F.col("size"), F.col("codepoint_offset"))).alias("a"))
    wanted = up.select("query_id", "document_id", "a.size", "a.codepoint_offset").distinct()
    return wanted.join(own, ["query_id", *KEY], "left_anti")


def fetch(keys: DataFrame, slices: DataFrame) -> DataFrame:
    """Slices at the keys' coordinates; unknown ones are left out."""
    return keys.join(slices, KEY)
