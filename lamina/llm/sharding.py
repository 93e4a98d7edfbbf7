"""Sharding by longest-processing-time scheduling: groups stay whole, largest first, to the least-loaded shard.

Every group is scheduled. Groups of one size are alike to the schedule, so it runs over the histogram of
group sizes: what a heap would do with a long run of equal groups is found by a level instead of step by step. Groups
of one size are then numbered, and each number belongs to a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Rows numbered in one task, about; the largest broadcast table of groups, sizes or offsets.
NUMBERED, BROADCAST_ROWS = 100_000, 100_000


def by_heap(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of n units of one size each shard gets, one after another: each to the least-loaded shard (ties to the smaller number)."""
    heap = [(int(x), s) for s, x in enumerate(loads)]
    heapq.heapify(heap)
    got = np.zeros(len(loads), dtype=np.int64)
    for _ in range(n):
        load, s = heap[0]
        got[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return got


def by_level(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """What by_heap gives, in a time that does not grow with n: the heap takes the n smallest of the loads
    x, x + size, x + 2 size, ... of all shards. Below a level each shard's number of these is known; the last few go by the heap."""
    below = lambda level: np.maximum(0, -((loads - level) // size))
    low, high = int(loads.min()), int(loads.max()) + size * (n // len(loads) + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if below(middle).sum() <= n else (low, middle - 1)
    got = below(low)
    return got + by_heap(loads + got * size, size, n - int(got.sum()))


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> dict[int, np.ndarray]:
    """Size -> how many of its groups each shard gets, from (size, groups): sizes fall, each group goes to the least-loaded shard."""
    loads = np.zeros(shards, dtype=np.int64)
    out = {}
    for size, n in sorted(histogram, reverse=True):
        got = (by_heap if n <= 8 * shards else by_level)(loads, size, n)
        loads += got * size
        out[size] = got
    return out


def digits(md5: Column, first: int) -> Column:
    """15 hex digits of an MD5 as a long below 2 ** 60."""
    return F.conv(F.substring(md5, first, 15), 16, 10).cast("long")


def sized(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """A join whose right side, of at most so many rows, is broadcast if these are few."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, "left")


def numbered(df: DataFrame, group: str, sizes: DataFrame, groups: int, rows: int, key: str, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: gapless from 0 within each group in order of the hash `key` (below 2 ** 60) and then `order`, though a group may be a
    third of all rows.

    sizes: group and n, its rows; groups, rows: how many there are in all. Rows are numbered inside stretches of the key, one for every NUMBERED rows of the group; a
    stretch starts after the rows of those before it.
    """
    many = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(NUMBERED)))
    stretch = F.least(F.greatest(F.floor(F.col(key) / float(1 << 60) * many), F.lit(0)), many - 1)
    dealt = sized(df, sizes.select(group, F.col("n").alias("_n")), [group], groups).withColumn("_stretch", stretch.cast("int"))
    counts = dealt.groupBy(group, "_stretch").agg(F.count("*").alias("_count"))
    before = W.partitionBy(group).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(group, "_stretch", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(group, "_stretch").orderBy(key, *order)
    out = sized(dealt.withColumn("_inside", F.row_number().over(inside) - 1), offsets, [group, "_stretch"], groups + rows // NUMBERED)
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_n", "_stretch", "_inside", "_before")


def lpt_shards(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: sizes near equal over the shards, equal texts together.

    A document's size is its text's UTF-8 bytes plus 8. Groups of equal texts (known by 120 bits of their MD5
    and their size) stay whole, and each is scheduled by its bytes. The driver holds the histogram of group sizes: of T bytes in
    all there are at most sqrt(2 T) different ones. A group larger than
    an even share fills its shard alone; that is the least maximum possible while it stays whole.

    Defined cases: a null text has size 8 and crc null, and null texts are one group; an empty text has
    size 8 and crc 0; null and repeated ids are kept as rows; groups of equal size go by their hash, and so do the slots of a shard's rows;
    an empty table gives no rows; other columns are not looked at.
    """
    text = F.col(text_col)
    digest = materialise(
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(-1)).alias("crc"),
            F.coalesce(digits(F.md5(text), 1), F.lit(-1)).alias("h"),
            F.coalesce(digits(F.md5(text), 16), F.lit(-1)).alias("i"),
        ),
        "shard-digest",
    )
    key = ["h", "i", "size"]
    groups = materialise(digest.groupBy(*key).agg(F.count("*").alias("rows")).withColumn("bytes", F.col("rows") * F.col("size")), "shard-groups")
    sizes = materialise(groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")), "shard-sizes")
    histogram = [(r["bytes"], r["n"], r["rows"]) for r in sizes.toLocalIterator()]
    n_groups, n_rows = sum(n for _, n, _ in histogram), sum(n for _, _, n in histogram)
    plan = schedule(((size, n) for size, n, _ in histogram), shards)
    # Numbers from the start of a stretch on belong to its shard.
    stretches = ((int(b), (np.cumsum(got) - got)[got > 0].tolist(), np.flatnonzero(got).tolist()) for b, got in plan.items())
    starts = documents.sparkSession.createDataFrame(list(stretches), "bytes long, starts array<long>, of array<int>")
    ranked = sized(numbered(groups, "bytes", sizes, len(plan), n_groups, "h", [F.col("i"), F.col("size")], "number"), starts, ["bytes"], len(plan))
    stretch = F.size(F.filter("starts", lambda s: s <= F.col("number")))
    placed = materialise(sized(digest, ranked.select(*key, F.element_at("of", stretch).alias("shard")), key, n_groups), "shard-placed")
    rows = placed.groupBy("shard").agg(F.count("*").alias("n"))
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("crc").cast("string"), F.col("size").cast("string"))
    dealt = placed.withColumn("key", digits(F.md5(row), 1))
    return numbered(dealt, "shard", rows, shards, n_rows, "key", [F.col("doc_id"), F.col("crc"), F.col("size")], "slot").select(
        "doc_id", "size", F.when(F.col("crc") >= 0, F.col("crc")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The schedule walked group by group, in order of size and hash. Groups of one size hold the shards that the heap gave them in the shards' order.
ORACLE = """
WITH RECURSIVE bytes AS (SELECT list(x ORDER BY n) AS t FROM (SELECT n, list_reduce(range(0, 8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n::BIGINT) AS x FROM range(0, 256) r(n))),
digest AS (SELECT doc_id, (coalesce(strlen(text), 0) + 8)::BIGINT AS size,
    CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) END AS crc,
    coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS h, coalesce(('0x' || substr(md5(text), 16, 15))::BIGINT, -1) AS i FROM documents, bytes),
groups AS (SELECT h, i, size, count(*) * size AS bytes, row_number() OVER (ORDER BY count(*) * size DESC, h, i, size) AS n FROM digest GROUP BY h, i, size),
walk AS (SELECT 0::BIGINT AS n, 0::BIGINT AS bytes, list_transform(range(0, 24), lambda s: 0::BIGINT) AS loads, 0 AS shard
  UNION ALL SELECT g.n, g.bytes, list_transform(loads, lambda x, s: CASE WHEN s = list_position(loads, list_min(loads)) THEN x + g.bytes ELSE x END), list_position(loads, list_min(loads)) - 1 FROM walk w JOIN groups g ON g.n = w.n + 1),
given AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS k FROM walk WHERE n > 0),
placed AS (SELECT g.h, g.i, g.size, d.shard FROM (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY h, i, size) AS k FROM groups) g JOIN given d USING (bytes, k)),
keyed AS (SELECT d.*, p.shard, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(crc, -1) || ':' || d.size), 1, 15))::BIGINT AS key FROM digest d JOIN placed p USING (h, i, size))
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST, crc NULLS FIRST, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM keyed
"""
