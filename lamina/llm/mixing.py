"""Mixing sources to target weights, with DataFrame operations only.

Words are summed by source; each source's share of the whole follows its weight, but stops at a
multiple of what it holds; the excess is shared out again by weight. The ratio of target to size is
the source's repetition rate: a document is taken floor(rate) times, plus once more if its hashed coin
falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_CLASS, small_enough, whole_row

#: Weights by the source's place in code point order, repeating; the most a source may be repeated;
#: the largest table of sources that is broadcast.
WEIGHTS, MOST, SOURCES = (1, 2, 3), 3, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS)), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: str) -> Column:
    """A number from 0 to 1 fixed by seed, id and text: 48 bits of MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target and rate to (src, source_size): weighted shares of the sum, none above most * source_size.

    Sources in order of cap / weight: while the level that the rest would get by weight is above a
    source's own, it stands at its cap; the first that is not sets the level of all that follow. The two
    windows run over one row a source.
    """
    place = W.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy()
    filling = W.orderBy("ratio", F.col("src").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("k", F.row_number().over(filling))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("k", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("water").isNull() | (F.col("ratio") < F.col("water")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("src", "source_size", "target", "rate")
    )


def rated(documents: DataFrame, keep_row: bool, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """`row` (if keep_row), doc_id, size, source_size, target, copies of every document."""
    cols = [whole_row(documents)] if keep_row else []
    own = documents.select(
        *cols,
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        coin(F.col(id_col), F.col(text_col), seed).alias("u"),
    )
    sizes = documents.groupBy(F.col(source_col).alias("src")).agg(F.sum(word_count(F.col(text_col))).alias("source_size"))
    plan = targets(sizes)
    if small_enough(sizes, SOURCES):
        plan = F.broadcast(plan)
    whole = F.floor("rate")
    return own.join(plan, F.col("source").eqNullSafe(F.col("src")), "left").select(
        *(["row"] if keep_row else []),
        "doc_id", "size", "source_size", "target",
        (whole + (F.col("u") < F.col("rate") - whole).cast("long")).cast("int").alias("copies"),
    )


def mix_plan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (words), one row a document.

    Defined cases: a null or empty text has size 0; null is a source of its own, the last one; a source
    without words has target 0 and its documents are not taken; null and repeated ids are kept, and equal
    rows share a coin; an empty table gives no rows; other columns are not looked at.
    """
    return rated(documents, False, id_col, text_col, source_col, seed).withColumn("taken", F.col("copies") * F.col("size"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns as they were.

    Defined cases: as for mix_plan(); documents without words are taken as often as their source's rate says; columns of any name
    pass through.
    """
    return (
        rated(documents, True, id_col, text_col, source_col, seed)
        .where(F.col("copies") > 0)
        .select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row"))
        .select("row.*")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS weight, source_size * 3 AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT l.*, (SELECT arg_min(level, k) FROM l WHERE ratio >= level) AS water FROM l),
p AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio < water THEN cap::DOUBLE ELSE weight * water END AS target FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, d.u, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies::INTEGER AS copies, (copies * size)::BIGINT AS taken
FROM (SELECT *, floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM q)
"""
