"""The containment forest among one query's hits: equi-joins on coordinates, markers vouch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..grid import DEFAULT_GRID, Grid
from .slicing import KEY

Q = ["query_id", *KEY]


def check_aligned(hits: DataFrame) -> None:
    if hits.where(F.col("codepoint_offset") % F.col("size") != 0).limit(1).count():
        raise ValidationError("a hit's offset is not a multiple of its size")


def one_of_each(hits: DataFrame, order: str | None = None, last: bool = False) -> DataFrame:
    """One hit of each coordinate of a query: the first by `order` (a column; without it by all columns), or the last."""
    rest = F.struct(*(c for c in hits.columns if c not in Q))
    by = F.col(order) if order else rest
    kept = hits.groupBy(*Q).agg((F.max_by if last else F.min_by)(rest, by).alias("kept"))
    return kept.select(*Q, "kept.*").select(*hits.columns)


def input_order(hits: DataFrame) -> str | None:
    """The column that numbers hits as they came: seq, or the fused rank."""
    return next((c for c in ("seq", "fused_rank") if c in hits.columns), None)


def nests() -> Column:
    """Whether the parent's span encloses the child's at a larger size: columns size, codepoint_offset, end and parent_size, parent_offset, parent_end."""
    return (F.col("parent_size") > F.col("size")) & (F.col("parent_offset") <= F.col("codepoint_offset")) & (F.col("end") <= F.col("parent_end"))


def contains() -> Column:
    """Whether the parent encloses the child and vouches for it: its descendants hold the child's marker."""
    return nests() & F.array_contains("descendant_markers", F.col("own_marker"))


def candidate_links(hits: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Every hit with every enclosing hit of its query: child key, parent_size, parent_offset, vouched. hits: one of each coordinate.

    Only the grid's place above a slice can enclose it, so this is an equi-join on places, not a join on ranges.
    """
    end = F.col("codepoint_offset") + F.col("codepoint_length")
    up = hits.select(*Q, "own_marker", end.alias("end"), F.explode(grid.ancestors_column(F.col("size"), F.col("codepoint_offset"))).alias("a"))
    child = up.select(*Q, "own_marker", "end", F.col("a.size").alias("parent_size"), F.col("a.codepoint_offset").alias("parent_offset"))
    parent = hits.select(
        "query_id", "document_id", F.col("size").alias("parent_size"), F.col("codepoint_offset").alias("parent_offset"), "descendant_markers", end.alias("parent_end"),
    )
    joined = child.join(parent, ["query_id", "document_id", "parent_size", "parent_offset"])
    return joined.where(nests()).select(*Q, "parent_size", "parent_offset", contains().alias("vouched"))


def build_forest(hits: DataFrame, grid: Grid = DEFAULT_GRID) -> tuple[DataFrame, DataFrame]:
    """(forest, anomalies).

    forest: one row a coordinate with parent_size, parent_offset of its minimal parent, null for roots: the
    smallest enclosing hit that vouches for it. anomalies: enclosing hits below that parent that do not.

    A coordinate that was hit several times counts as its first hit; a hit off the grid is an error.
    """
    check_aligned(hits)
    hits = one_of_each(hits, input_order(hits))
    links = candidate_links(hits, grid)
    minimal = links.groupBy(*Q).agg(F.min(F.when(F.col("vouched"), F.struct("parent_size", "parent_offset"))).alias("p"))
    forest = hits.select(*Q).join(minimal, Q, "left").select(*Q, F.col("p.parent_size"), F.col("p.parent_offset"))
    anomalies = (
        links.join(minimal, Q)
        .where(~F.col("vouched") & (F.col("p").isNull() | (F.col("parent_size") < F.col("p.parent_size"))))
        .select(*Q, "parent_size", "parent_offset")
    )
    return forest, anomalies


def chains(forest: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """(child key, ancestor_size, ancestor_offset, depth): each hit's chain of minimal parents, nearest first at depth 1.

    At most |sizes| - 1 joins, as sizes rise along a chain.
    """
    step = forest.where(F.col("parent_size").isNotNull())
    now = step.select(*Q, F.col("parent_size").alias("ancestor_size"), F.col("parent_offset").alias("ancestor_offset"), F.lit(1).alias("depth"))
    up = step.select(
        "query_id", "document_id", F.col("size").alias("ancestor_size"), F.col("codepoint_offset").alias("ancestor_offset"),
        F.col("parent_size").alias("next_size"), F.col("parent_offset").alias("next_offset"),
    )
    out = now
    for depth in range(2, len(grid.sizes)):
        now = now.join(up, ["query_id", "document_id", "ancestor_size", "ancestor_offset"]).select(
            *Q, F.col("next_size").alias("ancestor_size"), F.col("next_offset").alias("ancestor_offset"), F.lit(depth).alias("depth")
        )
        out = out.unionByName(now)
    return out


def edges(forest: DataFrame, closure: bool = False, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Minimal edges, or with closure every pair along the chains."""
    if closure:
        return chains(forest, grid).select(*Q, F.col("ancestor_size").alias("parent_size"), F.col("ancestor_offset").alias("parent_offset"))
    return forest.where(F.col("parent_size").isNotNull())


def _parents(forest: DataFrame) -> DataFrame:
    return edges(forest).select("query_id", "document_id", F.col("parent_size").alias("size"), F.col("parent_offset").alias("codepoint_offset")).distinct()


def minimal_parent(forest: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key, parent_size, parent_offset) of the asked coordinates; those that are no hits are left out, roots have nulls."""
    return keys.select(*Q).distinct().join(forest, Q)


def leaves(forest: DataFrame) -> DataFrame:
    return forest.join(_parents(forest), Q, "left_anti").select(*Q)


def roots(forest: DataFrame) -> DataFrame:
    return forest.where(F.col("parent_size").isNull()).select(*Q)


def metrics(forest: DataFrame, anomalies: DataFrame | None = None, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """query_id, hit_count, edge_count, anomaly_count, participation_rate, max_depth."""
    marked = forest.join(_parents(forest).withColumn("has_child", F.lit(True)), Q, "left")
    took_part = F.col("parent_size").isNotNull() | F.coalesce("has_child", F.lit(False))
    base = marked.groupBy("query_id").agg(
        F.count("*").alias("hit_count"),
        F.count_if(F.col("parent_size").isNotNull()).alias("edge_count"),
        F.avg(took_part.cast("int")).alias("participation_rate"),
    )
    depth = chains(forest, grid).groupBy("query_id").agg((F.max("depth") + 1).alias("max_depth"))
    out = base.join(depth, "query_id", "left").withColumn("max_depth", F.coalesce("max_depth", F.lit(1)))
    if anomalies is None:
        return out.withColumn("anomaly_count", F.lit(0).cast("long"))
    odd = anomalies.groupBy("query_id").agg(F.count("*").alias("anomaly_count"))
    return out.join(odd, "query_id", "left").withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
