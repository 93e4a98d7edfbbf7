"""Evaluation of traces over a query set: per-query metrics, their aggregate, drift against a baseline."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import write_text


#: What the reports of an evaluation's aggregate hold.
REPORTS = {
    "forest": ("queries", "mean_participation", "min_participation", "mean_depth", "depth_distribution", "mean_edges"),
    "budget": ("queries", "budget", "mean_results", "mean_trade_ups", "mean_utilization", "partial_queries"),
}


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) from lines of JSON with `query` or, where that is missing or empty, `text`, or of plain text. White space around a
    line is no part of it; blank lines and objects with neither are skipped; a line that starts an object must hold one."""
    line = F.regexp_replace("value", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    field = lambda name: F.nullif(F.get_json_object("line", f"$.{name}"), F.lit(""))
    whole = F.get_json_object("line", "$").isNotNull()
    broken = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("line"))).cast("string")
    parsed = F.when(whole, F.coalesce(field("query"), field("text"))).otherwise(broken)
    lines = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    return lines.select(F.when(F.startswith("line", F.lit("{")), parsed).otherwise(F.col("line")).alias("query")).where("query is not null")


def evaluate(trace: DataFrame) -> DataFrame:
    """One row a query."""
    return trace.select(
        "query_id", F.col("results").cast("int").alias("results"), F.col("hit_count").alias("forest_hits"), F.col("edge_count").alias("forest_edges"),
        "participation_rate", F.col("max_depth").cast("int").alias("max_depth"),
        F.coalesce(F.size("trade_ups"), F.lit(0)).alias("trade_ups"), F.coalesce(F.size("rejections"), F.lit(0)).alias("rejections"),
        "tokens_used", "budget", "utilization", (F.col("partial") if "partial" in trace.columns else F.lit(False)).alias("partial"),
    )


def aggregate(rows: DataFrame) -> DataFrame:
    """One row: means, minimum, partial count, distribution of depths as sorted (depth, queries). No query gives zeros and null utilization."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    summary = rows.agg(
        F.count("*").alias("queries"),
        zero(F.avg("participation_rate")).alias("mean_participation"),
        zero(F.min("participation_rate")).alias("min_participation"),
        zero(F.avg("max_depth")).alias("mean_depth"),
        zero(F.avg("forest_edges")).alias("mean_edges"),
        zero(F.avg("results")).alias("mean_results"),
        zero(F.avg("trade_ups")).alias("mean_trade_ups"),
        F.avg("utilization").alias("mean_utilization"),
        F.count_if("partial").alias("partial_queries"),
    )
    depths = rows.groupBy("max_depth").agg(F.count("*").alias("queries")).agg(
        F.array_sort(F.collect_list(F.struct("max_depth", "queries"))).alias("depth_distribution")
    )
    return summary.withColumn("_one", F.lit(1)).join(depths.withColumn("_one", F.lit(1)), "_one").drop("_one")


def compare_baseline(current: DataFrame, baseline: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """metric, baseline, current of the metrics that drifted; (metric, value) on both sides, keys from the baseline only.

    Numbers drift beyond the tolerance relative to the baseline (to 1 if that is 0); others must be equal.
    """
    b, c = baseline.select("metric", F.col("value").alias("baseline")), current.select("metric", F.col("value").alias("current"))
    x, y = F.col("baseline").try_cast("double"), F.col("current").try_cast("double")
    drift = F.abs(y - x) / F.when(x == 0, F.lit(1.0)).otherwise(F.abs(x)) > tolerance
    off = F.when(x.isNotNull() & y.isNotNull(), drift).otherwise(~F.col("baseline").eqNullSafe(F.col("current")))
    return b.join(c, "metric", "left").where(off).orderBy("metric")


def as_metrics(summary: DataFrame) -> DataFrame:
    """The aggregate's row as (metric, value) text pairs."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.to_json(c).alias("value") if c == "depth_distribution" else F.col(c).cast("string").alias("value")) for c in summary.columns]
    return summary.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a summary that write_outputs() gave as JSON."""
    one = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    return spark.createDataFrame([(k, text(v)) for k, v in sorted(one.items())], "metric string, value string")


def outputs(rows: DataFrame, summary: DataFrame) -> tuple[str, str]:
    """(CSV of the per-query rows, sorted JSON of the summary), as text. A query set is a report's size."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(rows.columns)
    for r in rows.orderBy("query_id").toLocalIterator():
        writer.writerow(["" if v is None else v for v in r])
    one = summary.first().asDict(recursive=True)
    return out.getvalue(), json.dumps(one, sort_keys=True, indent=2) + "\n"


def write_outputs(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """`per_query.csv` and `summary.json` in the folder."""
    for name, text in zip(("per_query.csv", "summary.json"), outputs(rows, summary), strict=True):
        write_text(rows.sparkSession, f"{folder.rstrip('/')}/{name}", text)
