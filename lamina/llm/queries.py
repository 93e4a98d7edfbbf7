"""The operators' registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, sharding
from .ann import additive_search
from .brown import lm_scores
from .common import read
from .licenses import license_scan
from .mixing import mix_plan
from .packing import pack
from .quality import quality
from .sharding import lpt_shards
from .simhash import near_duplicates
from .topk import exact_topk
from .toxicity import toxicity


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"))


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_search(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
o AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])))::BIGINT AS score
  FROM o a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_topk, op2_lpt_shards, op3_license_scan, op4_pack, op5_quality, op6_brown_lm, op7_mix, op8_simhash, op9_toxicity, op10_additive_ann,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op2_lpt_shards": sharding.ORACLE, "op7_mix": mixing.ORACLE}
