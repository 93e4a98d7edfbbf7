"""What the operators share: the shared folder, written tables, Arrow helpers, word tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise, release, shared_dir

__all__ = ["materialise", "release", "shared_dir"]

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of the rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters, all non-ASCII.
#: Every other byte becomes a space, so `split()` yields the words.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, so that columns added beside it cannot clash with them; `row.*` gives them back."""
    return F.struct(*map(column, df.columns)).alias("row")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_mod_py(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def batches_out(schema: T.StructType) -> Callable[[dict], pa.RecordBatch]:
    """Makes record batches of Spark's schema from columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def make(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type, from_pandas=False) for f in arrow],
            schema=arrow,
        )

    return make


#: Bytes of a batch on its way to or from Python: several copies of a batch live in a worker and in the JVM at once.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH bytes; one row may be larger. It changes how rows travel, not what comes of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields dicts of columns."""
    spark_schema = T._parse_datatype_string(schema)
    small_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = batches_out(spark_schema)
        for columns in fn(it):
            yield make(columns)

    return df.mapInArrow(run, spark_schema)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_sized(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "left") -> DataFrame:
    """Broadcast the right side behind a check of its rows; beyond the bound a shuffled join, split where skewed."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)
