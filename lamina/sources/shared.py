"""Tables in the folder that driver and executors share: they cut a plan short and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StoreUnavailable

_own: list[str] = []
_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and all runs on one machine an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise StoreUnavailable("spark.checkpoint.dir names no folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lamina-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; what is left in it goes when the driver ends."""
    at = f"{shared_dir(spark)}/lamina/{spark.sparkContext.applicationId}"
    if at not in _folders:
        _folders[at] = spark
        atexit.register(_sweep, at)
    return at


def _sweep(at: str) -> None:
    try:
        remove(_folders[at], at)
    except Exception:  # the JVM may be gone already
        pass


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(hadoop_path(spark, path), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's own, on any file system."""
    out = file_system(spark, path).create(hadoop_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(hadoop_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more, known by the files they read."""
    for df in tables:
        own = folder(df.sparkSession).split(":", 1)[-1].lstrip("/")
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{own}/" in parent:
                remove(df.sparkSession, parent)
