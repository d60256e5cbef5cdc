"""Intermediate tables that outlive an executor: Parquet in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import plain_unions

_left: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this program where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="courtside-"))
    return _own[0]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path, so that any store Spark can open will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def durable(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read again, which cuts its lineage; deleted by ``forget`` or at the end of the program."""
    spark = plain_unions(df).sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._courtside_path = path
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the end of the program."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``durable`` that no plan needs any longer."""
    for df in tables:
        fs, p = file_system(df.sparkSession, df._courtside_path)
        fs.delete(p, True)
        _left.pop(df._courtside_path, None)


@atexit.register
def _end() -> None:
    for path, spark in list(_left.items()):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                fs, p = file_system(spark, path)
                fs.delete(p, True)
