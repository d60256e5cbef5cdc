"""Tables that must outlive an executor: written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import plain_unions

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: written and not dropped yet: path -> session
_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="courtside-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a job when it is over, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def refuse_clash(columns: Iterable[str], *own: str) -> None:
    """Columns that pass through can't bear the names of those that the result adds."""
    if clash := sorted({c.lower() for c in columns} & {c.lower() for c in own}):
        raise ValueError(f"rename the columns {clash}: the result has its own")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage durably."""
    spark = plain_unions(df).sparkSession
    path = new_path(spark, tag)
    with shuffles_end(spark):
        df.write.parquet(path)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._courtside_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan needs any longer."""
    for df in tables:
        _delete(df.sparkSession, df._courtside_path)
        _left.pop(df._courtside_path, None)


@atexit.register
def _drop_left() -> None:
    """What results still read from is deleted when the program ends, if its session still runs."""
    for path, spark in list(_left.items()):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                _delete(spark, path)
