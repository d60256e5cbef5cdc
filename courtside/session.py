"""Session defaults for a cluster; tests and callers may bring their own session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "courtside", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def plain_unions(df: DataFrame) -> DataFrame:
    """``df``, in whose session a union no longer claims its inputs' partitioning.

    Spark 4.1 zips the partitions of a union's inputs where they are shuffled by the same keys; once adaptive
    execution has coalesced one of them differently, rows are lost or the job fails. Every operator that unites
    shuffled tables goes through here.
    """
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
