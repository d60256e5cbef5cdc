"""Corpus preparation: quality, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last keep the columns of ``documents``; columns beyond those are left behind.

In every stage an empty table gives an empty table, and rows with a null id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import byteconv, decontam, linedup, minhash, pfair
from courtside.llm.queries import MIX_WEIGHTS
from courtside.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network predicts to be good stay. Null text is scored as an empty text; rows that repeat
    fare alike; without labels all have one score and stay or go together; a score of just the threshold stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return byteconv.score_quality(docs, labels, columns=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document all of whose lines went goes with them. A document that lost no line stays as it
    is, also if its text is null, empty or very long. Of equal lines the one of least (doc_id, line) stays; rows that
    repeat doc_id and text keep the same lines."""
    out = linedup.dedup_lines(docs, COLUMNS)
    return out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id; null ids stay. Rows that share a
    doc_id are one document: the row whose text has the least hash stays. Null, empty and wordless texts are near
    nothing and stay."""
    mark = F.xxhash64("text")
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    row = docs.groupBy("doc_id").agg(F.min(mark).alias("mark")).join(kept, "doc_id", "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    one = docs.join(row, (docs.doc_id == row.kept_id) & (mark == row.kept_mark), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; rows that repeat fare alike."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=COLUMNS)
    return found.filter("n_hit = 0").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes in the mix: its source's blocks in earliest-deadline-first order. A null source is one
    source; rows that repeat have a place each; ties go by the hash of doc_id. Texts are not read."""
    return pfair.mix(docs, MIX_WEIGHTS)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mixing)]

#: a network, similarity joins and a scheduler can't be said in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
