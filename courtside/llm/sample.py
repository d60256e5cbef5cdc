"""A bounded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: a labelled text of more characters is not fitted on, which bounds the sample in bytes
MAX_CHARS = 100_000


def id_remainder(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fold: int | None = 5) -> tuple[list[str], list[int], float]:
    """Texts, labels (0/1) and the share of label 1 among all labelled rows.

    At most ``per_class`` ids of either class, those whose md5 is least, with one text each: where an id repeats, the
    one of least hash. ``fold``: only rows with crc32(doc_id) mod fold <> 0. Texts are whole; those of more than
    ``MAX_CHARS`` characters are left out, so the driver holds 2 * per_class * MAX_CHARS characters at most.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if fold:
        own = own.filter(id_remainder("doc_id", fold) != 0)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = own.filter("y = 0").orderBy(*order).limit(per_class).unionByName(own.filter("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= MAX_CHARS)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("row")).select("doc_id", "row.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    total = sum(counts.values())
    return [r.text for r in rows], [r.y for r in rows], (counts.get(1, 0) + 0.5) / (total + 1) if total else 0.5
