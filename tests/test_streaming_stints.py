"""Streamed stints against the batch operator on the same events, in shuffled micro-batches."""

import json
import random

from pyspark.sql import functions as F

from courtside.operators import lineups
from courtside.plans.catalog import _pbp
from courtside.snapshots import SnapshotTable
from courtside.streaming import stints

SF = "/root/testdata/sf0.001"


def split(spark, rows, schema, folder, parts, seed):
    """The rows in files of a random order, one micro-batch each."""
    order = rows[:]
    random.Random(seed).shuffle(order)
    for k in range(parts):
        spark.createDataFrame(order[k::parts], schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def run(spark, schema, folder, tmp, name):
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
    ev, st = SnapshotTable(spark, f"{tmp}/{name}-events", ("game_id",), 4), SnapshotTable(spark, f"{tmp}/{name}-stints", ("game_id",), 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # of state
    try:
        q = stints.stint_stream(s, ev, st, f"{tmp}/{name}-checkpoint", delay="3650 days", quiet_seconds=60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert q.awaitTermination(400)
    return ev, st, q


def test_any_order_gives_the_batch_rows(spark, tmp_path):
    some = _pbp(spark, SF).filter("game_id rlike '^(3|8)-'")  # the events of two users
    given = some.withColumn("ts", F.timestamp_seconds(F.col("event_num").cast("long") * 7 + 1_700_000_000))
    rows = given.collect()
    last = rows[0].asDict() | {"game_id": "the end", "ts": rows[0].ts.replace(year=2090)}
    want = {tuple(str(v) for v in r) for r in lineups.reconstruct_stints(given.drop("ts")).collect()}
    split(spark, rows, given.schema, tmp_path / "in", 2, 1)
    # repeated events and one that closes the watermark over all others
    spark.createDataFrame([*rows[:20], tuple(last[c] for c in given.columns)], given.schema).coalesce(1).write.parquet(f"{tmp_path}/in/900")
    ev, st, q = run(spark, given.schema, tmp_path / "in", tmp_path, "a")
    got = st.read()
    assert {tuple(str(r[c]) for c in lineups.reconstruct_stints(given.drop("ts")).columns) for r in got.collect()} == want and got.count() == len(want)
    assert ev.read().count() == len(rows)
    state = json.loads(q.lastProgress.json)["stateOperators"][0]
    assert state["customMetrics"]["numExpiredTimers"] >= 0 and state["numRowsTotal"] <= 4  # the closing event alone: its row, time and timer
