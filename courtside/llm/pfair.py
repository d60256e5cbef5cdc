"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed pseudo-random order and cut into blocks. Source s of integer weight
w_s, of total W, has for its i-th block (from 1) the release ``floor((i-1) * W / w_s)`` and the deadline
``ceil(i * W / w_s)``; in every slot the released block of earliest deadline goes out (ties: the overlap bit, then
the name). After t slots each source then has sent within less than one block of ``t * w_s / W``.

Sources end at different times. When one is used up, a new phase begins in which the others keep their weights
and share the rest, so every document is placed exactly once and each phase holds the bound for its own weights.

A schedule repeats after W slots, so only one period of each phase is simulated on the driver: at most
``sources * W`` entries, whatever the number of documents. A block's slot follows from that table in a join.
Ranks inside a source come from counts of hash buckets, so a source with a third of all rows is ranked in
``buckets`` independent pieces.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SOURCES = 500


def period(weights: dict[str, int]) -> list[str]:
    """One period (sum of weights) of the earliest-deadline-first Pfair schedule."""
    total = sum(weights.values())

    def job(s: str, i: int) -> tuple[int, int, int, str, int]:
        w = weights[s]
        # pseudo-deadline first; then those whose window overlaps the next one (they press harder)
        return -(-i * total // w), -int(i * total % w != 0), i, s, (i - 1) * total // w

    waiting = [(job(s, 1)[4], job(s, 1)) for s in weights]
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        _, _, i, s, _ = heapq.heappop(ready)
        out.append(s)
        nxt = job(s, i + 1)
        heapq.heappush(waiting, (max(nxt[4], slot + 1), nxt))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, str, int, int, int, list[int]]]:
    """(phase start slot, source, first block, blocks in the phase, period, slots of the source in a period)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start, out = {s: 0 for s in left}, 0, []
    while left:
        own = {s: weights[s] for s in left}
        plan, total = period(own), sum(own.values())
        at: dict[str, list[int]] = {s: [] for s in left}
        for k, s in enumerate(plan):
            at[s].append(k)
        last = {s: (n - 1) // own[s] * total + at[s][(n - 1) % own[s]] for s, n in left.items()}
        end = min(last.values())  # the slot in which a source sends its last block
        for s in list(left):
            full, part = divmod(end + 1, total)
            n = full * own[s] + sum(k < part for k in at[s])
            if n:
                out.append((start, s, done[s], n, total, at[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += end + 1
    return out


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = 16, buckets: int = 1024) -> DataFrame:
    """Columns doc_id, source, source_rank, block, slot, position_in_block; order by slot, then position_in_block.

    ``weights``: integer weight of a source (null: the empty name); sources not named weigh 1, as all do without
    it. Weights must be positive; their sum is the schedule's period. Order inside a source: md5 of doc_id, then
    doc_id, then md5 of the text; rows equal in all three are interchangeable. Null texts, long texts and null
    ids are placed like any row. Other columns are ignored; an empty table gives no rows. More than 500
    sources raise: their counts and periods are held by the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.md5(F.col("text").cast("string")).alias("t")
    ).withColumn("bucket", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    rows = rows.withColumn("bucket", F.floor("bucket"))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    totals = {r.source: r.n for r in counts.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    own = {s: int((weights or {}).get(s, 1)) for s in totals}
    if any(w < 1 for w in own.values()):
        raise ValueError("weights must be positive")
    plan = phases({s: -(-n // block) for s, n in totals.items()}, own)
    schedule = spark.createDataFrame(
        [(start, s, first, first + n, total, len(at), at) for start, s, first, n, total, at in plan], "start long, source string, first long, past long, period long, share long, slots array<long>"
    )
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "t")))
        .join(before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["source", "bucket"])
        .select("doc_id", "source", (F.col("before") + F.col("r") - 1).alias("source_rank"))
        .withColumn("block", F.floor(F.col("source_rank") / block))
    )
    i = F.col("block") - F.col("first")
    return (
        ranked.join(F.broadcast(schedule), "source")
        .filter("block >= first and block < past")
        .select(
            "doc_id", "source", "source_rank", "block",
            (F.col("start") + F.floor(i / F.col("share")) * F.col("period") + F.element_at("slots", (i % F.col("share") + 1).cast("int"))).alias("slot"),
            (F.col("source_rank") % block).alias("position_in_block"),
        )
    )
