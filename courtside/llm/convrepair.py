"""Repairing the structure of conversations at least cost.

A row of a conversation is blank, a duplicate, truncated or sound; the roles of a sound conversation are an optional
system row, then user and assistant in turn, any number of times. ``solve`` finds the cheapest edits: Keep a row (0), Rerole it to user
or assistant (2), Delete it (3; a must for blank and duplicate rows), Insert a row of empty text (2); a truncated row
that stays costs 1 more. Of equally cheap edit strings the ASCII-least is taken.

What the edits are depends only on the rows' role initials and faults, so those are encoded as one letter a row, and
a conversation as one compact string, its signature. Few signatures cover most conversations: each distinct one is
solved once, by memoised recursion, and its edits are joined back and replayed.

Rows first travel without their texts (a digest stands for one) to find order, faults and signatures by windows; the
letters are gathered in pieces of 4,096 rows, so a long conversation is a string of a letter a row. Texts are shuffled
once, sorted by conversation and turn behind the row that holds the edits, and replayed as a stream: a task holds one
batch and one edit string, however long the conversation. A conversation is one task's, as its order is its meaning.

Nulls: a null role or text counts as one space (so such a text is blank and such a role is rerole or delete); null ids
are one conversation; null turns come first. Ties: rows of equal turn go by role, then by the text's SHA-256, so equal
rows are neighbours and interchangeable. Empty and very long texts are texts as any; an empty role can't be kept. Other columns, whatever
their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import plain_unions

RANGE = r"\x20\x09-\x0D"
PIECE = 4096
RECURSE = 50  # rows that one descent may pass; a row takes up to six frames


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by crc32('conv_id:turn') % 20: 0 drops the row, 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def _plain(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, role, digest, fault, code, new_turn, illegal): a row for each of ``rows``, without its text.

    ``fault``: blank, duplicate, truncated or null; ``code``: its letter in the signature; ``illegal``: the roles of
    the row before and this one can't be neighbours.
    """
    skinny = _plain(rows).select(
        "conv_id", "turn", "role", "digest",
        (~F.col("text").rlike(f"[^{RANGE}]")).alias("blank"), (~F.col("text").rlike(f"[.!?][{RANGE}]*\\z")).alias("open"),
    ).repartition("conv_id")
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    along = Window.partitionBy("conv_id").orderBy(*order)
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("seq")) > 1
    m = skinny.withColumns({"seq": F.row_number().over(along), "before": F.lag("role").over(along), "turn_before": F.lag("turn").over(along)}).withColumn("again", again)
    initial = lambda c: F.substring(c, 1, 1)
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated")
    letter = F.when(initial("role").isin("s", "u", "a"), initial("role")).otherwise("x")
    return m.select(
        "conv_id", "turn", "seq", "role", "digest", fault.alias("fault"),
        F.when(F.col("blank") | F.col("again"), "d").when(F.col("open"), F.upper(letter)).otherwise(letter).alias("code"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
        (F.col("before").isNotNull() & ~F.concat(initial("before"), initial("role")).isin("su", "ua", "au")).alias("illegal"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal): a row a conversation."""
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    joined = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    pieces = (
        faults(rows)
        .withColumn("piece", F.floor((F.col("seq") - 1) / PIECE))
        .groupBy("conv_id", "piece")
        .agg(
            joined("seq", "code").alias("codes"), F.min("turn").alias("first"), F.max("turn").alias("last"), count(F.col("new_turn"), "turns"),
            *(count(F.col("fault") == f, f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal"), "illegal"),
        )
    )
    own = pieces.groupBy("conv_id").agg(
        joined("piece", "codes").alias("signature"), (F.max("last") - F.min("first") + 1 - F.sum("turns")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))
    )
    return own.withColumn("gaps", F.coalesce(F.col("gaps"), F.lit(0)).cast("long"))


#: what has been said so far: nothing, the system row, up to a user row, up to an assistant row
NOTHING, SYSTEM, USER, ASSISTANT = range(4)


def after(state: int) -> int:
    """The state once the next row of user or assistant is there."""
    return ASSISTANT if state == USER else USER


def solve(signature: str) -> tuple[str, int]:
    """The cheapest edits' initials and their cost.

    The cost from a row and state on is a memoised recursion over the edits of the next row. It is called from the end
    of the signature backwards in steps, so no descent is deeper than ``RECURSE`` rows. From one row and state edits of
    one initial lead to one state only, so taking the ASCII-least of the cheapest at each step gives the least string.
    """
    n = len(signature)
    memo: dict[tuple[int, int, int], float] = {}
    edits = bytearray(12 * (n + 1))  # of every row, state and number of inserts so far

    def options(i: int, state: int, inserts: int) -> Iterator[tuple[float, str]]:
        # two inserts bring a state back to itself, so more than two in a row never help
        if inserts < 2:
            yield 2 + cost(i, after(state), inserts + 1), "I"
        if i == n:
            if state in (NOTHING, ASSISTANT):
                yield 0, "\0"
            return
        yield 3 + cost(i + 1, state, 0), "D"
        code = signature[i]
        if code != "d":
            stays = int(code.isupper())
            yield 2 + stays + cost(i + 1, after(state), 0), "R"
            wanted = "a" if state == USER else "u"
            if code.lower() == wanted:
                yield stays + cost(i + 1, after(state), 0), "K"
            elif code.lower() == "s" and state == NOTHING:
                yield stays + cost(i + 1, SYSTEM, 0), "K"

    def cost(i: int, state: int, inserts: int) -> float:
        key = (i, state, inserts)
        if key not in memo:
            memo[key], edit = min(options(*key), default=(float("inf"), "\0"))
            edits[12 * i + 3 * state + inserts] = ord(edit)
        return memo[key]

    for i in [*range(n, 0, -RECURSE), 0]:
        for state in (NOTHING, SYSTEM, USER, ASSISTANT):
            cost(i, state, 0)
        memo = {key: c for key, c in memo.items() if key[0] == i}  # what the rows before can ask for
    i, state, inserts, out = 0, NOTHING, 0, []
    while edit := edits[12 * i + 3 * state + inserts]:
        out.append(edit := chr(edit))
        if edit == "I":
            state, inserts = after(state), inserts + 1
            continue
        if edit != "D":
            state = SYSTEM if edit == "K" and signature[i].lower() == "s" else after(state)
        i, inserts = i + 1, 0
    return "".join(out), int(memo[0, NOTHING, 0])


def audits(signed: DataFrame) -> DataFrame:
    """Adds audit and cost to what ``signatures`` returns; each distinct signature is solved once."""

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [solve(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["signature", "audit", "cost"])

    return signed.join(signed.select("signature").distinct().mapInArrow(solved, "signature string, audit string, cost long"), "signature")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch the repaired rows (conv_id, position, role, text, edit) that it completes; position 0 opens a conversation.

    Rows come by conversation, its edits before its rows.
    """
    conv, audit, at, state, position = None, None, 0, NOTHING, 0
    out: list[tuple] = []

    def put(role: str, text: str, edit: str) -> None:
        nonlocal position
        position += 1
        out.append((conv, position, role, text, edit))

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = after(state), at + 1
            put("user" if state == USER else "assistant", "", "insert")

    for b in batches:
        for c, edits, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if edits is not None:
                if audit is not None:
                    inserts()
                conv, audit, at, state, position = c, edits, 0, NOTHING, 0
                out.append((conv, 0, None, None, None))
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = SYSTEM if role[0] == "s" else after(state)
                put(role, text, "keep")
            elif edit == "R":
                state = after(state)
                put("user" if state == USER else "assistant", text, "rerole")
        yield out
        out = []
    if audit is not None:
        inserts()
        yield out


def _in_order(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Edits, then rows, of each conversation in order, all in one partition."""
    head = audited.select("conv_id", "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("digest"))
    both = plain_unions(head).unionByName(_plain(rows).withColumn("audit", F.lit(None).cast("string")))
    order = [F.col("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")


def repaired_rows(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) after the edits; position counts from 1, edit is keep, rerole or insert."""
    kind = rows.schema["conv_id"]
    schema = StructType([kind, StructField("position", LongType()), *(StructField(c, StringType()) for c in ("role", "text", "edit"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _replay(batches):
            for start in range(0, len(made), PIECE):
                part = [r for r in made[start : start + PIECE] if r[1]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(types)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    return _in_order(rows, audited).mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, n_rows, repaired_sha256): SHA-256 of the repaired ``role:text``, newline-joined, found as a stream."""
    schema = StructType([rows.schema["conv_id"], StructField("n_rows", LongType()), StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def rows_done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], schema.names)

        for made in _replay(batches):
            for conv, position, role, text, _ in made:
                if position == 0:
                    if now is not None:
                        done.append((now[0], now[1], now[2].hexdigest()))
                    now = (conv, 0, hashlib.sha256())
                    continue
                now[2].update(f"{chr(10) if position > 1 else ''}{role}:{text}".encode())
                now = (conv, position, now[2])
            yield rows_done()
            done = []
        if now is not None:
            done.append((now[0], now[1], now[2].hexdigest()))
            yield rows_done()

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    return _in_order(rows, audited).mapInArrow(run, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in ``rows``."""
    audited = audits(signatures(rows))
    done = repaired_digests(rows, audited.select("conv_id", "audit")).select(F.col("conv_id").alias("_id"), "repaired_sha256")
    return audited.join(done, audited.conv_id.eqNullSafe(done["_id"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
