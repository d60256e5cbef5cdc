"""Chat formatting in budgeted, turn-aligned windows.

A conversation too long for the token budget becomes several windows. Running sums of turn tokens choose where
each window ends; turns are never cut, and no window exceeds the budget but one of a single turn that alone does.
Each window begins with the conversation's system turn (its first, wherever it stands, in the windows after it) and a
limited number of earlier turns; both are context only. Where the system turn and the next new turn don't fit the
budget together, that window goes without the system turn. Each assistant text is a target once, in the window where
its turn is new.

Template, for each turn: ``### <Role>: <text></turn>`` and a line feed. Control strings inside texts and roles
are escaped reversibly: ``\\`` as ``\\\\``, ``###`` as ``\\h``, ``</turn>`` as ``\\t``, and ``:`` in roles as ``\\c``.

Rows are shuffled by conv_id, sorted, and streamed: a task holds one window, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
RAW = {v: k for k, v in NAMES.items()}
OUT = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c"}
IN = {v: k for k, v in OUT.items()}
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"


def escape(s: str) -> str:
    return re.sub(r"\\|###|</turn>", lambda m: OUT[m[0]], s)


def unescape(s: str) -> str:
    return re.sub(r"\\[\\htc]", lambda m: IN[m[0]], s)


def role_name(role: str) -> str:
    return NAMES.get(role) or "\\r" + escape(role).replace(":", "\\c")


def raw_role(name: str) -> str:
    return RAW.get(name) or unescape(name[2:])


def approximate_tokens(text: str) -> int:
    """A token for every four UTF-8 bytes begun."""
    return (len(text.encode()) + 3) // 4


def tokenizer_counter(path: str) -> Callable[[str], int]:
    """Counts with a ``tokenizers`` file, loaded once in each worker."""
    made: list = []

    def count(text: str) -> int:
        if not made:
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_file(path))
            made[0].encode_special_tokens = True
        return len(made[0].encode(text, add_special_tokens=False).ids)

    return count


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out = []
    for piece in formatted.split(CLOSE)[:-1]:
        name, _, text = piece[len(OPEN) :].partition(MID)
        out.append((raw_role(name), unescape(text)))
    return out


SCHEMA = "conv_id long, window long, text string, n_context long, loss array<struct<start:long,end:long>>, n_tokens long"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
_FIELDS = ["conv_id", "window", "text", "n_context", "loss", "n_tokens"]


def _window(conv, number, system, history, fresh):
    text, loss = [], []
    at = 0
    for kind, turns in (("context", [*system, *history]), ("new", fresh)):
        for role, body, _ in turns:
            head = OPEN + role_name(role) + MID
            if kind == "new" and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            text += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
    return conv, number, "".join(text), len(system) + len(history), loss, sum(t[2] for t in (*system, *history, *fresh))


def _windows(rows, budget: int, history_turns: int, history_tokens: int, count):
    """rows: (conv_id, role, text) sorted; yields windows in order."""
    conv = object()
    for c, role, text in rows:
        if c != conv:
            if conv.__class__ is not object and fresh:
                yield _window(conv, number, lead, history, fresh)
            conv, number, used = c, 0, 0
            system, lead, history, fresh = [], [], [], []
            past = deque(maxlen=history_turns or None)
        body = escape(text)
        turn = (role, body, count(body) + 4)
        if fresh and used + turn[2] > budget:
            yield _window(conv, number, lead, history, fresh)
            number += 1
            lead = system if sum(t[2] for t in system) + turn[2] <= budget else []
            room = min(history_tokens, budget - turn[2] - sum(t[2] for t in lead))
            history = []
            for t in reversed(past if history_turns else ()):
                room -= t[2]
                if room < 0 or any(t is x for x in system):
                    break
                history.insert(0, t)
            fresh, used = [], sum(t[2] for t in (*lead, *history))
        if role == "system" and not system:
            system = [turn]
        fresh.append(turn)
        past.append(turn)
        used += turn[2]
    if conv.__class__ is not object and fresh:
        yield _window(conv, number, lead, history, fresh)


def format_windows(conversations: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, count: Callable[[str], int] = approximate_tokens) -> DataFrame:
    """Windows (conv_id, window, text, n_context, loss, n_tokens) of conversations (conv_id, turn, role, text).

    n_context: turns at the window's start that repeat earlier ones. n_tokens is over ``budget`` only in a window of one
    turn that alone is (a very long text stays whole). loss: code point spans of the targets. The
    windows of a conversation stand together and in order in one partition. Null text or role: empty. Rows are
    ordered by turn (null first), then role and text; repeated rows are turns of their own; null conv_id is one
    conversation. Other columns are ignored; an empty table gives no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
        ready, size = [], 0
        for w in _windows(rows, budget, history_turns, history_tokens, count):
            ready.append(w)
            size += len(w[2])
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), _TYPES, strict=True)], names=_FIELDS)
                ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), _TYPES, strict=True)], names=_FIELDS)

    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .drop("turn")
        .mapInArrow(run, SCHEMA)
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None
        out: list[tuple] = []

        def done():
            if state:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for c, text, n_context, loss in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "n_context", "loss")), strict=True):
                if c != conv:
                    done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[n_context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    plain = unescape(text[span["start"] : span["end"]])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=fields)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=fields)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
