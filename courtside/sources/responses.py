"""Cached responses as a Spark data source: partitions by folder shard, filters that choose files, and a stream.

A response lies at ``folder/<first two digits>/<key>.json``, its key being the hash of endpoint and parameters. So a
filter on endpoint and game says which files hold the answer, and only those are opened; other reads go shard by
shard. Folders are opened by Arrow's file systems, that is locally, on a mounted share, or by a URI it knows.

    responses.read(spark, "/shared/cache", endpoint="box_score", games=["0022500001"])

Spark 4.1 remembers the filters that a loaded table was last read with and applies them to a later read of the same table
that has none. So filters choose files only with the option ``pushdown``, which ``read`` sets where its own filters are
in every plan; ``spark.read.format("responses")`` alone opens all files and filters rows.

Rows: request_hash, endpoint, game_id (null where the parameters have none), params_json, fetched_at, payload (JSON
text). Files that hold no such record are left out; with ``strict`` they are an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions.parsing import request_key

SCHEMA = "request_hash string, endpoint string, game_id string, params_json string, fetched_at double, payload string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: files of one partition where they are named; nanoseconds that a file is left to settle before a stream takes it
FILES, SETTLE = 256, 2_000_000_000


class Shard(InputPartition):
    """Files to read (those of them that are there), or with None all of a folder."""

    def __init__(self, folder: str, names: list[str] | None) -> None:
        super().__init__(folder)
        self.folder, self.names = folder, names


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _row(raw: bytes, name: str, strict: bool) -> tuple | None:
    try:
        r = json.loads(raw)
        params = r["params"]
        return name, r["endpoint"], params.get("game_id"), json.dumps(params, sort_keys=True), float(r["fetched_at"]), json.dumps(r["payload"])
    except (ValueError, KeyError, TypeError, AttributeError):
        if strict:
            raise ValueError(f"{name}.json is no response") from None
        return None


def _rows(path: str, strict: bool, part: Shard) -> Iterator[tuple]:
    store, root = _open(path)
    if part.names is None:
        at = [i.path for i in store.get_file_info(fs.FileSelector(f"{root}/{part.folder}", allow_not_found=True)) if i.base_name.endswith(".json")]
    else:
        at = [i.path for i in store.get_file_info([f"{root}/{n[:2]}/{n}.json" for n in part.names]) if i.type == fs.FileType.File]
    for p in sorted(at):
        with store.open_input_stream(p) as f:
            row = _row(f.read(), p.rsplit("/", 1)[-1].removesuffix(".json"), strict)
        if row:
            yield row


class ResponseReader(DataSourceReader):
    def __init__(self, path: str, strict: bool, pushdown: bool) -> None:
        self.path, self.strict, self.pushdown = path, strict, pushdown
        self.endpoints: set[str] | None = None
        self.games: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on endpoint and game choose files; Spark still evaluates all of them on the rows."""
        for f in filters:
            if self.pushdown and isinstance(f, (EqualTo, In)) and f.attribute in (("endpoint",), ("game_id",)):
                values = {v for v in ((f.value,) if isinstance(f, EqualTo) else f.value) if v is not None}
                name = "endpoints" if f.attribute == ("endpoint",) else "games"
                held = getattr(self, name)
                setattr(self, name, values if held is None else held & values)
            yield f

    def partitions(self) -> list[Shard]:
        if self.endpoints is not None and self.games is not None:
            names = sorted(request_key(e, {"game_id": g}) for e in self.endpoints for g in self.games)
            return [Shard("", names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Shard("", [])]
        store, root = _open(self.path)
        shards = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        return [Shard(s, None) for s in shards] or [Shard("", [])]

    def read(self, partition: Shard) -> Iterator[tuple]:
        return _rows(self.path, self.strict, partition)


class ResponseStream(DataSourceStreamReader):
    """Offsets are times of change: a batch has the files changed after the last one's newest, settled ones only."""

    def __init__(self, path: str, strict: bool) -> None:
        self.path, self.strict = path, strict

    def _files(self) -> list[tuple[int, str]]:
        store, root = _open(self.path)
        return sorted((i.mtime_ns, i.base_name.removesuffix(".json")) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith(".json"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        import time

        settled = time.time_ns() - SETTLE
        return {"changed": max((t for t, _ in self._files() if t <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        names = [n for t, n in self._files() if start["changed"] < t <= end["changed"]]
        return [Shard("", names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Shard("", [])]

    def read(self, partition: Shard) -> Iterator[tuple]:
        return _rows(self.path, self.strict, partition)


class ResponseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, bool]:
        return self.options["path"].rstrip("/"), self.options.get("strict", "false").lower() == "true"

    def reader(self, schema: StructType) -> ResponseReader:
        return ResponseReader(*self._args(), self.options.get("pushdown", "false").lower() == "true")

    def streamReader(self, schema: StructType) -> ResponseStream:  # noqa: N802
        return ResponseStream(*self._args())


def read(spark: SparkSession, path: str, endpoint: str | None = None, games: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Responses of an endpoint, or of some of its games, whose files alone are then opened; further filters on game
    narrow the files as well."""
    register(spark)
    options = {"strict": str(strict), "pushdown": str(endpoint is not None)}
    rows = spark.read.format("responses").options(**options).load(str(path))
    rows = rows if endpoint is None else rows.filter(F.col("endpoint") == endpoint)
    return rows if games is None else rows.filter(F.col("game_id").isin(list(games)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it push filters to Python sources."""
    spark.dataSource.register(ResponseSource)
    spark.conf.set(PUSHDOWN, "true")
