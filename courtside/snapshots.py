"""Tables that change by whole versions: readers see the old rows or the new ones, and a write that dies leaves the old.

A table is a folder. ``data/<write>/of=<bucket>`` holds the rows of one bucket as one write left them; rows are dealt to
buckets by the hash of the table's bucket columns. ``versions/<number>.json`` is a manifest: for each bucket the folder
that holds it. The greatest number is the table. A write puts the buckets it touches into a folder of its own,
then a manifest in place by one rename that fails if the name is taken; until then nothing refers to what it wrote.

So an upsert reads and writes the touched buckets only; all other buckets keep their files. Two writers can't lose each
other's rows: the one whose rename fails starts from the newer manifest, and writes again only if its buckets have
changed meanwhile. Files of versions older than the last ``keep`` go after a commit; so does what dead writes left, once
it is a day old. The rename must be atomic, as in HDFS and local file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .session import plain_unions
from .tables import file_system

ORPHAN_MS = 24 * 3600 * 1000


class Conflict(RuntimeError):
    """Another writer took the version number."""


@dataclass
class Manifest:
    version: int
    buckets: int
    by: list[str]
    schema: str
    folders: dict[str, str]  # bucket -> folder below the table

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "by": self.by, "schema": self.schema, "folders": self.folders})


class SnapshotTable:
    """``by``: the bucket columns, which every upsert's keys must contain; ``buckets``: their number. Both are fixed when the
    table is first written and then read from it."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = (), buckets: int = 16, keep: int = 3, attempts: int = 10) -> None:
        self.spark, self.path, self.by, self.buckets, self.keep, self.attempts = spark, path.rstrip("/"), list(by), buckets, keep, attempts

    # manifests

    def _fs(self, *below: str):
        return file_system(self.spark, "/".join((self.path, *below)))

    def versions(self) -> list[int]:
        fs, folder = self._fs("versions")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest, or a version that is still kept; None if there is no table."""
        while True:
            have = self.versions()
            if not have or version is not None and version not in have:
                return None
            fs, p = self._fs("versions", f"{have[-1] if version is None else version:012d}.json")
            try:
                stream = fs.open(p)
            except Exception:  # it was the newest when listed and has been cleared since
                if version is not None or self.versions() == have:
                    raise
                continue
            try:
                return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()

    def _commit(self, m: Manifest) -> None:
        """Put the manifest in place; ``Conflict`` if its number is taken."""
        fs, aside = self._fs("versions", f".{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(m.text().encode()))
        out.close()
        _, to = self._fs("versions", f"{m.version:012d}.json")
        jvm = self.spark._jvm
        plain = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = plain
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(to), options)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {m.version}") from e
            raise

    # reading

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest. The plan names its files, so later writes don't change it."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"{self.path}: no table" if version is None else f"{self.path}: no version {version}")
        return self._rows(m)

    def _rows(self, m: Manifest, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.path}/{f}" for b, f in sorted(m.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # writing

    def _bucket(self, by: list[str], buckets: int):
        # as text, so that a key is dealt alike whatever integer type a writer's rows have
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in by)), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, by: list[str], buckets: int) -> dict[str, str]:
        """Write rows below a new folder; bucket -> folder of those that have rows. A bucket is one task's."""
        name = f"data/{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("of", self._bucket(by, buckets)).repartition(buckets, "of").write.partitionBy("of").parquet(f"{self.path}/{name}")
        fs, folder = self._fs(name)
        found = (s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
        return {n.removeprefix("of="): f"{name}/{n}" for n in found if n.startswith("of=")}

    def replace(self, rows: DataFrame) -> int:
        """All rows anew; they may come from the table itself. Returns the version."""
        old = self.manifest()
        by, buckets = (old.by, old.buckets) if old else (self.by or [rows.columns[0]], self.buckets)
        self._plain_columns(rows)
        folders = self._write(rows, by, buckets)
        for _ in range(self.attempts):
            have = self.versions()
            m = Manifest((have[-1] if have else 0) + 1, buckets, by, rows.schema.json(), folders)
            try:
                self._commit(m)
            except Conflict:
                continue  # whatever came between is replaced as well
            self._clear()
            return m.version
        raise Conflict(f"{self.path}: {self.attempts} other writers came first")

    def upsert(self, rows: DataFrame, *keys: str) -> int:
        """Rows of equal ``keys`` (nulls equal nothing) are replaced by ``rows``, which are read once or twice. Returns the version."""
        return self._change(rows, keys, True)

    def delete(self, rows: DataFrame, *keys: str) -> int:
        """Rows whose ``keys`` occur in ``rows`` go."""
        return self._change(rows, keys, False)

    def _change(self, rows: DataFrame, keys: tuple[str, ...], add: bool) -> int:
        plain_unions(rows)
        done: tuple[dict[str, str | None], dict[str, str]] | None = None  # folders it was made from, folders it made
        for _ in range(self.attempts):
            old = self.manifest()
            if old is None:
                if not add:
                    return 0
                try:
                    return self._first(rows)
                except Conflict:
                    continue
            if not set(old.by) <= set(keys):
                raise ValueError(f"the keys {keys} must contain the bucket columns {old.by}")
            if done is None or any(old.folders.get(b) != f for b, f in done[0].items()):
                touched = {str(r.of) for r in rows.select(self._bucket(old.by, old.buckets).alias("of")).distinct().collect()}  # at most ``buckets``
                before = self._rows(old, touched)
                after = before.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(before.columns)
                if add:
                    after = after.unionByName(rows.select(before.columns))
                done = {b: old.folders.get(b) for b in touched}, self._write(after, old.by, old.buckets) if touched else {}
            folders = {b: f for b, f in old.folders.items() if b not in done[0]} | done[1]
            try:
                self._commit(Manifest(old.version + 1, old.buckets, old.by, old.schema, folders))
            except Conflict:
                continue
            self._clear()
            return old.version + 1
        raise Conflict(f"{self.path}: {self.attempts} other writers came first")

    def _first(self, rows: DataFrame) -> int:
        self._plain_columns(rows)
        by = self.by or [rows.columns[0]]
        self._commit(Manifest(1, self.buckets, by, rows.schema.json(), self._write(rows, by, self.buckets)))
        return 1

    @staticmethod
    def _plain_columns(rows: DataFrame) -> None:
        if "of" in rows.columns:
            raise ValueError("rename the column of: the table's folders have that name")

    def _clear(self) -> None:
        """Drop manifests before the last ``keep`` and the folders only they named, and day-old folders that none names."""
        have = self.versions()
        gone, stay = have[: -self.keep], have[-self.keep :]
        folders = lambda versions: {f for v in versions if (m := self.manifest(v)) for f in m.folders.values()}
        named = folders(stay)
        for f in folders(gone) - named:
            fs, p = self._fs(f)
            fs.delete(p, True)
        for v in gone:
            fs, p = self._fs("versions", f"{v:012d}.json")
            fs.delete(p, False)
        fs, data = self._fs("data")
        writes, now = {f.split("/")[1] for f in named}, int(time.time() * 1000)
        for s in fs.listStatus(data) if fs.exists(data) else ():
            name = s.getPath().getName()
            if name not in writes and (now - int(name.split("-")[0]) > ORPHAN_MS or not any(x.isDirectory() for x in fs.listStatus(s.getPath()))):
                fs.delete(s.getPath(), True)
