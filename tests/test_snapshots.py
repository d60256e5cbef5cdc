"""Snapshot tables: upserts touch their buckets only, readers see old or new, a dead write leaves the old, writers don't lose rows."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from courtside.snapshots import ORPHAN_MS, Conflict, SnapshotTable

ROW = "game_id string, n int, value string"


def rows_of(spark, games, value, n=3):
    return spark.createDataFrame([(g, k, value) for g in games for k in range(n)], ROW)


def held(df):
    return sorted((r.game_id, r.n, r.value) for r in df.collect())


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture()
def table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ("game_id",), buckets=8)
    t.upsert(rows_of(spark, [f"g{i}" for i in range(40)], "old"), "game_id", "n")
    return t


def test_upsert_touches_its_buckets_only(spark, table):
    before, files_before = table.manifest(), files(table.path)
    table.upsert(rows_of(spark, ["g7"], "new", n=2), "game_id", "n")
    after = table.manifest()
    assert held(table.read(1)) == sorted((f"g{i}", k, "old") for i in range(40) for k in range(3))
    moved = [b for b in after.folders if after.folders[b] != before.folders.get(b)]
    assert len(moved) == 1 and after.version == 2 and files_before <= files(table.path)
    got = held(table.read())
    assert len(got) == 120 and [x[2] for x in got if x[0] == "g7"] == ["new", "new", "old"] and sum(x[2] == "new" for x in got) == 2
    table.upsert(rows_of(spark, ["g7"], "whole", n=1), "game_id")  # by game: all its rows are replaced
    assert [x for x in held(table.read()) if x[0] == "g7"] == [("g7", 0, "whole")]
    table.upsert(rows_of(spark, [], "none"), "game_id")
    assert len(held(table.read())) == 118


def test_delete_and_replace(spark, table):
    table.delete(spark.createDataFrame([("g1",), ("g2",), ("zz",)], "game_id string"), "game_id")
    assert {x[0] for x in held(table.read())} == {f"g{i}" for i in range(40)} - {"g1", "g2"}
    table.replace(table.read().filter("n = 0"))  # from itself
    assert len(held(table.read())) == 38
    table.replace(table.read().limit(0))
    assert held(table.read()) == [] and table.read().columns == ["game_id", "n", "value"]
    table.upsert(rows_of(spark, ["a"], "x", n=1), "game_id")
    assert held(table.read()) == [("a", 0, "x")]


def test_nulls_and_repeats(spark, table):
    odd = spark.createDataFrame([(None, 0, "a"), (None, 0, "b"), ("g3", None, "c")], ROW)
    table.upsert(odd, "game_id", "n")
    table.upsert(odd.filter("game_id is null"), "game_id", "n")
    got = table.read().filter("game_id is null or n is null")
    assert got.count() == 5 and table.read().filter("game_id = 'g3'").count() == 4


def test_a_write_that_dies_leaves_the_old(spark, table, monkeypatch):
    want = held(table.read())
    bad = rows_of(spark, ["g1"], "new").withColumn("value", F.when(F.col("n") == 2, F.raise_error(F.lit("dead"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="dead"):
        table.upsert(bad, "game_id")
    assert held(table.read()) == want and table.versions() == [1]
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_commit", lambda self, x: (_ for _ in ()).throw(OSError("killed before the rename")))
        with pytest.raises(OSError):
            table.upsert(rows_of(spark, ["g1"], "new"), "game_id")
        with pytest.raises(OSError):
            table.replace(rows_of(spark, ["g1"], "new"))
    assert held(table.read()) == want and table.versions() == [1]
    left = len(os.listdir(f"{table.path}/data"))
    table.upsert(rows_of(spark, ["g1"], "new"), "game_id")
    assert len(os.listdir(f"{table.path}/data")) == left + 1  # young folders stay: they may be another writer's
    for name in os.listdir(f"{table.path}/data"):
        if not any(f.split("/")[1] == name for v in table.versions() for f in table.manifest(v).folders.values()):
            os.rename(f"{table.path}/data/{name}", f"{table.path}/data/{int(name.split('-')[0]) - 2 * ORPHAN_MS:015d}-{name.split('-')[1]}")
    table.upsert(rows_of(spark, ["g1"], "newer"), "game_id")
    assert len(os.listdir(f"{table.path}/data")) == 3


def test_readers_see_old_or_new(spark, table):
    seen, stop, failures = set(), threading.Event(), []

    def read():
        while not stop.is_set():
            try:
                seen.add((table.read().filter("value = 'old'").count(), table.read().count()))
            except Exception as e:
                failures.append(e)

    t = threading.Thread(target=read)
    t.start()
    for k in range(3):
        table.upsert(rows_of(spark, [f"g{i}" for i in range(10 * k, 10 * k + 10)], "new"), "game_id")
    stop.set()
    t.join()
    assert not failures and {n for n, _ in seen} <= {120, 90, 60, 30} and {n for _, n in seen} == {120}


def test_writers_lose_nothing(spark, table):
    """Many writers at once, of the same and of other buckets."""
    errors = []

    def write(i):
        try:
            SnapshotTable(spark, table.path, ("game_id",), attempts=30).upsert(rows_of(spark, [f"g{i}", f"new{i}"], f"w{i}", n=1), "game_id", "n")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(table.read())
    assert not errors and table.versions()[-1] == 6 and len(got) == 125
    assert all((f"g{i}", 0, f"w{i}") in got and (f"new{i}", 0, f"w{i}") in got for i in range(5))


def test_a_conflict_is_noticed_and_rebased(spark, table):
    """A commit of a number that is taken fails; an upsert of other buckets goes on with the folders it has written."""
    m = table.manifest()
    with pytest.raises(Conflict):
        table._commit(m)
    other = SnapshotTable(spark, table.path)
    commit, times = table._commit, []

    def late(manifest):
        times.append(manifest.version)
        if len(times) == 1:
            other.upsert(rows_of(spark, ["g7"], "theirs", n=1), "game_id")
        commit(manifest)

    table._commit = late
    of = {r.game_id: r.of for r in table.read().select("game_id", table._bucket(["game_id"], 8).alias("of")).distinct().collect()}
    mine = next(g for g in sorted(of) if of[g] != of["g7"])
    n = len(os.listdir(f"{table.path}/data"))
    table.upsert(rows_of(spark, [mine], "mine", n=1), "game_id")
    assert times == [2, 3] and len(os.listdir(f"{table.path}/data")) == n + 2
    got = held(table.read())
    assert ("g7", 0, "theirs") in got and (mine, 0, "mine") in got and len(got) == 116


def test_old_versions_go(spark, table):
    for k in range(6):
        table.upsert(rows_of(spark, ["g1"], f"v{k}"), "game_id")
    assert table.versions() == [5, 6, 7] and table.manifest(1) is None
    assert {f.rsplit("/", 1)[0] for f in files(table.path)} == {f for v in table.versions() for f in table.manifest(v).folders.values()}
    with pytest.raises(FileNotFoundError):
        table.read(2)
    with pytest.raises(FileNotFoundError):
        SnapshotTable(spark, table.path + "-none").read()
    with pytest.raises(ValueError):
        table.upsert(rows_of(spark, ["g1"], "x"), "n")
