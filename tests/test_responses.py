"""The response source: which files are opened, what rows come out, and a stream that takes each file once."""

import os
import time

import pytest

from courtside.functions.parsing import request_key
from courtside.sources import client, files, responses


@pytest.fixture()
def cache(spark, tmp_path):
    responses.register(spark)
    c = client.ResponseCache(tmp_path / "cache")
    for endpoint in ("box_score", "play_by_play"):
        for g in range(30):
            params = {"game_id": f"g{g}"}
            c.put(request_key(endpoint, params), {"endpoint": endpoint, "params": params, "fetched_at": 1.5 + g, "payload": {"n": g, "é": None}})
    c.put(request_key("players", {}), {"endpoint": "players", "params": {}, "fetched_at": 0.0, "payload": {}})
    return c


def load(spark, cache, **options):
    return spark.read.format("responses").options(**options).load(str(cache.folder))


def break_all_but(cache, *keys):
    for p in cache.folder.glob("*/*.json"):
        if p.stem not in keys:
            p.write_text("not a response")


def test_rows(spark, cache):
    df = load(spark, cache)
    assert df.count() == 61 and df.filter("game_id is null").first().endpoint == "players"
    r = df.filter("endpoint = 'box_score' and game_id = 'g7'").collect()
    assert [(x.request_hash, x.params_json, x.fetched_at, x.payload) for x in r] == [(request_key("box_score", {"game_id": "g7"}), '{"game_id": "g7"}', 8.5, '{"n": 7, "\\u00e9": null}')]
    assert df.filter("endpoint = 'box_score'").count() == 30 and df.filter("game_id in ('g1', 'g2')").count() == 4
    old = {(x.request_hash, x.params_json) for x in client.cached_payloads(spark, cache, "box_score").collect()}
    assert {x.request_hash for x in df.filter("endpoint = 'box_score'").collect()} == {k for k, _ in old}
    assert df.count() == 61


def test_a_game_filter_opens_its_files_only(spark, cache):
    want = [request_key(e, {"game_id": g}) for e in ("box_score", "play_by_play") for g in ("g3", "g4")]
    break_all_but(cache, *want)
    read = lambda **k: responses.read(spark, cache.folder, strict=True, **k)
    one = read(endpoint="box_score", games=["g3"])
    assert one.count() == 1 and read(endpoint="play_by_play", games=["g3", "g4", "none"]).count() == 2
    box = read(endpoint="box_score")
    assert box.filter("game_id = 'g4'").count() == 1 and box.filter("game_id = 'g3' and game_id = 'g4'").count() == 0 and one.count() == 1
    for wide in (box, read()):  # also after narrower reads of the same table
        with pytest.raises(Exception, match="is no response"):
            wide.count()
    assert load(spark, cache).count() == 4  # else what is no response is left out


def test_empty_folders(spark, tmp_path):
    responses.register(spark)
    os.makedirs(tmp_path / "none" / "ab")
    assert spark.read.format("responses").load(str(tmp_path / "none")).count() == 0


def test_through_the_parsers(spark, tmp_path):
    responses.register(spark)
    c = client.ResponseCache(tmp_path / "c")
    params = {"game_id": "g1"}
    payload = {"game": {"gameId": "g1", "actions": [{"actionNumber": 4, "clock": "PT11M30.00S", "period": 1, "teamId": 5, "personId": 9, "playerName": "A", "actionType": "Made Shot", "description": "x"}]}}
    c.put(request_key("play_by_play", params), {"endpoint": "play_by_play", "params": params, "fetched_at": 1.0, "payload": payload})
    rows = files.pbp_actions(load(spark, c).filter("endpoint = 'play_by_play'"), "payload").collect()
    assert [(r.game_id, r.event_num, r.clock_seconds_left) for r in rows] == [("g1", 4, 690.0)]


def test_stream_takes_each_file_once(spark, cache, tmp_path):
    for p in cache.folder.glob("*/*.json"):
        os.utime(p, ns=(time.time_ns() - 10**11,) * 2)

    def run():
        q = spark.readStream.format("responses").load(str(cache.folder)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.schema(responses.SCHEMA).parquet(f"{tmp_path}/out").count()

    assert run() == 61
    params = {"game_id": "late"}
    cache.put(key := request_key("box_score", params), {"endpoint": "box_score", "params": params, "fetched_at": 9.0, "payload": {}})
    os.utime(cache.path(key), ns=(time.time_ns() + 10**12,) * 2)
    assert run() == 61  # it may still be written to
    os.utime(cache.path(key), ns=(time.time_ns() - 10**10,) * 2)
    assert run() == 62
