"""Decoding, search answers, task marks, keyed stores, nested payloads and the watchdog against known answers."""

import json
import random
import time

from spanforge.sources import tables as S


def test_decoded_files(spark, tmp_path):
    rng, blobs = random.Random(11), {}
    for i in range(120):
        blob = b"".join(rng.choice([b"ab", "é".encode(), "中".encode(), "\U0001f600".encode(), b"\xff", b"\xe4\xb8", b"\xf0\x9f", "�".encode(), b"\n", b"\xc0", b"\x0e\xfb\xfb\xd0"]) for _ in range(rng.randrange(9)))
        (tmp_path / f"{i}.bin").write_bytes(blob)
        blobs[f"{i}.bin"] = blob
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.replaced) for r in S.decoded_files(spark, str(tmp_path)).collect()}
    text = {k: b.decode("utf-8", errors="replace") for k, b in blobs.items()}
    assert got == {k: (t, max(0, t.count("�") - blobs[k].count("�".encode()))) for k, t in text.items() if t}


def test_search_hits(spark):
    full = {"_id": "a-1:doc.htm", "_source": {"adsh": "a-1", "ciks": ["0000320193", "2"], "file_date": "2024-01-02", "form": "10-K/A", "display_names": ["A", "B"]}}
    answers = [json.dumps({"hits": {"hits": [full, {"_id": "b-2", "_source": {}}, {"_id": "c"}]}}), json.dumps({"hits": {"hits": []}}), "{}", "broken", None]
    rows = S.search_hits(spark.createDataFrame([(a,) for a in answers], "value string"), limit=2).collect()
    assert sorted(map(tuple, rows)) == [("a-1", 320193, "doc.htm", "2024-01-02", "10-K/A", "A"), ("b-2", 0, "", "", "10-K", "")]


def test_task_states_and_stores(spark, tmp_path):
    marks = [("a", "incomplete", 1), ("a", "done", 2), ("b", "incomplete", 3), ("c", "error", 1), ("c", "incomplete", 5), ("c", "done", 4)]
    got = S.task_states(spark.createDataFrame(marks, "task_id string, status string, written_at int")).collect()
    assert sorted(map(tuple, got)) == [("a", "done", 2), ("b", "incomplete", 3), ("c", "done", 4)]
    old = spark.createDataFrame([("x", 1, "old"), ("y", 1, "kept"), (None, 2, "old")], "k string, n int, v string")
    new = spark.createDataFrame([("new", 1, "x"), (None, 9, "z"), ("null key", 2, None)], "v string, n int, k string")
    rows = S.upserted(old, new, ["k", "n"])
    assert rows.columns == old.columns
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("x", 1, "new"), ("y", 1, "kept"), (None, 2, "null key"), ("z", 9, None)], key=str)
    for frame in (old, rows):
        S.write_artifact(frame, str(tmp_path / "store"))
    assert spark.read.json(str(tmp_path / "store")).count() == 4


def test_nested_payloads(spark):
    items = spark.createDataFrame([(1, "7", 9, "pass"), (1, "1A", 1, "missing"), (2, "1", 0, "pass")], "doc_id long, code string, ord int, status string")
    gaps = spark.createDataFrame([(1, 5, 9), (1, 0, 2), (3, 0, 1)], "doc_id long, start int, end int")
    exhibits = spark.createDataFrame([], "doc_id long, name string")
    got = {r.doc_id: json.loads(r.payload) for r in S.nested_payloads(items, gaps, exhibits).collect()}
    assert got == {
        1: {"items": [{"code": "1A", "status": "missing"}, {"code": "7", "status": "pass"}], "gaps": [{"start": 0, "end": 2}, {"start": 5, "end": 9}], "exhibits": []},
        2: {"items": [{"code": "1", "status": "pass"}], "gaps": [], "exhibits": []},
    }


def test_watchdog_stream(spark, tmp_path):
    from spanforge.streaming.state import watchdog_stream

    def put(rows, n):
        spark.createDataFrame(rows, "task_id string, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    put([("a", "start"), ("b", "start"), ("c", "start"), ("c", "done")], 0)
    stream = spark.readStream.schema("task_id string, status string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = watchdog_stream(stream, 15000).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while not run.recentProgress and time.time() < until:
            time.sleep(0.5)
        put([("b", "done")], 1)
        while spark.table("late").isEmpty() and time.time() < until:
            time.sleep(0.5)
        time.sleep(3)
        assert [tuple(r) for r in spark.table("late").collect()] == [("a", "WatchdogTimeout")]
    finally:
        run.stop()
