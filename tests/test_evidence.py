"""The audit log by run, listings and manifests."""

import hashlib
import json

import pytest

from spanforge.sources import evidence as E

SCHEMA = "run_id string, step int, note string"


def records(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_runs_are_added_and_read(spark, tmp_path):
    root = str(tmp_path / "log")
    assert E.read_runs(spark, root, SCHEMA).count() == 0 and E.read_runs(spark, root, SCHEMA, "a").columns == ["step", "note", "run_id"]
    E.append_runs(records(spark, ("a", 1, "x"), ("b", 1, None)), root)
    E.append_runs(records(spark, ("a", 2, "y\nz")), root)
    assert sorted(map(tuple, E.read_runs(spark, root, SCHEMA, "a").collect())) == [(1, "x", "a"), (2, "y\nz", "a")]
    assert E.read_runs(spark, root, SCHEMA).count() == 3 and E.read_runs(spark, root, SCHEMA, "none").count() == 0


@pytest.mark.parametrize("run_id", ["../a", "a/b", "a\\b", "", None, "x..y"])
def test_ids_stay_in_the_log(spark, tmp_path, run_id):
    with pytest.raises(Exception, match="invalid run_id"):
        E.append_runs(records(spark, ("ok", 1, "x"), (run_id, 1, "x")), str(tmp_path / "log"))
    if run_id is not None:
        with pytest.raises(ValueError, match="invalid run_id"):
            E.read_runs(spark, str(tmp_path / "log"), SCHEMA, run_id)


def test_corrupt_lines_have_a_place(spark, tmp_path):
    for run, lines in {"a": ['{"step":1}', "", "  ", '{"step":2}', "{broken", '{"step":3}', '{"step":"no number"}'], "b": ['{"step":1}', ""], "c": ["[]x"]}.items():
        (tmp_path / f"run_id={run}").mkdir()
        (tmp_path / f"run_id={run}" / "part.json").write_text("\n".join(lines))
    got = sorted((r.file.rsplit("/", 2)[-2], r.line) for r in E.corrupt_lines(spark, str(tmp_path), SCHEMA).collect())
    assert got == [("run_id=a", 5), ("run_id=a", 7), ("run_id=c", 1)]
    with pytest.raises(ValueError, match=r"run_id=a/part.json:5: corrupt"):
        E.read_runs(spark, str(tmp_path), SCHEMA)
    assert [tuple(r) for r in E.read_runs(spark, str(tmp_path), SCHEMA, "b").collect()] == [(1, None, "b")]


def test_streams_add_each_record_once(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("inbox", "log", "checkpoint"))
    for k in range(3):
        records(spark, ("a", k, "x"), ("b", k, "y")).write.mode("append").json(inbox)
        stream = spark.readStream.schema(SCHEMA).json(inbox)
        for _ in range(2):  # a restart with nothing new adds nothing
            E.append_runs_stream(stream, root, checkpoint).awaitTermination(60)
        assert E.read_runs(spark, root, SCHEMA).count() == 2 * (k + 1)
    other = str(tmp_path / "other")
    E.append_runs(records(spark, *(("a", k, "x") for k in range(6))), other)
    spark.createDataFrame([("{oops",)], "value string").write.mode("append").text(f"{other}/run_id=c")
    query = E.stream_runs(spark, other, SCHEMA).writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("log").collect()
    assert len(rows) == 7 and [r.run_id for r in rows if r.fault] == ["c"] and next(r.fault for r in rows if r.fault).endswith(": {oops")


def test_package_files(spark):
    listing = {"directory": {"item": [{"name": "a.htm", "type": "10-K", "size": "12"}, {"name": "b.jpg", "size": ""}, {"name": "c", "type": None}]}}
    answers = spark.createDataFrame([(1, json.dumps(listing)), (2, "{}"), (3, '{"directory":{"item":[]}}'), (4, None)], "id int, value string")
    assert sorted(map(tuple, E.package_files(answers).collect())) == [(1, "a.htm", "10-K", 12), (1, "b.jpg", "", 0), (1, "c", "", 0)]


def test_manifests(spark, tmp_path):
    values = {"b/x.json": {"b": 1.50, "a": ["é", None, True]}, "a.json": {"z": 10**20, "k": 1e5}, "b/y.json": []}
    (tmp_path / "b").mkdir()
    for name, value in values.items():
        (tmp_path / name).write_text(json.dumps(value, indent=3), encoding="utf-8-sig" if name == "a.json" else "utf-8")
    (tmp_path / "other.txt").write_text("no input")
    entries = [{"path": n, "sha256": hashlib.sha256(json.dumps(values[n], ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()} for n in sorted(values)]
    row = E.input_manifest(spark, str(tmp_path)).first()
    assert [r.asDict() for r in row.inputs] == entries
    assert row.input_manifest_sha256 == hashlib.sha256(json.dumps(entries, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    made = E.run_manifest(spark, str(tmp_path / "other.txt"), seeds={"a": 1}, packages=("pyspark", "no-such-package"))
    assert made["task_set"]["sha256"] == hashlib.sha256(b"no input").hexdigest() and made["packages"]["no-such-package"] is None and made["seeds"] == {"a": 1} and json.dumps(made)
