import json
import os


from tidewell.streaming import bursts

EVENTS = [("a", 0, "typed"), ("a", 2, "typed"), ("b", 3, "typed"), ("a", 20, "typed"), ("a", 21, "target_changed"), ("a", 22, "typed"), ("b", 40, "typed"), ("z", 300, "typed")]


def files(tmp_path, rows, parts):
    for k in range(parts):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"key": a, "ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z", "hint": h}) for a, t, h in rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in this order
    return str(tmp_path)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_session_bursts_converge_to_the_batch(spark, tmp_path):
    path = files(tmp_path, EVENTS, 3)
    schema = "key string, ts timestamp, hint string"
    batch = bursts.bursts(spark.read.schema(schema).json(path), "10 seconds", "30 seconds", ["key"]).collect()
    stream = run(bursts.bursts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path), "10 seconds", "30 seconds", ["key"]), "bursts_")
    plain = lambda rows: {(r["key"], str(r["began_at"]), r["n_events"]) for r in rows}
    assert plain(stream) == {x for x in plain(batch) if x[0] != "z"}  # the last burst is open still
    assert len(plain(batch)) == 5


def test_boundaries_close_bursts(spark, tmp_path):
    path = files(tmp_path, EVENTS, 2)
    stream = spark.readStream.schema("key string, ts timestamp, hint string").option("maxFilesPerTrigger", 1).json(path)
    got = run(bursts.bounded_bursts(stream, 10.0, "30 seconds"), "bounded_")
    out = sorted((r["key"], r["n_events"], r["closed_by"]) for r in got if r["key"] != "z")
    assert out == [("a", 1, "gap"), ("a", 1, "target_changed"), ("a", 2, "gap"), ("b", 1, "gap"), ("b", 1, "gap")]


def test_follow_and_compact(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"sessionID": "s", "recordType": "t", "n": 1}\n\n{"sessionID": "s", "recordType": "u"}\n')
    got = run(bursts.follow_journal(spark, str(tmp_path)), "follow_")
    assert sorted((r["session_id"], r["record_type"]) for r in got) == [("s", "t"), ("s", "u")]
    rows = spark.createDataFrame([("read", "App", "\n".join(map(str, range(20)))), ("write", None, "a\n b")], "kind string, app_name string, content string")
    lines = [r["value"] for r in bursts.compact(rows).collect()]
    assert lines[0].count("\n") == 8 and lines[1] == "WRITE -\na b"


def test_reads_overtaken_on_streams(spark, tmp_path):
    for name, rows in (("r", [("k", "r1", 0, 10), ("k", "r2", 11, 12), ("j", "r3", 0, 10)]), ("w", [("k", "w1", 5)])):
        (tmp_path / name).mkdir()
        at = lambda s: f"2024-01-01T00:00:{s:02d}Z"
        body = [dict(key=k, read_id=i, last_activity=at(a), captured_at=at(c)) for k, i, a, c in rows] if name == "r" else [dict(key=k, write_id=i, input_at=at(a)) for k, i, a in rows]
        (tmp_path / name / "x.json").write_text("\n".join(map(json.dumps, body)))
    r = spark.readStream.schema("key string, read_id string, last_activity timestamp, captured_at timestamp").json(str(tmp_path / "r"))
    w = spark.readStream.schema("key string, write_id string, input_at timestamp").json(str(tmp_path / "w"))
    got = run(bursts.overtaken_reads(r, w, "1 minute", "5 minutes"), "overtaken_")
    assert [(x["read_id"], x["write_id"]) for x in got] == [("r1", "w1")]
    assert got[0].__fields__ == ["key", "read_id", "write_id", "input_at"]


def test_late_rows_are_kept_apart(spark, tmp_path):
    rows = [("a", 100, "typed"), ("b", 5, "typed"), ("a", 60, "typed"), ("a", 95, "typed"), ("b", 4, "typed"), ("a", 101, "typed")]
    stream = spark.readStream.schema("key string, ts timestamp, hint string").option("maxFilesPerTrigger", 1).json(files(tmp_path, rows, 3))
    got = run(bursts.marked_late(stream, 30.0), "late_")
    assert len(got) == len(rows) and [(r["key"], r["ts"].second + 60 * r["ts"].minute) for r in got if r["is_late"]] == [("a", 60)]


def test_earlier_events_move_an_open_burst_s_beginning(spark, tmp_path):
    rows = [("a", 50, "typed"), ("a", 45, "typed"), ("a", 10, "typed"), ("z", 300, "typed")]
    stream = spark.readStream.schema("key string, ts timestamp, hint string").option("maxFilesPerTrigger", 1).json(files(tmp_path, rows, 4))
    got = run(bursts.bounded_bursts(stream, 10.0, "100 seconds"), "earlier_")
    out = sorted((r["began_at"].second, r["ended_at"].second, r["n_events"], r["closed_by"]) for r in got if r["key"] == "a")
    assert out == [(10, 10, 1, "late"), (45, 50, 2, "gap")]
