import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files


def line(k):
    return json.dumps({"recordType": "t", "sessionID": "s", "n": k, "pad": "é" * (k % 7)}, ensure_ascii=False)


def numbers(spark, out):
    return sorted(json.loads(r["raw"])["n"] for r in spark.read.schema("path string, at long, session_id string, record_type string, raw string").parquet(out).collect())


def test_follower_restarts_holds_partial_lines_and_begins_anew(spark, tmp_path, monkeypatch):
    path, out, mark = tmp_path / "raw.jsonl", str(tmp_path / "out"), str(tmp_path / "mark")
    path.write_text("".join(line(k) + "\n" + "\n" * (k % 3 == 0) for k in range(20)) + line(20)[:9])

    def step():
        q = files.follow_tail(spark, str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    step()
    assert numbers(spark, out) == list(range(12, 20))  # the last eight; the begun line waits
    with path.open("a") as f:
        f.write(line(20)[9:] + "\n" + line(21) + "\n" + line(22)[:5])
    step()
    assert numbers(spark, out) == list(range(12, 22))
    step()
    assert numbers(spark, out) == list(range(12, 22))  # a restart repeats nothing
    path.write_text(line(100) + "\n" + line(101) + "\n")
    step()
    assert numbers(spark, out) == [*range(12, 22), 100, 101]


def test_parts_make_each_line_once(tmp_path, monkeypatch):
    path = tmp_path / "raw.jsonl"
    text = "".join(line(k) * (1 + k % 5 * 30) + "\n" + "\n" * (k % 4 == 1) for k in range(200)) + "open"
    path.write_text(text)
    want, at = [], 0
    for x in text.encode().split(b"\n")[:-1]:
        if x:
            want.append((str(path), at, x.decode()))
        at += len(x) + 1
    for size in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(files, "PART_BYTES", size)
        reader = files._TailReader(str(path), True)
        if size == 1:
            path.write_text(text[:600])
            parts = reader.partitions({}, reader.latestOffset())
            got = [tuple(r) for p in parts for r in reader.read(p)]
            assert got == [w for w in want if w[1] + len(w[2].encode()) < len(text[:600].encode())]
            path.write_text(text)
            continue
        parts = reader.partitions({}, reader.latestOffset())
        assert [tuple(r) for p in parts for r in reader.read(p)] == want


def test_attach_within_the_last_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TAIL_BYTES", 30)
    path = tmp_path / "raw.jsonl"
    path.write_text("".join(f"line-{k}\n" for k in range(9)))  # 7 bytes each
    reader = files._TailReader(str(path), False)
    (at,) = reader.initialOffset().values()
    assert path.read_bytes()[at:] == b"line-5\nline-6\nline-7\nline-8\n"
    path.write_text("x" * 100)
    assert list(reader.latestOffset().values()) == [0] and list(reader.initialOffset().values()) == [0]


def test_sink_publishes_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = spark.range(100).selectExpr("id as n", "if(id % 2 = 0, null, 'é') as b").repartition(5)
    bad = rows.withColumn("b", F.when(F.col("n") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="lost"):
        files.publish_journal(bad, path)
    assert os.listdir(tmp_path) == []
    files.publish_journal(rows, path, "s1", ["n"])
    got = [x for name in sorted(os.listdir(path)) for x in open(f"{path}/{name}", encoding="utf-8").read().splitlines()]
    assert got == [json.dumps({**({"b": "é"} if k % 2 else {}), "n": k, "sessionID": "s1"}, separators=(",", ":"), ensure_ascii=False) for k in range(100)]
    assert all(stat.S_IMODE(os.stat(f"{path}/{name}").st_mode) == 0o600 for name in os.listdir(path))
    with pytest.raises(Exception, match="exists"):
        files.publish_journal(rows, path)
    assert os.listdir(tmp_path) == ["journal"]
    files.publish_journal(rows.limit(0), str(tmp_path / "none"))
    assert os.path.isdir(tmp_path / "none")


def test_results_resume_after_an_ordered_prefix(spark):
    expected = spark.createDataFrame([("b1", f"e{k}", k) for k in range(10)], "block string, example string, place long")
    keys = ["block", "example"]
    left = files.remaining(expected, expected.where("place < 4"), keys)
    assert sorted(r["place"] for r in left.collect()) == [4, 5, 6, 7, 8, 9] and left.columns == expected.columns
    assert files.remaining(expected, expected.limit(0), keys).count() == 10 and files.remaining(expected, expected, keys).count() == 0
    broken = [expected.where("place in (0, 2)"), expected.where("place < 2").withColumn("example", F.lit("e0")), expected.union(spark.createDataFrame([("b1", "x", 10)], expected.schema))]
    for held in broken:
        with pytest.raises(Exception, match="not a prefix"):
            files.remaining(expected, held, keys).collect()
