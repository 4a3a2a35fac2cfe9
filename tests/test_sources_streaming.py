import json

import pytest
from builders import rows
from pyspark.sql import functions as F

from duologue.sources import discovery, sinks, stages
from duologue.streaming import turns as st


def make(tmp_path, *names):
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    return str(tmp_path)


def test_tokens_in_names(spark, tmp_path):
    root = make(tmp_path, "d1_close_a.mp4", "d1_close_b.mp4", "d1_wide.mov", "x/d2-A.MP4", "x/d2-B.mp4", "notes.txt", "d3_close_a.mp4")
    found = {r["session_id"]: set(r["views"]) for r in discovery.discover_sessions(spark, root).collect()}
    assert found == {"d1": {"close_a", "close_b", "wide"}, "d2": {"close_a", "close_b"}}
    assert discovery.discover_sessions(spark, root, strict=False).count() == 3


def test_pairs_by_field(spark, tmp_path):
    root = make(tmp_path, "p01_s1.mp4", "p02_s1.mp4", "p03_s2.mp4", "p04_s2.mp4")
    found = {r["session_id"]: r["views"] for r in discovery.discover_sessions(spark, root).collect()}
    assert set(found) == {"s1", "s2"} and found["s1"]["close_a"].endswith("p01_s1.mp4")
    with pytest.raises(discovery.SessionError):
        discovery.discover_sessions(spark, make(tmp_path / "odd", "p01_s1.mp4", "p02_s1.mp4", "p03_s2.mp4"))
    with pytest.raises(discovery.SessionError):
        discovery.discover_sessions(spark, make(tmp_path / "twice", "d_close_a.mp4", "y/d_close_a.mp4"))


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"session_id": "q", "views": {"close_a": "a.mp4", "close_b": "/abs/b.mp4"}, "metadata": {"site": "x"}}, {"views": {"close_a": "c.mp4"}}]))
    got = rows(discovery.iter_sessions(spark, str(path)), "session_id")
    assert got[0]["views"] == {"close_a": f"{tmp_path}/a.mp4", "close_b": "/abs/b.mp4"} and got[1]["session_id"] == "session002"


def test_stage_tables(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    w = stages.Workspace(spark, str(tmp_path))
    assert w.table("t", {"a": 1}, build).count() == 3 and w.table("t", {"a": 1}, build).count() == 3 and len(calls) == 1
    assert w.table("t", {"a": 2}, build).count() == 3 and len(calls) == 2 and stages.key_of({"a": 1, "b": 2}) == stages.key_of({"b": 2, "a": 1})
    w.clear()
    w.table("t", {"a": 2}, build)
    assert len(calls) == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "</script>")], "session_id string, i int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_timeline(df, str(tmp_path / "p"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["t"] == "</script>" and spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert "</" not in df.select(sinks.embeddable_json(F.struct("t"))).first()[0]


def test_streaming_floor(spark, tmp_path):
    schema = "session_id string, person string, start double, end double, takes_floor boolean"
    spark.createDataFrame([("s", "A", 0.0, 3.0, True), ("s", "B", 1.0, 1.3, False), ("s", "B", 3.5, 6.0, True), ("s", "A", 6.2, 8.0, True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.stream_turns(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("floor_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["person"], r["turn"]) for r in rows(spark.table("floor_out"), "start")] == [("A", 0), ("B", 1), ("A", 2)]


def test_streaming_units(spark, tmp_path):
    data = [("s", "A", "2024-01-01 00:00:00", "2024-01-01 00:00:01"), ("s", "A", "2024-01-01 00:00:01.100", "2024-01-01 00:00:02"), ("s", "A", "2024-01-01 00:00:05", "2024-01-01 00:00:06"), ("s", "A", "2024-01-01 01:00:00", "2024-01-01 01:00:01")]
    df = spark.createDataFrame(data, "session_id string, person string, ts string, end_ts string").select("session_id", "person", F.to_timestamp("ts").alias("ts"), F.to_timestamp("end_ts").alias("end_ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.stream_ipus(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("unit_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["start"].second, r["end"].second) for r in rows(spark.table("unit_out"), "start")][:2] == [(0, 2), (5, 6)]


def test_fingerprints_and_manifests(spark, tmp_path):
    import json
    import os

    from duologue.sources import stages

    one = tmp_path / "media" / "a.mp4"
    one.parent.mkdir()
    one.write_bytes(b"x" * 3_000_000)
    os.utime(one, (1_000_000, 1_000_000))
    before, listed = stages.fingerprint_file(str(one)), stages.fingerprints(spark, str(one.parent)).first()["fingerprint"]
    assert before == stages.fingerprint_file(str(one)) and len(before) == 32 and len(listed) == 32
    one.write_bytes(b"x" * 2_999_999 + b"y")  # the last byte
    os.utime(one, (1_000_000, 1_000_000))
    assert stages.fingerprint_file(str(one)) != before
    one.write_bytes(b"x" * 2_000_000)
    os.utime(one, (1_000_000, 1_000_000))
    assert stages.fingerprints(spark, str(one.parent)).first()["fingerprint"] != listed
    work = stages.Workspace(spark, f"file://{tmp_path}/work")
    path = work.write_manifest({"settings": {"a": 1}, "n": 2})
    assert json.loads(open(path.removeprefix("file://")).read()) == {"settings": {"a": 1}, "n": 2}
