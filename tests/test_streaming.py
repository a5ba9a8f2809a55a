"""Streams over files that arrive."""

import json

from runtrail.streaming import events as stream


def test_windows_sessions_and_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"run_id": f"r{i % 2}", "at": f"2024-01-01T00:{i:02d}:00Z", "type": "net_connect" if i % 2 else "file_read", "target": "x", "cmdline": None} for i in range(30)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows[:15])))
    (source / "b.json").write_text("\n".join(map(json.dumps, rows[15:])) + "\n" + json.dumps(rows[29] | {"at": "2024-01-01T09:00:00Z"}))
    live = stream.event_stream(spark, str(source))
    q = stream.technique_windows(live).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("w").collect()) == 16
    q = stream.run_sessions(live).writeStream.outputMode("append").format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["events"] for r in spark.table("s").collect()) == 30
    q = stream.running_suspicion(live, threshold=0.0, least=1).writeStream.outputMode("update").format("memory").queryName("a").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["run_id"]: r["n"] for r in spark.table("a").orderBy("n").collect()} == {"r0": 15, "r1": 16}
    q = stream.write_stream(live, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 31
