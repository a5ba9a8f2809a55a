"""Readers on small files of each kind, good and bad."""

import json

from pyspark.sql import functions as F

from runtrail.operators import tokens, triage
from runtrail.plans import report
from runtrail.sources import reports


def files(spark, **texts):
    rows = [(k, v.encode() if isinstance(v, str) else v) for k, v in texts.items()]
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary").withColumn("sha256", F.sha2("content", 256))


SANDBOX = {
    "info": {"id": 7},
    "target": {"file": {"name": "s.exe", "sha256": "ab"}},
    "behavior": {
        "processes": [
            {"process_id": 100, "parent_id": 4, "process_name": "s.exe", "calls": [
                {"timestamp": 10.0, "api": "NtOpenFile", "category": "file", "arguments": []},
                {"timestamp": 10.5, "api": "WriteProcessMemory", "category": "p", "arguments": [{"name": "ProcessId", "value": "3300"}]},
                {"timestamp": 9.0, "api": "RegSetValueExA", "category": "r", "arguments": {"FullName": "HKCU\\Run\\x"}},
            ]},
            {"process_id": 101, "parent_id": 100, "process_name": "c.exe", "environ": {"CommandLine": "c.exe /x"}, "calls": []},
        ],
        "summary": {"files": ["C:\\a.txt", "C:\\w.dat"], "write_files": ["c:\\W.dat"], "keys": ["HKCU\\Run\\X"], "resolved_apis": ["k.dll.Sleep"], "executed_commands": ['"C:\\p q\\t.exe" -z'], "write_keys": ["hkcu\\run\\X"]},
    },
    "network": {"dns": [{"request": "x.test"}], "tcp": [{"dst": "1.2.3.4", "dport": 80}, {"dst": "1.2.3.4", "dport": 80}], "udp": []},
    "static": {"pe": {"imphash": "aa", "osversion": "6.0", "imported_dll_count": 2, "timestamp": "2019-01-01 00:00:00", "sections": [{"name": ".text", "entropy": "7.9"}, {"name": "UPX0", "entropy": "NaN"}], "imports": [{"dll": "K.DLL", "imports": [{"name": "WriteProcessMemory"}, {"name": "Sleep"}]}]}},
}


def test_native_traces(spark):
    good = {"run_id": "r", "events": [{"ts": 2, "type": "file_write", "pid": 1, "image": "a", "target": "x"}, {"ts": 1, "type": "dns_query", "pid": 1, "image": "a"}]}
    bad = {"events": [{"ts": 1, "type": "nope", "pid": 1, "image": "a"}]}
    events, rejects = reports.native_traces(files(spark, good=json.dumps(good), bad=json.dumps(bad), none="nope", array="[]", missing=json.dumps({"events": [{"ts": 1, "type": "dns_query", "image": "a"}]})))
    assert [(r["type"], r["seq"]) for r in events.orderBy("seq").collect()] == [("dns_query", 1), ("file_write", 2)]
    assert {r["path"] for r in rejects.collect()} == {"bad", "none", "array", "missing"}


def test_sandbox_reports(spark):
    f = files(spark, a=json.dumps(SANDBOX), b="{}", c="no json")
    events, rejects = reports.sandbox_events(f)
    rows = events.orderBy("seq").collect()
    kinds = [(r["type"], r["target"]) for r in rows]
    assert ("process_inject", "pid 3300") in kinds and ("registry_set", "HKCU\\Run\\x") in kinds and ("api_call", "NtOpenFile") in kinds
    assert kinds.count(("net_connect", "1.2.3.4:80")) == 1 and ("dns_query", "x.test") in kinds
    assert ("process_create", "c.exe") in kinds and ("process_create", "t.exe") in kinds
    assert ("registry_set", "hkcu\\run\\X") not in kinds  # the call log has it
    assert not any(t == "k.dll.Sleep" for _, t in kinds)  # API names of the summary go where there is a call log
    assert [t for k, t in kinds if k == "file_read"] == ["C:\\a.txt"]  # w.dat is a written file already
    assert min(r["ts"] for r in rows) == 0.0 and len({r["run_id"] for r in rows}) == 1
    assert {(r["run_id"], r["name"]) for r in reports.run_names(f.where("path = 'a'")).collect()} == {(rows[0]["run_id"], "7")}
    assert {r["path"] for r in rejects.collect()} == {"b", "c"}
    meta = reports.file_metadata(f).where("pe is not null")
    (bag,) = [r["tokens"] for r in tokens.static_tokens(meta).collect()]
    assert {"imphash:aa", "imp:k.dll:sleep", "dll:k.dll", "sec_ent:.text:7", "sec_ent:upx0:0", "osversion:6.0", "ndll:2", "pe_year:2019"} == set(bag) - {"imp:k.dll:writeprocessmemory", "sec:.text", "sec:upx0"}
    scored = triage.triage_metadata(meta).first()
    assert scored["detonate"] and {r["feature"] for r in scored["reasons"]} == {"api:WriteProcessMemory", "packer:UPX0", "high_entropy", "few_imports", "pe_executable"}


def log_event(eid, **data):
    fields = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in data.items())
    return f"<Event xmlns='x'><System><EventID>{eid}</EventID></System><EventData>{fields}</EventData></Event>"


def test_host_logs(spark):
    xml = log_event(1, UtcTime="2026-01-01 10:00:00.100", Image="C:\\x\\a.exe", ProcessId="5", ParentImage="C:\\b.exe", ParentProcessId="4", CommandLine="a &lt;1&gt;") + log_event(3, UtcTime="2026-01-01 10:00:02.100", Image="a.exe", ProcessId="5", DestinationIp="1.2.3.4", DestinationPort="443") + log_event(12, EventType="CreateKey", TargetObject="HKLM\\k") + log_event(13, TargetObject="HKLM\\k\\v", Image="a.exe") + log_event(5, Image="a")
    lines = "\n".join(json.dumps(x) for x in ({"EventID": 22, "EventData": {"QueryName": "q.test", "Image": "a.exe", "ProcessId": "5"}}, {"event_id": 11, "TargetFilename": "C:\\f.exe", "Image": "C:\\a.exe", "ProcessId": "0x5"}))
    events, rejects = reports.host_log_events(files(spark, xml=xml, json=lines, wide=xml.encode("utf-16"), bad=lines + "\nnot json", dtd="<!DOCTYPE x []>" + xml))
    got = {}
    for r in events.orderBy("seq").collect():
        got.setdefault(r["run_id"], []).append((r["type"], r["target"], r["pid"], r["ts"]))
    assert sorted(map(len, got.values())) == [2, 3, 3]
    xml_rows = next(v for v in got.values() if len(v) == 3)
    assert ("process_create", "a.exe", 4, 0.0) in xml_rows and ("net_connect", "1.2.3.4:443", 5, 2.0) in xml_rows
    assert {(k, t, p) for k, t, p, _ in next(v for v in got.values() if len(v) == 2)} == {("dns_query", "q.test", 5), ("file_write", "C:\\f.exe", 5)}
    assert {r["path"] for r in rejects.collect()} == {"bad", "dtd"}


def test_emulator_reports(spark):
    entry = {"ep_type": "m", "apis": [{"api_name": "KERNEL32.CreateFileA", "args": ["x"]}], "file_access": [{"event": "write", "path": "C:\\w"}, {"event": "open", "path": "C:\\r"}], "registry_access": [{"event": "create_key", "path": "HK"}, {"event": "set_value", "path": "HK", "value_name": "v"}], "network_events": {"dns": [{"query": "d.test"}], "traffic": [{"server": "9.9.9.9", "port": 53, "proto": "udp"}]}}
    events, rejects = reports.emulator_events(files(spark, listed=json.dumps([entry]), wrapped=json.dumps({"sha256": "x", "entry_points": [entry]}), empty="[]", none="{}"))
    rows = [(r["type"], r["target"]) for r in events.orderBy("run_id", "seq").collect()]
    want = [("api_call", "CreateFileA"), ("file_write", "C:\\w"), ("file_read", "C:\\r"), ("registry_set", "HK\\v"), ("dns_query", "d.test"), ("net_connect", "9.9.9.9:53")]
    assert rows == want * 2 and {r["path"] for r in rejects.collect()} == {"empty", "none"}


def test_tables(spark, tmp_path):
    (tmp_path / "calls.csv").write_text("sha256,labels,0,1,2\nab,1,Open,,Read\ncd,0,Close\n")
    calls = reports.sequence_table(spark, str(tmp_path / "calls.csv"))
    assert sorted((r["sha256"], r["label"], r["apis"]) for r in calls.collect()) == [("ab", 1, ["Open", "Read"]), ("cd", 0, ["Close"])]
    events = reports.call_sequences(spark.createDataFrame([("r", ["A", "", "B"])], "run_id string, apis array<string>"))
    assert [(r["target"], r["ts"]) for r in events.orderBy("seq").collect()] == [("A", 0.0), ("B", 2.0)]
    (tmp_path / "labels.csv").write_text("sha256,classification_family,classification_type,date\na,F,t,2019-01-01\na,G,t,2019-09-01\n")
    assert [tuple(r) for r in reports.labels_table(spark, str(tmp_path / "labels.csv")).select("sha256", "family", "split").collect()] == [("a", "G", "test")]


def test_whole_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(SANDBOX))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"run_id": "n", "events": [{"ts": 1, "type": "process_create", "pid": 1, "image": "a", "target": "powershell.exe", "cmdline": "powershell -enc AAAAAAAAAAAAAAAA", "child_pid": 2}]}))
    (tmp_path / "in" / "c.json").write_text("junk")
    rows, rejects = report.reports(spark, str(tmp_path / "in"))
    got = {r["report"]["name"]: r for r in rows.collect()}
    assert set(got) == {"7", "n"} and len({r["run_id"] for r in got.values()}) == 2 and rejects.count() == 1
    assert got["n"]["report"]["techniques"] == ["T1059.001"] and got["7"]["report"]["static"]["detonate"]
    assert any("powershell.exe" in s for s in got["n"]["report"]["rules"])
    again = {r["report"]["name"]: r["content_sha256"] for r in report.reports(spark, str(tmp_path / "in"))[0].collect()}
    assert again == {k: r["content_sha256"] for k, r in got.items()}
    done = report.batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ledger"))
    assert sorted(r["status"] for r in done.collect()) == ["done", "done", "failed"]
