"""Commands with their exit codes, the stream over a folder, ranks by hash, texts by width, sources that change, feature rows."""

import binascii
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtrail import __main__ as commands
from runtrail import session
from runtrail.operators import evaluation, models, negatives, triage
from runtrail.plans import report
from runtrail.sources import reports as sources


def native(run, target="a.exe"):
    return json.dumps({"run_id": run, "events": [{"ts": 0.0, "type": "process_create", "pid": 1, "image": "x.exe", "target": target, "cmdline": f"{target} /c run", "child_pid": 2}]})


def short_reports(spark, files):
    found, rejects = sources.parsed_files(sources.read_files(spark, files)[0] if isinstance(files, str) else files)
    return found.select("run_id", F.lit("h").alias("content_sha256"), F.lit("{}").alias("json"), F.lit("page").alias("page")).distinct(), rejects


@pytest.fixture
def quick(monkeypatch):
    """The whole report is tested elsewhere."""
    monkeypatch.setattr(report, "reports", short_reports)
    monkeypatch.setattr(report, "write_reports", lambda rows, out: rows.write.mode("overwrite").parquet(out))


def test_commands_exit_with_what_happened(spark, tmp_path, quick, capsys):
    runs, out = tmp_path / "runs", str(tmp_path / "out")
    runs.mkdir()
    (runs / "a.json").write_text(native("a"))
    assert commands.main(["report", str(runs), out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"reports": 1}
    pages = spark.read.text(f"{out}/pages")
    assert pages.count() == 1 and pages.first()["run_id"].startswith("native-")
    assert commands.main(["batch", str(runs), f"{out}-batch"]) == 0
    (runs / "b.json").write_text("{broken")
    assert commands.main(["report", str(runs), out]) == 1  # a reject
    assert [r["path"].split("/")[-1] for r in spark.read.parquet(f"{out}/rejects").collect()] == ["b.json"]
    assert commands.main(["batch", str(runs), f"{out}-batch"]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["failed"] == 1
    assert commands.main(["triage", str(runs), out]) == 0 and {r["md5"] for r in spark.read.parquet(f"{out}/triage").select("md5").collect()} >= {__import__("hashlib").md5(b"{broken").hexdigest()}
    assert commands.main(["report", str(tmp_path / "nowhere"), out]) == 2 and "not found" in capsys.readouterr().err
    for wrong in ([], ["fly"], ["report", "one"]):
        with pytest.raises(SystemExit) as stop:
            commands.main(wrong)
        assert stop.value.code == 2


def test_feature_commands_train_score_and_explain(spark, tmp_path, capsys):
    pick = random.Random(1)
    rows = []
    for i in range(160):
        bad = i % 2
        rows.append({"sha256": f"{i:064x}", "label": bad, "histogram": [pick.randint(1, 9) for _ in range(256)], "strings": {"urls": 5.0 * bad + pick.random(), "numstrings": pick.random()}, "imports": {"K.dll": ["WinExec" if bad and pick.random() < 0.9 else "ReadFile"]}})
    rows.append({"sha256": "u", "label": -1})
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, rows)))
    model, out = str(tmp_path / "model"), str(tmp_path / "out")
    assert commands.main(["train-features", str(tmp_path / "f.jsonl"), model]) == 0
    assert commands.main(["triage-features", str(tmp_path / "f.jsonl"), model, out]) == 0
    got = {r["sha256"]: r for r in spark.read.json(f"{out}/triage").collect()}
    assert len(got) == 161 and sum(got[f"{i:064x}"]["detonate"] == bool(i % 2) for i in range(160)) > 150
    assert got[f"{1:064x}"]["top"][0]["feature"] in ("strings.urls", "imports:WinExec") and len(got[f"{1:064x}"]["top"]) <= 6
    (tmp_path / "none.jsonl").write_text('{"label": 1}')
    capsys.readouterr()
    assert commands.main(["train-features", str(tmp_path / "none.jsonl"), model]) == 1 and "too few" in capsys.readouterr().err
    assert commands.main(["triage-features", str(tmp_path / "f.jsonl"), str(tmp_path / "no-model"), out]) == 1


def test_a_stream_reports_each_content_once_over_stops(spark, tmp_path, quick, monkeypatch):
    folder, out, ledger, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger"), str(tmp_path / "marks")
    folder.mkdir()

    def go():
        stream = report.report_stream(spark, str(folder), out, ledger, marks)
        stream.awaitTermination()

    (folder / "a.json").write_text(native("same"))
    go()
    (folder / "b.json").write_text(native("same", "b.exe"))
    (folder / "copy.json").write_text(native("same"))
    (folder / "torn.json").write_text("{torn")
    with monkeypatch.context() as m:  # stops between the reports and the ledger of its second micro-batch
        real = report.staged
        m.setattr(report, "staged", lambda df, label: (_ for _ in ()).throw(OSError("lost")) if label == "ledger" else real(df, label))
        with pytest.raises(Exception, match="lost"):
            go()
    assert report.finished_reports(spark, out, ledger).count() == 1
    go()
    go()
    (folder / "late.json").write_text(native("late"))
    go()
    ids = [r["run_id"] for r in report.finished_reports(spark, out, ledger).collect()]
    assert len(ids) == len(set(ids)) == 3
    states = sorted((r["status"], r["n"]) for r in report.ledger_of(spark, ledger).groupBy("status").agg(F.count("*").alias("n")).collect())
    assert states == [("done", 3), ("failed", 1)]
    (tmp_path / "ledger" / "torn").mkdir()
    (tmp_path / "ledger" / "torn" / "part-0.parquet").write_bytes(b"PAR1 torn")
    assert report.ledger_of(spark, ledger).count() == 4


def test_ranks_by_hash_ranges_equal_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).select("id", F.when(F.col("id") < 2500, "hot").when(F.col("id") % 7 > 0, "cold").alias("label"))
    rows = rows.unionByName(rows.limit(50))
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(3), "id"), "id")))
    got = evaluation.hash_ranked(rows, "label", "id", 3, "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    per = models.folds(rows, "id", "label", 4).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert max(r["d"] for r in per.collect()) <= 1
    runs = rows.select(F.col("label").alias("family"), F.col("id").alias("run_id"))
    assert {r["family"]: r["count"] for r in negatives.sampled_runs(runs, 20).groupBy("family").count().collect()} == {"hot": 20, "cold": 20, None: 20}


def test_texts_are_decoded_by_the_width_of_their_letters(spark):
    text = '{"EventID": 1, "x": "день €"}'
    forms = [text.encode(c) for c in ("utf-8", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le", "utf-32-be", "utf-8-sig")] + [text.encode("utf-16-le") + b"x"]
    got = [r["t"] for r in spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(forms)], "i int, b binary").select("i", sources.decoded(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == [text] * len(forms)


def test_a_table_is_made_anew_when_its_source_changes(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert session.ingested(spark, "changing", path, make).count() == session.ingested(spark, "changing", path, make).count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert session.ingested(spark, "changing", path, make).count() == 8 and len(made) == 2


def test_feature_rows_have_named_places(spark, tmp_path):
    crc = lambda t, n: binascii.crc32(t.encode()) % n
    row = {
        "sha256": "a", "label": 1, "histogram": [3] * 128 + [0] * 128, "strings": {"numstrings": 4, "printables": 10, "printabledist": [5] + [0] * 94 + [5], "urls": 2}, "general": {"size": 77},
        "header": {"coff": {"timestamp": 9, "machine": "I386", "characteristics": ["A", "B", "A"]}, "optional": {"magic": "PE32", "sizeof_code": 512}},
        "section": {"entry": ".text", "sections": [{"name": ".text", "size": 10, "entropy": 6.5, "vsize": 12, "props": ["MEM_READ", "MEM_EXECUTE"]}, {"name": "UPX0", "size": 0, "props": ["MEM_WRITE"]}, {"name": ""}]},
        "imports": {"KERNEL32.dll": ["VirtualAllocEx@8", "sleep"], "a.dll": []}, "exports": ["f", "g"], "datadirectories": [{"name": "x", "size": 3, "virtual_address": 4}],
    }
    (tmp_path / "part.jsonl").write_text(json.dumps(row) + "\n{}\n")
    read = sources.feature_rows(spark, str(tmp_path / "part.jsonl"), labelled_only=False)
    got = triage.file_features(read).orderBy(F.desc("sha256")).collect()
    assert {r["member"] for r in got} == {"part.jsonl"} and {len(r["features"]) for r in got} == {2440} == {len(triage.FEATURE_NAMES)} and len(set(triage.FEATURE_NAMES)) == 2440
    at = dict(zip(triage.FEATURE_NAMES, got[0]["features"]))
    want = {"histogram[0]": 1 / 128, "strings.numstrings": 4, "strings.printabledist[95]": 0.5, "strings.urls": 2, "general.size": 77, "header.coff.timestamp": 9, f"header.machine#{crc('I386', 10)}": 1, "header.sizeof_code": 512, "section.count": 3, "section.n_zero_size": 2, "section.n_empty_name": 1, "section.n_rx": 1, "section.n_w": 1, f"section.size#{crc('.text', 50)}": 10, f"section.entry_name#{crc('.text', 50)}": 1, f"section.entry_props#{crc('MEM_READ', 50)}": 1, f"imports.library#{crc('a.dll', 256)}": 1, f"imports.function#{crc('kernel32.dll:sleep', 1024)}": 1, "datadir[0].size": 3, "datadir[0].va": 4, "imports:VirtualAllocEx": 1, "imports:Sleep": 1, "imports:WinExec": 0, "section:upx0": 1, "file_entropy": 7}
    assert {k: at[k] for k in want} == pytest.approx(want)
    assert sum(at[f"header.characteristics#{i}"] for i in range(10)) == 3 and sum(at[f"exports#{i}"] for i in range(128)) == 2
    empty = dict(zip(triage.FEATURE_NAMES, got[1]["features"]))
    marks = {f"header.machine#{crc('', 10)}", f"header.subsystem#{crc('', 10)}", f"header.magic#{crc('', 10)}", f"section.entry_name#{crc('', 50)}"}
    assert {k for k, v in empty.items() if v} == marks and all(math.isfinite(v) for v in np.array(got[1]["features"]))
