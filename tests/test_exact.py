"""Nothing is cut silently: exact statistics, whole reachability, batches that run again, runs kept apart, models that come back."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from runtrail.operators import evaluation as ev
from runtrail.operators import events, evidence, graph, models, rules, tokens, triage
from runtrail.plans import report
from runtrail.sources import reports as sources


def test_tests_of_clusters_are_exact_or_an_error(spark):
    means = [1.0, 1.0, 1.0, -5.0, 2.5, 2.5, -0.5, 3.0]
    rows = spark.createDataFrame([(k, m + d) for k, m in enumerate(means) for d in (-1.0, 1.0)], "k int, v double")
    got = ev.sign_flips(rows, "k", "v").first()
    sums = [abs(sum(m * s for m, s in zip(means, signs))) for signs in itertools.product((1, -1), repeat=len(means))]
    assert got["observed"] == pytest.approx(sum(means) / len(means)) and got["p"] == pytest.approx(sum(s >= abs(sum(means)) - 1e-12 for s in sums) / len(sums))
    order = sorted(map(abs, means))
    ranks = [(2 * order.index(abs(m)) + order.count(abs(m)) + 1) / 2 for m in means]
    observed = abs(sum(r if m > 0 else -r for m, r in zip(means, ranks)))
    sums = [abs(sum(r * s for r, s in zip(ranks, signs))) for signs in itertools.product((1, -1), repeat=len(means))]
    got = ev.signed_ranks(rows, "k", "v").first()
    assert got["p"] == pytest.approx(sum(s >= observed - 1e-12 for s in sums) / len(sums)) and got["statistic"] == (sum(ranks) - observed) / 2
    many = spark.range(30).select(F.col("id").alias("k"), F.lit(1.0).alias("v"))
    assert tuple(ev.sign_flips(rows.limit(0), "k", "v").first()) == (None, 1.0) and ev.signed_ranks(rows.limit(0), "k", "v").first()["p"] == 1.0
    for test in (ev.sign_flips, ev.signed_ranks):
        with pytest.raises(ValueError):
            test(many, "k", "v")


def test_every_group_size_has_its_quantile(spark):
    rows = spark.createDataFrame([(n, float(i % 2)) for n in (1, 2, 3, 10, 40) for i in range(n)], "g int, v double")
    got = {r["g"]: r for r in ev.mean_interval(rows, "v", ["g"]).collect()}
    t = {2: 12.706205, 3: 4.302653, 10: 2.262157, 40: 2.022691}
    for n in (2, 3, 10, 40):
        values = [i % 2 for i in range(n)]
        mean = sum(values) / n
        sd = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5
        assert got[n]["half"] == pytest.approx(t[n] * sd / n**0.5, rel=1e-4)
    assert got[1]["half"] == 0


def test_proportions_near_one_stay_within_bounds(spark):
    import math

    values = [0.99, 1.0, 0.98, 0.995, 0.97]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = ev.proportion_interval(rows, "v", 800, 200).first()
    odds = [math.log(p / (1 - p)) for p in (min(max(v, 0.0025), 0.9975) for v in values)]
    mean = sum(odds) / 5
    half = 2.776445 * (sum((o - mean) ** 2 for o in odds) / 4 * (1 / 5 + 200 / 800)) ** 0.5
    assert got["on_logit"] and got["low"] == pytest.approx(1 / (1 + math.exp(half - mean)), rel=1e-5) and got["high"] == pytest.approx(1 / (1 + math.exp(-mean - half)), rel=1e-5)


def test_bootstrap_of_groups_surrounds_the_mean(spark):
    rows = spark.createDataFrame([(f"g{i % 6}", float(i % 6) + (i % 5) / 10) for i in range(120)], "g string, v double")
    got = ev.two_level_bootstrap(rows, "g", "v", draws=300).first()
    assert 1.0 < got["low"] < 2.7 < got["high"] < 4.4


def test_running_totals_over_many_values(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    values = sorted(((r["score"], r["label"]) for r in rows.collect()), reverse=True)
    tp = fp = 0
    area = 0
    for _, label in values:
        tp, fp = tp + label, fp + 1 - label
        area += tp * (1 - label)
    assert ev.roc_auc(rows).first()["auc"] == pytest.approx(area / (tp * fp))
    positives = sorted(s for s, label in values if label)
    assert ev.gate_threshold(rows, 0.9).first()["threshold"] == positives[int((1 - 0.9) * len(positives))]


def test_descendants_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([("r", f"n{i}", f"n{i + 1}") for i in range(20)], "run_id string, src string, dst string")
    start = spark.createDataFrame([("r", "n0")], "run_id string, id string")
    assert graph.descendants(chain, start).count() == 20
    with pytest.raises(RuntimeError):
        graph.descendants(chain, start, max_rounds=5)
    assert [r["dst"] for r in graph.children(chain.withColumns({"relation": F.lit("spawned"), "seq": F.lit(1)}), "n3").collect()] == ["n4"]


def test_folds_are_stratified_and_stable(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("y"))
    folded = models.folds(rows, "id", "y", 5)
    assert {(r["fold"], r["y"]): r["count"] for r in folded.groupBy("fold", "y").count().collect()} == {(f, y): 10 for f in range(5) for y in range(2)}
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, models.folds(rows.repartition(7), "id", "y", 5).collect()))


def native(run=None, digest=None, target="a.exe"):
    body = {"events": [{"ts": 0.0, "type": "process_create", "pid": 1, "image": "x.exe", "target": target, "cmdline": f"{target} /c run", "child_pid": 2}]}
    return json.dumps(body | ({"run_id": run} if run else {}) | ({"sample_sha256": digest} if digest else {}))


def test_batches_do_only_what_is_new_and_nothing_twice(spark, tmp_path, monkeypatch):
    folder, out, ledger = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger")
    folder.mkdir()
    seen = []

    def short(spark, files):  # the whole report is tested elsewhere
        seen.append(files.count())
        found, rejects = sources.parsed_files(files)
        return found.select("run_id", F.lit("h").alias("content_sha256"), F.lit("{}").alias("json"), F.lit("").alias("page")).distinct(), rejects

    monkeypatch.setattr(report, "reports", short)
    monkeypatch.setattr(report, "write_reports", lambda rows, out: rows.write.mode("overwrite").parquet(out))
    (folder / "a.json").write_text(native("a"))
    assert [tuple(r) for r in report.batch(spark, str(folder), out, ledger).select("status").collect()] == [("done",)]
    (folder / "b.json").write_text(native("b", target="b.exe"))
    (folder / "c.json").write_text("{broken")
    stop = monkeypatch.context()
    with stop as m:  # a run that dies between its reports and its ledger
        m.setattr(report, "staged", lambda df, label: (_ for _ in ()).throw(OSError("lost")) if label == "ledger" else df)
        with pytest.raises(OSError):
            report.batch(spark, str(folder), out, ledger)
    assert report.finished_reports(spark, out, ledger).count() == 1
    again = {r["status"] for r in report.batch(spark, str(folder), out, ledger).collect()}
    assert again == {"done", "failed"}
    assert seen == [1, 2, 2]
    ids = [r["run_id"] for r in report.finished_reports(spark, out, ledger).collect()]
    names = sources.run_names(sources.read_files(spark, str(folder))[0]).where(F.col("run_id").isin(ids))
    assert len(ids) == 2 and sorted(r["name"] for r in names.collect()) == ["a", "b"]


def sandbox(run):
    return json.dumps({"info": {"id": run}, "behavior": {"summary": {"executed_commands": ["cmd.exe /c x"]}}, "network": {}})


def test_runs_of_several_files_readers_and_batches_stay_apart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a", native()), ("b", native(target="b.exe")), ("c", native("7")), ("d", native("7", target="d.exe")), ("copy", native("7")), ("box", sandbox(7))):
        (folder / f"{name}.json").write_text(text)
    found, rejects = sources.read_reports(spark, str(folder))
    runs = [r["run_id"] for r in found.collect()]
    assert len(runs) == len(set(runs)) == 5 and rejects.count() == 0
    names = {r["run_id"]: r["name"] for r in sources.run_names(sources.read_files(spark, str(folder))[0]).where("path not like '%copy%'").collect()}
    assert sorted(names[r] for r in runs) == ["7", "7", "7", "a.json", "b.json"]
    (folder / "a.json").unlink()  # an id does not depend on what else lies there
    assert set(sources.read_reports(spark, str(folder))[0].toPandas()["run_id"]) < set(runs)


def test_two_batches_of_equal_names_are_two_reports(spark, tmp_path):
    folder, out, ledger = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger")
    folder.mkdir()
    for text in (native("same"), native("same", target="b.exe")):
        (folder / f"{len(text)}.json").write_text(text)
        assert [r["status"] for r in report.batch(spark, str(folder), out, ledger).collect()] == ["done"]
    rows = report.finished_reports(spark, out, ledger).collect()
    assert len({r["run_id"] for r in rows}) == len(rows) == 2 and {json.loads(r["json"])["name"] for r in rows} == {"same"}


def test_samples_are_bound_to_their_runs(spark, tmp_path):
    import hashlib

    samples, runs = tmp_path / "samples", tmp_path / "runs"
    samples.mkdir(), runs.mkdir()
    data = b"MZ" + b"powershell -enc AAAA http://evil.example.net/x VirtualAllocEx WriteProcessMemory"
    (samples / "s.bin").write_bytes(data)
    (runs / "bound.json").write_text(native("bound", hashlib.sha256(data).hexdigest()))
    (runs / "free.json").write_text(native("free"))
    (runs / "other.json").write_text(native("other", "0" * 64))
    path = spark.read.format("binaryFile").load(str(samples)).first()["path"]
    (runs / "twice.json").write_text(native("twice"))
    (runs / "again.json").write_text(native("twice", target="b.exe"))
    (runs / "torn.json").write_text(native("torn")[:40])
    (runs / "log.json").write_text('{"EventID": 255}')
    by_id = sources.run_names(sources.read_files(spark, str(runs))[0]).where("path like '%again%'").first()["run_id"]
    asked = [(path, r) for r in ("bound", "free", "other", "nobody", "twice", "log.json", by_id)] + [("nowhere", "free")]
    pairs = spark.createDataFrame(asked, "sample_path string, run_id string")
    rows, rejects = report.analyze(spark, str(samples), str(runs), pairs.unionByName(pairs))
    got = {r["report"]["name"]: r for r in rows.collect()}
    assert {k: v["binding"] for k, v in got.items()} == {"bound": "bound", "free": "unbound", "twice": "unbound"} and got["twice"]["run_id"] == by_id and rows.count() == 3
    why = sorted((r["path"].split("/")[-1], r["run_id"] or "", r["reason"]) for r in rejects.collect())
    assert why == [("nowhere", "free", "unknown sample"), ("s.bin", "log.json", "run without events"), ("s.bin", "nobody", "unknown run"), ("s.bin", "other", "evidence mismatch"), ("s.bin", "twice", "several runs have this name"), ("torn.json", "", "no events")]
    assert "not bound" in got["free"]["verdict"]["confidence"] and 'powershell -enc AAAA http' in got["bound"]["yara"]
    assert evidence.bound(pairs.limit(0).withColumn("sha256", F.lit("x")), pairs.limit(0).withColumn("sha256", F.lit("x")))[0].count() == 0


def test_emulated_calls_start_processes(spark, tmp_path):
    calls = [("kernel32.CreateProcessA", ["0x0", "cmd.exe /c dir"]), ("kernel32.WinExec", ["calc.exe"]), ("shell32.ShellExecuteW", ["0x1", "open", "a.exe", "-x"]), ("advapi32.CreateProcessAsUserW", ["0x5", "b.exe", '"b.exe" -y']), ("kernel32.Sleep", ["0x1"]), ("kernel32.CreateProcessW", ["0x0", "0x0"])]
    (tmp_path / "e.json").write_text(json.dumps({"entry_points": [{"ep_type": "main", "apis": [{"api_name": n, "args": a} for n, a in calls]}]}))
    rows = sources.read_reports(spark, str(tmp_path))[0].orderBy("seq").collect()
    made = [(r["target"], r["cmdline"]) for r in rows if r["type"] == "process_create"]
    assert made == [("cmd.exe", "cmd.exe /c dir"), ("calc.exe", "calc.exe"), ("a.exe", "a.exe -x"), ("b.exe", '"b.exe" -y')]
    assert [round(r["ts"], 3) for r in rows[:3]] == [0.001, 0.001, 0.002] and len(rows) == 10


def test_sequences_by_line_and_by_code(spark, tmp_path):
    (tmp_path / "labels").write_text("worm\n\ntrojan\nworm\n")
    (tmp_path / "calls").write_text("a b c\nd\ne f\n")
    got = [(r["line"], r["label"], r["apis"], r["n_calls"]) for r in sources.positional_sequences(spark, str(tmp_path / "labels"), str(tmp_path / "calls")).orderBy("line").collect()]
    assert got == [(0, "worm", ["a", "b", "c"], 3), (1, "trojan", ["d"], 1), (2, "worm", ["e", "f"], 2)]
    (tmp_path / "codes.csv").write_text("hash,t_0,t_1,malware\nx,1,2,1\ny,1,2,0\nz,3,4,0\n")
    assert sorted((r["digest"], r["codes"], r["label"]) for r in sources.coded_sequences(spark, str(tmp_path / "codes.csv")).collect()) == [("x", ["1", "2"], 1), ("z", ["3", "4"], 0)]


def test_models_come_back_as_saved_and_explain_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(i, [f"{'xyz'[i % 3]}{j}" for j in range(4)] + ["all"], "xyz"[i % 3]) for i in range(30)], "run_id long, tokens array<string>, family string")
    model = models.FamilyModel.fit(rows.select("tokens", "family"), cells=1 << 12, rounds=20)
    model.save(str(tmp_path / "family"))
    again = models.FamilyModel.load(str(tmp_path / "family"))
    plain = rows.drop("family")
    want = sorted((r["run_id"], r["family"], round(r["confidence"], 9)) for r in model.predict(plain).collect())
    assert want == sorted((r["run_id"], r["family"], round(r["confidence"], 9)) for r in again.predict(plain).collect())
    told = again.explain(again.predict(plain).select("run_id", "tokens", "family"), 4).collect()
    assert all(r["token"][0] == r["family"] and r["impact"] > 0 for r in told) and len(told) == 120
    calls = spark.createDataFrame([(i, float(j), j, f"f{(i % 2) * 3 + j % 3}") for i in range(20) for j in range(8)], "run_id long, ts double, seq long, api string")
    table, intercept = models.fit_ngrams(calls, spark.range(20).select(F.col("id").alias("run_id"), (F.col("id") % 2).cast("int").alias("label")))
    models.save_ngrams(table, intercept, str(tmp_path / "ngrams"))
    loaded, bias = models.load_ngrams(spark, str(tmp_path / "ngrams"))
    assert bias == intercept and sorted(map(tuple, loaded.collect())) == sorted(map(tuple, table.select("token", "idf", "weight").collect()))
    p = {r["run_id"]: r["probability"] for r in tokens.ngram_scores(calls, loaded, bias).collect()}
    assert min(v for k, v in p.items() if k % 2) > max(v for k, v in p.items() if not k % 2)
    gate = models.fit_gate(spark.createDataFrame([([float(i), float(i % 7)], int(i > 20)) for i in range(40)], "features array<double>, label int"), rounds=3, depth=2)
    models.save_gate(gate, 0.4, str(tmp_path / "gate"))
    assert models.load_gate(spark, str(tmp_path / "gate"))[1] == 0.4
    left = models.leave_one_out(rows, "family", lambda train: models.FamilyModel.fit(train.select("tokens", "family"), cells=1 << 10, rounds=5), lambda m, held: m.predict(held.withColumnRenamed("family", "truth")).select("truth", "family"))
    assert left.count() == 30 and left.where("truth = family").count() == 0


def test_string_rules_are_picked_written_and_found(spark):
    files = spark.createDataFrame([("f" * 64, "malicious", ["kernel32.dll", "powershell -enc AAAA", "some long harmless looking text", "http://evil.example.net/x", "short", "benign everywhere"])], "file_id string, label string, strings array<string>")
    rule = rules.string_rules(files, [b"xx benign everywhere yy"]).first()
    assert rule["picked"] == ["powershell -enc AAAA", "http://evil.example.net/x", "some long harmless looking text", "kernel32.dll"] and rule["need"] == 2
    assert rule["yara"].startswith("rule file_ffffffffffff\n{\n") and '$s1 = "http://evil.example.net/x" ascii wide' in rule["yara"] and rule["yara"].endswith("        2 of ($s*)\n}\n")
    blobs = spark.createDataFrame([("narrow", b"..powershell -enc AAAA\x00http://evil.example.net/x"), ("wide", "http://evil.example.net/x  some long harmless looking text".encode("utf-16-le")), ("one", b"powershell -enc AAAA")], "file_id string, content binary")
    asked = rules.string_rules(files, []).where("false").select(F.col("file_id").alias("rule"), "picked", "need").unionByName(spark.createDataFrame([("r", rule["picked"], 2)], "rule string, picked array<string>, need int"))
    assert sorted(r["file_id"] for r in rules.string_hits(asked, blobs).collect()) == ["narrow", "wide"]
    made = spark.createDataFrame([("ab" * 16, ["imp:a.dll:f", 'imp:b.dll:g"'], 2), ("", [], 0)], "imphash string, imports array<string>, need int")
    texts = [r["yara"] for r in rules.metadata_yara(made, F.lit("1 x"), F.lit("0" * 64)).collect()]
    assert f'pe.imphash() == "{"ab" * 16}"' in texts[0] and 'pe.imports("b.dll", "g\\"")' in texts[0] and ") >= 2" in texts[0] and "rule r_1_x" in texts[0] and texts[1] == ""


def test_heuristic_scores_of_feature_rows(spark):
    import math

    row = {"histogram": [10] * 256, "strings": {"urls": 5.0}, "section": {"sections": [{"name": "UPX0"}]}, "imports": {"KERNEL32.dll": ["VirtualAllocEx", "WinExec"]}}
    df = spark.read.schema(triage.FILE_ROW).json(spark.sparkContext.parallelize([json.dumps(row), "{}"]))
    got = [r["heuristic"] for r in triage.heuristic_scores(df).collect()]
    logit = -2.0 + 0.8 + 0.9 + 0.5 + 0.7 + 2.0 * 0.8 + 0.9
    assert got[0] == pytest.approx(1 / (1 + math.exp(-logit))) and got[1] == pytest.approx(1 / (1 + math.exp(1.2)))


def test_entropy_and_hashed_buckets(spark):
    import binascii
    import math

    rows = spark.createDataFrame([(b"aab",), (b"",), (None,), (bytes(range(256)),)], "b binary").withColumn("e", triage.byte_entropy("b")).collect()
    assert [round(r["e"], 6) for r in rows] == [round(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3), 6), 0.0, 0.0, 8.0]
    words = ["a", "b", "a", "zz", "q"]
    got = spark.createDataFrame([(words,), ([],)], "t array<string>").select(triage.bucket_counts(F.col("t"), 16).alias("c")).collect()
    want = [0.0] * 16
    for w in words:
        want[binascii.crc32(w.encode()) % 16] += 1
    assert got[0]["c"] == want and got[1]["c"] == [0.0] * 16


def test_plain_rules_fit_their_own_events(spark):
    made = [("r", 1, "process_create", "powershell.exe", "powershell.exe -enc AA"), ("r", 2, "file_write", r"C:\\x\\a.locked", None), ("r", 3, "process_inject", "explorer.exe", None), ("r", 4, "file_read", "x", None), ("s", 1, "file_write", r"D:\\B.LOCKED", None)]
    rows = spark.createDataFrame([(a, b, float(b), c, d, e, "sample.exe", 1) for a, b, c, d, e in made], "run_id string, seq long, ts double, type string, target string, cmdline string, image string, pid long")
    found = rules.plain_rules(rows)
    assert {r["category"] for r in found.where("run_id = 'r'").collect()} == {"process_creation", "file_event", "create_remote_thread"}
    hit = {(r["category"], r["run_id"]) for r in rules.plain_matches(found.where("run_id = 'r'"), rows).collect()}
    assert hit == {("process_creation", "r"), ("file_event", "r"), ("file_event", "s"), ("create_remote_thread", "r")}
    kept = lambda benign: {r["category"] for r in rules.plain_surviving(found.where("run_id = 'r'"), benign).collect()}
    assert kept(rows.where("false")) == {"process_creation", "file_event", "create_remote_thread"}
    assert kept(rows.where("run_id = 's'")) == {"process_creation", "create_remote_thread"}
    assert kept(rows.where("type = 'process_inject'")) == {"process_creation", "file_event"}
    # the target names the image, whatever the command line begins with
    other = rows.where("type = 'process_create'").withColumns({"target": F.lit(r"C:\bin\POWERSHELL.exe"), "cmdline": F.lit("x -ENC B")})
    assert kept(other) == {"file_event", "create_remote_thread"} and kept(other.withColumn("cmdline", F.lit(None).cast("string"))) == {"process_creation", "file_event", "create_remote_thread"}
    assert events.techniques_of_runs(rows).count() == 2
