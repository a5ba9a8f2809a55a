"""Column functions on hand-made rows: nulls, empty and hostile values."""

import math

import pytest
from pyspark.sql import functions as F

from runtrail.functions import scalar, text


def one(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.select(make(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_normalize(spark):
    got = one(spark, [r'  "C:\Users\Bob\AppData\Roaming\x12.exe" ', "HKEY_CURRENT_USER\\Software\\{01234567-89AB-cdef-0123-456789abcdef}", "s-1-5-21-123-456", "deadbeef1 face", "x١٢y", None, "", "C:\\Windows\\System32\\a", "9" * 400], text.normalize)
    assert got == ["%appdata%\\x#.exe", "hkcu\\software\\<guid>", "<sid>", "<hex> face", "x#y", "", "", "%system%\\a", "<hex>"]


def test_paths(spark):
    paths = ["c:\\a\\b.txt", "c:\\a", "c:\\", "a/b/c", "\\\\srv\\share\\x\\y", "", "x", "a\\\\b", "/x"]
    import ntpath

    assert one(spark, paths, text.dirname) == [ntpath.dirname(p) for p in paths]
    assert one(spark, paths, text.basename) == [ntpath.basename(p) for p in paths]
    assert one(spark, ["a\\b.tar.gz", "a.b\\c", ""], text.extension) == ["gz", "", ""]


def test_images(spark):
    assert one(spark, ['"C:\\x y\\a.exe" /q', "cmd.exe /c dir", "tool -x", "", None], text.command_image) == ["a.exe", "cmd.exe", "tool", "unknown", "unknown"]
    assert one(spark, ['"C:\\x y\\a.exe" /q', "c:\\b.exe -z", "tool -x", None], lambda v: text.image_of(v, F.lit("t.exe"))) == ["C:\\x y\\a.exe", "c:\\b.exe", "t.exe", "t.exe"]


def test_ladder_and_literals(spark):
    (got,) = one(spark, ["C:\\Users\\bob\\AppData\\Roaming\\svc42\\a1.exe"], lambda v: text.ladder(v, "path"))
    assert got == ["C:\\Users\\*\\AppData\\Roaming\\svc42\\a1.exe", "C:\\Users\\*\\AppData\\Roaming\\svc*\\a*.exe", "C:\\Users\\*\\AppData\\Roaming\\svc*\\*.exe", "C:\\Users\\*\\AppData\\Roaming\\*\\a*.exe", "C:\\Users\\*\\AppData\\Roaming\\*\\*.exe"]
    (keys,) = one(spark, ["HKLM\\Software\\Vendor\\Run 7"], lambda v: text.ladder(v, "key"))
    assert keys == ["HKLM\\Software\\Vendor\\Run 7", "HKLM\\Software\\Vendor\\Run *", "HKLM\\Software\\Vendor\\*"]
    assert one(spark, ["C:\\Users\\*\\AppData\\Roaming\\svc*\\*.exe", "*", "%TEMP%\\abc", "hklm\\software\\vendor"], text.literal_length) == [6, 0, 3, 6]
    assert one(spark, ["50%_a!*b"], text.like_pattern) == ["50!%!_a!!%b"]


def test_escapes(spark):
    assert one(spark, ["a\\b?c*\x01"], text.sigma_value) == ["a\\\\b\\?c*?"]
    assert one(spark, ["it's\n"], text.yaml_quoted) == ["'it''s '"]
    assert one(spark, ['a"b\\é\x01'], text.yara_string) == ['a\\"b\\\\\\xc3\\xa9\\x01']
    assert one(spark, ["AB" * 16, "xyz", None], lambda v: text.hex_or(v, 32, "none")) == ["ab" * 16, "none", "none"]
    assert one(spark, ["http://evil.net/x 1.2.3.4 kernel32.dll ftp://a.org //b.example.org 0x7f.1"], text.defang) == ["hxxp://evil[.]net/x 1[.]2[.]3[.]4 kernel32.dll fxp://a[.]org [//]b.example[.]org 0x7f[.]1"]
    assert one(spark, ["a|b <x> [y](z) #&"], text.markdown_text) == ["a&#124;b &lt;x&gt; &#91;y&#93;&#40;z&#41; &#35;&amp;"]
    (label,) = one(spark, ['"x"[1]' + "y" * 100], text.diagram_label)
    assert len(label) == 60 and '"' not in label and "[" not in label and "~" in label


def test_scalars(spark):
    assert one(spark, ["1.5", "NaN", "Infinity", "x", None, "99"], lambda v: scalar.finite_float(v, -1.0, high=8.0)) == [1.5, -1, -1, -1, -1, 8]
    assert one(spark, ["12", "0x1F", "abc", None, "3.9", "99999999999999999999"], lambda v: scalar.safe_int(v, -1)) == [12, 31, -1, -1, 3, -1]
    assert one(spark, [4.5, 5.5], scalar.half_even, "double") == [4, 6]
    (p,) = one(spark, [[1.0, 2.0, 1000.0]], scalar.softmax, "array<double>")
    assert p == pytest.approx([0, 0, 1])
    assert one(spark, [[0.0, 0.0], [1.0, 3.0]], scalar.normalised, "array<double>") == [[0, 0], [0.25, 0.75]]
    assert one(spark, [[1.0, 1.0, 0.0], []], scalar.entropy_of_counts, "array<double>") == [1.0, 0.0]
    assert one(spark, ["unknown (closest: a b)", "x", None], scalar.predicted_family) == ["a b", "x", None]


def test_student_and_tests(spark):
    from runtrail.operators import evaluation as ev

    assert ev.student_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5) and ev.student_cdf(0, 3) == 0.5
    rows = spark.createDataFrame([(i < 12, 7 <= i < 20) for i in range(20)], "a boolean, b boolean")
    r = ev.mcnemar(rows, "a", "b").first()
    want = 2 * sum(math.comb(15, i) for i in range(8)) / 2**15
    assert (r["only_a"], r["only_b"]) == (7, 8) and r["p"] == pytest.approx(min(1, want))
    pairs = spark.createDataFrame([(0.1 * i, 0.1 * i + 0.05 + 0.01 * (i % 2)) for i in range(10)], "a double, b double")
    t = ev.paired_t(pairs, "a", "b")
    assert t["n"] == 10 and t["mean_diff"] == pytest.approx(0.055) and t["p"] < 1e-6
    low, high = ev.bootstrap(spark.range(500).withColumn("x", F.col("id") % 10), F.sum(F.col("w") * F.col("x")) / F.sum("w"), "id", draws=60).first()
    assert low < 4.5 < high and high - low < 1.5


def test_synthetic_corpus_and_small_scorer(spark):
    from runtrail.operators import scoring

    events, runs = scoring.synthetic_runs()
    assert len(runs) == 120 and sum(r[1] for r in runs) == 60 and events == scoring.synthetic_runs(120, 7)[0]
    weights, bias = scoring.trained(spark)
    fresh, labels = scoring.synthetic_events(spark, 60, 99)
    truth = labels.select("run_id", F.col("label").alias("truth"))
    got = scoring.behaviour_scores(fresh, weights, bias, labels).join(truth, "run_id").collect()
    assert len(got) == 60 and sum((r["probability"] >= 0.5) == bool(r["truth"]) for r in got) >= 0.95 * len(got)
