"""Command line: python -m runtrail COMMAND ...

    triage SAMPLES OUT                     score files as bytes
    report REPORTS OUT                     report a folder of recorded runs
    batch REPORTS OUT                      the same, resumable: only what the ledger has not done
    analyze SAMPLES RUNS OUT [--pairs F]   samples with their recorded runs; without F those whose runs record the sample's digest
    train-features FEATURES MODEL          boosted gate over pre-extracted file features, with its threshold
    triage-features FEATURES MODEL OUT     scores, decisions and the features that moved them
    demo OUT                               synthetic runs written as traces, reported and summed up

Nothing is executed. Exit status: 0 all done, 1 something was rejected or could not be read (the rejects are written beside the
results), 2 an input is missing.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = {
    "triage": ("path", "out"), "report": ("path", "out"), "batch": ("path", "out"), "analyze": ("path", "runs", "out"),
    "train-features": ("path", "model"), "triage-features": ("path", "model", "out"), "demo": ("out",),
}
#: Share of known positives that the gate's threshold keeps.
RECALL = 0.99
INPUTS = ("path", "runs", "pairs")


def parser() -> argparse.ArgumentParser:
    given = argparse.ArgumentParser(prog="runtrail", description="Reports of recorded runs and samples. Nothing is executed.")
    commands = given.add_subparsers(dest="command", required=True)
    for name, places in COMMANDS.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        if name == "analyze":
            command.add_argument("--pairs", help="comma-separated file with a header: sample_path, run_id (an id or a name)")
    return given


def there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def rejected(rejects: DataFrame, out: str) -> int:
    """Write the rejects; 1 if there are any."""
    rejects.write.mode("overwrite").parquet(f"{out}/rejects")
    return int(bool(rejects.sparkSession.read.parquet(f"{out}/rejects").take(1)))


def told(**facts: object) -> None:
    print(json.dumps(facts, default=str))


def triage(spark: SparkSession, path: str, out: str) -> int:
    from .operators.triage import triage_files
    from .sources.reports import read_files

    files, large = read_files(spark, path)
    triage_files(files).drop("content").write.mode("overwrite").parquet(f"{out}/triage")
    rows = spark.read.parquet(f"{out}/triage")
    told(files=rows.count(), detonate=rows.where("detonate").count())
    return rejected(large, out)


def report(spark: SparkSession, path: str, out: str) -> int:
    from .plans.report import reports, write_pages, write_reports

    rows, rejects = reports(spark, path)
    write_reports(rows, f"{out}/reports")
    written = spark.read.parquet(f"{out}/reports")
    write_pages(written, out)
    told(reports=written.count())
    return rejected(rejects, out)


def batch(spark: SparkSession, path: str, out: str) -> int:
    from .plans.report import batch as run_batch

    done = run_batch(spark, path, out, f"{out}-ledger").groupBy("status").count().collect()
    counts = {r["status"]: r["count"] for r in done}
    told(done=counts.get("done", 0), failed=counts.get("failed", 0), ledger=f"{out}-ledger")
    return int("failed" in counts)


def analyze(spark: SparkSession, path: str, runs: str, out: str, pairs: str | None = None) -> int:
    from .plans.report import analyze as run_analyze
    from .sources.reports import read_files, recorded_samples

    if pairs:
        asked = spark.read.csv(pairs, header=True, schema="sample_path string, run_id string")
    else:
        files = read_files(spark, path)[0].select(F.col("path").alias("sample_path"), "sha256")
        asked = files.join(recorded_samples(read_files(spark, runs)[0]), "sha256").select("sample_path", "run_id")
    rows, rejects = run_analyze(spark, path, runs, asked)
    rows.write.mode("overwrite").parquet(f"{out}/analyses")
    verdicts = spark.read.parquet(f"{out}/analyses").groupBy("verdict.label").count().collect()
    told(verdicts={r["label"]: r["count"] for r in verdicts})
    return rejected(rejects, out)


def train_features(spark: SparkSession, path: str, model: str) -> int:
    from .operators.evaluation import gate_threshold
    from .operators.models import fit_gate, gate_scores, save_gate
    from .operators.triage import file_features
    from .session import staged
    from .sources.reports import feature_rows

    rows = staged(file_features(feature_rows(spark, path)).select("sha256", "label", "features", (F.crc32(F.coalesce("sha256", F.lit(""))) % 5 == 0).alias("held")), "features")
    if not rows.where("not held").take(1) or not rows.where("held and label = 1").take(1):
        raise ValueError("too few labelled rows: some to learn from and some positives held out are needed")
    gate = fit_gate(rows.where("not held"))
    found = gate_threshold(gate_scores(gate, rows.where("held")), RECALL).first()
    save_gate(gate, float(found["threshold"]), model)
    told(rows=rows.count(), **found.asDict())
    return 0


def triage_features(spark: SparkSession, path: str, model: str, out: str) -> int:
    from .operators.attributions import forest_of, top_contributions, with_contributions
    from .operators.models import gate_scores, load_gate
    from .operators.triage import FEATURE_NAMES, file_features
    from .sources.reports import feature_rows

    gate, threshold = load_gate(spark, model)
    rows = gate_scores(gate, file_features(feature_rows(spark, path, labelled_only=False)).select(F.monotonically_increasing_id().alias("row"), "sha256", "features"))
    rows = with_contributions(rows, forest_of(gate, spark), keep=["row", "sha256", "score"])
    rows.write.mode("overwrite").parquet(f"{out}/contributions")
    rows = spark.read.parquet(f"{out}/contributions")
    top = top_contributions(rows, "row", FEATURE_NAMES, 6).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "contribution"))).alias("top"))
    decided = rows.join(top, "row", "left").select("sha256", F.round("score", 4).alias("score"), (F.col("score") >= threshold).alias("detonate"), F.lit(round(threshold, 5)).alias("threshold"), "top")
    decided.write.mode("overwrite").json(f"{out}/triage")
    told(rows=rows.count(), detonate=spark.read.json(f"{out}/triage").where("detonate").count())
    return 0


def demo(spark: SparkSession, out: str) -> int:
    from .operators.scoring import synthetic_events

    events, _ = synthetic_events(spark)
    listed = F.struct("seq", F.struct("ts", "type", "pid", "image", "target", "cmdline").alias("e"))
    traces = events.groupBy("run_id").agg(F.array_sort(F.collect_list(listed)).alias("s"))
    body = F.to_json(F.struct("run_id", F.transform("s", lambda x: x["e"]).alias("events")))
    traces.select("run_id", body.alias("value")).write.mode("overwrite").partitionBy("run_id").text(f"{out}/traces")
    return report(spark, f"{out}/traces", out)


def main(args: list[str] | None = None) -> int:
    given = vars(parser().parse_args(args))
    command = given.pop("command")
    spark = SparkSession.builder.appName("runtrail").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in INPUTS:
        if given.get(name) and not there(spark, given[name]):
            print(f"runtrail: {name} not found: {given[name]}", file=sys.stderr)
            return 2
    try:
        return globals()[command.replace("-", "_")](spark, **given)
    except (ValueError, OSError, PySparkException) as error:
        print(f"runtrail: error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
