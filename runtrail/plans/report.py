"""Reports of whole folders: parse, reconstruct, score, attribute, synthesise rules, fuse, and write.

Everything is keyed by run_id and runs for all reports at once; a single report is the same plan over one row. The event table is
staged once, as every later part reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fused, predicted_family, verdict
from ..functions.text import defang, markdown_text
from ..operators import events as e
from ..operators import evidence, graph, negatives, rules, scoring, tokens, triage
from ..operators.evaluation import still_to_do
from ..operators.models import FamilyModel, open_set
from ..session import staged
from ..sources import reports as sources


def negative_lines(spark: SparkSession, packaged: DataFrame | None = None) -> DataFrame:
    """(run_id, category, line, family): lines of the synthetic benign runs, and a packaged corpus (category, line, families)."""
    events, runs = scoring.synthetic_events(spark)
    benign = events.join(runs.where("label = 0").select("run_id"), "run_id")
    own = e.rule_lines(benign).select("run_id", "category", "line").withColumn("family", F.lit("benign"))
    if packaged is None:
        return own
    # a line seen in one family alone is that family's: it does not count against it; shared lines are everybody's
    more = packaged.select(F.concat(F.lit("packaged-"), F.md5("line")).alias("run_id"), "category", "line", F.when(F.size("families") == 1, F.get("families", F.lit(0))).otherwise(F.lit("shared")).alias("family"))
    return own.unionByName(more)


def prototypes(spark: SparkSession) -> DataFrame:
    events, runs = scoring.synthetic_events(spark)
    sets = e.techniques_of_runs(events)
    return sets.join(runs.where("family is not null").select("run_id", "family"), "run_id").withColumnRenamed("run_id", "proto_id")


def behaviour(spark: SparkSession, events: DataFrame, runs: DataFrame, ngram_model: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(run_id, probability, label, contributions, family, similarity, scorer): n-grams where a run has calls enough, else the small scorer."""
    weights, intercept = scoring.trained(spark)
    base = scoring.behaviour_scores(events, weights, intercept, runs)
    family = scoring.family_of_runs(events, prototypes(spark))
    rows = base.join(family, "run_id", "left")
    p, name = F.col("probability"), F.lit("technique-features")
    if ngram_model is not None:
        table, bias = ngram_model
        rows = rows.join(tokens.ngram_scores(tokens.api_calls(events), table, bias).withColumnRenamed("probability", "p2"), "run_id", "left")
        p, name = F.coalesce("p2", "probability"), F.when(F.col("p2").isNotNull(), "api-ngrams").otherwise(name)
    label = verdict(p)
    return rows.select("run_id", p.alias("probability"), label.alias("label"), "contributions", F.when(label != "benign", F.col("family")).alias("family"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), name.alias("scorer"))


def attributed(behaviour_rows: DataFrame, token_rows: DataFrame, model: FamilyModel | None, threshold: float = 0.5) -> DataFrame:
    """Families by the trained model instead, where there is one: known, or unknown with the closest named."""
    if model is None:
        return behaviour_rows
    named = model.predict(token_rows).select("run_id", open_set(F.col("family"), F.col("confidence"), threshold).alias("named"), F.round("confidence", 3).alias("confidence"))
    return behaviour_rows.join(named, "run_id", "left").withColumns({"family": F.coalesce("named", "family"), "similarity": F.coalesce("confidence", "similarity")}).drop("named", "confidence")


def canonical_hash(report: Column) -> Column:
    """SHA-256 of the report as JSON with its fields in the order of the schema; no clock, no paths."""
    return F.sha2(F.to_json(report, {"ignoreNullFields": "false"}), 256)


def reports(spark: SparkSession, path: str | DataFrame, packaged: DataFrame | None = None, family_model: FamilyModel | None = None, ngram_model: tuple[DataFrame, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, rejects) of a folder, or of files (path, content, sha256): one struct per run, with its content hash."""
    files, large = sources.read_files(spark, path) if isinstance(path, str) else (path, None)
    events, rejects = sources.parsed_files(files)
    rejects = rejects if large is None else rejects.unionByName(large)
    events = staged(events, "events")
    runs = events.select("run_id").distinct()
    names = sources.run_names(files).groupBy("run_id").agg(F.min_by("name", "path").alias("name"))
    static = triage.triage_metadata(sources.file_metadata(files).where("pe is not null"))
    static_tokens = tokens.static_tokens(static.select("run_id", "pe"))
    scored = behaviour(spark, events, runs, ngram_model)
    bags = tokens.token_sets(tokens.behaviour_tokens(events).unionByName(static_tokens.select("run_id", F.explode("tokens").alias("token"))))
    scored = attributed(scored, bags, family_model)
    families = scored.select("run_id", F.coalesce(predicted_family(F.col("family")), F.lit("")).alias("family"))
    found = rules.synthesize(events.join(families, "run_id"), negative_lines(spark, packaged))
    tagged = e.with_technique(events).where("technique is not null").groupBy("run_id", F.lower(F.coalesce("target", "cmdline")).alias("key")).agg(F.max_by("technique", "seq").alias("technique"))
    named = found.withColumn("key", F.lower("source")).join(tagged, ["run_id", "key"], "left").withColumn("sha256", F.lit(None).cast("string"))
    texts = rules.sigma_text(named).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sigma"))).alias("s")).select("run_id", F.transform("s", lambda x: x["sigma"]).alias("sigma"))
    counts = graph.nodes(events).groupBy("run_id").agg(F.count("*").alias("nodes")).join(graph.edges(events).groupBy("run_id").agg(F.count("*").alias("edges")), "run_id", "full")
    steps = e.timeline(events).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "description", "technique", "tactic"))).alias("timeline"))
    rows = scored.join(static.select("run_id", F.struct("score", "label", "detonate", "reasons").alias("static")), "run_id", "left")
    for part in (names, e.techniques_of_runs(events), e.indicators(events), counts, steps, texts):
        rows = rows.join(part, "run_id", "left")
    known = F.coalesce(F.col("static.score"), F.lit(0.0))
    body = F.struct("run_id", "name", fused(known, F.col("probability"), F.coalesce("static.label", F.lit("benign"))).alias("verdict"), "static", F.struct("probability", "label", "contributions", "family", "similarity", "scorer").alias("behaviour"), "techniques", "timeline", F.struct("nodes", "edges").alias("graph"), F.struct("network", "domains", "dropped", "registry").alias("iocs"), F.coalesce("sigma", F.array().cast("array<string>")).alias("rules"))
    return rows.select("run_id", body.alias("report"), canonical_hash(body).alias("content_sha256")), rejects


def markdown(report: Column) -> Column:
    """A short page of a report; all text of the run is escaped and made harmless."""
    line = lambda name, value: F.concat(F.lit(f"| {name} | "), markdown_text(F.coalesce(value.cast("string"), F.lit("-"))), F.lit(" |\n"))
    steps = F.array_join(F.transform(F.slice(report["timeline"], 1, 40), lambda s: F.concat(F.lit("- "), markdown_text(s["description"]), F.lit(" "), F.coalesce(s["technique"], F.lit("")))), "\n")
    return F.concat(F.lit("# Run report\n\n| | |\n|-|-|\n"), line("run", report["name"]), line("id", report["run_id"]), line("verdict", report["verdict"]["label"]), line("confidence", report["verdict"]["confidence"]), line("score", report["verdict"]["score"]), line("family", report["behaviour"]["family"]), line("techniques", F.array_join(report["techniques"], ", ")), F.lit("\n## Timeline\n\n"), F.coalesce(steps, F.lit("")), F.lit("\n\n## Network\n\n"), F.coalesce(F.array_join(F.transform(report["iocs"]["network"], defang), "\n"), F.lit("")), F.lit("\n"))


def write_reports(rows: DataFrame, out: str) -> None:
    """JSON and Markdown pages, one row each, written by Spark's committers over what stood at ``out``."""
    page = markdown(F.col("report"))
    rows.select("run_id", "content_sha256", F.to_json("report").alias("json"), page.alias("page")).write.mode("overwrite").parquet(out)


def write_pages(rows: DataFrame, out: str) -> None:
    """Written reports (run_id, json, page) as files: a folder of each run below ``out``/json and ``out``/pages."""
    for column, folder in (("json", "json"), ("page", "pages")):
        rows.select("run_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("run_id").text(f"{out}/{folder}")


def build_negative_corpus(lines: DataFrame, imports: DataFrame, per_family: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lines with their families, prevalence of imports) of sampled runs.

    ``lines``: (category, line, family[, run_id]), ``imports``: (family, run_id, token). With ``per_family`` both come from the
    same sample, at most so many runs of each family.
    """
    if per_family is not None:
        runs = lines.select("family", "run_id").unionByName(imports.select("family", "run_id")).distinct()
        drawn = staged(negatives.sampled_runs(runs, per_family, seed), "sampled")
        lines, imports = (t.join(drawn, ["family", "run_id"], "left_semi") for t in (lines, imports))
    return negatives.line_families(lines), negatives.import_prevalence(imports)


LEDGER = "job string, status string, at timestamp, detail string, batch string"


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; none yet is an empty one. Torn files are left out: what they did is done again, under the same name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(LEDGER).options(recursiveFileLookup="true", ignoreCorruptFiles="true").parquet(path) if there else spark.createDataFrame([], LEDGER)


def report_part(spark: SparkSession, files: DataFrame, failed: DataFrame, todo: DataFrame, out: str, ledger_path: str, label: str) -> DataFrame:
    """Report the files that ``todo`` (job, path) names, and write (job, status, ..) of all its jobs to the ledger, under one label.

    Both are written over what stood under the label, reports first, so a part that is cut off and done again leaves nothing double.
    """
    rows, rejects = reports(spark, files.join(todo.select("path"), "path", "left_semi"))
    write_reports(rows, f"{out}/batch={label}")
    reasons = rejects.unionByName(failed).groupBy("path").agg(F.first("reason").alias("detail"))
    done = todo.join(reasons, "path", "left").select("job", F.when(F.col("detail").isNull(), "done").otherwise("failed").alias("status"), F.current_timestamp().alias("at"), "detail", F.lit(label).alias("batch"))
    done = staged(done, "ledger")
    done.write.mode("overwrite").parquet(f"{ledger_path}/{label}")
    return done


def jobs_of(files: DataFrame, large: DataFrame) -> DataFrame:
    """(job, path): one job per content; files over the cap are jobs by their path."""
    jobs = files.groupBy(F.substring("sha256", 1, 16).alias("job")).agg(F.min("path").alias("path"))
    return jobs.unionByName(large.select(F.substring(F.sha2("path", 256), 1, 16).alias("job"), "path"))


def batch(spark: SparkSession, path: str, out: str, ledger_path: str) -> DataFrame:
    """Report the files that the ledger has not done, and only those; files that fail are listed with their reason.

    A batch is named by what it does: its reports and its ledger rows are written over a folder of that name, reports first. So a
    run that is cut off leaves nothing double: the next one has the same to do, hence the same name. ``finished_reports`` reads
    what the ledger knows. A job is a file's content.
    """
    files, large = sources.read_files(spark, path)
    todo = staged(still_to_do(jobs_of(files, large), ledger_of(spark, ledger_path), "job", F.col("at")), "todo")
    name = todo.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("job")).alias("h")).first()
    if not name["n"]:
        return todo.select("job", F.lit("done").alias("status"))
    label = f"{name['n']}-{name['h'] & (2**64 - 1):016x}"
    return report_part(spark, files, large, todo, out, ledger_path, label).select("job", "status")


def report_stream(spark: SparkSession, path: str, out: str, ledger_path: str, checkpoint: str, files_per_batch: int = 1000, max_bytes: int = sources.MAX_BYTES):
    """Start a stream over a folder that reports each content once, takes what there is and stops; start it again to go on.

    A micro-batch is written under its number, so one that is repeated after a stop (before, between or after its two writes)
    replaces itself. What the ledger of other micro-batches knows is left out, so a content that arrives again, under whatever
    name, has no second report. A run's id is its content's, hence unique over all time.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    files = files.schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def report_batch(arrived: DataFrame, number: int) -> None:
        session, label = arrived.sparkSession, f"stream-{number}"
        kept = staged(arrived.where(F.col("length") <= max_bytes).select("path", "content", F.sha2("content", 256).alias("sha256")), "arrived")
        large = arrived.where(F.col("length") > max_bytes).select("path", F.lit("file too large").alias("reason"))
        known = ledger_of(session, ledger_path).where(F.col("batch") != label)
        todo = staged(still_to_do(jobs_of(kept, large), known, "job", F.col("at")), "todo")
        if todo.take(1):
            report_part(session, kept, large, todo, out, ledger_path, label)

    return files.writeStream.foreachBatch(report_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_reports(spark: SparkSession, out: str, ledger_path: str) -> DataFrame:
    """The reports of all batches that the ledger knows: (run_id, content_sha256, json, page)."""
    known = ledger_of(spark, ledger_path).select("batch").distinct()
    rows = spark.read.schema("run_id string, content_sha256 string, json string, page string, batch string").parquet(out)
    return rows.join(known, "batch", "left_semi").drop("batch")


def analyze(spark: SparkSession, samples: str | DataFrame, recorded: str | DataFrame, pairs: DataFrame, benign: list[bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, rejects) of samples with their recorded runs: each pair (sample_path, run_id) is triaged, bound and reported.

    ``samples`` and ``recorded`` are folders or files (path, content, sha256). ``run_id`` of a pair is a run's id or its name. A
    run that records another sample's digest is rejected; one that records none is unbound, which lowers the confidence.

    Rejects (path, run_id, reason) name every pair without a report (unknown sample, unknown run, a name that several runs have, a
    run without events, evidence of another sample; of one pair the first reason) and every file that gives none, with a null run:
    files over the size cap, traces that cannot be read.
    """
    (files, large), (traces, long) = ((given, None) if isinstance(given, DataFrame) else sources.read_files(spark, given) for given in (samples, recorded))
    static = triage.triage_files(files.select("path", "sha256", "content"))
    strings = rules.string_rules(static.select(F.col("sha256").alias("file_id"), "label", "strings"), benign or [])
    rows, unread = reports(spark, traces)
    names = staged(sources.run_names(traces).select("run_id", "name").distinct(), "run-names")
    known = names.select(F.col("name").alias("asked"), "run_id").unionByName(names.select(F.col("run_id").alias("asked"), "run_id")).distinct()
    found = known.groupBy("asked").agg(F.count("*").alias("runs"), F.min("run_id").alias("run_id"))
    asked = pairs.select("sample_path", F.col("run_id").alias("asked")).distinct().join(found, "asked", "left").join(files.select(F.col("path").alias("sample_path"), "sha256"), "sample_path", "left")
    asked = asked.join(rows.select("run_id", F.lit(True).alias("reported")), "run_id", "left")
    reason = F.when(F.col("sha256").isNull(), "unknown sample").when(F.col("runs").isNull(), "unknown run").when(F.col("runs") > 1, "several runs have this name").when(F.col("reported").isNull(), "run without events")
    asked = staged(asked.select(F.col("sample_path").alias("path"), "asked", "run_id", "sha256", reason.alias("reason")), "pairs")
    bound, mismatched = evidence.bound(asked.where("reason is null").drop("reason"), sources.recorded_samples(traces))
    no_run = lambda df: df.select("path", F.lit(None).cast("string").alias("run_id"), "reason")
    rejects = asked.where("reason is not null").select("path", F.col("asked").alias("run_id"), "reason").unionByName(mismatched.select("path", F.col("asked").alias("run_id"), "reason")).unionByName(no_run(unread))
    for over in (large, long):
        rejects = rejects if over is None else rejects.unionByName(no_run(over))
    joined = bound.join(static.select("path", F.struct("score", "label", "detonate", "reasons", "urls", "ips", "entropy").alias("sample")), "path").join(rows, "run_id").join(strings.select(F.col("file_id").alias("sha256"), "yara"), "sha256", "left")
    verdict_ = fused(F.col("sample.score"), F.col("report.behaviour.probability"), F.col("sample.label"))
    weaker = F.when(F.col("binding") == "unbound", F.concat(verdict_["confidence"], F.lit(" (trace not bound to sample)"))).otherwise(verdict_["confidence"])
    return joined.select("path", "sha256", "run_id", "binding", F.struct(verdict_["label"].alias("label"), weaker.alias("confidence"), verdict_["score"].alias("score")).alias("verdict"), "sample", "yara", "report"), rejects
