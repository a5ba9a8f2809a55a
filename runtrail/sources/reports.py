"""Reports of sandboxes, emulators and host logs as typed events.

Every reader takes (path, raw text) rows and returns ``events``; rejects say why a file gave none. Files are read whole, parsed
permissively and judged as a whole where one bad entry spoils the file. Each event carries ``seq``, its place in its run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_int
from ..functions.text import basename, command_image
from ..operators.events import EVENT_TYPES
from ..session import staged

MAX_BYTES, MAX_EVENTS, MAX_CHARS, MAX_LIST, MAX_CALLS = 512 << 20, 100_000, 512, 2000, 5000
COLUMNS = ("run_id", "ts", "type", "pid", "image", "ppid", "target", "cmdline", "child_pid", "api", "opened_only", "resolved_only", "synthetic_ts")

# --- fixed values: API names whose calls have their own event type

INJECT = ["writeprocessmemory", "ntwritevirtualmemory", "createremotethread", "createremotethreadex", "ntcreatethreadex", "rtlcreateuserthread", "queueuserapc", "ntqueueapcthread", "setthreadcontext", "ntsetcontextthread", "ntmapviewofsection"]
KEY_SET = ["regsetvalueexa", "regsetvalueexw", "ntsetvaluekey", "regsetvaluea", "regsetvaluew"]
KEY_DELETE = ["regdeletevaluea", "regdeletevaluew", "regdeletekeya", "regdeletekeyw", "ntdeletekey", "ntdeletevaluekey"]
FILE_DELETE = ["deletefilea", "deletefilew", "ntdeletefile"]
SERVICE = ["createservicea", "createservicew"]
MUTEX = ["ntcreatemutant", "createmutexa", "createmutexw", "createmutexexa", "createmutexexw"]


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path, content, sha256), rejects (path, reason)) of all files under a path, size-capped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = files.where(F.col("length") <= max_bytes).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return fits, files.where(F.col("length") > max_bytes).select("path", F.lit("file too large").alias("reason"))


def decoded(content: Column) -> Column:
    """Text of a log export by its byte-order mark, or by where zero bytes stand in its first letter: UTF-8, UTF-16, UTF-32.

    Bytes after the last whole letter are left out; broken UTF-8 does no harm.
    """
    head = F.hex(F.substring(content, 1, 4))
    plain = F.decode(F.substring(content, 1, 4), "ISO-8859-1")
    whole = lambda width: F.substring(content, F.lit(1), (F.floor(F.octet_length(content) / width) * width).cast("int"))
    utf8 = F.coalesce(F.try_validate_utf8(content.cast("string")), F.make_valid_utf8(content.cast("string")))
    text = (
        F.when(head.isin("FFFE0000", "0000FEFF"), F.decode(whole(4), "UTF-32"))
        .when(F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF")), F.decode(whole(2), "UTF-16"))
        .when(plain.rlike("^[^\x00]\x00\x00\x00"), F.decode(F.concat(F.unhex(F.lit("FFFE0000")), whole(4)), "UTF-32"))
        .when(plain.rlike("^\x00\x00\x00[^\x00]"), F.decode(whole(4), "UTF-32"))
        .when(plain.rlike("^[^\x00]\x00"), F.decode(whole(2), "UTF-16LE"))
        .when(plain.rlike("^\x00[^\x00]"), F.decode(whole(2), "UTF-16BE"))
        .otherwise(utf8)
    )
    return F.regexp_replace(text, "^﻿", "")


def finished(rows: DataFrame, order: list) -> DataFrame:
    """The columns of the event table, ``seq`` by time, then by the order given: ties keep their place."""
    for c, kind in (("ppid", "long"), ("cmdline", "string"), ("child_pid", "long"), ("api", "string"), ("opened_only", "boolean"), ("resolved_only", "boolean"), ("synthetic_ts", "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", *order))
    return rows.select(*COLUMNS, seq.cast("long").alias("seq"))


def run_key(kind: str | Column, sha256: Column) -> Column:
    """The id of a run: its reader's kind and its file's digest. It depends on nothing else that lies in a folder or came before."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("-"), F.substring(sha256, 1, 32))


def run_names(files: DataFrame) -> DataFrame:
    """(run_id, name, path, sha256) of files: the name is what the report calls its run, else the name of its file.

    Names need not be unique; several runs may share one.
    """
    raw = F.col("content").cast("string")
    rows = files.withColumn("kind", report_kind(F.col("content")))
    own = F.when(F.col("kind") == "native", F.from_json(raw, "struct<run_id:string>")["run_id"]).when(F.col("kind") == "sandbox", F.from_json(raw, "struct<info:struct<id:string>>")["info"]["id"])
    return rows.select(run_key(F.col("kind"), F.col("sha256")).alias("run_id"), F.coalesce(F.nullif(own, F.lit("")), F.regexp_extract("path", r"[^/\\\\]*$", 0)).alias("name"), "path", "sha256")


# --- native traces

NATIVE = "struct<run_id:string,sandbox:string,sample_sha256:string,events:array<struct<ts:double,type:string,pid:string,image:string,ppid:string,target:string,cmdline:string,child_pid:string,api:string,opened_only:boolean,resolved_only:boolean>>>"


def native_traces(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of ``{"events": [...]}`` files. One bad event spoils its file."""
    doc = files.select("path", "sha256", F.from_json(F.col("content").cast("string"), NATIVE).alias("d"))
    doc = doc.withColumn("run_id", run_key("native", F.col("sha256")))
    each = lambda e: e["type"].isin(*EVENT_TYPES) & e["ts"].isNotNull() & ~F.isnan(e["ts"]) & (F.abs(e["ts"]) < float("inf")) & (e["ts"] >= 0) & e["pid"].try_cast("long").isNotNull() & (F.coalesce(e["image"], F.lit("")) != "")
    reason = (
        F.when(F.col("d.events").isNull(), "no events")
        .when(F.size("d.events") > MAX_EVENTS, "too many events")
        .when(~F.forall("d.events", lambda e: F.coalesce(each(e), F.lit(False))), "bad event")
    )
    judged = doc.withColumn("reason", reason)
    good = judged.where("reason is null").select("run_id", F.posexplode("d.events").alias("pos", "e"))
    rows = good.select("run_id", "pos", "e.ts", "e.type", F.col("e.pid").try_cast("long").alias("pid"), "e.image", F.col("e.ppid").try_cast("long").alias("ppid"), "e.target", "e.cmdline", F.col("e.child_pid").try_cast("long").alias("child_pid"), "e.api", "e.opened_only", "e.resolved_only")
    return finished(rows, ["pos"]), judged.where("reason is not null").select("path", "reason")


# --- sandbox reports

CALL = "struct<timestamp:double,api:string,category:string,arguments:string>"
SUMMARY = ("executed_commands", "write_files", "delete_files", "read_files", "files", "write_keys", "delete_keys", "read_keys", "keys", "mutexes", "created_services", "started_services", "resolved_apis")
REPORT = (
    "struct<info:struct<id:string>,target:struct<file:struct<name:string,sha256:string>>,"
    f"behavior:struct<processes:array<struct<process_id:string,parent_id:string,process_name:string,environ:struct<CommandLine:string>,calls:array<{CALL}>>>,"
    f"summary:struct<{','.join(f'{s}:array<string>' for s in SUMMARY)}>>,"
    "network:struct<dns:array<struct<request:string>>,tcp:array<struct<dst:string,dport:string>>,udp:array<struct<dst:string,dport:string>>>,"
    "static:struct<pe:struct<imphash:string,timestamp:string,osversion:string,imported_dll_count:string,sections:array<struct<name:string,entropy:string>>,imports:array<struct<dll:string,imports:array<struct<name:string>>>>,exports:array<struct<name:string>>,digital_signers:array<string>>>>"
)


def parsed_reports(files: DataFrame) -> DataFrame:
    """(path, sha256, run_id, image, r): the report as a struct; ``r`` is null where the text is no report."""
    r = F.from_json(F.col("content").cast("string"), REPORT)
    rows = files.select("path", "sha256", r.alias("r"))
    return rows.select("path", "sha256", run_key("sandbox", F.col("sha256")).alias("run_id"), F.coalesce("r.target.file.name", F.lit("sample.exe")).alias("sample"), "r")


def arguments(raw: Column) -> Column:
    """Call arguments, a list of {name, value} or an object, as a map of lower-case names."""
    listed = F.from_json(raw, "array<struct<name:string,value:string>>")
    as_list = F.transform(F.filter(listed, lambda a: a["name"].isNotNull()), lambda a: F.struct(F.lower(a["name"]).alias("k"), F.substring(F.coalesce(a["value"], F.lit("")), 1, MAX_CHARS).alias("v")))
    as_map = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.substring(F.coalesce(e["value"], F.lit("")), 1, MAX_CHARS).alias("v")))
    pairs = F.when(F.startswith(F.ltrim(raw), F.lit("{")), as_map).otherwise(F.slice(as_list, 1, 64))
    return F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>"))


def first_of(pairs: Column, *names: str) -> Column:
    """The first non-empty argument among the names; of a repeated name the last."""
    named = lambda n: lambda p: p["k"] == n
    values = [F.get(F.reverse(F.filter(pairs, named(n))), F.lit(0))["v"] for n in names]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def report_calls(reports: DataFrame) -> DataFrame:
    """Events of the call log: a process start for each process with a known parent, then its calls by their API."""
    procs = F.slice(F.col("r.behavior.processes"), 1, MAX_LIST)
    starts = F.transform(procs, lambda p: F.get(p["calls"], F.lit(0))["timestamp"])
    usable = F.filter(starts, lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    rows = reports.select("run_id", "sample", F.array_min(usable).alias("t0"), procs.alias("procs"), F.posexplode(procs).alias("i", "p"))
    pid, ppid = safe_int(F.col("p.process_id"), -1), safe_int(F.col("p.parent_id"), 0)
    rows = rows.withColumns({"pid": F.when(F.col("p.process_id").isNull(), 1000 + F.col("i")).otherwise(pid), "ppid": ppid, "image": F.coalesce(F.nullif("p.process_name", F.lit("")), "sample")})
    parent = F.get(F.filter("procs", lambda q: safe_int(q["process_id"], -1) == F.col("ppid")), F.lit(0))
    started = rows.where(parent.isNotNull()).select("run_id", F.col("i").alias("o1"), F.lit(-1).alias("o2"), (F.col("i") * 1e-3).alias("ts"), F.lit("process_create").alias("type"), F.col("ppid").alias("pid"), F.coalesce(F.nullif(parent["process_name"], F.lit("")), F.lit("?")).alias("image"), F.col("image").alias("target"), F.nullif("p.environ.CommandLine", F.lit("")).alias("cmdline"), F.col("pid").alias("child_pid"), F.lit(None).cast("string").alias("api"))
    calls = rows.select("run_id", "t0", "i", "pid", "image", F.posexplode(F.slice(F.col("p.calls"), 1, MAX_CALLS)).alias("j", "c"))
    low, a = F.lower(F.col("c.api")), F.col("a")
    calls = calls.where("c is not null").withColumn("a", arguments(F.col("c.arguments")))
    kind = F.when(low.isin(*INJECT), "process_inject").when(low.isin(*KEY_SET), "registry_set").when(low.isin(*KEY_DELETE), "registry_delete").when(low.isin(*FILE_DELETE), "file_delete").when(low.isin(*SERVICE), "service_create").when(low.isin(*MUTEX), "mutex_create").otherwise("api_call")
    process = first_of(a, "processid", "process_identifier", "pid")
    target = (
        F.when(kind == "process_inject", F.coalesce(F.concat(F.lit("pid "), process), F.lit("unknown")))
        .when(kind == "registry_set", F.coalesce(first_of(a, "fullname", "regkey", "keyname", "valuename"), F.lit("?")))
        .when(kind == "registry_delete", F.coalesce(first_of(a, "fullname", "regkey", "keyname"), F.lit("?")))
        .when(kind == "file_delete", F.coalesce(first_of(a, "filename", "filepath"), F.lit("?")))
        .when(kind == "service_create", F.coalesce(first_of(a, "servicename", "binarypathname"), F.lit("?")))
        .when(kind == "mutex_create", F.coalesce(first_of(a, "mutantname", "mutexname"), F.lit("?")))
        .otherwise(F.col("c.api"))
    )
    ts = F.col("c.timestamp")
    at = F.when(ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < float("inf")) & F.col("t0").isNotNull(), F.greatest(F.lit(0.0), ts - F.col("t0"))).otherwise(F.col("i") + F.col("j") * 1e-4)
    child = F.when(kind == "process_inject", F.coalesce(F.when(process.rlike("^[0-9]{1,18}$"), process.try_cast("long")), F.lit(-1).cast("long")))
    made = calls.select("run_id", F.col("i").alias("o1"), F.col("j").alias("o2"), at.alias("ts"), kind.alias("type"), "pid", "image", target.alias("target"), F.lit(None).cast("string").alias("cmdline"), child.alias("child_pid"), F.when(kind != "api_call", F.col("c.api")).alias("api"))
    return started.unionByName(made)


#: Lists of the summary: its name, the event type, whether it says only that something was opened or resolved.
SUMMARY_KINDS = (
    ("executed_commands", "process_create"), ("write_files", "file_write"), ("delete_files", "file_delete"), ("read_files", "file_read"), ("files", "file_read"),
    ("write_keys", "registry_set"), ("delete_keys", "registry_delete"), ("read_keys", "registry_read"), ("keys", "registry_read"), ("mutexes", "mutex_create"),
    ("created_services", "service_create"), ("started_services", "service_start"), ("resolved_apis", "api_call"),
)


def report_summary(reports: DataFrame) -> DataFrame:
    """Events of the summary lists in their fixed order; files and keys beyond the typed lists count as opened only."""
    s = F.col("r.behavior.summary")
    none = F.array().cast("array<string>")
    low = lambda name: F.transform(F.coalesce(s[name], none), lambda v: F.lower(v))

    def listed(name: str) -> Column:
        values = F.slice(F.filter(F.coalesce(s[name], none), lambda v: v.isNotNull()), 1, MAX_LIST)
        typed = {"files": ("write_files", "delete_files", "read_files"), "keys": ("write_keys", "delete_keys", "read_keys")}.get(name)
        if typed:
            known = reduce(F.array_union, map(low, typed))
            values = F.filter(values, lambda v: ~F.array_contains(known, F.lower(v)))
        return values

    entry = lambda k, name, kind: lambda v: F.struct(F.lit(k).alias("o1"), F.lit(kind).alias("type"), F.substring(v, 1, MAX_CHARS).alias("v"), F.lit(name).alias("list"))
    parts = [F.transform(listed(name), entry(k, name, kind)) for k, (name, kind) in enumerate(SUMMARY_KINDS)]
    rows = reports.where(s.isNotNull()).select("run_id", "sample", F.posexplode(F.concat(*parts)).alias("o2", "x"))
    command = F.col("x.type") == "process_create"
    return rows.select(
        "run_id", F.col("x.o1").alias("o1"), "o2", F.round((F.col("o2") + 1) * 1e-3, 6).alias("ts"), F.col("x.type").alias("type"), F.lit(1000).cast("long").alias("pid"), F.col("sample").alias("image"),
        F.when(command, command_image(F.col("x.v"))).otherwise(F.col("x.v")).alias("target"), F.when(command, F.col("x.v")).alias("cmdline"), F.when(command, F.lit(-1)).cast("long").alias("child_pid"),
        F.lit(None).cast("string").alias("api"), F.col("x.list").isin("files", "keys").alias("opened_only"), (F.col("x.list") == "resolved_apis").alias("resolved_only"), F.lit(True).alias("synthetic_ts"),
    )


def report_network(reports: DataFrame) -> DataFrame:
    """Name queries, then flows, each flow once per protocol in the order met."""
    n = F.col("r.network")
    none = F.array()
    flows = lambda f: F.array_distinct(F.transform(F.filter(F.slice(F.coalesce(n[f], none.cast("array<struct<dst:string,dport:string>>")), 1, MAX_LIST), lambda x: x["dst"].isNotNull()), lambda x: F.concat(x["dst"], F.lit(":"), F.coalesce(x["dport"], F.lit("None")))))
    dns = F.transform(F.filter(F.slice(F.coalesce(n["dns"], none.cast("array<struct<request:string>>")), 1, MAX_LIST), lambda x: F.coalesce(x["request"], F.lit("")) != ""), lambda x: x["request"])
    item = lambda values, k, kind: F.transform(values, lambda v: F.struct(F.lit(k).alias("o1"), F.lit(kind).alias("type"), v.alias("v")))
    rows = reports.where(n.isNotNull()).select("run_id", "sample", F.posexplode(F.concat(item(dns, 0, "dns_query"), item(flows("tcp"), 1, "net_connect"), item(flows("udp"), 2, "net_connect"))).alias("o2", "x"))
    return rows.select("run_id", F.col("x.o1").alias("o1"), "o2", ((F.col("o2") + 1) * 1e-3).alias("ts"), F.col("x.type").alias("type"), F.lit(1000).cast("long").alias("pid"), F.col("sample").alias("image"), F.col("x.v").alias("target"), F.lit(True).alias("synthetic_ts"))


def sandbox_events(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): calls, then summary facts that the calls do not have (none of their API names), then network."""
    reports = parsed_reports(files)
    calls, summary, network = report_calls(reports), report_summary(reports), report_network(reports)
    key = lambda df: df.select("run_id", "type", F.lower(F.coalesce("target", F.lit(""))).alias("key")).distinct()
    new = summary.withColumn("key", F.lower(F.coalesce("target", F.lit("")))).join(key(calls), ["run_id", "type", "key"], "left_anti").drop("key")
    logged = calls.select("run_id").distinct().withColumn("__logged", F.lit(True))
    new = new.join(logged, "run_id", "left").where((F.col("type") != "api_call") | F.col("__logged").isNull()).drop("__logged")
    last = calls.groupBy("run_id").agg(F.max("ts").alias("end"))
    parts = [calls.withColumn("part", F.lit(0)), new.join(last, "run_id", "left").withColumn("ts", F.round(F.col("ts") + F.coalesce("end", F.lit(0.0)), 6)).drop("end").withColumn("part", F.lit(1))]
    end = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    tail = end.groupBy("run_id").agg(F.max("ts").alias("end"))
    parts.append(network.join(tail, "run_id", "left").withColumn("ts", F.col("ts") + F.coalesce("end", F.lit(0.0))).drop("end").withColumn("part", F.lit(2)))
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    made = finished(events, ["part", "o1", "o2"])
    rejects = reports.join(events.select("run_id").distinct(), "run_id", "left_anti").select("path", F.when(F.col("r").isNull(), "no report").otherwise("no events").alias("reason"))
    return made, rejects


def file_metadata(files: DataFrame) -> DataFrame:
    """(run_id, sha256, pe): the static part of reports."""
    return parsed_reports(files).select("run_id", "sha256", F.col("r.static.pe").alias("pe"))


# --- host logs


def host_log_events(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of event-log exports, XML or JSON lines, in any Unicode encoding; a file is a run."""
    texts = files.select("path", run_key("host_log", F.col("sha256")).alias("run_id"), decoded(F.col("content")).alias("text"))
    xml = texts.where(F.startswith(F.ltrim("text"), F.lit("<")))
    unsafe = F.upper("text").rlike("<!(DOCTYPE|ENTITY)")
    records = F.regexp_extract_all("text", F.lit(r"(?s)<(?:\w+:)?Event[\s>].*?</(?:\w+:)?Event>"), 0)
    listed = xml.where(~unsafe).select("run_id", F.posexplode(records).alias("i", "x"))
    number = F.regexp_extract("x", r"<(?:\w+:)?EventID[^>]*>\s*(\d+)", 1)
    names = F.regexp_extract_all("x", F.lit(r"(?s)<(?:\w+:)?Data\s+Name=[\"']([^\"']*)[\"']\s*(?:/>|>(.*?)</)"), 1)
    values = F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<(?:\w+:)?Data\s+Name=[\"']([^\"']*)[\"']\s*(?:/>|>(.*?)</)"), 2), lambda v: plain_xml(F.coalesce(v, F.lit(""))))
    from_xml = listed.select("run_id", "i", number.try_cast("int").alias("eid"), F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), values.alias("v")))).alias("d"))
    lines = texts.where(~F.startswith(F.ltrim("text"), F.lit("<"))).select("path", "run_id", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "x"))
    flat = F.from_json("x", "map<string,string>")
    parsed = lines.withColumns({"m": flat}).withColumn("d", F.coalesce(F.from_json(F.try_element_at("m", F.lit("EventData")), "map<string,string>"), F.col("m")))
    broken = parsed.groupBy("path", "run_id").agg(F.count_if(F.col("m").isNull()).alias("bad")).where("bad > 0")
    from_json = parsed.join(broken.select("run_id"), "run_id", "left_anti").select("run_id", "i", F.coalesce(F.try_element_at("m", F.lit("EventID")), F.try_element_at("m", F.lit("event_id"))).try_cast("int").alias("eid"), "d")
    rows = from_xml.unionByName(from_json)
    rejects = xml.where(unsafe).select("path", F.lit("document type not allowed").alias("reason")).unionByName(broken.select("path", F.lit("bad line").alias("reason")))
    return typed_log(rows), rejects


def plain_xml(v: Column) -> Column:
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(entity), F.lit(c))
    return v


def typed_log(rows: DataFrame) -> DataFrame:
    """Log records (run_id, i, eid, d) by their number; times relative to the first real one."""
    g = lambda name: F.coalesce(F.try_element_at("d", F.lit(name)), F.lit(""))
    eid = F.col("eid")
    removed = F.contains(F.lower(g("EventType")), F.lit("delete"))
    created = (eid == 12) & ~removed
    kind = (
        F.when(eid == 1, "process_create").when(eid == 3, "net_connect").when(eid == 8, "process_inject").when(eid.isin(11, 15), "file_write").when(eid.isin(23, 26), "file_delete")
        .when(eid.isin(12, 13, 14) & removed, "registry_delete").when(eid.isin(13, 14), "registry_set").when(eid == 22, "dns_query").when(eid == 17, "mutex_create")
    )
    address = F.coalesce(F.nullif(F.try_element_at("d", F.lit("DestinationHostname")), F.lit("")), F.try_element_at("d", F.lit("DestinationIp")), F.lit("None"))
    target = (
        F.when(eid == 1, basename(g("Image"))).when(eid == 3, F.concat(F.coalesce(F.try_element_at("d", F.lit("DestinationIp")), address), F.lit(":"), g("DestinationPort"))).when(eid == 8, basename(g("TargetImage")))
        .when(eid.isin(11, 15, 23, 26), g("TargetFilename")).when(eid.isin(12, 13, 14), g("TargetObject")).when(eid == 22, g("QueryName")).when(eid == 17, g("PipeName"))
    )
    actor = F.when(eid == 1, g("ParentImage")).when(eid == 8, g("SourceImage")).otherwise(g("Image"))
    pid = F.when(eid == 1, g("ParentProcessId")).when(eid == 8, g("SourceProcessId")).otherwise(g("ProcessId"))
    real = F.coalesce(F.try_to_timestamp(F.substring(g("UtcTime"), 1, 26), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(F.substring(g("UtcTime"), 1, 23), F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(F.substring(g("UtcTime"), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
    kept = rows.where(~created).select(
        "run_id", "i", kind.alias("type"), target.alias("target"), F.coalesce(F.nullif(basename(actor), F.lit("")), F.lit("unknown")).alias("image"), safe_int(pid, 0).alias("pid"), (F.unix_micros(real) / 1e6).alias("at"),
        F.when(eid == 1, F.nullif(g("CommandLine"), F.lit(""))).alias("cmdline"), F.when(eid == 1, safe_int(g("ProcessId"), -1)).when(eid == 8, safe_int(g("TargetProcessId"), -1)).alias("child_pid"), F.when(eid == 8, F.lit("CreateRemoteThread")).alias("api"),
    ).where("type is not null and target <> ''")
    zero = F.min("at").over(Window.partitionBy("run_id"))
    timed = kept.withColumns({"ts": F.round(F.coalesce(F.col("at") - zero, F.col("i") * 1e-3), 6), "synthetic_ts": F.col("at").isNull()})
    return finished(timed, ["i"])


# --- emulator reports

EMULATED = "struct<sha256:string,entry_points:array<struct<ep_type:string,apis:array<struct<api_name:string,args:array<string>>>,file_access:array<struct<event:string,path:string>>,registry_access:array<struct<event:string,path:string,value_name:string>>,network_events:struct<dns:array<struct<query:string>>,traffic:array<struct<server:string,port:string,proto:string>>>>>>"


def emulator_events(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): API calls, file, registry and network access of every entry point, in ticks of a millisecond."""
    raw = F.col("content").cast("string")
    wrapped = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.concat(F.lit('{"entry_points":'), raw, F.lit("}"))).otherwise(raw)
    doc = files.select("path", run_key("emulator", F.col("sha256")).alias("run_id"), F.from_json(wrapped, EMULATED).alias("d"))
    none = F.array()
    fact = lambda kind, target, api=None: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), F.substring(target, 1, MAX_CHARS).alias("target"), (api if api is not None else F.lit(None).cast("string")).alias("api"), F.lit(None).cast("string").alias("cmdline"), F.lit(1).alias("tick"))
    file_kind = lambda e: F.when(F.lower(e).rlike("write|create"), "file_write").when(F.contains(F.lower(e), F.lit("delete")), "file_delete").otherwise("file_read")
    key_kind = lambda e: F.when(F.contains(F.lower(e), F.lit("delete")), "registry_delete").when(F.lower(e).rlike("write|set") & ~F.contains(F.lower(e), F.lit("key")), "registry_set").when(F.contains(F.lower(e), F.lit("create")), F.lit(None)).otherwise("registry_read")
    cap = lambda c, n: F.slice(c, 1, n)
    argument = lambda a, i: F.coalesce(F.get(a["args"], F.lit(i)), F.lit(""))
    plain = lambda v: F.when(F.startswith(F.lower(v), F.lit("0x")) | v.isin("", "None"), "").otherwise(v)

    def started(a: Column) -> Column:
        """The process that a call starts, or null: which argument names it depends on the family of the call."""
        low = F.lower(F.substring_index(a["api_name"], ".", -1))
        at = lambda i: plain(argument(a, i))
        second = F.startswith(low, F.lit("createprocessasuser")) | F.startswith(low, F.lit("createprocesswith")) | F.startswith(low, F.lit("createprocessinternal"))
        first, shell = F.startswith(low, F.lit("createprocess")), F.startswith(low, F.lit("shellexecute"))
        app = F.when(second, at(1)).when(first, at(0)).when(shell, at(2)).otherwise(F.lit(""))
        cmd = F.when(second, at(2)).when(first, at(1)).when(low == "winexec", at(0)).otherwise(F.when(app != "", F.trim(F.concat(app, F.lit(" "), at(3)))).otherwise(F.lit("")))
        quoted = F.regexp_extract(cmd, '^"([^"]*)"', 1)
        target = F.when(app != "", app).when(cmd.rlike('^"[^"]*"'), quoted).otherwise(F.substring_index(cmd, " ", 1))
        made = F.struct(F.lit("process_create").alias("type"), F.nullif(F.substring(target, 1, MAX_CHARS), F.lit("")).alias("target"), a["api_name"].alias("api"), F.nullif(F.substring(cmd, 1, MAX_CHARS), F.lit("")).alias("cmdline"), F.lit(0).alias("tick"))
        return F.when((second | first | shell | (low == "winexec")) & ((target != "") | (cmd != "")), made)

    called = lambda a: F.array_compact(F.array(fact("api_call", F.substring_index(a["api_name"], ".", -1), a["api_name"]), started(a)))
    apis = lambda p: F.flatten(F.transform(F.filter(cap(F.coalesce(p["apis"], none.cast("array<struct<api_name:string,args:array<string>>>")), 5000), lambda a: F.coalesce(a["api_name"], F.lit("")) != ""), called))
    opened = lambda p: F.transform(F.filter(cap(F.coalesce(p["file_access"], none.cast("array<struct<event:string,path:string>>")), 2000), lambda a: F.coalesce(a["path"], F.lit("")) != ""), lambda a: fact(file_kind(F.coalesce(a["event"], F.lit(""))), a["path"]))
    keys = lambda p: F.transform(F.filter(cap(F.coalesce(p["registry_access"], none.cast("array<struct<event:string,path:string,value_name:string>>")), 2000), lambda a: F.coalesce(a["path"], F.lit("")) != ""), lambda a: fact(key_kind(F.coalesce(a["event"], F.lit(""))), F.concat_ws("\\", a["path"], F.nullif(a["value_name"], F.lit("")))))
    dns = lambda p: F.transform(F.filter(F.coalesce(p["network_events"]["dns"], none.cast("array<struct<query:string>>")), lambda a: F.coalesce(a["query"], F.lit("")) != ""), lambda a: fact("dns_query", a["query"]))
    flows = lambda p: F.transform(F.filter(F.coalesce(p["network_events"]["traffic"], none.cast("array<struct<server:string,port:string,proto:string>>")), lambda a: F.coalesce(a["server"], F.lit("")) != ""), lambda a: fact("net_connect", F.concat(a["server"], F.lit(":"), F.coalesce(a["port"], F.lit("0")))))
    facts = F.filter(F.flatten(F.transform(cap(F.col("d.entry_points"), 256), lambda p: F.concat(apis(p), opened(p), keys(p), dns(p), flows(p)))), lambda f: f["type"].isNotNull())
    rows = doc.where("d.entry_points is not null").select("run_id", F.posexplode(facts).alias("i", "f"))
    # a process start shares the tick of its call
    tick = F.sum("f.tick").over(Window.partitionBy("run_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    process = F.col("f.type") == "process_create"
    events = rows.select("run_id", "i", (tick * 1e-3).alias("ts"), "f.type", F.lit(1000).cast("long").alias("pid"), F.lit("sample.exe").alias("image"), "f.target", "f.cmdline", F.when(process, F.lit(-1)).cast("long").alias("child_pid"), "f.api", F.lit(True).alias("synthetic_ts"))
    rejects = doc.where("d.entry_points is null or size(d.entry_points) = 0").select("path", F.lit("no entry points").alias("reason"))
    return finished(events, ["i"]), rejects


# --- sequences, labels, dispatch


def call_sequences(rows: DataFrame) -> DataFrame:
    """Events of (run_id, apis): time is the place in the whole list, empty names left out."""
    made = rows.select("run_id", F.posexplode("apis").alias("i", "a")).where("a is not null and trim(a) <> ''")
    return finished(made.select("run_id", "i", F.col("i").cast("double").alias("ts"), F.lit("api_call").alias("type"), F.lit(1000).cast("long").alias("pid"), F.lit("sample.exe").alias("image"), F.substring("a", 1, 128).alias("target")), ["i"])


def sequence_table(spark: SparkSession, path: str, max_calls: int = 100_000) -> DataFrame:
    """(sha256, label, apis, truncated) of a wide, ragged comma-separated table: digest, label, then one call per column.

    ``truncated`` counts the calls beyond ``max_calls``, which are cut.
    """
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("sha256")))
    parts = F.split("value", ",")
    return lines.select(F.get(parts, F.lit(0)).alias("sha256"), F.get(parts, F.lit(1)).try_cast("int").alias("label"), F.filter(F.slice(parts, 3, max_calls), lambda a: F.trim(a) != "").alias("apis"), F.greatest(F.lit(0), F.size(parts) - 2 - max_calls).alias("truncated"))


def labels_table(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, family, kind, date, split) of a label table with a header; of rows that repeat a digest the last counts."""
    rows = spark.read.csv(path, header=True).select("sha256", F.col("classification_family").alias("family"), F.col("classification_type").alias("kind"), "date", F.monotonically_increasing_id().alias("line"))
    last = rows.groupBy("sha256").agg(F.max_by(F.struct("date", "family", "kind"), "line").alias("r")).select("sha256", "r.*")
    return last.withColumn("split", F.when(F.col("date") < "2019-08-01", "train").otherwise("test"))


def labelled(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """Reports joined to their labels by the digest in the file's name; others go."""
    digest = F.lower(F.regexp_extract("path", r"([0-9A-Fa-f]{64})[^/]*$", 1))
    return reports.withColumn("sha256", digest).join(labels, "sha256")


def feature_rows(spark: SparkSession, path: str, labelled_only: bool = True) -> DataFrame:
    """Pre-extracted file features, one JSON object a line, with ``member``, the file it stands in; unlabelled rows (-1) go."""
    from ..operators.triage import FILE_ROW

    rows = spark.read.schema(FILE_ROW).json(path).select("*", F.col("_metadata.file_name").alias("member"))
    return rows.where(F.col("label").isin(0, 1)) if labelled_only else rows


def report_kind(content: Column) -> Column:
    """host_log, emulator, sandbox or native, by what the text holds."""
    raw = F.substring(content.cast("string"), 1, 65_536)
    return (
        F.when(F.startswith(F.ltrim(raw), F.lit("<")) | raw.rlike('"(EventID|event_id)"'), "host_log")
        .when(raw.rlike('"(entry_points|ep_type|apis)"'), "emulator")
        .when(raw.rlike('"(behavior|static|network|info)"\\s*:\\s*\\{'), "sandbox")
        .otherwise("native")
    )


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a folder of reports of all kinds, each file by its own reader."""
    files, large = read_files(spark, path)
    events, rejects = parsed_files(files)
    return events, rejects.unionByName(large)


def parsed_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of files (path, content, sha256); of files of equal content the first by path counts."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path")).select("path")
    files = files.join(first, "path", "left_semi").withColumn("kind", report_kind(F.col("content")))
    readers = {"host_log": host_log_events, "emulator": emulator_events, "sandbox": sandbox_events, "native": native_traces}
    made = [reader(files.where(F.col("kind") == kind).drop("kind")) for kind, reader in readers.items()]
    return reduce(DataFrame.unionByName, (m[0] for m in made)), reduce(DataFrame.unionByName, (m[1] for m in made))


def recorded_samples(files: DataFrame) -> DataFrame:
    """(run_id, sha256): the sample digests that runs record: of native traces, of sandbox targets, of process starts in host logs."""
    files = files.withColumn("kind", report_kind(F.col("content")))
    native = files.where("kind = 'native'").select(run_key("native", F.col("sha256")).alias("run_id"), F.from_json(F.col("content").cast("string"), "struct<sample_sha256:string>")["sample_sha256"].alias("sha256"))
    sandbox = parsed_reports(files.where("kind = 'sandbox'")).select("run_id", F.col("r.target.file.sha256").alias("sha256"))
    logs = files.where("kind = 'host_log'").select(run_key("host_log", F.col("sha256")).alias("run_id"), F.explode(F.regexp_extract_all(decoded(F.col("content")), F.lit("(?i)SHA256=([0-9a-f]{64})"), 1)).alias("sha256"))
    return reduce(DataFrame.unionByName, (native, sandbox, logs)).select("run_id", F.lower("sha256").alias("sha256")).where("sha256 rlike '^[0-9a-f]{64}$'").distinct()


# --- sequences of benchmarks


def positional_sequences(spark: SparkSession, labels_path: str, calls_path: str) -> DataFrame:
    """(line, label, apis, n_calls, sig): the n-th line of one text file labels the n-th of another; sig is a digest of the calls.

    Lines are numbered by file, offset of their partition and place, so neither file passes through one task.
    """
    labels = numbered_lines(spark, labels_path, skip_empty=True).select("line", F.trim("value").alias("label"))
    calls = numbered_lines(spark, calls_path).select("line", F.filter(F.split(F.trim("value"), r"\s+"), lambda c: c != "").alias("apis"))
    return labels.join(calls, "line").select("line", "label", "apis", F.size("apis").alias("n_calls"), F.sha2(F.array_join("apis", " "), 256).alias("sig"))


def numbered_lines(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    """(line, value): lines of a text file by their place, from 0: counts of partitions first, then places within each."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    rows = staged(rows.where(F.trim("value") != "") if skip_empty else rows, "lines").withColumn("part", F.shiftright("id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the file
    base = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return rows.withColumn("place", place).join(F.broadcast(base), "part").select((F.col("base") + F.col("place")).alias("line"), "value")


def coded_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(digest, codes, label): a table with a header of a digest, call codes and a last column of labels; of equal sequences the
    first row of the file counts."""
    rows = numbered_lines(spark, path).where("line > 0").withColumn("c", F.split("value", ","))
    rows = rows.where(F.size("c") > 2).select("line", F.get("c", F.lit(0)).alias("digest"), F.slice("c", F.lit(2), F.size("c") - 2).alias("codes"), F.element_at("c", -1).try_cast("int").alias("label"))
    kept = rows.groupBy("codes").agg(F.min_by(F.struct("digest", "label"), "line").alias("r"))
    return kept.select("r.digest", "codes", "r.label")
