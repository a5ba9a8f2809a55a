"""Static triage: additive, explainable scores of file bytes and of file metadata; feature rows of pre-extracted files."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import crc_bucket, entropy_of_counts, finite_float, let, normalised, sigmoid, verdict
from ..functions.text import addresses_in, printable_strings, urls_in

# --- fixed values: weights of the additive score

APIS = {
    "VirtualAllocEx": 0.9, "WriteProcessMemory": 0.9, "CreateRemoteThread": 1.0, "NtUnmapViewOfSection": 1.0, "SetWindowsHookEx": 0.6, "GetAsyncKeyState": 0.6,
    "IsDebuggerPresent": 0.4, "URLDownloadToFile": 0.8, "WinExec": 0.5, "CryptEncrypt": 0.5, "RegSetValueEx": 0.3, "InternetOpenUrl": 0.5,
}
TOKENS = {r"CurrentVersion\\Run": 0.8, "vssadmin delete shadows": 1.2, "powershell -enc": 1.0, "bcdedit /set": 0.8, "schtasks /create": 0.6, "YOUR FILES HAVE BEEN ENCRYPTED": 1.5}
PACKERS = {"UPX0": 0.7, "UPX1": 0.7, ".aspack": 0.7, "MPRESS1": 0.7}
BIAS, DETONATE, HIGH_ENTROPY, ANALYSED_BYTES = -2.0, 0.35, 7.2, 50 * 1024 * 1024


def reason(name: Column | str, value: Column | float, weight: float) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    value = F.lit(float(value)) if isinstance(value, (int, float)) else value.cast("double")
    return F.struct(name.alias("feature"), value.alias("value"), F.lit(float(weight)).alias("weight"), F.round(value * F.lit(float(weight)), 4).alias("impact"))


def weighed(reasons: list[Column]) -> Column:
    """Array of the reasons that hold, greatest impact first."""
    held = F.array_compact(F.array(*reasons))
    return F.array_sort(held, lambda a, b: F.when(F.abs(a["impact"]) > F.abs(b["impact"]), -1).when(F.abs(a["impact"]) < F.abs(b["impact"]), 1).otherwise(0))


def total(reasons: Column) -> Column:
    return F.aggregate(reasons, F.lit(BIAS), lambda a, r: a + r["impact"])


def text_reasons(text: Column) -> list[Column]:
    """Indicators within text: API names as they are, tokens in any case, the first packer mark."""
    apis = [F.when(F.contains(text, F.lit(a)), reason(f"api:{a}", 1.0, w)) for a, w in APIS.items()]
    tokens = [F.when(text.rlike(f"(?i){t}"), reason(f"token:{t}", 1.0, w)) for t, w in TOKENS.items()]
    packer = reduce(lambda rest, p: F.when(F.contains(text, F.lit(p[0])), reason(f"packer:{p[0]}", 1.0, p[1])).otherwise(rest), reversed(list(PACKERS.items())), F.lit(None))
    return [*apis, *tokens, packer]


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Bits per byte of a binary column, 0 for none: its bytes are counted in one pass, batch by batch."""
    import numpy as np

    def bits(value: bytes | None) -> float:
        counts = np.bincount(np.frombuffer(value or b"", np.uint8), minlength=256)
        share = counts[counts > 0] / max(1, counts.sum())
        return float(-(share * np.log2(share)).sum()) + 0.0

    return data.map(bits)


def triage_files(files: DataFrame, data_col: str = "content") -> DataFrame:
    """Add score, label, detonate, reasons, strings, urls, ips, entropy, is_pe and md5 to files with their bytes."""
    data = F.substring(data_col, 1, ANALYSED_BYTES)
    rows = files.withColumns({"strings": printable_strings(data), "entropy": byte_entropy(data), "is_pe": F.substring(data_col, 1, 2) == F.lit(bytearray(b"MZ")), "md5": F.md5(data_col)})
    plain = F.decode(data, "ISO-8859-1")
    rows = rows.withColumns({"urls": urls_in(plain), "ips": addresses_in(plain), "__text": F.array_join("strings", "\n")})
    more = [
        F.when(F.col("entropy") > HIGH_ENTROPY, reason("high_entropy", F.round(F.col("entropy") - HIGH_ENTROPY, 3), 2.0)),
        F.when(F.col("is_pe"), reason("pe_executable", 1.0, 0.8)),
        F.when(F.size("urls") > 0, reason("embedded_urls", F.least(F.size("urls"), F.lit(3)), 0.3)),
    ]
    rows = rows.withColumn("reasons", weighed([*text_reasons(F.col("__text")), *more]))
    p = sigmoid(total(F.col("reasons")))
    return rows.withColumns({"score": F.round(p, 4), "label": verdict(p, DETONATE), "detonate": (p >= DETONATE) | F.col("is_pe"), "entropy": F.round("entropy", 4)}).drop("__text")


def triage_texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The same additive score over a text column: (.., n_reasons, score, label)."""
    reasons = weighed(text_reasons(F.coalesce(text_col, F.lit(""))))
    rows = rows.withColumn("__r", reasons)
    p = sigmoid(total(F.col("__r")))
    return rows.withColumns({"n_reasons": F.size("__r"), "score": p, "label": verdict(p, DETONATE)}).drop("__r")


def triage_metadata(files: DataFrame, pe: str = "pe") -> DataFrame:
    """Add score, label, detonate (always) and reasons from a struct of file metadata."""
    p = F.col(pe)
    names = F.flatten(F.transform(p["imports"], lambda d: F.transform(d["imports"], lambda f: F.lower(f["name"]))))
    names = F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))
    sections = F.coalesce(p["sections"], F.array().cast("array<struct<name:string,entropy:string>>"))
    starts = lambda a: lambda n: F.startswith(n, F.lit(a))
    marked = lambda m: lambda s: F.contains(F.coalesce(s["name"], F.lit("")), F.lit(m))
    apis = [F.when(F.exists(names, starts(a.lower())), reason(f"api:{a}", 1.0, w)) for a, w in APIS.items()]
    packers = [F.when(F.exists(sections, marked(m)), reason(f"packer:{m}", 1.0, w)) for m, w in PACKERS.items()]
    packer = F.coalesce(*packers)
    top = F.coalesce(F.array_max(F.transform(sections, lambda s: finite_float(s["entropy"], 0.0, 0.0, 8.0))), F.lit(0.0))
    more = [F.when(top > HIGH_ENTROPY, reason("high_entropy", F.round(top - HIGH_ENTROPY, 3), 2.0)), F.when(F.size(names) < 10, reason("few_imports", 1.0, 0.6)), reason("pe_executable", 1.0, 0.8)]
    rows = files.withColumn("reasons", weighed([*apis, packer, *more]))
    score = sigmoid(total(F.col("reasons")))
    return rows.withColumns({"score": F.round(score, 4), "label": verdict(score, DETONATE), "detonate": F.lit(True)})


# --- feature rows of pre-extracted files

SECTION_BUCKETS, LIBRARIES, FUNCTIONS, EXPORTS, HEADER_BUCKETS, DIRECTORIES = 50, 256, 1024, 128, 10, 15

# --- fixed values: fields of a feature row, APIs and section names with a feature of their own

STRING_FIELDS = ["numstrings", "avlength", "printables"], ["entropy", "paths", "urls", "registry", "MZ"]
GENERAL_FIELDS = ["size", "vsize", "has_debug", "exports", "imports", "has_relocations", "has_resources", "has_signature", "has_tls", "symbols"]
HEADER_FIELDS = [
    "major_image_version", "minor_image_version", "major_linker_version", "minor_linker_version", "major_operating_system_version", "minor_operating_system_version",
    "major_subsystem_version", "minor_subsystem_version", "sizeof_code", "sizeof_headers", "sizeof_heap_commit",
]
MORE_APIS = [
    "VirtualAlloc", "VirtualProtect", "LoadLibraryA", "GetProcAddress", "CreateProcessA", "CreateProcessW", "ShellExecuteA", "ShellExecuteW", "OpenProcess", "ReadProcessMemory",
    "ResumeThread", "SetThreadContext", "GetThreadContext", "CryptAcquireContextA", "CryptDecrypt", "CryptGenKey", "InternetOpenA", "InternetReadFile", "HttpSendRequestA", "WSAStartup",
    "connect", "socket", "RegCreateKeyExA", "RegOpenKeyExA", "CreateServiceA", "OpenSCManagerA", "AdjustTokenPrivileges", "GetTickCount", "Sleep", "FindFirstFileA",
    "GetForegroundWindow", "GetKeyboardState", "OpenClipboard", "CreateToolhelp32Snapshot",
]
MORE_PACKERS = [".packed", ".themida", ".vmp0", ".vmp1", "petite", ".nsp0", ".adata", "pec2"]

NAMED_APIS = sorted({*APIS, *MORE_APIS})
NAMED_SECTIONS = sorted({*(p.lower() for p in PACKERS), *MORE_PACKERS})


def numbered(name: str, n: int, mark: str = "#") -> list[str]:
    return [f"{name}[{i}]" if mark == "[" else f"{name}#{i}" for i in range(n)]


#: The name of every feature, in the order of ``file_features``.
FEATURE_NAMES = [
    *numbered("histogram", 256, "["), *numbered("byteentropy", 256, "["),
    *(f"strings.{f}" for f in STRING_FIELDS[0]), *numbered("strings.printabledist", 96, "["), *(f"strings.{f}" for f in STRING_FIELDS[1]), *(f"general.{f}" for f in GENERAL_FIELDS),
    "header.coff.timestamp", *(n for f in ("machine", "characteristics", "subsystem", "dll_characteristics", "magic") for n in numbered(f"header.{f}", HEADER_BUCKETS)), *(f"header.{f}" for f in HEADER_FIELDS),
    *(f"section.{f}" for f in ("count", "n_zero_size", "n_empty_name", "n_rx", "n_w")), *(n for f in ("size", "entropy", "vsize", "entry_name", "entry_props") for n in numbered(f"section.{f}", SECTION_BUCKETS)),
    *numbered("imports.library", LIBRARIES), *numbered("imports.function", FUNCTIONS), *numbered("exports", EXPORTS), *(f"datadir[{i}].{f}" for i in range(DIRECTORIES) for f in ("size", "va")),
    *(f"imports:{a}" for a in NAMED_APIS), *(f"section:{p}" for p in NAMED_SECTIONS), "file_entropy",
]


def bucket_counts(tokens: Column, n: int) -> Column:
    """Counts of an array of tokens in ``n`` hashed buckets, as an array of ``n`` doubles."""
    return bucket_sums(F.transform(tokens, lambda t: F.struct(t.alias("name"), F.lit(1.0).alias("value"))), n)


def bucket_sums(pairs: Column, n: int) -> Column:
    """Sums of an array of (name, value) in ``n`` hashed buckets.

    Pairs are sorted by bucket behind a mark for each bucket, so that marks say where a bucket's pairs lie: one sort, one slice
    per bucket.
    """
    placed = F.transform(pairs, lambda p: F.struct(crc_bucket(p["name"], n).alias("b"), F.lit(1).alias("o"), p["value"].alias("v")))
    marks = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda b: F.struct(b.alias("b"), F.lit(0).alias("o"), F.lit(0.0).alias("v")))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, p: a + p["v"])
    starts = lambda s: F.filter(F.transform(s, lambda p, i: F.when(p["o"] == 0, i)), lambda i: i.isNotNull())
    sums = lambda s, at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: total(F.slice(s, F.get(at, b) + 1, F.get(at, b + 1) - F.get(at, b))))
    return let(F.array_sort(F.concat(placed, marks)), lambda s: let(starts(s), lambda at: sums(s, at)))


def file_features(rows: DataFrame) -> DataFrame:
    """Add ``features``, an array of doubles whose places are named by ``FEATURE_NAMES``; missing fields count as nothing.

    Histograms are divided by their sums; names of sections, libraries, functions and exports and words of the header are counted
    in hashed buckets; notable APIs and packers' sections have places of their own. Rows are as ``feature_rows`` reads them.
    """
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    numbers = lambda prefix, fields: F.array(*[number(F.col(f"{prefix}.{f}")) for f in fields])
    none, text = F.array().cast("array<string>"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    of_size = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: number(F.get(F.coalesce(c, F.array().cast("array<bigint>")), i)))
    words = lambda c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull())
    optional, coff = (lambda f: F.col(f"header.optional.{f}")), (lambda f: F.col(f"header.coff.{f}"))
    rows = rows.withColumns({
        "__sections": F.filter(F.coalesce("section.sections", F.array().cast("array<struct<name:string,size:double,entropy:double,vsize:double,props:array<string>>>")), lambda s: s.isNotNull()),
        "__functions": F.flatten(F.transform(F.map_entries(F.coalesce("imports", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(words(e["value"]), lambda f: F.struct(F.lower(e["key"]).alias("library"), f.alias("f"))))),
        "__entry": text(F.col("section.entry")),
    }).withColumns({"__names": F.array_distinct(F.transform("__functions", lambda x: F.lower(F.substring_index(x["f"], "@", 1)))), "__marks": F.transform("__sections", lambda s: F.lower(text(s["name"])))})
    sections = F.col("__sections")
    holds = lambda s, prop: F.array_contains(words(s["props"]), prop)
    having = lambda condition: F.size(F.filter(sections, condition)).cast("double")
    valued = lambda field: bucket_sums(F.transform(sections, lambda s: F.struct(text(s["name"]).alias("name"), number(s[field]).alias("value"))), SECTION_BUCKETS)
    entry_props = words(F.get(F.filter(sections, lambda s: text(s["name"]) == F.col("__entry")), F.lit(0))["props"])
    summed = lambda c: let(c, normalised)
    spread = F.when(number(F.col("strings.printables")) != 0, summed(of_size(F.col("strings.printabledist"), 96))).otherwise(F.array_repeat(F.lit(0.0), 96))
    api = lambda a: (F.exists("__names", lambda n: F.startswith(n, F.lit(a.lower()))) if a in APIS else F.array_contains("__names", a.lower())).cast("double")
    directory = lambda i: [number(F.get("datadirectories", F.lit(i))[f]) for f in ("size", "virtual_address")]
    parts = [
        summed(of_size(F.col("histogram"), 256)), summed(of_size(F.col("byteentropy"), 256)), numbers("strings", STRING_FIELDS[0]), spread, numbers("strings", STRING_FIELDS[1]), numbers("general", GENERAL_FIELDS),
        F.array(number(coff("timestamp"))), bucket_counts(F.array(text(coff("machine"))), HEADER_BUCKETS), bucket_counts(words(coff("characteristics")), HEADER_BUCKETS),
        bucket_counts(F.array(text(optional("subsystem"))), HEADER_BUCKETS), bucket_counts(words(optional("dll_characteristics")), HEADER_BUCKETS), bucket_counts(F.array(text(optional("magic"))), HEADER_BUCKETS), numbers("header.optional", HEADER_FIELDS),
        F.array(F.size(sections).cast("double"), having(lambda s: number(s["size"]) == 0), having(lambda s: text(s["name"]) == ""), having(lambda s: holds(s, "MEM_READ") & holds(s, "MEM_EXECUTE")), having(lambda s: holds(s, "MEM_WRITE"))),
        valued("size"), valued("entropy"), valued("vsize"), bucket_counts(F.array("__entry"), SECTION_BUCKETS), bucket_counts(entry_props, SECTION_BUCKETS),
        bucket_counts(F.transform(F.map_keys(F.coalesce("imports", F.create_map().cast("map<string,array<string>>"))), lambda x: F.lower(x)), LIBRARIES),
        bucket_counts(F.transform("__functions", lambda x: F.concat(x["library"], F.lit(":"), x["f"])), FUNCTIONS), bucket_counts(words(F.col("exports")), EXPORTS),
        F.array(*[v for i in range(DIRECTORIES) for v in directory(i)]), F.array(*map(api, NAMED_APIS)), F.array(*[F.array_contains("__marks", p).cast("double") for p in NAMED_SECTIONS]), F.array(entropy_of_counts(of_size(F.col("histogram"), 256))),
    ]
    return rows.withColumn("features", F.concat(*parts)).drop("__sections", "__functions", "__entry", "__names", "__marks")


def heuristic_scores(rows: DataFrame) -> DataFrame:
    """Add ``heuristic``: the additive score over feature rows: imports for API names, section names for packer marks, entropy
    from the byte histogram, URLs by their number."""
    none = F.array().cast("array<string>")
    names = F.transform(F.flatten(F.coalesce(F.map_values("imports"), F.array(none))), lambda f: F.lower(f))
    sections = F.coalesce(F.transform("section.sections", lambda s: F.coalesce(s["name"], F.lit(""))), none)
    score = F.lit(BIAS + 0.8)  # every such file is an executable
    named = lambda api: F.exists("__names", lambda n: F.startswith(n, F.lit(api.lower())))
    for api, weight in APIS.items():
        score = score + F.when(named(api), weight).otherwise(0.0)
    marks = F.array(*map(F.lit, PACKERS))
    score = score + F.when(F.arrays_overlap("__sections", marks), 0.7).otherwise(0.0)
    counts = F.transform(F.coalesce("histogram", F.array().cast("array<bigint>")), lambda c: c.cast("double"))
    high = F.greatest(F.col("__entropy") - HIGH_ENTROPY, F.lit(0.0))
    urls = F.least(F.coalesce("strings.urls", F.lit(0.0)), F.lit(3.0))
    rows = rows.withColumns({"__names": names, "__sections": sections, "__entropy": entropy_of_counts(counts)})
    return rows.withColumn("heuristic", sigmoid(score + 2.0 * high + 0.3 * urls)).drop("__names", "__sections", "__entropy")


FILE_ROW = (
    "sha256 string, label int, appeared string, histogram array<long>, byteentropy array<long>,"
    "strings struct<numstrings:double,avlength:double,printabledist:array<long>,printables:double,entropy:double,paths:double,urls:double,registry:double,MZ:double>,"
    "general struct<size:double,vsize:double,has_debug:double,exports:double,imports:double,has_relocations:double,has_resources:double,has_signature:double,has_tls:double,symbols:double>,"
    "header struct<coff:struct<timestamp:long,machine:string,characteristics:array<string>>,optional:struct<subsystem:string,dll_characteristics:array<string>,magic:string,major_image_version:double,minor_image_version:double,major_linker_version:double,minor_linker_version:double,major_operating_system_version:double,minor_operating_system_version:double,major_subsystem_version:double,minor_subsystem_version:double,sizeof_code:double,sizeof_headers:double,sizeof_heap_commit:double>>,"
    "section struct<entry:string,sections:array<struct<name:string,size:double,entropy:double,vsize:double,props:array<string>>>>,"
    "imports map<string,array<string>>, exports array<string>, datadirectories array<struct<name:string,size:double,virtual_address:double>>"
)
