"""Text as columns: value normalisation, paths, wildcard ladders, escaping, defanging, string extraction.

Every function takes and returns Columns, so the work stays inside Spark's generated code. Java patterns carry ``(?U)`` where
digits and white space of any script count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns and replacements that decide tokens and rules

GUID = r"\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?"
SID = r"(?U)s-1-5-21-[\d-]+"
HEX_RUN = r"(?U)(?<![a-z])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![a-z])"
ENVIRONMENT = [
    (r"c:\\users\\[^\\]+\\appdata\\roaming", "%appdata%"),
    (r"c:\\users\\[^\\]+\\appdata\\local\\temp", "%temp%"),
    (r"c:\\users\\[^\\]+\\appdata\\local", "%localappdata%"),
    (r"c:\\users\\[^\\]+", "%userprofile%"),
    (r"c:\\programdata", "%programdata%"),
    (r"c:\\windows\\(system32|syswow64)", "%system%"),
    (r"c:\\windows", "%windir%"),
    (r"hkey_current_user", "hkcu"),
    (r"hkey_local_machine", "hklm"),
    (r"hkey_users\\[^\\]+", "hkcu"),
]
RULE_USER = r"(?i)(c:\\users\\)[^\\]+"
RULE_SID = r"(?iU)s-1-5-21(-\d+)+"
RULE_GUID = "(?i)" + GUID
RULE_NUMBER = r"(?iU)(?<![a-z])(?=[0-9a-f]*\d)[0-9a-f]{4,}(?![a-z])|\d+"
GENERIC_PREFIX = (
    r"(?i)^(\*\\)?("
    r"c:\\users\\\*\\appdata\\(local|roaming|locallow)(\\temp)?|c:\\users\\\*|"
    r"c:\\windows\\microsoft\.net\\framework(64)?(\\\*)?|"
    r"c:\\windows(\\(system32|syswow64|temp))?|c:\\program files( \(x86\))?|c:\\programdata|"
    r"\\device\\[^\\]+|"
    r"hk(ey_)?(current_user|local_machine|lm|cu|users|cr|classes_root)(\\\*)?"
    r"(\\environment|\\software(\\classes\\local settings(\\muicache|\\software\\microsoft\\windows\\shell\\muicache)?|"
    r"\\microsoft\\windows\\currentversion|\\microsoft\\windows nt\\currentversion|\\wow6432node)?)?"
    r")"
)
GENERIC_TOKEN = r"(?i)%[a-z0-9_()]+%|(?<![a-z])(system32|syswow64|sysnative)(?![a-z])|@"
SAFE_ENDINGS = [
    "exe", "dll", "sys", "bat", "cmd", "com", "scr", "ps1", "vbs", "js", "tmp", "dat",
    "txt", "log", "ini", "lnk", "db", "xml", "json", "bin", "jpg", "png", "zip", "msi",
    "inf", "cpl", "ocx", "drv", "php", "html", "htm", "asp", "aspx", "jsp", "cgi", "url",
    "vbe", "wsf", "hta", "mui", "nls", "manifest",
]
MARKDOWN = {"\\": "&#92;", "[": "&#91;", "]": "&#93;", "(": "&#40;", ")": "&#41;", "!": "&#33;", "|": "&#124;", "`": "&#96;", "*": "&#42;", "_": "&#95;", "~": "&#126;"}
NORMAL_CHARS, LABEL_CHARS = 300, 60
CONTROL = r"[\x00-\x1f\x7f]"

# --- normalisation and paths


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(v: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def normalize(value: Column) -> Column:
    """Lower case, 300 characters, run-specific parts replaced: folders, GUIDs, SIDs, hexadecimal runs, numbers."""
    v = stripped(F.lower(F.coalesce(value, F.lit(""))))
    v = F.substring(F.regexp_replace(v, r'^"+|"+$', ""), 1, NORMAL_CHARS)
    known = v
    for pattern, name in ENVIRONMENT:
        known = F.regexp_replace(known, pattern, name)
    v = F.when(F.contains(v, F.lit("c:\\")) | F.contains(v, F.lit("hkey_")), known).otherwise(v)
    for pattern, name in ((GUID, "<guid>"), (SID, "<sid>"), (HEX_RUN, "<hex>"), (r"(?U)\d+", "#")):
        v = F.regexp_replace(v, pattern, name)
    return v


ROOT = r"^(?s)([\\/]{2}[^\\/]+[\\/][^\\/]+[\\/]?|[^\\/]:[\\/]?|[\\/](?![\\/]))"


def path_root(v: Column) -> Column:
    return F.regexp_extract(v, ROOT, 1)


def dirname(v: Column) -> Column:
    """Folder of a path with either slash; the root keeps its slash, other trailing slashes go."""
    root = path_root(v)
    tail = F.regexp_replace(v, ROOT, "")
    return F.concat(root, F.regexp_replace(F.regexp_extract(tail, r"(?s)^(.*)[\\/][^\\/]*$", 1), r"[\\/]+$", ""))


def basename(v: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(v, ROOT, ""), r"([^\\/]*)$", 1)


def extension(v: Column) -> Column:
    b = basename(v)
    return F.when(F.contains(b, F.lit(".")), F.substring_index(b, ".", -1)).otherwise(F.lit(""))


def command_image(cmd: Column) -> Column:
    """Base name of the executable of a command line; ``unknown`` where there is none."""
    c = F.coalesce(cmd, F.lit(""))
    named = F.regexp_extract(c, r'(?i)^\s*"?([^"]+?\.(?:exe|com|bat|cmd|scr|dll|ps1|vbs|js))"?(?:\s|$)', 1)
    first = F.substring_index(F.regexp_replace(stripped(c), r'^"+|"+$', ""), " ", 1)
    found = basename(F.regexp_replace(F.when(named != "", named).otherwise(first), r'^"+|"+$', ""))
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def image_of(cmd: Column, target: Column) -> Column:
    """Full image path of a command line: quoted, or up to an executable ending; else the target."""
    c = stripped(F.coalesce(cmd, F.lit("")))
    quoted = F.regexp_extract(c, r'(?s)^"([^"]+)"', 1)
    bare = F.regexp_extract(c, r"(?i)^(\S+?\.(exe|com|scr|bat|cmd))\b", 1)
    return F.when(quoted != "", quoted).when(bare != "", bare).otherwise(F.coalesce(target, F.lit("")))


# --- wildcard patterns


def tidy(v: Column) -> Column:
    return F.regexp_replace(v, r"\*{2,}", "*")


def without_identity(v: Column) -> Column:
    """User names, SIDs and GUIDs become ``*``."""
    v = F.regexp_replace(v, RULE_USER, "$1*")
    return F.regexp_replace(F.regexp_replace(v, RULE_SID, "*"), RULE_GUID, "*")


def without_numbers(v: Column) -> Column:
    return F.regexp_replace(v, RULE_NUMBER, "*")


def ladder(value: Column, kind: str) -> Column:
    """Patterns from specific to general, each once: ``kind`` is path, key or anything else."""
    return ladder_from(ladder_base(value), kind)


def ladder_base(value: Column) -> Column:
    """The first pattern of a ladder, of which all others are made: values of many users have one."""
    return tidy(without_identity(stripped(value)))


def ladder_from(base: Column, kind: str) -> Column:
    """``ladder`` of a value by its ``ladder_base``."""
    dotted = lambda v: let(extension(v), lambda x: F.when(x != "", F.concat(F.lit("."), x)).otherwise(F.lit("")))

    def beyond(v1: Column) -> Column:
        if kind in ("path", "image"):
            path = lambda d, b, x, up: F.array(F.when(d != "", tidy(F.concat(d, F.lit("\\*"), x))), F.when((d != "") & (up != ""), tidy(F.concat(up, F.lit("\\*\\"), b))), F.when((d != "") & (up != ""), tidy(F.concat(up, F.lit("\\*\\*"), x))))
            return let(dirname(v1), lambda d: let(dotted(v1), lambda x: let(dirname(d), lambda up: path(d, basename(v1), x, up))))
        if kind == "key":
            return let(F.regexp_extract(v1, r"(?s)^(.*)\\[^\\]*$", 1), lambda above: F.array(F.when(above != "", tidy(F.concat(above, F.lit("\\*"))))))
        return F.array().cast("array<string>")

    rungs = let(base, lambda v0: let(tidy(without_numbers(v0)), lambda v1: F.concat(F.array(v0, v1), beyond(v1))))
    return F.array_distinct(F.array_compact(rungs))


def literal_length(pattern: Column) -> Column:
    """Characters of a pattern that are specific: no wildcards, generic folders or variables."""
    p = F.regexp_replace(F.regexp_replace(pattern, GENERIC_PREFIX, ""), GENERIC_TOKEN, "")
    return F.length(F.translate(p, "*\\.", ""))


def like_pattern(pattern: Column) -> Column:
    """The pattern for ``ILIKE ... ESCAPE '!'``."""
    p = F.replace(F.replace(F.replace(pattern, F.lit("!"), F.lit("!!")), F.lit("%"), F.lit("!%")), F.lit("_"), F.lit("!_"))
    return F.replace(p, F.lit("*"), F.lit("%"))


# --- escaping


def sigma_value(pattern: Column) -> Column:
    """A wildcard pattern as a value of a detection rule: ``*`` stays a wildcard."""
    v = F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("?"), F.lit("\\?"))
    return F.regexp_replace(v, CONTROL, "?")


def sigma_literal(value: Column) -> Column:
    v = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("*"), F.lit("\\*"))
    return F.regexp_replace(F.replace(v, F.lit("?"), F.lit("\\?")), CONTROL, "?")


def yaml_quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.regexp_replace(value, CONTROL, " "), F.lit("'"), F.lit("''")), F.lit("'"))


def yara_string(value: Column) -> Column:
    """Body of a double-quoted byte string; bytes outside printable ASCII as two hexadecimal digits."""
    octets = F.regexp_extract_all(F.lower(F.hex(F.encode(value, "UTF-8"))), F.lit("(..)"), 1)

    def letter(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        plain = F.when(h == "5c", F.lit("\\\\")).when(h == "22", F.lit('\\"')).otherwise(F.chr(code))
        return F.when(code.between(32, 126), plain).otherwise(F.concat(F.lit("\\x"), h))

    return F.array_join(F.transform(octets, letter), "")


def hex_or(value: Column, digits: int, fallback: str = "") -> Column:
    v = F.lower(stripped(F.coalesce(value, F.lit(""))))
    return F.when(v.rlike("^[0-9a-f]{%d}$" % digits), v).otherwise(F.lit(fallback))


def defang(value: Column) -> Column:
    """URLs, hosts and addresses made harmless for readers; names of files stay."""
    v = F.regexp_replace(value, r"(?i)\bhttps://", "hxxps://")
    v = F.regexp_replace(v, r"(?i)\bhttp://", "hxxp://")
    v = F.regexp_replace(F.regexp_replace(v, r"(?i)\bftps://", "fxps://"), r"(?i)\bftp://", "fxp://")
    for scheme in ("wss", "ws", "file", "smb"):
        v = F.regexp_replace(v, rf"(?i)\b{scheme}://", f"{scheme}[:]//")
    v = F.regexp_replace(v, r"(?i)(?<![\w/:])//(?=(?:[\w-]+\.)+[\w-]+|\d{6,10}\b|0x[0-9a-f]{6,8}\b|\[)", "[//]")
    v = F.regexp_replace(v, r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w.])", "$1[.]$2[.]$3[.]$4")
    part = r"(?:0x[0-9a-f]{1,8}|0[0-7]{1,11}|\d{1,10})"
    odd = rf"(?i)(?<![\w.])(?=(?:{part}\.){{0,3}}(?:0x|0\d))({part})"
    for more in (3, 2, 1):
        groups = "".join(rf"\.({part})" for _ in range(more))
        v = F.regexp_replace(v, odd + groups + r"(?![\w.])", "$1" + "".join(f"[.]${i + 2}" for i in range(more)))
    safe = "|".join(SAFE_ENDINGS)
    return F.regexp_replace(v, rf"(?<=[A-Za-z0-9-])\.(?!(?i:{safe})(?![A-Za-z]))(?=[A-Za-z]{{2,24}}(?:[/:\s'\"`)\],;]|$))", "[.]")


def markdown_text(value: Column, defanged: bool = True) -> Column:
    """Untrusted text for a table cell: one line, no structure, no markup."""
    t = F.regexp_replace(value, CONTROL, " ")
    t = defang(t) if defanged else t
    t = F.replace(t, F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("#"), F.lit("&#35;"))  # before the entities that hold one
    for c, entity in (("<", "&lt;"), (">", "&gt;"), *MARKDOWN.items()):
        t = F.replace(t, F.lit(c), F.lit(entity))
    return F.replace(t, F.lit("--8&lt;--"), F.lit("-&#45;8&lt;--"))


def diagram_label(value: Column, n: int = LABEL_CHARS) -> Column:
    """A node label without quotes or brackets, shortened in the middle, addresses made harmless."""
    t = F.regexp_replace(value, CONTROL, " ")
    k = (n - 1) // 2
    t = F.when(F.length(t) > n, F.concat(F.substring(t, 1, k), F.lit("~"), F.right(t, F.lit(n - 1 - k)))).otherwise(t)
    return defang(F.translate(t, "\"<>[]{}|`#", "'()()()/'"))


# --- strings of files


def printable_strings(data: Column, limit: int | None = 2000) -> Column:
    """Printable runs of five characters and more of a binary column, the first ``limit`` or all."""
    runs = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(r"([\x20-\x7e]{5,})"), 1)
    return runs if limit is None else F.slice(runs, 1, limit)


URL = r"https?://[A-Za-z0-9_.\-/:%?=&]{4,200}"
ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"


def urls_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), 0)))


def addresses_in(text: Column) -> Column:
    valid = F.filter(F.regexp_extract_all(text, F.lit(ADDRESS), 0), lambda a: F.forall(F.split(a, r"\."), lambda p: p.cast("int") <= 255))
    return F.array_sort(F.array_distinct(valid))
