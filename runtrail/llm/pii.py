"""Personal data by candidate gradient boosting, all in DataFrame and SQL functions.

Generators with high recall propose spans that may overlap: the four base patterns (always kept), spelled-out addresses
("name at host dot org"), digit runs in any grouping (each as a card and as a phone number) and colon-separated addresses.
Boosted trees score each candidate by its format and by the words around it; a threshold per kind, calibrated on held-out
training candidates to a precision, selects; of overlapping selections the best scored stays, and none displaces a base span.

The trees are trained here on a bounded labelled table that SQL makes by rule (``TRAINING_ROWS`` snippets), with Spark's own
boosting, and become one SQL expression: scoring needs no shuffle, no join and no Python.

Offsets are code points of the original text, ends exclusive. Defined results: a null text is empty; texts without a match have
no spans (the digest is that of the empty string); adjacent and repeated values are separate spans; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import inspect
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and look-arounds only spare backtracking: they match what the plain forms match.
#: A card is a whole run of digits with single separators, so its length is checked at once.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "contains({t}, '@')", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9]'", "phone": "contains({t}, '+')"}
VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": "luhn_check(regexp_replace(x.v, '[ -]', ''))",
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) between 8 and 15",
}
#: What every text with a spelled-out address holds: an at, a name, a dot and a letter, in any of the pattern's forms.
SPELLED = r"{t} rlike '(?i)(?:[(\\[{{ ]at[)\\]}} ]|@) ?[a-z0-9-]{{1,63}} ?(?:[(\\[{{ ]dot[)\\]}} ]|[.]) ?[a-z0-9-]'"
#: Further generators: kinds proposed, pattern, what a text must hold. Each pattern implies its condition.
WIDER = [
    (("email",), r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[a-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[a-z0-9-]{1,63}){1,8}", SPELLED),
    # the same with no space about a plain dot, so that an address ends before the next sentence
    (("email",), r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[a-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?|\.)[a-z0-9-]{1,63}){1,8}", SPELLED),
    # brackets alone: a plain at before the address ("reach Ann at ann (at) host") does not take its name
    (("email",), r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?|\.)[a-z0-9-]{1,63}){1,8}", SPELLED),
    (("phone",), r"(?<![A-Za-z0-9.,+/-])0[0-9]{1,5}\x20?[/-]\x20?[0-9]{3,10}(?:[\x20-][0-9]{1,4})?(?![A-Za-z0-9/])", "{t} rlike '0[0-9]{{1,5}} ?[/-] ?[0-9]{{3}}'"),
    (("card", "phone"), r"(?<![A-Za-z0-9.,+])\(?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6,18}+(?![A-Za-z0-9])", "{t} rlike '[0-9][ ()./-]*[0-9][ ()./-]*[0-9][ ()./-]*[0-9][ ()./-]*[0-9][ ()./-]*[0-9][ ()./-]*[0-9]'"),
    (("card",), r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4}(?![\x20-]?[0-9])|[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])", "{t} rlike '[0-9]{{13}}|[0-9]{{4}}[ -][0-9]{{4}}'"),
    (("phone",), r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|(?<![0-9][\x20-])[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])", "{t} rlike '[0-9]{{3}}[ .-][0-9]{{4}}'"),
    (("ip",), r"(?i)(?<![0-9a-z:.])(?:(?:[0-9a-f]{1,4}+:){2,7}+:?|[0-9a-f]{0,4}+::)(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?(?![0-9a-z:])", "contains({t}, ':')"),
]
#: Elements to a block of the running sums and comparisons; characters to a block of the text that is put together anew.
BLOCK, TEXT_BLOCKS = 64, (1 << 16, 512)
BEFORE, AFTER = 24, 8
TRAINING_ROWS = 8000
PRECISION = 0.98


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def by_blocks(array: str, size: int, body) -> str:
    """SQL that cuts an array into blocks, maps each by ``body`` (of the block and its number) to an array and joins these."""
    return f"flatten(transform(sequence(0, (size({array}) - 1) div {size}), b{size} -> {let(f'k{size}', f'slice({array}, b{size} * {size} + 1, {size})', body(f'k{size}', f'b{size}'))}))"


def running_sums(n: str) -> str:
    """SQL for the running sums of an array of numbers: those of blocks first, then within each block."""
    total = lambda a: f"aggregate({a}, 0, (acc, z) -> acc + z)"
    sums = f"transform(sequence(0, (size({n}) - 1) div {BLOCK}), b -> {total(f'slice({n}, b * {BLOCK} + 1, {BLOCK})')})"
    each = by_blocks(n, BLOCK, lambda k, b: let("base", total(f"slice(blocks, 1, {b})"), f"transform({k}, (y, i) -> base + {total(f'slice({k}, 1, i + 1)')})"))
    return let("blocks", sums, each)


def found_spans(t: str, pattern: str, needs: str, around: bool = False) -> str:
    """SQL for the matches of ``pattern`` as structs (s, e, v) and, if wanted, what stands before and after (pre, post).

    split gives the gaps that belong to the matches; the ends are running sums of gap and match. What stands around a match comes
    from its gaps and neighbours, never from the whole text, so the work grows with the text and its matches, not their product.
    """
    p = quoted(pattern)
    extra = f", 'pre', right(concat(coalesce(get(w.m, i - 1), ''), get(w.g, i)), {BEFORE}), 'post', left(concat(get(w.g, i + 1), coalesce(get(w.m, i + 1), '')), {AFTER})" if around else ""
    spans = f"transform(w.m, (x, i) -> named_struct('s', get(ends, i) - length(x), 'e', get(ends, i), 'v', x{extra}))"
    lengths = "transform(w.m, (x, i) -> length(x) + length(get(w.g, i)))"
    spans = let("w", f"named_struct('m', regexp_extract_all({t}, {p}, 0), 'g', split({t}, {p}, -1))", let("n", lengths, let("ends", running_sums("n"), spans)))
    more = "pre:string,post:string" if around else ""
    return f"case when {needs.format(t=t)} then {spans} else cast(array() as array<struct<s:int,e:int,v:string{',' + more if more else ''}>>) end"


def kept_near(items: str, others: str, condition: str) -> str:
    """SQL for the elements x of ``items`` (sorted by s) for which no y of ``others`` that overlaps x meets ``condition``.

    Blocks of blocks: each is compared only with what reaches into it, so long texts full of candidates are no square.
    """
    reach = lambda k, among: let("lim", f"named_struct('lo', array_min(transform({k}, x -> x.s)), 'hi', array_max(transform({k}, x -> x.e)))", f"filter({among}, y -> y.s < lim.hi and lim.lo < y.e)")
    inner = lambda k, _: let("near", reach(k, "wide"), f"filter({k}, x -> not exists(near, y -> y.s < x.e and x.s < y.e and {condition}))")
    return by_blocks(items, 4096, lambda k, _: let("wide", reach(k, others), by_blocks(k, BLOCK, inner)))


def with_base(rows: DataFrame, t: str) -> DataFrame:
    """Add one array of valid base spans per kind: base_email, base_ip, base_card, base_phone."""
    rows = rows.withColumns({f"raw_{k}": F.expr(found_spans(t, BASE[k], NEEDS[k])) for k in KINDS})
    return rows.withColumns({f"base_{k}": F.expr(f"filter(raw_{k}, x -> {VALID[k]})") for k in KINDS}).drop(*[f"raw_{k}" for k in KINDS])


#: Features of a candidate x (kind k, s, e, v, pre, post); d is its digits, all lower case in lo, lp.
FEATURES = [
    "int(x.k = 'email')", "int(x.k = 'ip')", "int(x.k = 'card')", "int(x.k = 'phone')",
    "length(x.d)", "length(x.v)", "length(regexp_replace(x.v, '[^A-Za-z]', ''))", "length(regexp_replace(x.v, '[A-Za-z0-9]', ''))",
    "int(length(x.d) > 1 and luhn_check(x.d))", "int(contains(x.v, '('))", "int(contains(x.v, '@'))",
    "int(lower(x.v) rlike '[(\\\\[{ ]at[)\\\\]} ]')", "int(lower(x.v) rlike '[(\\\\[{ ]dot[)\\\\]} ]')",
    "size(regexp_extract_all(x.v, '[0-9]+', 0))", "coalesce(array_max(transform(regexp_extract_all(x.v, '[0-9]+', 0), g -> length(g))), 0)",
    "coalesce(length(try_element_at(regexp_extract_all(x.v, '[0-9]+', 0), -1)), 0)",
    "int(lower(x.pre) rlike '(mail|contact|write|reach|send|address)')", "int(lower(x.pre) rlike '(tel|phone|call|mobile|fax|cell|dial|sms|whatsapp)')",
    "int(lower(x.pre) rlike '(card|visa|master|amex|credit|debit|payment)')", "int(lower(x.pre) rlike '(\\\\bip\\\\b|ipv6|host|addr|server|client|login|ping)')",
    "int(lower(x.pre) rlike '(order|invoice|isbn|issn|\\\\bid\\\\b|serial|version|\\\\bno\\\\b|ref|total|sku|page|date|time|token|hash|build|part)')",
    "int(x.v rlike '^(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|^[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)[0-9]{2}')",
    "int(x.pre rlike '[A-Za-z0-9]$')", "int(x.post rlike '^[A-Za-z0-9]')", "int(x.pre rlike '[-_#$=/:,.]$')", "int(x.post rlike '^[%,.:/][0-9]')",
    "size(regexp_extract_all(x.v, ':', 0))", "int(contains(x.v, '::'))", "int(lower(x.v) rlike '(com|org|net|edu|gov|io|de|fr|es|uk)$')", "int(x.v rlike '[.][0-9]{1,2}$')",
    "int(startswith(x.v, '+'))", "int(x.pre rlike '[+(]$')", "int(x.pre rlike '[0-9][ -]$')", "int(x.post rlike '^[ -]?[0-9]')",
    "length(regexp_replace(x.v, '[^(]', '')) - length(regexp_replace(x.v, '[^)]', ''))", "length(regexp_replace(x.v, '[^.]', ''))",
    "int(x.d rlike '^(4|5[1-5]|2[2-7]|3[047]|3[689]|6[045])')", "int(x.pre rlike '(^|[^0-9])[0-9]{13,19} $')", "int(x.post rlike '^ [0-9]{7}$')", "int(x.v rlike '^[0-9]{13,19}$')", "int(x.v rlike '^0[1-9]')", "length(regexp_extract(x.v, '^[(]?([0-9]+)', 1))", "int(x.v rlike '^(19|20)[0-9]{2}[ /-](19|20)?[0-9]{2}$')",
    "int(contains(x.v, '. '))", "int(contains(x.v, '/'))", "int(lower(x.v) rlike '[.](com|org|net|edu|gov|io|de|fr|es|uk)$')",
]


def with_candidates(rows: DataFrame, t: str) -> DataFrame:
    """Add ``candidates``: what the wider generators propose, each span once for every kind it could be, with its features f."""
    rows = rows.withColumns({f"wide_{i}": F.expr(found_spans(t, pattern, needs, True)) for i, (_, pattern, needs) in enumerate(WIDER)})
    proposed = [f"transform(wide_{i}, x -> named_struct('s', x.s, 'e', x.e, 'k', '{k}', 'v', x.v, 'd', regexp_replace(x.v, '[^0-9]', ''), 'pre', x.pre, 'post', x.post))" for i, (kinds, _, _) in enumerate(WIDER) for k in kinds]
    # in order of their place; generators may propose the same span twice, and then the first in order stays
    rows = rows.withColumn("sorted", F.expr(f"array_sort(concat({', '.join(proposed)}))")).drop(*[f"wide_{i}" for i in range(len(WIDER))])
    rows = rows.withColumn("proposed", F.expr("filter(sorted, (x, i) -> i = 0 or x.s <> get(sorted, i - 1).s or x.e <> get(sorted, i - 1).e or x.k <> get(sorted, i - 1).k)")).drop("sorted")
    features = ", ".join(f"double({f})" for f in FEATURES)
    return rows.withColumn("candidates", F.expr(f"transform(proposed, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'f', array({features})))")).drop("proposed")


def snippets(spark: SparkSession, n: int = TRAINING_ROWS) -> DataFrame:
    """The labelled training table: n snippets by rule, each with one item of a known kind or of none, and its place."""
    draw = lambda k, m: f"pmod(xxhash64(id, {k}), {m})"
    digits = lambda k, n: f"lpad(cast({draw(k, 10**n)} as string), {n}, '{k % 10}')"
    either = lambda a, b: f"case when {draw(30, 2)} = 0 then {a} else {b} end"
    pick = lambda k, *words: f"element_at(array({', '.join(repr(w) for w in words)}), cast({draw(k, len(words))} + 1 as int))"
    syllable = lambda k: pick(k, "an", "mar", "lo", "ker", "ti", "son", "be", "ru", "gar", "vel", "ino", "sta", "ch", "mu", "pe")
    name = f"concat({either(pick(1, 'ann', 'j.smith', 'marie', 'lopez', 'kurt', 'info', 'sales'), f'concat({syllable(31)}, {syllable(32)})')}, {pick(2, '', '.b', '_x', '77', '.doe', '')})"
    host = either(pick(3, "example", "mail7", "uni-bonn", "corp", "post2"), f"concat({syllable(33)}, {syllable(34)}, {pick(35, '', '-', '')}, {syllable(36)})")
    tld = pick(4, "com", "org", "net", "de", "fr", "es", "io")
    body = f"concat({pick(5, '4', '5', '37', '6011')}, {digits(6, 11)})"
    # the last digit makes the Luhn sum a multiple of ten
    luhn = lambda b: f"concat({b}, try_element_at(filter(array('0','1','2','3','4','5','6','7','8','9'), c -> luhn_check(concat({b}, c))), 1))"
    unlike = lambda b: f"concat({b}, translate(right({luhn(b)}, 1), '0123456789', '1234567890'))"  # noqa: E731  (no card)
    short_card = luhn(f"concat({pick(5, '34', '37')}, {digits(6, 12)})")
    diners = luhn(f"rpad(concat({pick(5, '300', '305', '36', '38')}, {digits(6, 11)}), 13, '0')")
    items = [
        ("email", either(f"concat({name}, {pick(7, ' at ', ' (at) ', '(at)', ' [at] ', ' @ ')}, {host}, {pick(8, ' dot ', ' (dot) ', '(dot)', ' [dot] ')}, {tld})", f"concat({name}, {pick(7, ' (at) ', '(at)', ' [at] ', '{at}', ' @ ', ' at ')}, {host}, '.', {tld})"), ("", "mail:", "contact", "write to", "reach me:")),
        ("email", f"concat({name}, {pick(7, ' (at) ', '(at)', ' [at] ', '[at]', '{at}', ' {at} ')}, {host}, {pick(8, '.', '.', ' dot ', ' (dot) ', '(dot)', ' [dot] ')}, {tld})", ("", "", "mail", "write to", "reach me", "questions", "it is")),
        ("email", f"concat({name}, {pick(7, ' at ', ' @ ')}, {host}, {pick(8, '.', ' dot ', ' dot ')}, {tld})", ("", "mail", "write to", "contact", "is")),
        ("email", f"concat({name}, {pick(7, ' (at) ', '[at]', '{at}')}, {host}, {pick(8, '(dot)', ' [dot] ', '{dot}')}, 'co', {pick(8, '(dot)', ' [dot] ', '{dot}')}, {tld})", ("", "mail", "send to")),
        ("phone", f"concat('(', {digits(9, 3)}, ') ', {digits(10, 3)}, '-', {digits(11, 4)})", ("", "tel", "phone:", "call", "fax", "mobile")),
        ("phone", either(f"concat({digits(9, 3)}, {pick(12, '-', '.', ' ')}, {digits(10, 3)}, {pick(12, '-', '.', ' ')}, {digits(11, 4)})", f"concat('0', {digits(9, 2)}, '/', {digits(10, 3)}, {digits(11, 3)}, {pick(12, '', '7', '42')})"), ("tel", "phone:", "call", "fax", "mobile", "dial", "cell:")),
        ("phone", f"concat('00', {digits(9, 2)}, ' ', {digits(10, 3)}, ' ', {digits(11, 4)}, {digits(13, 2)})", ("tel.", "phone", "call me", "sms")),
        ("phone", f"concat('0', {digits(9, 3)}, {pick(12, ' / ', '/', '-', ' - ')}, {digits(10, 4)}, {pick(13, '', '3', '12', '847')})", ("", "tel", "phone:", "call", "fax", "telefon", "mobil")),
        ("phone", f"concat('00', {digits(9, 2)}, {pick(12, ' ', '-')}, {digits(10, 3)}, {pick(12, ' ', '-')}, {digits(11, 3)}, {pick(12, ' ', '-')}, {digits(13, 3)})", ("", "tel.", "phone", "call me", "movil")),
        ("card", either(diners, f"regexp_replace({diners}, '^(....)(......)(....)$', {pick(12, "$1 $2 $3", "$1-$2-$3")})"), ("", "card", "diners", "diners club:", "payment", "credit card")),
        ("ip", either(f"concat('fe80::', lower(hex({draw(14, 4096)})))", f"concat('2001:db8::', lower(hex({draw(15, 65536)})))"), ("", "ip", "host", "server", "gateway", "ping")),
        ("phone", either(f"concat('0', {digits(9, 2)}, {pick(12, '/', '-', '/ ', ' ')}, {digits(10, 4)}, {digits(11, 1)}, {pick(13, '-1', '-34', '-20', '-114')})", f"concat('0', {digits(9, 2)}, '-', {digits(10, 4)}, {digits(11, 3)})"), ("", "fax", "tel", "praxis", "buero")),
        ("phone", f"concat({draw(9, 8)} + 2, {digits(10, 2)}, ' ', {digits(11, 3)}, ' ', {digits(13, 4)})", ("", "number is", "call", "at home", "dial", "phone")),
        ("ip", f"concat_ws(':', '2001', lower(hex({draw(14, 65536)})), '0000', '0000', '0000', lower(hex({draw(15, 65536)})), '0042', lower(hex({draw(16, 65536)})))", ("", "ip", "host", "server", "log", "client")),
        ("phone", f"concat({pick(9, '0044', '0049', '00 44', '00 33')}, ' ', {digits(10, 2)}, ' ', {digits(11, 4)}, ' ', {digits(13, 4)})", ("", "mobile", "tel:", "call", "phone")),
        ("", f"concat({draw(9, 900)} + 1, ' ', {pick(10, '500', '250', '000', '750')}, ' 000')", ("", "sum of", "total", "about", "budget")),
        ("", f"concat({pick(9, '19', '20')}, {digits(10, 2)}, {pick(12, '/', '-', ' / ')}, {pick(13, '19', '20', '')}, {digits(11, 2)})", ("", "season", "year", "winter", "vol", "from")),
        ("", f"concat({digits(9, 2)}, '.', {digits(10, 4)}, {pick(12, ' ', ', ')}, {digits(11, 2)}, '.', {digits(13, 4)})", ("", "at", "coordinates", "gps", "values")),
        ("", f"concat({digits(9, 2)}, {pick(12, '/', '-', ' / ')}, {digits(10, 4)})", ("", "page", "no", "file", "ref", "year", "season")),
        ("", f"concat({digits(9, 3)}, {digits(10, 5)}, {digits(11, 6)})", ("", "order", "token", "serial", "id", "ref")),
        ("card", short_card, ("", "card", "amex", "credit card:", "payment")),
        ("card", f"regexp_replace({short_card}, '^(....)(......)(.....)$', '$1 $2 $3')", ("", "card", "amex:", "debit")),
        ("card", luhn(f"concat({pick(5, '4', '4', '5')}, {digits(6, 11)}, {digits(13, 3)})"), ("", "card", "visa", "+1 (212) 555-0147", "call", "555-3296"), ("", "", " 4929142748216203", " 12", " 4465758382889437")),
        ("card", luhn(f"concat({pick(5, '4', '4', '5')}, {digits(6, 11)}, {digits(13, 3)})"), ("4929142748216203", "in 4929142748216203", "5312111122223333", "4465758382889437"), ("", "", " 5312111122223333")),
        ("card", luhn(f"concat({pick(5, '4', '4', '5')}, {digits(6, 11)}, {digits(13, 3)})"), ("in", "4465758382889437", "4929142748216203", "over"), (" 4929142748216203", " 5312111122223333", " 4465758382889437", "")),
        ("card", luhn(f"concat({pick(5, '4', '4', '5')}, {digits(6, 11)}, {digits(13, 3)})"), ("in", "the", "4929142748216203", "over 4465758382889437"), (" 4929142748216203", " 5312111122223333", "", "")),
        ("card", f"regexp_replace({luhn(f"concat({pick(5, '4', '5')}, {digits(6, 11)}, {digits(13, 3)})")}, '^(....)(....)(....)(....)$', '{"$1-$2-$3-$4"}')", ("", "card", "visa", "12")),
        ("phone", f"concat('+', {pick(5, '1', '1', '33', '49')}, ' (', {digits(9, 3)}, ') ', {digits(10, 3)}, '-', {digits(11, 4)})", ("", "", "", "tel", "phone:", "call"), (" 4929142748216203", " 12", " 77 1", " 5312 1111 2222 3333", "")),
        ("phone", f"concat('+', {pick(5, '1', '1', '33', '49')}, ' (', {digits(9, 3)}, ') ', {digits(10, 3)}, '-', {digits(11, 4)})", ("", "", "over", "then"), (" 4929142748216203", " 12", " 77 1", " 5312 1111 2222 3333", "")),
        ("", unlike(f"concat({pick(5, '4', '9', '1')}, {digits(6, 11)}, {digits(13, 3)})"), ("", "order", "token", "build", "serial", "ref")),
        ("ip", f"concat('2001:db8:', lower(hex({draw(14, 65536)})), '::', lower(hex({draw(15, 65536)})))", ("", "ip", "host", "server", "ipv6:")),
        ("ip", f"concat('fe80:', lower(hex({draw(14, 65536)})), ':', lower(hex({draw(15, 65536)})), ':0:1:', lower(hex({draw(16, 65536)})), ':a:b')", ("", "ip", "client", "addr")),
        ("", f"concat(20, {digits(9, 2)}, '-0', {draw(10, 9)}, '-1', {draw(11, 9)}, {pick(12, '', ' 12', ' 10:30', 'T08:15:00')})", ("", "date", "on", "time", "published")),
        ("", f"concat({digits(9, 2)}, ':', {digits(10, 2)}, ':', {digits(11, 2)})", ("", "time", "at", "length", "host")),
        ("", f"{digits(9, 9)}", ("", "order", "invoice", "id", "ref", "serial", "total", "call", "card")),
        ("", f"concat({digits(9, 9)}, {digits(10, 5)})", ("", "order", "token", "build", "part", "card", "tel")),
        ("", f"concat('978-', {draw(9, 9)}, '-', {digits(10, 3)}, '-', {digits(11, 5)}, '-', {draw(12, 9)})", ("", "isbn", "order", "ref")),
        ("", f"concat({digits(9, 3)}, {digits(10, 4)}, '.', {digits(11, 2)})", ("", "total", "sum", "page", "phone")),
        ("", either(f"concat({digits(9, 4)}, ' ', {digits(10, 4)}, ' ', {digits(11, 4)})", f"concat({digits(9, 2)}, '/', {digits(10, 2)}, '/20', {digits(11, 2)})"), ("", "page", "sku", "numbers", "ref")),
        ("", f"concat({digits(9, 3)}, '.', {digits(10, 3)}, '.', {digits(11, 3)}, '.', {digits(12, 3)}, '.', {digits(13, 3)})", ("", "version", "build", "total")),
        ("", either(f"concat({pick(1, 'look', 'meet', 'stay', 'arrive')}, ' at ', {pick(2, 'the', 'this', 'that')}, {pick(3, '.', ' dot ', '. ', '. ')}, {pick(4, 'and', 'then', 'pattern', 'matrix')})", f"concat({pick(1, 'was', 'look', 'erone', 'inthe')}, ' at ', {pick(2, 'home', 'theat', '10', 'this')}, {pick(3, '. ', '. ', '.')}, {pick(4, 'The', 'Pages', 'Des', '30')})"), ("", "please", "we", "they")),
    ]
    case = lambda at: "case cast(%s as int) %s end" % (draw(0, len(items)), " ".join(f"when {i} then {at(i)}" for i in range(len(items))))
    filler = lambda k: pick(k, "the report of", "und die", "que la", "was seen", "over and", "ending erst", "pour le", "than, it")
    rows = spark.range(n).select(
        "id",
        F.expr(case(lambda i: items[i][1])).alias("item"),
        F.expr(case(lambda i: f"'{items[i][0]}'")).alias("truth"),
        F.expr(f"concat({filler(20)}, ' ', {case(lambda i: pick(21, *items[i][2]))}, ' ')").alias("left"),
        F.expr(f"concat({case(lambda i: pick(24, *items[i][3]) if len(items[i]) > 3 else repr(''))}, {pick(22, ' ', '. ', ', ', ' ')}, {filler(23)})").alias("right"),
    )
    return rows.withColumns({"text": F.concat("left", "item", "right"), "at": F.length("left"), "until": F.length("left") + F.length("item")})


class Booster:
    """Boosted trees as SQL over the feature array ``x.f``, and a threshold for each kind."""

    def __init__(self, margin: str, thresholds: dict[str, float]):
        self.margin, self.thresholds = margin, thresholds

    def probability(self) -> str:
        return f"1 / (1 + exp(-2 * ({self.margin})))"

    def selected(self) -> str:
        bar = " ".join(f"when '{k}' then {self.thresholds[k]!r}D" for k in KINDS)
        return f"filter(transform(candidates, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'p', {self.probability()})), x -> x.p >= case x.k {bar} end)"


def tree_sql(node) -> str:
    """One tree of the fitted model as nested CASE."""
    if node.subtreeDepth() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"case when x.f[{split.featureIndex()}] <= {float(split.threshold())!r}D then {tree_sql(node.leftChild())} else {tree_sql(node.rightChild())} end"


_FITTED: dict[tuple, Booster] = {}


def fit(spark: SparkSession, rows: int = TRAINING_ROWS, trees: int = 16, depth: int = 5, precision: float = PRECISION) -> Booster:
    """The boosted trees of the snippets. They depend on the parameters and the rules here alone, so they are trained once and kept
    in the shared folder under a digest of both; an application reads them once."""
    rules = repr((rows, trees, depth, precision, BASE, WIDER, FEATURES)) + inspect.getsource(snippets) + inspect.getsource(train)
    digest = hashlib.sha256(rules.encode()).hexdigest()[:24]
    key = (spark.sparkContext.applicationId, digest)
    if key not in _FITTED:
        path = f"{shared_dir(spark)}/pii-trees-{digest}"
        try:
            kept = spark.read.schema("margin string, thresholds map<string,double>").json(path).first()
        except AnalysisException:  # none kept yet
            kept = None
        if kept is None:
            made = train(spark, rows, trees, depth, precision)
            bars = F.create_map(*[F.lit(x) for pair in made.thresholds.items() for x in pair])
            spark.range(1).select(F.lit(made.margin).alias("margin"), bars.alias("thresholds")).coalesce(1).write.mode("overwrite").json(path)
            _FITTED[key] = made
        else:
            _FITTED[key] = Booster(kept["margin"], kept["thresholds"])
    return _FITTED[key]


def train(spark: SparkSession, rows: int, trees: int, depth: int, precision: float) -> Booster:
    """Train on two thirds of the snippets, calibrate the thresholds on the rest."""
    table = snippets(spark, rows).persist()  # else its rules are worked out again wherever the text is named
    table.count()
    made = with_candidates(table, "text").select("id", "truth", "at", "until", F.explode("candidates").alias("c"))
    # a whole card number beside the item is one too, though it is not the item: it teaches neither way
    beside = (F.col("c.k") == "card") & (F.get("c.f", F.lit(4)) == 16) & (F.get("c.f", F.lit(8)) == 1) & ((F.col("c.e") <= F.col("at")) | (F.col("c.s") >= F.col("until")))
    made = made.where(~beside)
    right = (F.col("c.k") == F.col("truth")) & (F.col("c.s") == F.col("at")) & (F.col("c.e") == F.col("until"))
    made = cached = made.select("id", "c.k", F.col("c.f").alias("f"), right.cast("double").alias("label"), array_to_vector("c.f").alias("features")).persist()
    try:
        made.count()  # in parallel; the boosting then reads few partitions
        made = made.coalesce(2)
        held = F.pmod(F.xxhash64("id", F.lit(77)), F.lit(3)) == 0
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.5, seed=5, cacheNodeIds=False, maxMemoryInMB=256).fit(made.where(~held))
        weights = list(model.treeWeights)
        jvm_trees = model._java_obj.trees()
        margin = " + ".join(f"{float(w)!r}D * ({tree_sql(jvm_trees[i].rootNode())})" for i, w in enumerate(weights))
        scored = made.where(held).withColumn("x", F.struct("f")).withColumn("p", F.expr(f"1 / (1 + exp(-2 * ({margin})))"))
        # of each kind, the least score from which on held-out candidates keep the precision
        rows_ = scored.groupBy("k", "p").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
        thresholds = {}
        for kind in KINDS:
            bar, n, good = 1.1, 0, 0.0
            for r in sorted((r for r in rows_ if r["k"] == kind), key=lambda r: -r["p"]):
                n, good = n + r["n"], good + r["good"]
                if good >= precision * n:
                    bar = r["p"]
            thresholds[kind] = max(bar, 0.5)
    finally:
        cached.unpersist()
        table.unpersist()
    return Booster(margin, thresholds)


ORDER = "case k " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"


def with_spans(docs: DataFrame, booster: Booster, text_col: str = "text") -> DataFrame:
    """Add ``base_<kind>`` and ``pii_spans``: array of (o, k, s, e), base and selected spans by kind, then start."""
    rows = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    rows = with_candidates(with_base(rows, "__t"), "__t")
    base = reduce(lambda a, b: f"{a}, {b}", (f"transform(base_{k}, x -> named_struct('o', {i}, 'k', '{k}', 's', x.s, 'e', x.e))" for i, k in enumerate(KINDS)))
    rows = rows.withColumns({"__base": F.expr(f"concat({base})"), "__chosen": F.expr(f"case when size(candidates) > 0 then {booster.selected()} else cast(array() as array<struct<k:string,s:int,e:int,p:double>>) end")})
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    best = "(y.p > x.p or (y.p = x.p and (y.e - y.s > x.e - x.s or (y.e - y.s = x.e - x.s and (y.s < x.s or (y.s = x.s and y.k < x.k))))))"
    rows = rows.withColumn("__chosen", F.expr(f"case when size(__chosen) = 0 then __chosen else {kept_near('__chosen', '__base', 'true')} end"))
    rows = rows.withColumn("__chosen", F.expr(f"case when size(__chosen) < 2 then __chosen else {kept_near('__chosen', '__chosen', best)} end"))
    added = f"transform(__chosen, x -> named_struct('o', case x.k {order} end, 'k', x.k, 's', x.s, 'e', x.e))"
    return rows.withColumn("pii_spans", F.expr(f"array_sort(concat(__base, {added}))")).drop("__base", "__chosen", "candidates")


def between(a: str, b: str) -> str:
    """SQL for the characters from ``a`` to ``b`` of the text whose blocks are in ``__blocks``."""
    n = TEXT_BLOCKS[1]
    block = lambda i: f"coalesce(get(__blocks, int({i} div {n})), '')"
    within = f"substring({block(a)}, {a} % {n} + 1, {b} - {a})"
    across = f"concat(substring({block(a)}, {a} % {n} + 1), array_join(slice(__blocks, int({a} div {n}) + 2, int({b} div {n}) - int({a} div {n}) - 1), ''), substring({block(b)}, 1, {b} % {n}))"
    return f"case when {a} >= {b} then '' when {a} div {n} = {b} div {n} then {within} else {across} end"


def redacted(docs: DataFrame, booster: Booster | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with each run of overlapping spans replaced by the kind of its first, as in [EMAIL]; null texts stay null.

    ``length_col``, where there is one, becomes the length of the new text. Other columns pass unchanged.
    """
    booster = booster or fit(docs.sparkSession)
    own = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    rows = with_spans(inner, booster, f"c{own.index(text_col)}")
    text = f"c{own.index(text_col)}"
    rows = rows.withColumn("__sorted", F.expr("transform(array_sort(transform(pii_spans, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k))), (x, i) -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'i', i))"))
    # a run begins where no earlier span reaches in; it ends with the span of its members that reaches farthest
    rows = rows.withColumn("__first", F.expr(f"case when size(__sorted) > 0 then transform({kept_near('__sorted', '__sorted', 'y.i < x.i')}, x -> x.i) end"))
    ends = "array_max(transform(slice(__sorted, i + 1, coalesce(get(__first, j + 1), size(__sorted)) - i), x -> x.e))"
    rows = rows.withColumn("__runs", F.expr(f"transform(__first, (i, j) -> named_struct('s', get(__sorted, i).s, 'e', {ends}, 'k', get(__sorted, i).k))"))
    cut = lambda t, size: f"transform(sequence(0, greatest(length({t}) - 1, 0) div {size}), b{size} -> substring({t}, b{size} * {size} + 1, {size}))"
    rows = rows.withColumn("__blocks", F.expr(f"case when size(__sorted) > 0 then flatten(transform({cut('__t', TEXT_BLOCKS[0])}, t -> {cut('t', TEXT_BLOCKS[1])})) end"))
    parts = f"transform(__runs, (x, i) -> concat({between('coalesce(get(__runs, i - 1).e, 0)', 'x.s')}, '[', upper(x.k), ']'))"
    rows = rows.withColumn("__new", F.expr(f"case when size(__sorted) > 0 then concat(array_join({parts}, ''), {between('element_at(__runs, -1).e', 'length(__t)')}) else {text} end"))
    made = {text_col: F.col("__new")} | ({length_col: F.length("__new").cast(docs.schema[length_col].dataType)} if length_col in own else {})
    return rows.select(*[made.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(own)])


def pii_digest(rows: DataFrame) -> DataFrame:
    joined = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.k, x.s, x.e)), ',')")
    base = "concat(" + ", ".join(f"transform(base_{k}, x -> named_struct('k', '{k}', 's', x.s, 'e', x.e))" for k in KINDS) + ")"
    return rows.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
