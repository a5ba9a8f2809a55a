"""Main text of web pages: page structure first, then repeated runs of a host by suffix arrays.

A tolerant scanner cuts a page into blocks. Structure settles what it can: scripts, styles, menus, page headers, footers, sidebars,
forms, notices, adverts and comments (by element, role, or a word of class or id) are boilerplate; blocks within an article stand.
What structure leaves open (pages or parts of pages without an article element) is settled by the host's suffix arrays: the token
streams of a host's pages (open blocks and boilerplate, not articles) are laid end to end, suffixes are sorted to a depth of
``min_tokens`` by prefix doubling, and equal neighbours are runs that repeat. Distinct pages are dealt by host; arrays of one host
are merged by adding, for every run, the pages that hold it, in one shuffle with partial sums. A run that at least ``min_pages`` distinct pages
and ``min_share`` of the host's distinct pages hold is boilerplate: covered tokens go, unique runs stay in place. Pages of equal
blocks count as one page, so copies of a page do not remove each other. Text within articles stays however often it repeats.

Blocks: character references are decoded, white space (any of Unicode) becomes one space, a line break in a block is a space, cells
of a table row are one block; blocks are joined by a line feed. Defined results: null, empty and textless pages have an empty text;
unclosed elements end with their parent, an unclosed comment or script takes the rest; a page without a usable URL has the empty
host. Repeated rows are rows of their own. Outputs replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spans_of, staged
from .urls import url_parts

MIN_TOKENS, MIN_PAGES, MIN_SHARE = 8, 3, 0.1
SLAB_BYTES = 1 << 21
#: Tasks that a host is dealt over, tokens of one suffix array.
HOST_PARTS, ARRAY_TOKENS = 64, 1 << 20

# --- fixed values: elements by what they do to text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: No text of a page in any place.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select button textarea datalist form menu dialog nav footer aside noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody tfoot thead tr ul".split()
)
#: An opening element ends an open one of the same kind, up to the element that bounds it.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table td th article section div body main nav aside footer header form blockquote".split())
CELLS = frozenset(("td", "th"))
#: Words of class, id and role that mark a part of a page: about its layout, and about what others put there.
LAYOUT = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar toolbar widget contentinfo complementary search pagination pager banner".split())
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments disqus respond replies hidden invisible".split()
)
#: Whole class names and ids of a text's container, where a page has neither an article nor a main element.
CONTAINER = frozenset("content main main-content article article-body article-content post post-body post-content entry entry-content story story-body".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
MARKS = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SWITCH = re.compile(r"^(?:has|no|with|without|is|js|not)[-_]", re.I)

CHROME, OUTSIDE, MAIN, ARTICLE = 0, 1, 2, 3
KEPT, DROP_LAYOUT, DROP_ALL = 0, 1, 2


def marked(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    """(drop, is a container) of an element by its name and its class, id, role and visibility; ``inside`` is its parent's place."""
    if tag == "header":
        drop = DROP_LAYOUT if inside < MAIN else KEPT
    else:
        drop = KEPT if tag not in SILENT else DROP_LAYOUT if tag in ("nav", "footer", "aside", "menu", "form") else DROP_ALL
    container = tag in ("article", "main")
    if not attributes or tag in ("html", "body"):
        return drop, container
    for found in MARKS.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return DROP_ALL, False
        if name not in ("class", "id", "role"):
            continue
        for whole in value.split():
            if SWITCH.match(whole):
                continue
            if whole.lower() in CONTAINER or (name == "role" and whole == "main"):
                container = True
                continue
            words = {w.lower() for w in WORDS.findall(whole)}
            if words & FOREIGN:
                drop = DROP_ALL
            elif words & LAYOUT and tag not in ("article", "main") and not (inside >= MAIN and words & LAYOUT <= {"header"}):
                drop = max(drop, DROP_LAYOUT)
    return drop, container


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(place, text) of all blocks in page order; CHROME blocks are boilerplate by structure, invisible text is left out."""
    found: list[tuple[int, str]] = []
    if not html:
        return found
    named = re.search(r"<(?:article|main)[\s>]", html, re.I) is not None
    parts: list[str] = []
    stack: list[tuple[str, int, int, bool]] = [("", KEPT, OUTSIDE, True)]  # name, drop, place, may be seen

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text and stack[-1][3]:
                found.append((CHROME if stack[-1][1] else stack[-1][2], text))

    def pop(to: int) -> None:
        if any(s[0] in BLOCK for s in stack[to:]):
            while len(stack) > to:
                if stack[-1][0] in BLOCK or stack[-1][1:] != stack[-2][1:]:
                    flush()
                stack.pop()
        else:
            del stack[to:]

    at = 0
    while True:
        m = TAG.search(html, at)
        parts.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK or stack[i][1:] != stack[i - 1][1:]:
                        flush()
                    pop(i)
                    break
            else:
                if tag == "p":
                    flush()
            if tag in CELLS:
                parts.append(" ")
            continue
        if tag in BLOCK or tag == "hr":
            flush()
        if tag == "br" or tag in CELLS:
            parts.append(" ")
        if tag in VOID:
            continue
        ends = ENDS.get(tag, ("p",) if tag in BLOCK else ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                pop(i)
                break
            if stack[i][0] in BOUNDS:
                break
        _, drop, place, seen = stack[-1]
        own, container = marked(tag, m[3] or m[6] or "", place)
        if tag in ("article", "main") or (container and not named):
            # a text's container ends the layout part that it stands in (often one that was never closed), not what others put there
            drop, place = (own if own == DROP_ALL else KEPT) if drop != DROP_ALL else drop, max(place, ARTICLE if tag == "article" else MAIN)
        else:
            drop = max(drop, own)
        if own == DROP_ALL and tag in SILENT:
            seen = False
        if (drop, place, seen) != stack[-1][1:] and any(p.strip() for p in parts):
            flush()  # text before a part of another kind is a block of its own
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if not (m[3] or m[6] or "").endswith("/") or tag in BLOCK:
            stack.append((tag, drop, place, seen))
    while len(stack) > 1:
        flush()
        stack.pop()
    flush()
    return found


def settled(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Blocks as (1 stands, 0 open, -1 boilerplate): outside text is open only where the page has no container with text."""
    contained = any(place >= MAIN for place, _ in blocks)
    return [(1 if place == ARTICLE else 0 if place == MAIN or (place == OUTSIDE and not contained) else -1, text) for place, text in blocks]


def token_numbers(words: list[str]) -> np.ndarray:
    """A 64-bit number of each word."""
    import xxhash

    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def suffix_classes(tokens: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of every suffix) of a stream: suffixes in order of their first ``depth`` tokens, equal ones in one class.

    By prefix doubling; ``room`` is how many tokens a suffix has to the end of its page, and sets shorter suffixes apart.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < depth:
        step = min(length, depth - length)
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:]
        after[room <= step] = 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    return np.argsort(rank, kind="stable"), rank


def run_keys(host: int, tokens: np.ndarray, depth: int) -> np.ndarray:
    """A number of the host and the ``depth`` tokens from each place of a page that has so many."""
    n = len(tokens) - depth + 1
    if n < 1:
        return np.zeros(0, np.int64)
    mixed = (host & (2**64 - 1)) * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 & (2**64 - 1)
    key = np.full(n, mixed ^ mixed >> 29, np.uint64)
    for i in range(depth):
        key = (key ^ tokens[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


class Slab:
    """Runs of the pages of one slab, by one suffix array; pages of equal blocks of one host are one page."""

    def __init__(self, depth: int):
        self.depth, self.seen = depth, set()
        self.pages: list[np.ndarray] = []
        self.hosts: list[int] = []

    def add(self, host: int, page: int, tokens: np.ndarray) -> bool:
        if (host, page) in self.seen:
            return False
        self.seen.add((host, page))
        self.pages.append(tokens)
        self.hosts.append(host)
        return True

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, pages that hold it) of every run of the slab."""
        if not self.pages:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in self.pages], np.int64)
        stream = np.concatenate(self.pages)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(stream))
        keys = np.zeros(len(stream), np.int64)
        full = room >= self.depth
        keys[full] = np.concatenate([run_keys(h, p, self.depth) for h, p in zip(self.hosts, self.pages)])
        hosts = np.array(self.hosts, np.int64)[owner]
        order, rank = suffix_classes(stream, room, self.depth)
        order = order[full[order]]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = order[np.lexsort((owner[order], hosts[order], rank[order]))]
        same = (rank[order][1:] == rank[order][:-1]) & (hosts[order][1:] == hosts[order][:-1])
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        first_of_page = np.concatenate(([True], ~same | (owner[order][1:] != owner[order][:-1])))
        return keys[order[heads]], np.add.reduceat(first_of_page.astype(np.int64), heads)


def surveyed(pages: DataFrame, keep: list[str], html_col: str, depth: int) -> DataFrame:
    """One pass over all pages. ``kind`` 1: (key: host, n: number of the page's blocks, keys: its stream of open and boilerplate
    tokens) of each page. 2: pages with open blocks: their columns, host, blocks, their state, and the key of the run at each open token."""
    fields = [*(pages.schema[c] for c in keep), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("state", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [*keep, "kind", "key", "n", "blocks", "state", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            column, hosts = (batch.column(batch.schema.get_field_index(c)) for c in (html_col, "__host"))
            for lo, hi in spans_of(column, SLAB_BYTES):
                open_rows, streams = [], []
                for i, (html, host) in enumerate(zip(column.slice(lo, hi - lo).to_pylist(), hosts.slice(lo, hi - lo).to_pylist()), lo):
                    blocks = settled(blocks_of(html))
                    tokens = token_numbers([w for s, t in blocks if s < 1 for w in t.split()])
                    page = xxhash.xxh64_intdigest("\n".join(t for _, t in blocks))
                    streams.append((host, page - (page >> 63 << 64), tokens.view(np.int64)))
                    if any(s == 0 for s, _ in blocks):
                        open_rows.append((i, host, blocks, run_keys(host, tokens, depth)))
                yield rows_of(batch, [None] * len(streams), [1] * len(streams), [r[0] for r in streams], [r[1] for r in streams], [(None, None, r[2]) for r in streams])
                if open_rows:
                    yield rows_of(batch, [r[0] for r in open_rows], [2] * len(open_rows), [r[1] for r in open_rows], [0] * len(open_rows), [([t for _, t in r[2]], [s for s, _ in r[2]], r[3].tolist()) for r in open_rows])

    def rows_of(batch: pa.RecordBatch, at: list, kind: list, key: list, n: list, more: list | None) -> pa.RecordBatch:
        own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in keep]
        parts = [[m[j] for m in more] if more else [None] * len(at) for j in range(3)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip([kind, key, n, *parts], kinds))], names=names)

    return pages.select(*{c: None for c in [*keep, html_col, "__host"]}).mapInArrow(run, nullable(schema))


def host_runs(streams: DataFrame, depth: int) -> DataFrame:
    """(key, n): runs and how many pages hold them, by suffix arrays of hosts. ``streams``: (host, page, tokens), each page once.

    A host's streams are dealt by host; a large host is dealt over up to ``HOST_PARTS`` tasks and cut into arrays of ``ARRAY_TOKENS``
    tokens, whose runs are added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, held = Slab(depth), 0

        def closed() -> pa.RecordBatch:
            keys, n = slab.runs()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            tokens = batch.column(2)
            for i, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                stream = tokens[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                slab.add(host, page, stream)
                held += len(stream)
                if held >= ARRAY_TOKENS:
                    yield closed()
                    slab, held = Slab(depth), 0
        yield closed()

    dealt = streams.select("host", "page", "tokens").repartition("host", F.pmod("page", F.lit(HOST_PARTS)))
    return dealt.mapInArrow(run, "key long, n long")


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def joined_text(blocks: list[tuple[int, str]], covered: set[int]) -> str:
    """The text of a page; ``covered`` are places in its stream of open and boilerplate tokens."""
    kept, at = [], 0
    for state, text in blocks:
        if state == 1:
            kept.append(text)
            continue
        words = text.split()
        if state == 0:
            left = words if not covered else [w for i, w in enumerate(words, at) if i not in covered]
            if left:
                kept.append(" ".join(left))
        at += len(words)
    return "\n".join(kept)


def extracted(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: list[str] | None = None, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The columns ``keep`` (default: all but the html) and ``text``, the main text of each page."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", html_col)]
    host, _ = url_parts(F.col(url_col))
    columns = [f"__k{i}" for i in range(len(keep))]  # own names: those of the passes must not clash with them
    rows = pages.select(*(F.col(k).alias(c) for k, c in zip(keep, columns)), F.col(html_col).alias("__html"), F.xxhash64(host).alias("__host"))
    found = staged(surveyed(rows, columns, "__html", min_tokens), "html-runs")
    # hosts without open blocks have nothing that an array could settle; pages of equal blocks are one page, wherever they were read
    asked = found.where("kind = 2").select(F.col("key").alias("host")).distinct()
    streams = found.where("kind = 1").select(F.col("key").alias("host"), F.col("n").alias("page"), F.col("keys").alias("tokens")).join(asked, "host", "left_semi")
    streams = staged(streams.groupBy("host", "page").agg(F.first("tokens").alias("tokens")), "html-streams")
    repeated = host_runs(streams, min_tokens).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    counts = streams.groupBy("host").agg(F.count("*").alias("of"))
    pages_open = staged(found.where("kind = 2").select(*columns, F.col("key").alias("host"), "blocks", "state", "keys", F.monotonically_increasing_id().alias("row")), "html-open")
    at = pages_open.select("row", "host", F.posexplode("keys").alias("at", "key"))
    held = at.join(repeated, "key").join(counts, "host").where(F.col("n") >= F.lit(min_share) * F.col("of"))
    covered = held.groupBy("row").agg(F.collect_list("at").alias("at"))
    names = [*columns, "text"]
    schema = nullable(T.StructType([*(rows.schema[c] for c in columns), T.StructField("text", T.StringType())]))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, state, at in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("blocks", "state", "at"))):
                texts.append(joined_text(list(zip(state, blocks)), {i + j for i in at or () for j in range(min_tokens)}))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(texts, pa.string())], names=names)

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__html"))
            for lo, hi in spans_of(column, SLAB_BYTES):
                all_blocks = [settled(blocks_of(h)) for h in column.slice(lo, hi - lo).to_pylist()]
                mask = pa.array([not any(s == 0 for s, _ in b) for b in all_blocks])
                texts = pa.array([joined_text(b, set()) for b in all_blocks], pa.string())
                part = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in columns), texts], names=names)
                yield part.filter(mask)

    done = rows.select(*columns, "__html").mapInArrow(standing, schema)
    open_done = pages_open.join(covered, "row", "left").select(*columns, "blocks", "state", "at").mapInArrow(cleaned, schema)
    return done.unionByName(open_done).select(*(F.col(c).alias(k) for c, k in zip(columns, keep)), "text")


def html_digest(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
