"""Cross-tokenizer alignment: union-find over overlapping tokens, links within components, corpus-wide counts of id pairs.

Tokenizer A (a byte-level BPE file) reads a space and the text; tokenizer B (a piece model with byte fallback) reads the text and
adds the space itself. Both cut the same bytes. Tokens are the nodes of a bipartite graph with an edge wherever an A token and a B
token overlap; its connected components are the minimal groups, which begin and end where both tokenizers have a boundary.
Components come from a union-find that hooks and halves all trees in step. Every A token of a group is linked to every B token of
it; a group's links are kept as distinct pairs of ids and how often they occur.

A space after another letter is a boundary of both tokenizers (checked on the piece vocabulary; where it is none, texts stay
whole). Texts are cut there; segments met for the first time are aligned together in one graph, and a worker keeps what a segment
adds to a document, up to a bound in bytes.

How many documents hold a pair is counted by Spark over all documents, with partial counts before the shuffle. The counts go back to
the documents in two joins that give each pair exactly once: the ``head`` most frequent pairs (a fixed number) by a broadcast, so
that no frequent pair is a hot key, all others by a shuffle.

Defined results: texts that are null, empty, or whose tokens do not spell the bytes of a space and the text have no tokens, zeros
and an empty ``groups``. Repeated rows count as documents of their own. Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spans_of, staged
from .tokens import byte_letters

#: Pairs that are broadcast with their counts; the others are joined by a shuffle.
HEAD = 1 << 16
#: Text bytes handled at once, links of a group beyond which its ids are made distinct before they are paired, and the bytes that
#: known segments may take before they are forgotten.
SLAB_BYTES, WIDE_GROUP, CACHE_BYTES = 1 << 20, 4096, 192 << 20
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


class Numbers(dict):
    """Numbers of segments in the order met; ``new`` are those met since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.new.append(segment)
        return number


class Pair:
    """Both tokenizers, the bytes of their tokens and the segments aligned so far; one per Python worker and pair of files."""

    _built: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        pieces = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p in pieces]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.top = max(len(self.a_bytes), len(self.b_bytes))
        #: Decimal ids, each followed by one of the separators , | ; or nothing.
        self.written = [f"{i}{s}" for s in (",", "|", ";", "") for i in range(self.top)]
        #: No piece goes on over a space, so that a space after another letter is a boundary of both tokenizers.
        self.local = not any("▁" in p.lstrip("▁") for p in pieces)
        self.lead = self.b.encode("a")
        self.forget()

    def forget(self) -> None:
        self.numbers, self.size = Numbers(), 0
        self.texts: list[str] = []
        self.table = {c: np.zeros(0, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "spelled", "key", "times")}
        self.first = np.zeros(1, np.int64)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Pair":
        if (a_path, b_path) not in cls._built:
            cls._built[a_path, b_path] = cls(a_path, b_path)
        return cls._built[a_path, b_path]

    def segments(self, text: str | None) -> list[str]:
        """A space and the text, cut before every space that follows a letter that is no white space."""
        if not text:
            return []
        return SEGMENT.findall(" " + text) if self.local else [" " + text]

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each segment; none where the tokens of either do not spell it."""
        coded = []
        heard = self.b.encode(["a" + s for s in segments] if self.local else [s[1:] for s in segments], num_threads=1)
        skip = len(self.lead) if self.local else 0
        for segment, b in zip(segments, heard):
            a, b, spelled = self.a.encode(segment, add_special_tokens=False).ids, b[skip:], segment.encode("utf-8")
            same = b"".join(map(self.a_bytes.__getitem__, a)) == spelled == b"".join(map(self.b_bytes.__getitem__, b))
            coded.append((a, b) if same else ([], []))
        return coded

    def learn(self) -> None:
        """Align the segments that were met for the first time, all in one graph, and keep what they add to a document."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        coded, n = self.encode(new), len(new)
        n_a, n_b = (np.array([len(c[side]) for c in coded], np.int64) for side in (0, 1))
        a, b = (np.array([i for c in coded for i in c[side]], np.int64) for side in (0, 1))
        ga, gb, groups = components(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]))
        owner = np.zeros(groups, np.int64)
        owner[ga] = np.repeat(np.arange(n), n_a)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, owner, np.bincount(ga, minlength=groups) * np.bincount(gb, minlength=groups))
        group, la, lb, times = linked(ga, gb, a, b, groups)
        order = np.argsort(owner[group], kind="stable")
        made = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner, minlength=n), "n_links": n_links, "spelled": (n_a > 0).astype(np.int64), "key": (la * len(self.b_bytes) + lb)[order], "times": times[order]}
        self.table = {c: np.concatenate((self.table[c], v)) for c, v in made.items()}
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.bincount(owner[group], minlength=n))))
        self.texts += written_groups(self, ga, gb, a, b, n_a + n_b)
        self.size += sum(len(s) * 12 + 300 for s in new)


def roots(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component: every edge hooks the larger root to the smaller, then all paths are halved."""
    parent = np.arange(nodes)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each A token, group of each B token, groups), groups numbered in the order of the bytes.

    The ends cut the bytes into pieces that lie in one token of each side: the edges of the overlap graph.
    """
    cuts = np.union1d(a_ends, b_ends)
    left, right = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    root = roots(len(a_ends) + len(b_ends), left, right + len(a_ends))
    numbers = np.cumsum(root[: len(a_ends)] == np.arange(len(a_ends))) - 1  # an A token comes first in each component
    group = numbers[root]
    return group[: len(a_ends)], group[len(a_ends) :], int(numbers[-1]) + 1 if len(numbers) else 0


def linked(ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, occurrences) of all links; groups with many tokens give distinct pairs with their number."""
    ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    wide = np.flatnonzero(ca * cb > WIDE_GROUP)
    narrow = np.isin(ga, wide, invert=True) if len(wide) else np.ones(len(ga), bool)
    first = np.cumsum(cb) - cb  # tokens of a group lie together
    g = ga[narrow]
    times = cb[g]
    parts = [(np.repeat(g, times), np.repeat(a[narrow], times), b[runs(first[g], times)], np.ones(int(times.sum()), np.int64))]
    for w in wide.tolist():
        ua, na = np.unique(a[ga == w], return_counts=True)
        ub, nb = np.unique(b[gb == w], return_counts=True)
        parts.append((np.full(len(ua) * len(ub), w), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.repeat(na, len(ub)) * np.tile(nb, len(ua))))
    return tuple(np.concatenate(p) for p in zip(*parts))


def runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of each run, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def aligned_slab(pair: Pair, texts: list[str | None]) -> dict[str, pa.Array]:
    """The columns of ``aligned`` for some texts, put together from their segments."""
    if pair.size > CACHE_BYTES:
        pair.forget()
    met = [list(map(pair.numbers.__getitem__, pair.segments(t))) for t in texts]
    pair.learn()
    table, docs = pair.table, len(texts)
    met = [m if all(map(table["spelled"].__getitem__, set(m))) else [] for m in met]
    sizes = np.array([len(m) for m in met], np.int64)
    seg, doc = np.array([i for m in met for i in m], np.int64), np.repeat(np.arange(docs), sizes)
    ends = np.cumsum(sizes)

    def total(name: str) -> pa.Array:
        sums = np.concatenate(([0], np.cumsum(table[name][seg])))
        return pa.array(sums[ends] - sums[ends - sizes], pa.int64())

    totals = {c: total(c) for c in ("n_a", "n_b", "n_groups", "n_links")}
    held, times = np.unique(doc * len(pair.texts) + seg, return_counts=True)
    doc, seg = np.divmod(held, max(1, len(pair.texts)))
    lengths = pair.first[seg + 1] - pair.first[seg]
    at = runs(pair.first[seg], lengths)
    width = len(pair.a_bytes) * len(pair.b_bytes)
    key, times = np.repeat(doc, lengths) * width + table["key"][at], np.repeat(times, lengths) * table["times"][at]
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, times = key[new], np.add.reduceat(times, new) if len(new) else times
    offsets = np.concatenate(([0], np.cumsum(np.bincount(key // width, minlength=docs))))
    nested = lambda v, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, kind))
    a, b = np.divmod(key % width, len(pair.b_bytes))
    digests = [hashlib.sha256(";".join(map(pair.texts.__getitem__, m)).encode()).hexdigest() if m else "" for m in met]
    return {**totals, "groups": pa.array(digests, pa.string()), "a": nested(a, pa.int32()), "b": nested(b, pa.int32()), "times": nested(times, pa.int64())}


def written_groups(pair: Pair, ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Every segment's groups, written ``a1,a2|b1;a3|b2,b3``; ``sizes`` counts its tokens of both sides."""
    group, side, ids = np.concatenate((ga, gb)), np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b))
    order = np.argsort(group * 2 + side, kind="stable")
    place = (group * 2 + side)[order]
    after = np.append(place[1:], -9)
    mark = np.where(after == place, 0, np.where(after // 2 == place // 2, 1, 2))
    ends = np.cumsum(sizes)
    mark[ends[sizes > 0] - 1] = 3
    words = list(map(pair.written.__getitem__, (mark * pair.top + ids[order]).tolist()))
    return ["".join(words[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]


def aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row n_a, n_b, n_groups, n_links, ``groups`` (digest) and its distinct linked id pairs as parallel lists a, b, times."""
    outputs = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()), ("a", T.ArrayType(T.IntegerType())), ("b", T.ArrayType(T.IntegerType())), ("times", T.ArrayType(T.LongType()))]
    names = [n for n, _ in outputs]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in spans_of(column, SLAB_BYTES):
                made = aligned_slab(Pair.of(a_path, b_path), column.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep), *(made[n] for n in names)], names=[*keep, *names])

    return docs.select(*{c: None for c in [*keep, text_col]}).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows a pair is linked, and whether that is the most of its A id."""
    counts = staged(links.groupBy("a", "b").agg(F.count("*").alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return staged(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def link_sums(links: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """(row, n_best, count_sum) of links (row, a, b, times): each link meets its pair's count once."""
    top = staged(counts.orderBy(F.desc("n"), "a", "b").limit(head), "pair-head")
    often = links.join(F.broadcast(top), ["a", "b"])
    rare = links.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_anti").join(counts.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_anti"), ["a", "b"])
    sums = [part.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")) for part in (often, rare)]
    return sums[0].unionByName(sums[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id", head: int = HEAD) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of its groups."""
    rows = staged(aligned(docs, a_path, b_path, text_col, [id_col]).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("row", "x.*")
    sums = link_sums(links, pair_counts(links), head)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
