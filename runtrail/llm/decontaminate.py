"""Benchmark decontamination: an Aho-Corasick automaton over the normalised items, texts scanned once, offsets in the original.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is 13 consecutive words of an item;
an item of fewer words (not none) is one window. A document word inside an occurrence of a window is *hit*; a document is
contaminated if some word is hit and at least one word in twenty is.

The automaton holds each item cut into blocks of seven words (and items shorter than a window whole): whichever 13 words of an
item occur in a text, one block lies within them. Where a block is found, the windows around it are looked up, so the automaton
is as large as the benchmark, not 13 times so. Beyond ``shard_chars`` characters the items are dealt into shards by hash; each
shard is sent to the tasks by itself and scanned in a pass of its own, and the hits of all passes are merged: the same results for
a benchmark of any size, with bounded memory.

Defined results: a null or wordless text has no words and is clean; null or wordless items have no window; equal items count
once each; an empty benchmark leaves every document clean. An output replaces a column of the same name; other columns pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, spans_of, staged

WINDOW = 13
#: Characters of benchmark text to a shard: about 64 bytes of memory each for the automaton, as many for the windows.
SHARD_CHARS = 2_000_000
#: Words of an item that travel as one row; longer items are cut with an overlap of a window less one word.
PIECE_WORDS = 20_000
#: Maps a byte of UTF-8 to itself, its lower case, or a space where it is no part of a word.
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OUTPUTS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType())))]
RUNS = pa.list_(pa.list_(pa.int32()))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def pieces_of(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """The item as pieces that together have all its windows and no other."""
    step = PIECE_WORDS - size + 1
    for lo in range(0, max(1, len(words) - size + 1), step):
        if piece := words[lo : lo + PIECE_WORDS]:
            yield b" ".join(piece)


class Scanner:
    """The automaton of a shard, built once per Python worker from (item, piece) rows."""

    _built: dict[str, "Scanner"] = {}

    def __init__(self, pieces: list[tuple[str, bytes]], size: int = WINDOW):
        import ahocorasick

        self.size, self.block = size, (size + 1) // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.windows: dict[bytes, set[str]] = {}
        for item, piece in pieces:
            words = piece.split(b" ")
            if len(words) < size:
                self.automaton.add_word(f" {piece.decode('latin-1')} ", len(words))
            for lo in range(0, len(words) - self.block + 1 if len(words) >= size else 0, self.block):
                self.automaton.add_word(f" {b' '.join(words[lo : lo + self.block]).decode('latin-1')} ", self.block)
            for lo in range(max(1, len(words) - size + 1)):
                self.windows.setdefault(b" ".join(words[lo : lo + size]), set()).add(item)
        if self.windows:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, pieces: list[tuple[str, bytes]], size: int) -> "Scanner":
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(pieces, size)
        return cls._built[key]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Runs of hit words as [first, end), and the items whose windows occur."""
        if not words or not self.windows:
            return [], set()
        joined = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(joined))
        if not found:
            return [], set()
        ends, sizes = np.array(found).T
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(spaces, ends) - 1  # index of the last word
        whole = {(int(e) - int(n) + 1, int(n)) for e, n in zip(last, sizes) if n < self.size}  # items shorter than a window
        for e in last[sizes == self.block].tolist():
            whole |= {(lo, self.size) for lo in range(max(0, e - self.size + 1), min(e - self.block + 1, len(words) - self.size) + 1)}
        hits, items = [], set()
        for lo, n in whole:
            of = self.windows.get(b" ".join(words[lo : lo + n]))
            if of:
                hits.append([lo, lo + n])
                items |= of
        return merged(hits), items


def merged(runs: list[list[int]]) -> list[list[int]]:
    """Overlapping and adjacent runs as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def finished(text: str | None, n_words: int, runs: list[list[int]], items) -> tuple:
    """One row of OUTPUTS; runs of words become [start, end) code points of the original text."""
    at = [m.span() for m in WORDS.finditer(text)] if runs else []
    return n_words, sum(b - a for a, b in runs), len(items), sorted(items), [[at[a][0], at[b - 1][1]] for a, b in runs]


def columns_of(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), RUNS)
    return {name: pa.array([r[i] for r in rows], kind) for i, ((name, _), kind) in enumerate(zip(OUTPUTS, kinds))}


def benchmark_pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, piece): the normalised words of each item, long items cut."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("piece", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces_of(words_of(t), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=schema.names)

    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, schema).distinct()


def scan_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW, shard_chars: int = SHARD_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_hit, n_items, items, hit_spans and contaminated to every document."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {"contaminated", *(n for n, _ in OUTPUTS)}]
    letters = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-letters // shard_chars))
    pieces = benchmark_pieces(benchmark, size=size)
    if shards == 1:
        key, shared = sent(docs, pieces)

        def scan(texts: list[str | None]) -> dict[str, pa.Array]:
            scanner = Scanner.of(key, shared.value, size)
            return columns_of([finished(t, len(words), *scanner.scan(words)) for t in texts for words in [words_of(t)]])

        found = arrow_columns(docs, scan, text_col, OUTPUTS, keep)
    else:
        found = scan_in_shards(docs, staged(pieces.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))), "benchmark"), shards, text_col, size, keep)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def sent(docs: DataFrame, pieces: DataFrame):
    """The pieces of one shard, a bounded number of characters, as a broadcast, and a key of their content."""
    rows = sorted((r["item"], bytes(r["piece"])) for r in pieces.select("item", "piece").collect())
    return hashlib.sha256(repr(rows).encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(rows)


def scan_in_shards(docs: DataFrame, pieces: DataFrame, shards: int, text_col: str, size: int, keep: list[str]) -> DataFrame:
    """One pass over the texts for each shard, keeping only rows with hits; their runs are merged and joined back by row number."""
    names = [*keep, *([] if text_col in keep else [text_col])]
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("row"))
    rows, text = staged(renamed, "decontaminate"), f"c{names.index(text_col)}"
    runs_type = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("runs", runs_type)])
    parts = []
    for shard in range(shards):
        key, shared = sent(docs, pieces.where(F.col("shard") == shard))

        def scan(batches: Iterator[pa.RecordBatch], key=key, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scanner = Scanner.of(key, shared.value, size)
                for lo, hi in spans_of(batch.column(1)):
                    met = [(row, *scanner.scan(words_of(t))) for row, t in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist())]
                    met = [m for m in met if m[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in met], pa.int64()), pa.array([sorted(m[2]) for m in met], pa.list_(pa.string())), pa.array([m[1] for m in met], RUNS)], names=schema.names)

        parts.append(staged(rows.select("row", text).mapInArrow(scan, schema), "decontaminate-hits"))
        shared.destroy()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"), F.flatten(F.collect_list("runs")).alias("runs"))
    joined = rows.join(hits, "row", "left")
    made = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], *[T.StructField(n, t) for n, t in OUTPUTS]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(f"c{i}")) for i in range(len(keep))]
            texts, found, runs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, "found", "runs"))
            got = columns_of([finished(t, len(words_of(t)), merged(r or []), set(f or [])) for t, f, r in zip(texts, found, runs)])
            yield pa.RecordBatch.from_arrays([*own, *got.values()], names=made.names)

    return joined.mapInArrow(finish, made).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _ in OUTPUTS])


def contamination_digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
