"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most 4 bits differ in at most 4 bytes, so they share at
least 4 positional bytes: the guaranteed minimum of matches. The index lists fingerprints by three of their positional bytes,
for the 20 triples of a covering family in which every four positions hold a triple; no qualifying pair can miss all lists.
For each pair that meets in a list the shared positional bytes are tallied, pairs below the minimum go, the rest are verified.

Only distinct fingerprints are indexed (copies collapse before), lists are short because a key has 24 bits, and the lists that
are long nonetheless (many near copies of one text) are re-keyed by a fourth byte (four shared bytes are guaranteed), and those
still long by four of the eight half-bytes of the rest (at most four of them differ). A list then holds at most 2^16 fingerprints,
whatever the data. A list over ``LONG_LIST`` yields a spanning forest of its links, not all pairs: components lose nothing.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like any other; texts of fewer than four
words have one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, staged
from .components import connected_components

BYTES, MAX_BITS, SEED = 8, 4, 42
#: Positional bytes that two fingerprints within MAX_BITS bits share at least.
MIN_SHARED = BYTES - MAX_BITS
#: Lists of more fingerprints give a spanning forest of their links instead of the pairs.
LONG_LIST = 128
#: Lists of more fingerprints are re-keyed first.
CROWDED_LIST = 4096
#: A fingerprint of more rows than this, and than a 4096th of all rows, meets its rows by broadcast: 4095 such at most.
HOT_ROWS, HOT_SHARE = 64, 4096
#: Words of a long text that are held as Python objects at once.
BLOCK_WORDS = 200_000


def covering_triples() -> list[tuple[int, ...]]:
    """Triples of positions such that any four positions hold one: positions in a ring of three groups (Turan's construction)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    kept = []
    for triple in combinations(range(BYTES), 3):
        counts = [len(set(triple) & set(g)) for g in groups]
        if 3 in counts or any(counts[i] == 2 and counts[(i + 1) % 3] == 1 for i in range(3)):
            kept.append(triple)
    return kept


TRIPLES = covering_triples()
FOURS = list(combinations(range(BYTES), 4))


def shingle_hashes(text: str | None, size: int = 4) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of ``size`` words, block by block."""
    import xxhash

    if not text:
        return
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only, bytes.split cuts at \x20\x09-\x0D only
    rest: list[bytes] = []
    seen = False
    hash64 = xxhash.xxh64_intdigest
    while data or rest:
        words = rest + data.split(None, BLOCK_WORDS) if data else rest
        data = words.pop() if len(words) > len(rest) + BLOCK_WORDS else b""
        if not words:
            return
        n = len(words)
        if n < size:
            if not data and not seen:
                yield np.array([hash64(b" ".join(words), SEED)], np.uint64)
            if not data:
                return
            rest = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        yield np.fromiter((hash64(joined[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, n - size + 1)
        seen = True
        if not data:
            return
        rest = words[n - size + 1 :]


def fingerprint(text: str | None, size: int = 4) -> int:
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        total += len(hashes)
        for lo in range(0, len(hashes), 4096):
            part = hashes[lo : lo + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def with_fingerprint(docs: DataFrame, text_col: str = "text", size: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``: the fingerprint as a signed long."""

    def made(texts: list[str | None]) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))}

    return arrow_columns(docs, made, text_col, [("fp", T.LongType())], keep)


def keys_of(fps: np.ndarray, positions: list[tuple[int, ...]]) -> np.ndarray:
    """One key per fingerprint and set of positions: the number of the set above the half-bytes at its positions."""
    halves = np.stack([(fps >> (4 * h)) & 15 for h in range(2 * BYTES)], axis=1)
    keys = np.empty((len(fps), len(positions)), np.int64)
    for j, chosen in enumerate(positions):
        key = np.full(len(fps), j, np.int64)
        for h in chosen:
            key = (key << 4) | halves[:, h]
        keys[:, j] = key
    return keys


def halves_of(positions: tuple[int, ...]) -> tuple[int, ...]:
    """The half-bytes of bytes."""
    return tuple(h for p in positions for h in (2 * p, 2 * p + 1))


def listed(fps: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): the lists of ``fps`` for sets of half-bytes."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for lo in range(0, len(values), 4096):
                part = values[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(part, positions).ravel()), pa.array(np.repeat(part, len(positions)))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(post, schema)


def relisted(index: DataFrame) -> DataFrame:
    """The lists of four bytes, each dealt by every four of its eight other half-bytes: of a linked pair four are equal."""
    rest = [halves_of(tuple(p for p in range(BYTES) if p not in four)) for four in FOURS]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for j in np.unique(keys >> 32).tolist():
                at = np.flatnonzero(keys >> 32 == j)
                for lo in range(0, len(at), 4096):
                    part = at[lo : lo + 4096]
                    sub = keys_of(np.ascontiguousarray(values[part]), list(combinations(rest[j], 4)))
                    # the list's number and bytes above the choice of half-bytes and their values: 7 + 32 + 7 + 16 bits
                    yield pa.RecordBatch.from_arrays([pa.array(((keys[part][:, None] << 23) | sub).ravel()), pa.array(np.repeat(values[part], sub.shape[1]))], names=["key", "fp"])

    return index.select("key", "fp").mapInArrow(post, schema)


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64))


def verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tally the shared positional bytes of each pair; those with the guaranteed minimum are compared bit by bit."""
    differ = np.bitwise_xor(x, y)
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    kept = tally >= MIN_SHARED
    kept[kept] = np.bitwise_count(differ[kept].view(np.uint64)) <= MAX_BITS
    return kept


def forest(values: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``values``: a breadth-first search that compares a frontier with what is unreached."""
    left, right = [], []
    unreached = values.copy()
    while len(unreached):
        frontier, unreached = unreached[:1], unreached[1:]
        while len(frontier) and len(unreached):
            reached = np.zeros(len(unreached), bool)
            for lo in range(0, len(frontier), 64):
                for at in range(0, len(unreached), block * 16):
                    part = slice(at, at + block * 16)
                    near = np.bitwise_count((frontier[lo : lo + 64, None] ^ unreached[None, part]).view(np.uint64)) <= MAX_BITS
                    near[:, reached[part]] = False
                    hit = near.any(axis=0)
                    left.append(frontier[lo : lo + 64][near.argmax(axis=0)[hit]])
                    right.append(unreached[part][hit])
                    reached[part] |= hit
            frontier, unreached = unreached[reached], unreached[~reached]
    return (np.concatenate(left), np.concatenate(right)) if left else (values[:0], values[:0])


def links_in_lists(index: DataFrame) -> DataFrame:
    """(a, b) for the links within each list of ``index`` (key, fp): all pairs of short lists, forests of long ones."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            long = np.repeat(sizes > LONG_LIST, sizes)
            a, b = [], []
            k, f = key[~long], fp[~long]
            for step in range(1, int(sizes[sizes <= LONG_LIST].max(initial=1))):
                same = np.flatnonzero(k[step:] == k[:-step])
                if not len(same):
                    break
                x, y = f[same], f[same + step]
                good = verified(x, y)
                a.append(x[good])
                b.append(y[good])
            for start, size in zip(starts[sizes > LONG_LIST], sizes[sizes > LONG_LIST]):
                x, y = forest(fp[start : start + size])
                a.append(x)
                b.append(y)
            a, b = (np.concatenate(v) if v else key[:0] for v in (a, b))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False)))
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            if cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links(key, fp)

    return index.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(met, schema)


def crowded_keys(index: DataFrame) -> DataFrame | None:
    """The keys of lists over ``CROWDED_LIST``, staged; None where there are none."""
    found = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED_LIST).select("key")
    found = staged(found, "simhash-crowded")
    return found if found.take(1) else None


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints of ``fps`` that keep every component of the full link graph whole."""
    index = listed(fps, [halves_of(t) for t in TRIPLES])
    crowded = crowded_keys(index)
    if crowded is None:
        return links_in_lists(index).distinct()
    links = links_in_lists(index.join(crowded, "key", "left_anti"))
    # members of crowded lists: any two with a link share four positional bytes, so the lists of four hold the pair
    often = staged(index.join(crowded, "key", "left_semi").select("fp").distinct(), "simhash-often")
    index = listed(often, [halves_of(f) for f in FOURS])
    crowded = crowded_keys(index)
    if crowded is None:
        return links.unionByName(links_in_lists(index)).distinct()
    finest = relisted(index.join(crowded, "key", "left_semi"))
    return links.unionByName(links_in_lists(index.join(crowded, "key", "left_anti"))).unionByName(links_in_lists(finest)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp, component_id): the least id that each document reaches over links of at most MAX_BITS bits."""
    slim = staged(with_fingerprint(docs, text_col, size, [id_col]), "simhash")
    fps = slim.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    fps = staged(fps, "simhash-distinct")
    rows = fps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    roots = connected_components(fingerprint_links(fps), "a", "b")
    linked = staged(fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    moved = with_value(linked.select("fp", "root"), least, "root", rows).select("fp", "component_id")
    groups = fps.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return with_value(slim, groups, "fp", rows).select(id_col, "fp", "component_id")


def with_value(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``values`` (key, n, component_id), where n is how many rows have the key, of ``total`` at most.

    Keys of more than a 4096th of all rows, so 4095 at most, are broadcast; the rest is joined by key.
    """
    values = staged(values.select(key, "n", "component_id"), "simhash-values")
    often = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(values.where(often).select(key, F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    split = rows.join(hot, key, "left")
    many = split.where("is_hot").select(*rows.columns, F.col("hot_id").alias("component_id"))
    few = split.where("is_hot is null").select(*rows.columns).join(values.where(~often).select(key, "component_id"), key)
    return many.unionByName(few.select(*rows.columns, "component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each group the one of least id; rows that repeat both id and text stay once.

    Columns and rows pass unchanged. A null id stands for no document of its own: such rows stay (their groups have no least id).
    """
    found = near_duplicates(docs, id_col, text_col)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(stay, id_col, "left_semi")
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(id_col, "__text").orderBy(F.lit(0)))
    once = kept.withColumn("__text", F.xxhash64(text_col)).withColumn("__n", first).where("__n = 1").drop("__text", "__n")
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def component_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
