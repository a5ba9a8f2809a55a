"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits, bias-corrected likeness.

Every shingle of five words is hashed once; the top bits of the hash choose one of ``BINS`` bins and each bin keeps its least
hash. An empty bin borrows the value of a non-empty one that a 2-universal sequence of probes finds (Shrivastava, 2017), the
same for every document. The low ``BITS`` bits of each value are packed. Two fingerprints that agree in a share m of their bins
have the likeness (m - c) / (1 - c), c = 2^-BITS being chance, cut to 0..1.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]+`` of the text as it is; fewer than five words make one shingle; a null
text is empty, and a text without words has the fingerprint of zeros, alike to its equals only (likeness 1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns

BINS, BITS, SHINGLE = 256, 8, 5
CHANCE = 2.0**-BITS
SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: Odd multipliers of the words of a shingle and of the final mix.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BLOCK_WORDS = 1 << 18
#: Range bounds are a constant of the plan and as fine as approximate percentiles can be.
ROWS_PER_RANGE, MAX_RANGES = 5000, 40_000


def probes(tries: int) -> np.ndarray:
    """Bin that the t-th probe for bin e looks at: (a_t * e + b_t) mod a prime, mod the bins."""
    prime = np.uint64((1 << 31) - 1)
    t = np.arange(1, tries + 1, dtype=np.uint64)
    a, b = (t * np.uint64(1_103_515_245) + np.uint64(12_345)) % prime, (t * np.uint64(69_069) + np.uint64(362_437)) % prime
    return (((a[None, :] * np.arange(1, BINS + 1, dtype=np.uint64)[:, None] + b[None, :]) % prime) % np.uint64(BINS)).astype(np.int64)


PROBES = probes(64)


class WordHashes(dict):
    """XXH64 of words; those of at most 64 bytes are remembered, up to a bound in number and so in bytes."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = value
        return value


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = min(SHINGLE, len(words))
    count = len(words) - n + 1
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h += words[j : j + count] * MULTIPLIERS[j]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def bin_minima(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(least hash, filled) of each bin, word blocks overlapping by a shingle less one word."""
    least, filled = np.full(BINS, np.iinfo(np.uint64).max, np.uint64), np.zeros(BINS, bool)
    data, rest = text.encode("utf-8", "surrogatepass"), np.zeros(0, np.uint64)
    while data:
        words = data.split(None, BLOCK_WORDS)
        data = words.pop() if len(words) > BLOCK_WORDS else b""
        now = np.concatenate((rest, word_hashes(words)))
        rest = now[-(SHINGLE - 1) :]
        if not len(now) or (len(now) < SHINGLE and data):
            continue
        h = np.sort(shingle_hashes(now))
        bins = (h >> SHIFT).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        at = bins[first]
        least[at] = np.minimum(least[at], h[first])
        filled[at] = True
    return least, filled


def densified(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    empty = np.flatnonzero(~filled)
    if len(empty) and filled.any():
        seen = filled[PROBES[empty]]
        found = seen.any(axis=1)
        source = PROBES[empty, seen.argmax(axis=1)]
        if not found.all():  # very few filled bins: longer sequences for the rest, then the next filled bin upwards
            for i in np.flatnonzero(~found):
                far = LONG_PROBES[empty[i]]
                hit = filled[far]
                source[i] = far[hit.argmax()] if hit.any() else np.flatnonzero(filled)[np.searchsorted(np.flatnonzero(filled), empty[i]) % filled.sum()]
        least = least.copy()
        least[empty] = least[source]
    return least


LONG_PROBES = probes(4096)


def fingerprint(text: str | None) -> bytes:
    least, filled = bin_minima(text or "")
    if not filled.any():
        return bytes(BINS * BITS // 8)
    return (densified(least, filled) & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes()


def likeness(x: bytes, y: bytes) -> float:
    if not any(x) or not any(y):
        return float(x == y)
    m = float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)))
    return min(1.0, max(0.0, (m - CHANCE) / (1 - CHANCE)))


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``minhash``: the packed fingerprint."""
    return arrow_columns(docs, lambda texts: {"minhash": pa.array([fingerprint(t) for t in texts], pa.binary())}, text_col, [("minhash", T.BinaryType())], keep)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the following text, or all of it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likenesses to it and to the next text in order of the id.

    Texts are dealt once, by ranges of the id; the first row of each range also goes to the end of the range before (of the first
    range to the end of the last), so every row meets the next in its own task. Range bounds are ids from the table, about
    ``ranges`` of them (default: so that a task has about ``ROWS_PER_RANGE`` rows, and no fewer than twice the shuffle's
    partitions). Rows of one id are ordered by text; null ids come first.
    """
    spark = docs.sparkSession
    if ranges is None:
        ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-docs.count() // ROWS_PER_RANGE)))
    share = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(id_col, F.array(*map(F.lit, share)) if share else F.array(F.lit(0.5)), MAX_RANGES).alias("q"), F.min(id_col).alias("least"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    least = None if found["nulls"] else found["least"]
    bounds = sorted({q for q in found["q"] or [] if q > (found["least"] if least is not None else q - 1)}) if ranges > 1 else []
    # binary search for the range of an id
    place = range_of(F.col(id_col), bounds)
    first = (F.col(id_col).eqNullSafe(F.lit(least)) & (F.lit(0) == place)) | (F.col(id_col).isin(bounds) if bounds else F.lit(False))
    before = F.when(first, F.when(place == 0, F.lit(len(bounds))).otherwise(place - 1))
    dealt = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.explode(F.array_compact(F.array(F.struct(place.alias("p"), F.lit(0).alias("after")), F.when(before.isNotNull(), F.struct(before.alias("p"), F.lit(1).alias("after")))))).alias("r"))
    dealt = dealt.select("r.p", "r.after", "id", "text").repartitionById(len(bounds) + 1, F.col("p").cast("int")).sortWithinPartitions("p", "after", F.col("id").asc_nulls_first(), "text")
    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    schema[0].nullable = True

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, int, str, bytes] | None = None  # range, id, text and fingerprint of the row that lacks its next
        sealed = False

        def result(row: tuple, text: str, print_: bytes) -> tuple:
            new = edited(row[2], text)
            other = fingerprint(new)
            return row[1], len(row[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), row[3].hex(), other.hex(), likeness(row[3], other), likeness(row[3], print_)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=schema.names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(2).type
            rows = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for p, after, key, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if after and (sealed or waiting is None or waiting[0] != p):
                        continue  # of the rows that begin the next range only the first counts
                    print_ = fingerprint(text)
                    if waiting is not None and waiting[0] == p:
                        rows.append(result(waiting, text, print_))
                    if after:
                        waiting, sealed = None, True
                    else:
                        waiting, sealed = (p, key, text, print_), False
                if len(rows) >= 512:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return dealt.mapInArrow(walk, schema)


def range_of(value: F.Column, bounds: list) -> F.Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search; 0 for null.

    A few bounds become nested comparisons, many an array that is halved step by step.
    """
    if not bounds:
        return F.lit(0)
    if len(bounds) > 256:
        table = F.array(*map(F.lit, bounds))
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

        def halve(s: F.Column, _: F.Column) -> F.Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            above = (s["lo"] < s["hi"]) & (value >= F.get(table, mid))
            return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

        steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
        return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve)["lo"])

    def search(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))
