"""Language identification by nearest centroid over normalised TF-IDF vectors of byte n-grams.

A text is lower-cased, ASCII digits and punctuation become spaces, and its 2- and 3-grams of UTF-8 bytes are counted in hashed
cells. Counts are damped by a logarithm, weighted by inverse document frequency and normalised. Each language has several
centroids (spherical k-means over its training vectors); a text goes to the language of the nearest by cosine, and is rejected
where that cosine is below its language's bar for texts of about its length. The bar stands between what noise reaches (letters,
encoded bytes and scripts drawn at random) and what all but the lowest hundredth of training texts and their pieces reach.

Training reads at most ``per_language`` labelled rows of each language (the least by hash of the id), a bound of the operator;
n-gram frequencies come from these rows. Every text is predicted whole, long ones block by block.

Defined results: a null text or one without a letter is ``und`` with score 0, rejected; without any training row every text is
``und``; ties go to the language first by name.
"""

from __future__ import annotations

import base64
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, is_held_out, may_learn, spans_of

CELLS = 2048
CENTROIDS = 4
PER_LANGUAGE = 250
#: Languages that a model takes; more are an error, as the training rows on the driver are bounded by it.
MAX_LANGUAGES = 200
UNDETERMINED = "und"
#: ASCII other than letters becomes a space.
PLAIN = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
#: Letters of the piece that each training text also gives, so that one centroid more stands for short texts.
PIECE = 48
#: Numbers of n-grams for which a bar is set; between them it is interpolated over the logarithm.
LENGTHS = np.array([32, 64, 128, 256, 512, 1024, 2048, 4096])
#: The share of training cosines that is trimmed as outliers, and the place of the bar on the way from noise to the rest.
TRIMMED, PLACE = 0.01, 1 / 3
#: Fewer training pieces of a length than this say nothing of its lowest hundredth.
LEAST = 20
BLOCK = 1 << 19
OUTPUTS = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]


def counts_of(text: str | None) -> np.ndarray:
    """Counts of hashed 2- and 3-grams."""
    counts = np.zeros(CELLS, np.int64)
    if not text:
        return counts
    before = np.zeros(0, np.uint32)
    for lo in range(0, len(text), BLOCK):
        data = text[lo : lo + BLOCK].lower().encode("utf-8", "replace").translate(PLAIN)
        data = (b"" if lo else b" ") + data + (b" " if lo + BLOCK >= len(text) else b"")
        x = np.concatenate((before, np.frombuffer(data, np.uint8).astype(np.uint32)))
        two = x[:-1] * np.uint32(2_654_435_761) + x[1:] * np.uint32(40_503)
        three = two[:-1] * np.uint32(31) + x[2:] * np.uint32(2_246_822_519)
        for grams in (two[1:] if len(before) > 1 else two, three):  # the pair within ``before`` was counted with its own block
            counts += np.bincount((grams ^ (grams >> np.uint32(15))) % np.uint32(CELLS), minlength=CELLS)
        before = x[-2:]
    counts[BLANK] = 0
    return counts


def blank_cells() -> np.ndarray:
    x = np.uint32(32)
    with np.errstate(over="ignore"):
        two = x * np.uint32(2_654_435_761) + x * np.uint32(40_503)
        three = two * np.uint32(31) + x * np.uint32(2_246_822_519)
    return np.array([(g ^ (g >> np.uint32(15))) % np.uint32(CELLS) for g in (two, three)])


#: Cells of runs of blanks, which say nothing of a language.
BLANK = blank_cells()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(length, 1e-12)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, bars: np.ndarray):
        self.languages, self.idf, self.centroids, self.owner, self.bars = languages, idf, centroids, owner, bars

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit((np.log1p(counts) * self.idf).astype(np.float32))

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return self.owner[best], cosines[np.arange(len(best)), best]

    def reached(self, counts: np.ndarray) -> np.ndarray:
        """Cosine of the nearest centroid of each language."""
        cosines = self.vectors(counts) @ self.centroids.T
        return np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)

    def expected(self, own: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The bar of each text's language at its number of n-grams."""
        x, bars = np.log(np.maximum(grams, 1)), np.empty(len(own))
        for k in np.unique(own):
            bars[own == k] = np.interp(x[own == k], np.log(LENGTHS), self.bars[k])
        return bars


def piece_of(text: str, letters: int = PIECE) -> str:
    """A piece of the text that starts at a place given by its length."""
    at = (len(text) * 7919) % max(1, len(text) - letters)
    return text[at : at + letters]


def noise(letters: int, each: int = 12) -> list[str]:
    """Texts of no language: letters of several scripts drawn at random, with and without spaces, and encoded bytes."""
    draw = random.Random(letters)
    made = []
    for first, last in ((97, 122), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x4E00, 0x9FA5)):
        for k in range(each):
            run = "".join(chr(draw.randint(first, last)) for _ in range(letters))
            made.append(run if k % 2 else " ".join(run[i : i + 6] for i in range(0, letters, 6)))
    for _ in range(each):
        data = draw.randbytes(letters)
        made += [base64.b64encode(data).decode()[:letters], data.hex()[:letters]]
    return made


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """At most ``per_language`` rows of each language, the least by hash of the id, found from ids alone before texts are read."""
    labelled = docs.where(may_learn(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    tallies = labelled.groupBy(lang_col).agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(tallies) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, and the driver's memory with it")
    if not tallies:
        return labelled.limit(0).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    lot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    chosen = F.lit(False)
    for row in tallies:  # the lot alone leaves about twice the bound, the rank the bound itself
        chosen = chosen | ((F.col(lang_col) == row[0]) & (lot < int(min(1.0, 2.0 * per_language / row["n"]) * (1 << 40))))
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(lot, id_col))
    return labelled.where(chosen).withColumn("__rank", rank).where(F.col("__rank") <= per_language).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """At most ``per_language`` rows of each of at most ``max_languages`` languages (more raise an error) are learned from. Counts are made by tasks; the driver gets a short vector of cells for each training row, a bounded number."""

    def pack(texts: list[str | None]) -> dict[str, pa.Array]:
        cells = lambda t: np.minimum(counts_of(t), 65_535).astype("<u2").tobytes()
        return {"cells": pa.array([cells(t) for t in texts], pa.binary()), "piece": pa.array([cells(piece_of(t)) for t in texts], pa.binary())}

    chosen = training_rows(docs, id_col, text_col, lang_col, per_language, max_languages)
    rows = arrow_columns(chosen, pack, "text", [("cells", T.BinaryType()), ("piece", T.BinaryType())], ["lang"]).collect()
    rows = sorted(r for r in ((r["lang"], bytes(r["cells"]), bytes(r["piece"])) for r in rows) if r[1].strip(b"\0"))
    if not rows:
        return None
    counts, pieces = (np.frombuffer(b"".join(r[k] for r in rows), "<u2").reshape(len(rows), CELLS) for k in (1, 2))
    languages = sorted({r[0] for r in rows})
    owner = np.array([languages.index(r[0]) for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x, short = (unit((np.log1p(c) * idf).astype(np.float32)) for c in (counts, pieces))
    found, owners = [], []
    for k in range(len(languages)):
        for c in (*spherical_means(x[owner == k], centroids), *unit(short[owner == k].mean(axis=0, keepdims=True))):
            found.append(c)
            owners.append(k)
    model = Model(languages, idf, np.array(found, np.float32), np.array(owners), np.zeros((len(languages), len(LENGTHS))))
    model.bars = bars_of(chosen, model)
    return model


def bars_of(chosen: DataFrame, model: Model) -> np.ndarray:
    """The bar of each language and length. Tasks compare pieces of the training rows; the driver gets their cosines alone."""
    index = {name: k for k, name in enumerate(model.languages)}

    def compare(langs: list[str], texts: list[str]) -> list[list[float]]:
        """For each row its cosines by length, -1 where the text is shorter."""
        made = []
        for name, text in zip(langs, texts):
            counts = np.array([counts_of(piece_of(text, int(n) // 2)) for n in LENGTHS])
            reached = model.reached(counts)[:, index[name]] if name in index else np.full(len(LENGTHS), -1.0)
            made.append(np.where(counts.sum(axis=1) * 4 >= LENGTHS * 3, reached, -1.0).tolist())
        return made

    def run(batches):
        for batch in batches:
            for lo, hi in spans_of(batch.column(1)):
                langs, texts = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(compare(langs, texts), pa.list_(pa.float64()))], names=["lang", "cosines"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    rows = chosen.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, schema).collect()
    random_texts = [model.reached(np.array([counts_of(t) for t in noise(int(n) // 2)])).max(axis=0) for n in LENGTHS]
    bars = np.zeros((len(model.languages), len(LENGTHS)))
    for name, k in index.items():
        cosines = np.array([r["cosines"] for r in rows if r["lang"] == name]).reshape(-1, len(LENGTHS))
        clean = 0.0
        for i in range(len(LENGTHS)):
            there = cosines[cosines[:, i] >= 0, i]
            clean = float(np.quantile(there, TRIMMED)) if len(there) >= LEAST else clean  # else as at the length before
            floor = min(float(random_texts[i][k]), clean)
            bars[k, i] = floor + PLACE * (clean - floor)
    return bars


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids; the first is the row nearest to the mean, each next one the row farthest from those before."""
    k = min(k, len(x))
    centres = [x[(x @ x.mean(axis=0)).argmax()]]
    while len(centres) < k:
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([unit(x[own == j].mean(axis=0, keepdims=True))[0] if (own == j).any() else c[j] for j in range(len(c))])
    return c


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (cosine of the nearest centroid, 0 to 1) and rejected."""

    def predict(texts: list[str | None]) -> dict[str, pa.Array]:
        known = np.array([model is not None and has_letter(t) for t in texts], bool)
        names: list[str] = [UNDETERMINED] * len(texts)
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        at = np.flatnonzero(known)
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            counts = np.array([counts_of(texts[i]) for i in part])
            own, cosines = model.nearest(counts)
            scores[part] = np.clip(cosines, 0.0, 1.0)
            rejected[part] = cosines < model.expected(own, counts.sum(axis=1))
            for i, k in zip(part, own):
                names[i] = model.languages[k]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "rejected": pa.array(rejected)}

    return arrow_columns(docs, predict, text_col, OUTPUTS, keep)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    own = docs.columns
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    found = identify(renamed, model, f"c{own.index(text_col)}").where(~F.col("rejected"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def language_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
