"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal.

Statistics of the whole text are cut into at most 64 bins by training quantiles; each boosting round grows one tree level by
level from histograms of gradients and Hessians of the logistic loss. All trees lie in flat arrays (feature, threshold, left,
right, value), and a batch walks every tree together: one gather per level.

Training reads at most ``max_rows`` labelled rows (the least by hash of the id), a bound of the operator; all texts are scored.

Defined results: null and empty texts have all statistics zero and are scored like any other; an id labelled twice counts with
its least label; without training rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, is_held_out, may_learn

MAX_ROWS = 20_000
FEATURES = ("chars", "words", "word_length", "upper", "digits", "marks", "odd_marks", "spaces", "wide", "distinct_words", "top_word", "repeats", "adjacent", "lines", "line_length", "line_copies", "short_words", "long_words", "ends", "word_spread", "pipes", "capitals")
ODD = frozenset(b"%*#$&|^~`=<>{}[]\\@_!")
MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
IS_ODD = np.array([b in ODD for b in range(256)])
#: Words of a text that are Python objects at once.
PIECE_WORDS = 500_000


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one text; words of very long texts are gathered piece by piece."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    tally = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    counts: dict[bytes, int] = {}
    words = adjacent = capitals = 0
    last = b""
    rest = data
    while rest:
        part = rest.split(None, PIECE_WORDS)
        rest = part.pop() if len(part) > PIECE_WORDS else b""
        words += len(part)
        for w in part:
            counts[w] = counts.get(w, 0) + 1
            adjacent += w == last
            last = w
    if not words:
        return [float(len(text)), 0.0] + [0.0] * (len(FEATURES) - 2)
    lengths = np.fromiter(map(len, counts), np.float64, len(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))
    capitals = sum(c for w, c in counts.items() if 65 <= w[0] <= 90)
    mean = float((lengths * weights).sum() / words)
    spread = float(np.sqrt(max(0.0, (lengths * lengths * weights).sum() / words - mean * mean)))
    lines = data.split(b"\n")
    return [
        float(len(text)), float(words), mean, tally[65:91].sum() / n, tally[48:58].sum() / n, tally[MARK].sum() / n, tally[IS_ODD].sum() / n,
        (tally[32] + tally[9:14].sum()) / n, tally[128:].sum() / n, len(counts) / words, float(weights.max()) / words,
        float(weights[weights > 1].sum()) / words, adjacent / words, float(len(lines)), len(data) / len(lines), 1.0 - len(set(lines)) / len(lines),
        float(weights[lengths <= 3].sum()) / words, float(weights[lengths > 12].sum()) / words, tally[46] / words, spread, tally[124] / words, capitals / words,
    ]


@dataclass
class Forest:
    """Trees as rows of flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(down, self.left[trees, at], self.right[trees, at])
        return self.base + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boost ``rounds`` trees on rows ``x`` with labels ``y`` in {0, 1}."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, size = np.full(len(y), base), 2 ** (depth + 1) - 1
    out = {k: np.zeros((rounds, size), t) for k, t in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float))}
    for r in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        out["left"][r] = out["right"][r] = np.arange(size)
        for level in range(depth):
            lo, width = 2**level - 1, 2**level
            open_rows = np.flatnonzero(node >= lo)
            if not len(open_rows):
                break
            local = node[open_rows] - lo
            best = np.full(width, 1e-6)
            split: list[tuple[int, int] | None] = [None] * width
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (len(c) + 1) + binned[open_rows, j]
                g, h, k = (np.bincount(key, w, width * (len(c) + 1)).reshape(width, -1).cumsum(axis=1) for w in (grad[open_rows], hess[open_rows], None))
                gain = g[:, :-1] ** 2 / (h[:, :-1] + ridge) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(k[:, :-1] < least) | (k[:, -1:] - k[:, :-1] < least)] = 0
                at = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[i], split[i] = gain[i, at[i]], (j, int(at[i]))
            for i, chosen in enumerate(split):
                if chosen:
                    j, cut = chosen
                    here = lo + i
                    out["feature"][r, here], out["threshold"][r, here] = j, cuts[j][cut]
                    out["left"][r, here], out["right"][r, here] = 2 * here + 1, 2 * here + 2
                    own = open_rows[local == i]
                    node[own] = np.where(binned[own, j] <= cut, 2 * here + 1, 2 * here + 2)
        total_g, total_h = np.bincount(node, grad, size), np.bincount(node, hess, size)
        out["value"][r] = rate * total_g / (total_h + ridge)
        margin += out["value"][r, node]
    return Forest(**out, base=base, depth=depth)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Forest | None:
    """Labels are sampled first (ids only); the driver gets one row of statistics for each of at most ``max_rows`` rows."""
    usable = labels.where(may_learn(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), id_col)  # bounded by max_rows
    made = arrow_columns(rows, _statistics_column, "text", [("x", T.ArrayType(T.DoubleType()))], [id_col, "label"])
    # ids may repeat: still no more than ``max_rows``
    made = made.orderBy(F.xxhash64(id_col), id_col, "x").limit(max_rows).select("label", "x").collect()
    made = sorted((tuple(r["x"]), int(r["label"])) for r in made)
    if not made:
        return None
    return grow(np.array([r[0] for r in made]), np.array([r[1] for r in made], float))


def _statistics_column(texts: list[str | None]) -> dict[str, pa.Array]:
    return {"x": pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))}


def scored(docs: DataFrame, model: Forest | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, 0 to 1, higher where the label 1 is likelier."""

    def score(texts: list[str | None]) -> dict[str, pa.Array]:
        if model is None:
            return {"score": pa.array(np.full(len(texts), 0.5))}
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
        return {"score": pa.array(np.concatenate([model.score(x[lo : lo + 1024]) for lo in range(0, len(x), 1024)] or [np.zeros(0)]))}

    return arrow_columns(docs, score, text_col, [("score", T.DoubleType())], keep)


def quality_digest(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
