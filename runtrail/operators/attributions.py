"""Attributions of boosted trees: Shapley values along decision paths, over trees flattened into arrays.

A tree is a set of leaves; a leaf is its value and, for every feature on its path, the interval that leads to it and the share of
training rows that goes its way. With some features known and the others not, a leaf counts with its value times, for each feature
on its path, whether the row is in the interval (known) or the share (unknown). The Shapley values of that game are exact in the
features of one path: they depend on which intervals hold the row, so a leaf's values are tabled by that pattern (or computed for
each row where a path has many features), and rows of an Arrow batch are looked up together.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: Features of a path up to which all patterns are tabled, and rows that are looked up at once.
TABLED, SLAB_ROWS = 10, 4096


@dataclass(frozen=True)
class Leaf:
    """``value``: of the leaf times its tree's weight. Row i of the arrays: a feature, its interval (low, high], its share of rows."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves_of(nodes: dict[int, tuple[int, float, int, int, float, float]], weight: float = 1.0) -> list[Leaf]:
    """Leaves of a tree of nodes {number: (feature, threshold, left, right, value, rows)}; the root is 0, a leaf's left is -1.

    A row goes left where its feature is at most the threshold.
    """
    found, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        feature, threshold, left, right, value, rows = nodes[at]
        if left < 0:
            names = sorted(path)
            parts = np.array([path[f] for f in names], np.float64).reshape(-1, 3)
            found.append(Leaf(value * weight, np.array(names, np.int64), parts[:, 0], parts[:, 1], parts[:, 2]))
            continue
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            stack.append((child, path | {feature: (*bounds, share * nodes[child][5] / rows)}))
    return found


def path_values(held: np.ndarray, share: np.ndarray, value: float) -> np.ndarray:
    """Shapley values (rows x features) of a leaf for rows whose features hold (1) or not (0) its intervals."""
    rows, m = held.shape
    out = np.empty((rows, m))
    weights = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    for i in range(m):
        # coefficient k: the sum over all sets of k known features among the others
        sums = np.zeros((rows, m))
        sums[:, 0] = 1.0
        for j in range(m):
            if j != i:
                known = sums[:, :-1] * held[:, j : j + 1]
                sums *= share[j]
                sums[:, 1:] += known
        out[:, i] = (held[:, i] - share[i]) * (sums @ weights)
    return out * value


class Forest:
    """The leaves of an ensemble and what they give without any feature known."""

    def __init__(self, leaves: list[Leaf]):
        self.leaves = leaves
        self.expected = float(sum(leaf.value * leaf.share.prod() for leaf in leaves))
        self.tables: list[np.ndarray | None] = []
        for leaf in leaves:
            m = len(leaf.features)
            patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(np.float64) if m <= TABLED else None
            self.tables.append(path_values(patterns, leaf.share, leaf.value) if patterns is not None else None)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (rows x features); with ``expected`` they add up to the margin."""
        out = np.zeros(x.shape)
        for leaf, table in zip(self.leaves, self.tables):
            if not len(leaf.features):
                continue
            part = x[:, leaf.features]
            held = (part > leaf.low) & (part <= leaf.high)
            if table is None:
                out[:, leaf.features] += path_values(held.astype(np.float64), leaf.share, leaf.value)
            else:
                out[:, leaf.features] += table[held @ (1 << np.arange(len(leaf.features)))]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for leaf in self.leaves:
            part = x[:, leaf.features]
            total += leaf.value * ((part > leaf.low) & (part <= leaf.high)).all(axis=1)
        return total


def forest_of(model: GBTClassificationModel, spark: SparkSession) -> Forest:
    """The trees of a fitted gate, read from its stored form: a table of a row per node."""
    path = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("rawCount").cast("double").alias("rows"), F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("kinds"))
    trees: dict[int, dict] = {}
    for r in rows.toLocalIterator():  # a row per node: trees times leaves, set by the model's parameters
        if r["leftChild"] >= 0 and r["kinds"] >= 0:
            raise ValueError("a split over categories has no interval")
        trees.setdefault(r["treeID"], {})[r["id"]] = (r["feature"], r["threshold"], r["leftChild"], r["rightChild"], r["prediction"], r["rows"])
    return Forest([leaf for t, nodes in sorted(trees.items()) for leaf in leaves_of(nodes, model.treeWeights[t])])


def with_contributions(rows: DataFrame, forest: Forest, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), ``expected`` and ``contributions``, an array beside ``features``; null features give null."""
    keep = [c for c in (rows.columns if keep is None else keep) if c not in ("expected", "contributions")]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType, True) for c in keep), T.StructField("expected", T.DoubleType()), T.StructField("contributions", T.ArrayType(T.DoubleType()))])
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # bounded by trees times leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLAB_ROWS):
                part = batch.slice(lo, SLAB_ROWS)
                column = part.column(part.schema.get_field_index(features))
                there = np.flatnonzero(np.asarray(column.is_valid()))
                made: list = [None] * part.num_rows
                if len(there):
                    x = np.array(column.take(pa.array(there)).to_pylist(), np.float64)
                    for i, values in zip(there.tolist(), shared.value.contributions(x)):
                        made[i] = values
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([shared.value.expected] * part.num_rows), pa.array(made, pa.list_(pa.float64()))], names=[*keep, "expected", "contributions"])

    return rows.select(*{c: None for c in [*keep, features]}).mapInArrow(run, schema)


def top_contributions(rows: DataFrame, key: str, names: list[str] | None = None, k: int = 8) -> DataFrame:
    """(key, rank, feature, contribution): the ``k`` largest of each row by size, rounded to 4, none of no size."""
    entry = F.transform("contributions", lambda v, i: F.struct((-F.abs(v)).alias("order"), i.alias("at"), F.round(v, 4).alias("contribution")))
    best = F.slice(F.array_sort(F.filter(entry, lambda e: e["contribution"] != 0)), 1, k)
    each = rows.select(key, F.posexplode(best).alias("rank", "e"))
    feature = F.get(F.array(*map(F.lit, names)), F.col("e.at")) if names else F.concat(F.lit("f"), F.col("e.at").cast("string"))
    return each.select(key, (F.col("rank") + 1).alias("rank"), feature.alias("feature"), F.col("e.contribution").alias("contribution"))
