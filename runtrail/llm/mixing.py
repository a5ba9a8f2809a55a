"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by its weight, at most ``cap`` times its own size, the excess shared anew by weight: the
water level over caps and weights. A document's expected copies are its source's target over the source's size. Expected copies
are prefix-summed within the source, one random offset is added per source, and a document is emitted once for each integer
boundary that its step crosses. Documents are summed in order of size class, so that the copies spread evenly over sizes and
the words taken come near the target.

The prefix sum is distributed: documents fall into groups (source, size class, hash of the id); group counts are aggregated
before any shuffle and their running totals give each group its first rank, so no task ever holds a source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words has target
0 and nothing is taken from it; rows that repeat an id count each, in order of a
hash of their texts; a null id sorts first in its group; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 20_240_229
#: Documents to a group of the prefix sum, about: the largest class of the largest source holds a few hundredths of all rows.
ROWS_PER_SPLIT = 5_000_000
LEAST_SPLITS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Four classes to each doubling of the size, in whole numbers."""
    binary = F.length(F.bin(size + 1))
    return (binary * 4 + F.expr("shiftright(size + 1, greatest(length(bin(size + 1)) - 3, 0)) & 3")).cast("int")


def lot(value: Column, digits: int = 8) -> Column:
    """A number from the MD5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """From (source, source_size), one row per source, the target of each: min(cap * size, level * weight), summing to all sizes.

    In order of cap over weight, capping one source more raises the level as long as that source was above its cap and lowers it
    afterwards, so the level is the greatest over all prefixes. One task sorts the sources, as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__rank", F.row_number().over(order) - 1).withColumn("__w", F.get(F.array(*map(F.lit, weights)), F.col("__rank") % len(weights)))
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    rising = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("__all", F.sum("source_size").over(everything).cast("double")).withColumn("__level", level)
    ranked = ranked.withColumn("__final", F.max("__level").over(everything))
    return ranked.select("source", "source_size", F.least("__cap", F.col("__final") * F.col("__w")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every document with size, source_size, target (its source's) and copies; ``keep`` names the columns passed through."""
    made = ("size", "source_size", "target", "copies")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    own = {"__id": F.col(id_col), "__source": F.col(source_col), "size": word_count(F.col(text_col))}
    splits = max(LEAST_SPLITS, math.ceil(docs.select(F.count("*").alias("n")).first()["n"] / ROWS_PER_SPLIT))
    group = ["__null", "__key", "__class", "__split"]

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"__null": F.col("__source").isNull(), "__key": F.coalesce("__source", F.lit("")), "__class": size_class(F.col("size")), "__split": (lot(F.coalesce(F.col("__id").cast("string"), F.lit(""))) % splits).cast("int")})

    sized = docs.select(*keep, *[c.alias(n) for n, c in own.items()], lot(F.coalesce(text_col, F.lit("")), 15).alias("__lot"))
    if text_col in keep:  # words are counted twice, so that texts are not written
        plain = docs.select(*[c.alias(n) for n, c in own.items()])
    else:
        plain = sized = staged(sized, "mixing-sizes")
    counts = staged(grouped(plain).groupBy(*group).agg(F.count("*").alias("__n"), F.sum("size").alias("__words")), "mixing")
    sizes = counts.groupBy("__null", "__key").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col("__null"), F.col("__key")).alias("source"), "source_size"), weights, cap)
    targets = targets.withColumns({"__null": F.col("source").isNull(), "__key": F.coalesce("source", F.lit(""))}).drop("source")
    earlier = Window.partitionBy("__null", "__key").orderBy("__class", "__split").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n", "__words").join(targets, ["__null", "__key"])
    at = F.col("__first") + F.row_number().over(Window.partitionBy(*group).orderBy("size", F.col("__id").asc_nulls_first(), "__lot"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = lot(F.concat(F.lit(f"{seed}:"), F.when(F.col("__null"), "null").otherwise(F.concat(F.lit("="), "__key")))) / F.lit(float(1 << 32))
    step = F.floor(F.col("__ratio") * F.col("__at") + F.col("__u")) - F.floor(F.col("__ratio") * (F.col("__at") - 1) + F.col("__u"))
    ranked = grouped(sized).join(first, group).withColumns({"__at": at, "__ratio": ratio, "__u": offset})
    return ranked.select(*keep, "size", "source_size", "target", F.least(step, F.lit(math.ceil(cap))).cast("long").alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per copy taken, numbered in ``copy`` from 1, with the other columns unchanged."""
    own = [c for c in docs.columns if c != "copy"]
    taken = mixed(docs, keep=own, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*own, "copy")


def mixing_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
