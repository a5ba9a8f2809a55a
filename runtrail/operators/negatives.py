"""The negative corpus: which families have a line, how common an import is, and both without one family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import hash_ranked


def line_families(lines: DataFrame) -> DataFrame:
    """(category, line, families) of (category, line, family)."""
    return lines.groupBy("category", "line").agg(F.array_sort(F.collect_set("family")).alias("families"))


def lines_without(table: DataFrame, family: str | None) -> DataFrame:
    """Lines that stay negatives for a family: those seen in it alone go, shared ones stay."""
    return table if family is None else table.where(~((F.size("families") == 1) & (F.get("families", F.lit(0)) == family)))


def import_prevalence(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(family, token, p): share of a family's runs with a token; tokens of fewer than ``least`` runs go. Rounded to 4."""
    rows = tokens.select("family", "run_id", "token").distinct()
    size = tokens.groupBy("family").agg(F.count_distinct("run_id").alias("runs"))
    return _shares(rows, size, least)


def set_prevalence(sets: DataFrame, least: int = 2) -> DataFrame:
    """``import_prevalence`` of (family, run_id, tokens) with one row of distinct tokens a run: no token is shuffled with its run."""
    sets = sets.where(F.size("tokens") > 0)
    return _shares(sets.select("family", F.explode("tokens").alias("token")), sets.groupBy("family").agg(F.count("*").alias("runs")), least)


def _shares(rows: DataFrame, size: DataFrame, least: int) -> DataFrame:
    counts = rows.groupBy("family", "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(size, "family").select("family", "token", F.round(F.col("n") / F.col("runs"), 4).alias("p"))


def prevalence_without(prevalence: DataFrame, family: str | None) -> DataFrame:
    """(token, p): the greatest over the other families."""
    rows = prevalence if family is None else prevalence.where(F.col("family") != family)
    return rows.groupBy("token").agg(F.max("p").alias("p"))


def sampled_runs(runs: DataFrame, per_family: int = 200, seed: int = 0) -> DataFrame:
    """At most ``per_family`` runs of each family, by hash of their identity: the same on every run."""
    return hash_ranked(runs, "family", "run_id", seed, "__n").where(F.col("__n") <= per_family).drop("__n")


def mean_prevalence(tokens: DataFrame, runs: DataFrame, prefix: str = "imp:") -> DataFrame:
    """(token, p): share of all ``runs`` that have a token of a prefix; ``tokens``: (run_id, token)."""
    n = runs.select("run_id").distinct().agg(F.count("*").alias("n"))
    own = tokens.where(F.startswith("token", F.lit(prefix))).join(runs.select("run_id").distinct(), "run_id", "left_semi").distinct()
    return own.groupBy("token").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("token", (F.col("c") / F.col("n")).alias("p"))  # one row


def merged_corpora(*tables: DataFrame) -> DataFrame:
    """(category, line, families) of several line tables, the families of equal lines united."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("category", "line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"))


def without_members(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Runs that are no members of a packaged corpus."""
    return runs.join(members.select("run_id").distinct(), "run_id", "left_anti")


def corpus_differences(packaged: DataFrame, drawn: DataFrame) -> DataFrame:
    """(category, line, side): lines that only one of two corpora has; none where a new draw gives the packaged one."""
    p, d = packaged.select("category", "line").distinct(), drawn.select("category", "line").distinct()
    return p.exceptAll(d).withColumn("side", F.lit("packaged")).unionByName(d.exceptAll(p).withColumn("side", F.lit("drawn")))
