"""Provenance graphs as node and edge tables: reconstruction, roots, children, descendants, diagrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import diagram_label
from ..session import staged
from .events import RELATIONS, lookup, with_technique


def edges(events: DataFrame) -> DataFrame:
    """(run_id, seq, ts, src, dst, relation), one per event that is kept; API calls only with a technique."""
    rows = with_technique(events).where(~((F.col("type") == "api_call") & F.col("technique").isNull()))
    relation, kind = (lookup({k: v[i] for k, v in RELATIONS.items()}, F.col("type")) for i in (0, 1))
    child = F.concat(F.lit("proc:"), F.coalesce(F.col("child_pid").cast("string"), F.lit("-1")))
    object_ = F.concat(kind, F.lit(":"), F.coalesce("target", F.lit("None")))
    return rows.select("run_id", "seq", "ts", F.concat(F.lit("proc:"), F.col("pid").cast("string")).alias("src"), F.when(kind == "proc", child).otherwise(object_).alias("dst"), relation.alias("relation"), "image", "target")


def nodes(events: DataFrame, with_place: bool = False) -> DataFrame:
    """(run_id, id, kind, label[, at]): every endpoint once, with the label it had first, and where that was."""
    e = edges(events)
    sources = e.select("run_id", F.col("src").alias("id"), (F.col("seq") * 2).alias("at"), F.concat(F.col("image"), F.lit(" ("), F.substring_index("src", ":", -1), F.lit(")")).alias("label"))
    targets = e.select("run_id", F.col("dst").alias("id"), (F.col("seq") * 2 + 1).alias("at"), F.coalesce("target", F.lit("None")).alias("label"))
    seen = sources.unionByName(targets).groupBy("run_id", "id").agg(F.min_by("label", "at").alias("label"), F.min("at").alias("at"))
    return seen.select("run_id", "id", F.substring_index("id", ":", 1).alias("kind"), "label", *(["at"] if with_place else []))


def roots(events: DataFrame) -> DataFrame:
    """Process nodes that no edge leads to."""
    e = edges(events)
    return nodes(events).where("kind = 'proc'").join(e.select("run_id", F.col("dst").alias("id")), ["run_id", "id"], "left_anti")


def children(edge_table: DataFrame, node: str) -> DataFrame:
    return edge_table.where(F.col("src") == node).select("run_id", "dst", "relation", "seq")


def descendants(edge_table: DataFrame, starts: DataFrame, max_rounds: int = 1000, keep=None) -> DataFrame:
    """(run_id, start, id): all that each start reaches, itself only on a cycle. Rounds follow the longest shortest path.

    Each round joins only what the round before found and writes only that; ``keep`` cuts lineage (default: a table in the
    shared folder). More than ``max_rounds`` rounds are an error, never a part of the result.
    """
    keep = keep or (lambda df: staged(df, "reach"))
    steps = edge_table.select("run_id", F.col("src").alias("id"), "dst").distinct()
    frontier = starts.select("run_id", F.col("id").alias("start"), "id")
    found: list[DataFrame] = []
    for _ in range(max_rounds):
        onward = frontier.join(steps, ["run_id", "id"]).select("run_id", "start", F.col("dst").alias("id")).distinct()
        if found:
            onward = onward.join(reduce(DataFrame.unionByName, found), ["run_id", "start", "id"], "left_anti")
        frontier = keep(onward)
        if not frontier.take(1):
            return reduce(DataFrame.unionByName, found) if found else frontier
        found.append(frontier)
        if len(found) == 16:  # few files, each row written a few times at most
            found = [keep(reduce(DataFrame.unionByName, found))]
    raise RuntimeError(f"more is reached after {max_rounds} rounds")


def diagrams(events: DataFrame) -> DataFrame:
    """(run_id, diagram): a flow chart of each run: numbered nodes in order of their first event, then edges in order."""
    numbered = nodes(events, with_place=True).withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("at")) - 1)
    name = F.concat(F.lit("n"), F.col("n").cast("string"))
    boxes = numbered.select("run_id", F.lit(0).alias("part"), F.col("n").cast("long").alias("o"), F.concat(F.lit("  "), name, F.lit('["'), F.col("kind"), F.lit(": "), diagram_label(F.col("label")), F.lit('"]')).alias("line"))
    end = lambda side: numbered.select("run_id", F.col("id").alias(side), name.alias(f"{side}_name"))
    drawn = edges(events).join(end("src"), ["run_id", "src"]).join(end("dst"), ["run_id", "dst"])
    arrows = drawn.select("run_id", F.lit(1).alias("part"), F.col("seq").alias("o"), F.concat(F.lit("  "), F.col("src_name"), F.lit(' -->|"'), F.col("relation"), F.lit('"| '), F.col("dst_name")).alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("part", "o", "line")))
    return boxes.unionByName(arrows).groupBy("run_id").agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n")).alias("diagram"))
