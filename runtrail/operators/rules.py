"""Rule synthesis: candidate ladders, matching of patterns against lines, veto by negatives, selection, evaluation."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from ..functions.text import hex_or, image_of, ladder_base, ladder_from, literal_length, sigma_value, stripped, tidy, without_identity, without_numbers, yaml_quoted, yara_string
from ..session import staged
from .automaton import short_matches
from .events import CATEGORIES, lookup, with_technique
from .overlaps import hit_rules

MIN_LITERAL, MAX_RULES = 10, 10
#: Literal letters of a pattern by which it finds its lines.
GRAM = 6


#: What the ladder of an action is made of: its category, the first pattern and, of a process, the pattern of its arguments.
SHAPE = ["category", "base", "whole"]


def actions(events: DataFrame) -> DataFrame:
    """(run_id, first_seq, category, source, base, whole): the distinct actions of a run, each with the shape of its ladder."""
    category = lookup(CATEGORIES, F.col("type"))
    cmd, target = F.coalesce("cmdline", F.lit("")), F.coalesce("target", F.lit(""))
    source = F.coalesce(F.nullif(cmd, F.lit("")), target)
    rows = events.select("run_id", "seq", category.alias("category"), cmd.alias("cmd"), target.alias("target"), F.lower(source).alias("key")).where("category is not null and key <> ''")
    first = rows.groupBy("run_id", "category", "key").agg(F.min_by(F.struct("seq", "cmd", "target"), "seq").alias("e")).select("run_id", "category", "e.*")
    process = F.col("category") == "process_creation"
    rest = F.when(F.startswith("cmd", F.lit('"')), F.expr("substring(cmd, length(image) + 3)")).otherwise(F.expr("substring(cmd, length(image) + 1)"))
    named = first.withColumn("image", F.when(process, image_of(F.col("cmd"), F.col("target")))).withColumn("args", F.when(process, stripped(rest)))
    whole = tidy(F.concat(F.lit("*"), tidy(without_numbers(without_identity(F.col("args")))), F.lit("*")))
    base = ladder_base(F.when(process, F.col("image")).otherwise(F.col("target")))
    return named.select("run_id", F.col("seq").alias("first_seq"), "category", F.when(process, F.col("cmd")).otherwise(F.col("target")).alias("source"), base.alias("base"), F.when(F.col("args") != "", whole).otherwise(F.lit("")).alias("whole"))


def ladders(acts: DataFrame) -> DataFrame:
    """(category, base, whole, pos, rung, pattern, specific): the ladder of each distinct shape of ``actions``, made once.

    A process has one rule more before its ladder, of its image and arguments. ``pattern`` is matched against whole lines;
    ``specific`` tells whether enough of it is literal.
    """
    rows = acts.select(*SHAPE).distinct().withColumn("images", F.when(F.col("category") == "process_creation", ladder_from(F.col("base"), "image")))
    entry = lambda rung, pattern, literal: F.struct(rung.cast("int").alias("rung"), pattern.alias("pattern"), literal.alias("specific"))
    plain = lambda rungs, suffix="": F.transform(rungs, lambda p, i: entry(i, F.concat(p, F.lit(suffix)), literal_length(p) >= MIN_LITERAL))
    second = F.get(F.col("images"), F.least(F.lit(1), F.size("images") - 1))
    both = entry(F.lit(0), F.concat(second, F.lit("\t"), F.col("whole")), (literal_length(second) >= MIN_LITERAL) | (literal_length(F.col("whole")) >= MIN_LITERAL))
    process = F.when(F.col("whole") != "", F.concat(F.array(both), plain(F.col("images"), "\t*"))).otherwise(plain(F.col("images"), "\t*"))
    rungs = F.when(F.col("category") == "process_creation", process).when(F.col("category") == "registry_set", plain(ladder_from(F.col("base"), "key"))).otherwise(plain(ladder_from(F.col("base"), "path")))
    return rows.select(*SHAPE, F.posexplode(rungs).alias("pos", "r")).select(*SHAPE, "pos", "r.rung", "r.pattern", "r.specific")


def candidates(events: DataFrame) -> DataFrame:
    """(run_id, first_seq, category, source, pos, rung, pattern, specific): the ladder of each distinct action of a run."""
    acts = staged(actions(events), "actions")
    made = acts.join(staged(ladders(acts), "ladders"), SHAPE)
    return made.select("run_id", "first_seq", "category", "source", "pos", "rung", "pattern", "specific")


def picked(acts: DataFrame, passing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidates of actions (``actions``, family): of those of their shape and family that pass the last alone, which is all that
    ``selected`` takes. ``passing``: (ladders' columns, family); one candidate per value of ``keys`` where there are any."""
    keys = keys or []
    best = passing.groupBy(*SHAPE, "family", *keys).agg(F.max_by(F.struct("pos", "rung", "pattern"), "pos").alias("b")).select(*SHAPE, "family", *keys, "b.*")
    return of_actions(acts, best).select("run_id", "family", *keys, "first_seq", "category", "source", "pos", "rung", "pattern")


def of_actions(acts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows by shape and family joined with the actions (``actions``, family) that have both; a missing family is one too."""
    named = found.select(*[F.col(c).alias(f"own_{c}") if c in (*SHAPE, "family") else F.col(c) for c in found.columns])
    return acts.join(named, [*[F.col(c) == F.col(f"own_{c}") for c in SHAPE], F.col("family").eqNullSafe(F.col("own_family"))]).drop(*[f"own_{c}" for c in (*SHAPE, "family")])


def matches(patterns: DataFrame, lines: DataFrame) -> DataFrame:
    """(category, pattern, line): distinct patterns against distinct lines of their category, whole lines, any case.

    Patterns without a wildcard meet equal lines. Of the others each is keyed by the piece of ``GRAM`` literal letters that the
    fewest lines have, and meets only the lines with that piece; then the whole pattern is compared. Patterns without so long a
    piece are found by an automaton over all their pieces, in one pass over the lines.
    """
    # written first: each is read several times below
    p = staged(patterns.select("category", "pattern").distinct(), "patterns").withColumn("low", F.lower("pattern"))
    lines = staged(lines.select("category", "line").distinct(), "lines").withColumn("low_line", F.lower("line"))
    exact = p.where(~F.contains("pattern", F.lit("*")))
    wild = p.where(F.contains("pattern", F.lit("*")))
    found = exact.join(lines.withColumnRenamed("low_line", "low"), ["category", "low"])
    pieces = lambda text: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))
    own = F.array_distinct(F.filter(F.flatten(F.transform(F.split("low", r"\*"), pieces)), lambda g: F.length(g) == GRAM))
    keyed = wild.withColumn("grams", own)
    # pieces of lines count only if a pattern asks for them: an inner join with a short side before anything is grouped
    asked = staged(keyed.select("category", F.explode("grams").alias("gram")).distinct(), "asked-grams")
    places = F.sequence(F.lit(1), F.greatest(F.length("low_line") - (GRAM - 1), F.lit(1)))
    grams = lines.select("category", "line", "low_line", F.explode(places).alias("place")).withColumn("gram", F.substring("low_line", F.col("place"), F.lit(GRAM)))
    common = staged(grams.select("category", "gram").join(asked, ["category", "gram"]).groupBy("category", "gram").agg(F.count("*").alias("n")), "common-grams")
    options = keyed.select("category", "pattern", "low", F.size("grams").alias("asked"), F.explode("grams").alias("gram")).join(common, ["category", "gram"])
    # a pattern with a piece that no line has cannot match
    rarest = options.groupBy("category", "pattern", "low", "asked").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("had")).where("had = asked")
    near = staged(rarest.select("category", "pattern", "gram", *wildcard_pieces(F.col("low"))), "keyed-patterns").join(grams, ["category", "gram"])
    # a piece that a line has twice counts at its first place
    near = near.where(F.call_function("locate", F.col("gram"), F.col("low_line")) == F.col("place")).where(fitting(F.col("low_line")))
    short = short_matches(keyed.where(F.size("grams") == 0), lines)
    return found.select("category", "pattern", "line").unionByName(near.select("category", "pattern", "line")).unionByName(short)


def wildcard_pieces(pattern: Column) -> list[Column]:
    """(head, middle, tail): what stands before the first wildcard, between and after the last one."""
    parts = F.split(pattern, r"\*")
    return [F.get(parts, F.lit(0)).alias("head"), F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "").alias("middle"), F.element_at(parts, -1).alias("tail")]


def fitting(line: Column) -> Column:
    """Whether a whole line fits ``wildcard_pieces``: each at the first place behind the one before it, so that no pair compiles
    a regular expression, as ``LIKE`` does for a pattern that is a column."""
    place = lambda at, x: F.call_function("locate", x, line, at)
    after = F.aggregate("middle", F.length("head") + 1, lambda at, x: F.when((at > 0) & (place(at, x) > 0), place(at, x) + F.length(x)).otherwise(F.lit(0)))
    return F.startswith(line, F.col("head")) & F.endswith(line, F.col("tail")) & after.between(1, F.length(line) - F.length("tail") + 1)


def run_hits(patterns: DataFrame, lines: DataFrame) -> DataFrame:
    """(category, pattern, run_id) for every run with a line that a pattern matches."""
    return matches(patterns, lines).join(lines.select("run_id", "category", "line"), ["category", "line"]).select("category", "pattern", "run_id").distinct()


def surviving(rules: DataFrame, hits: DataFrame, max_neg_hits: int = 0, one_family: bool = False) -> DataFrame:
    """Candidates that are specific and hit at most ``max_neg_hits`` negative runs.

    ``hits``: (category, pattern, neg_run, neg_family); with ``family`` in the rules, negatives of the own family do not count. Then
    runs are counted by pattern and family before they meet a rule: those of others are all but those of its own family alone.
    ``one_family``: a pattern has a run once, with the one family that the run has, so nothing need be made distinct.
    """
    own = rules.where("specific")
    if "family" not in own.columns:
        asked = own.select("category", "pattern").distinct().join(hits, ["category", "pattern"])
        many = asked.groupBy("category", "pattern").agg(F.count_distinct("neg_run").alias("n")).where(F.col("n") > max_neg_hits)
        return own.join(many.drop("n"), ["category", "pattern"], "left_anti")
    known = hits.where("neg_run is not null and neg_family is not null")
    if one_family:
        known = known.withColumn("only", F.col("neg_family"))
    else:
        known = known.groupBy("category", "pattern", "neg_run").agg(F.min("neg_family").alias("low"), F.max("neg_family").alias("high"))
        known = known.withColumn("only", F.when(F.col("low") == F.col("high"), F.col("low")))
    counts = staged(known.groupBy("category", "pattern", "only").agg(F.count("*").alias("n")), "family-hits")
    total = counts.groupBy("category", "pattern").agg(F.sum("n").alias("total")).where(F.col("total") > max_neg_hits)
    asked = own.select("category", "pattern", "family").distinct().where("family is not null").join(total, ["category", "pattern"])
    same = counts.where("only is not null").select("category", "pattern", F.col("only").alias("family"), F.col("n").alias("same"))
    many = asked.join(same, ["category", "pattern", "family"], "left").where(F.col("total") - F.coalesce("same", F.lit(0)) > max_neg_hits)
    return own.join(many.select("category", "pattern", "family"), ["category", "pattern", "family"], "left_anti")


def selected(passing: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """Of each action the last pattern that passes; equal patterns once; the ``max_rules`` most general of each run."""
    best = passing.groupBy("run_id", "first_seq", "category").agg(F.max_by(F.struct("rung", "pattern", "source"), "pos").alias("b")).select("run_id", "first_seq", "category", "b.*")
    order = F.struct("first_seq", "category")
    once = best.groupBy("run_id", F.lower("pattern").alias("low")).agg(F.min_by(F.struct("first_seq", "category", "rung", "pattern", "source"), order).alias("b")).select("run_id", "b.*")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("rung"), "category", "first_seq"))
    return once.withColumn("rank", rank).where(F.col("rank") <= max_rules)


def synthesize(events: DataFrame, negative_lines: DataFrame, max_rules: int = MAX_RULES, max_neg_hits: int = 0, max_rung: int | None = None) -> DataFrame:
    """Rules of each run. ``events`` may carry ``family``; ``negative_lines``: (run_id, category, line[, family])."""
    rules = staged(candidates(events), "candidates")
    rules = rules if max_rung is None else rules.where(F.col("rung") <= max_rung)
    if "family" in events.columns:
        rules = rules.join(events.select("run_id", "family").distinct(), "run_id")
    family = F.col("family") if "family" in negative_lines.columns else F.lit(None).cast("string")
    families = negative_lines.select(F.col("run_id").alias("neg_run"), family.alias("neg_family")).distinct()
    hits = run_hits(rules, negative_lines).withColumnRenamed("run_id", "neg_run").join(families, "neg_run")
    return selected(surviving(rules, hits, max_neg_hits), max_rules)


def sigma_text(rules: DataFrame, sha_col: str = "sha256", technique_col: str = "technique") -> DataFrame:
    """Add ``sigma``: the rule as YAML, values escaped and quoted."""
    field = lambda name, value: F.concat(F.lit(f"        {name}: "), yaml_quoted(sigma_value(value)), F.lit("\n"))
    image, command = F.substring_index("pattern", "\t", 1), F.substring_index("pattern", "\t", -1)
    selection = (
        F.when(F.col("category") == "process_creation", F.concat(field("Image", image), F.when(command != "*", field("CommandLine", command)).otherwise(F.lit(""))))
        .when(F.col("category") == "registry_set", field("TargetObject", F.col("pattern")))
        .otherwise(field("TargetFilename", F.col("pattern")))
    )
    tag = F.regexp_replace(F.lower(F.coalesce(technique_col, F.lit(""))), "[^a-z0-9.]", "")
    tags = F.when(tag != "", F.concat(F.lit("tags:\n    - attack."), tag, F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("title: "), yaml_quoted(F.concat(F.col("category"), F.lit(" pattern"))), F.lit("\nstatus: experimental\ndescription: derived from run of "), hex_or(F.col(sha_col), 64, "unknown"), F.lit("\n"))
    body = F.concat(F.lit("logsource:\n    product: windows\n    category: "), F.col("category"), F.lit("\ndetection:\n    selection:\n"), selection, F.lit("    condition: selection\nlevel: medium\n"))
    return rules.withColumn("sigma", F.concat(head, tags, body))


# --- rules over file metadata


#: Most common tokens that are looked up by a broadcast, the others by a join.
HEAD_TOKENS = 1 << 16
#: Sets of a block of negatives that a token of a rule is tried on, round by round; what no round hits is tried on all.
TRIED = (64, 4096)


def rare_imports(static: DataFrame, prevalence: DataFrame, k: int = 8, cut: float = 0.05) -> DataFrame:
    """(run_id, imports): of (run_id, token) the k rarest imports, then those under ``cut``; rarity first, then name.

    As rarity comes first, imports from ``cut`` on stand behind all others and go before the k are taken.
    """
    own = static.where(F.startswith("token", F.lit("imp:"))).select("run_id", "token")
    frequent = F.broadcast(most_common(prevalence).where(F.col("p") >= cut).select("token"))
    sets = own.join(frequent, "token", "left_anti").groupBy("run_id").agg(F.collect_set("token").alias("tokens"))
    return rare_in_sets(sets, prevalence, k, cut)


def rare_in_sets(sets: DataFrame, prevalence: DataFrame, k: int = 8, cut: float = 0.05) -> DataFrame:
    """``rare_imports`` of (run_id, tokens) with rows of distinct tokens, one or several a run."""
    return rarest(rare_rows(sets.select("run_id", "tokens"), prevalence, k, cut), prevalence, k, cut)


def rare_rows(sets: DataFrame, prevalence: DataFrame, k: int, cut: float, held: bool = False) -> DataFrame:
    """Sets (.., tokens) with ``often``, the k rarest of their most common tokens, and ``rest``, all that are not among those.

    The ``HEAD_TOKENS`` most common tokens are looked up within the row, of which the k rarest stay; only the others, none of them
    more common, are joined. So a run's common tokens are neither shuffled nor sorted with those of all others. With ``held``, the
    tokens but the most common ones from ``cut`` on and their number ``n`` stand beside them.
    """
    spark = sets.sparkSession
    head = sorted((r["p"], r["token"]) for r in most_common(prevalence).collect())
    shared = spark.sparkContext.broadcast(([p for p, _ in head], [t for _, t in head]))
    entry = pa.struct([("p", pa.float64()), ("token", pa.string())])
    keep = [c for c in sets.columns if c != "tokens"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, names = shared.value
        under = bisect_left(shares, cut)
        shares, names = pa.array(shares, pa.float64()), pa.array(names, pa.string())
        for batch in batches:
            n, tokens = batch.num_rows, batch.column(len(keep))
            flat = tokens.flatten()
            rank = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False))
            near = (rank >= 0) & (rank < under)
            order = np.lexsort((rank[near], row[near]))
            at, found = row[near][order], rank[near][order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, found = at[first], pa.array(found[first])
            ends = lambda rows: pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())
            often = pa.StructArray.from_arrays([shares.take(found), names.take(found)], fields=list(entry))
            lists = lambda which: pa.ListArray.from_arrays(ends(row[which]), flat.filter(pa.array(which)))
            out = {c: batch.column(i) for i, c in enumerate(keep)} | {"often": pa.ListArray.from_arrays(ends(at), often), "rest": lists(rank < 0)}
            if held:
                out["tokens"] = lists(rank < under)
                out["n"] = out["tokens"].value_lengths()
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in keep) + ", often array<struct<p: double, token: string>>, rest array<string>" + ", tokens array<string>, n int" * held
    return staged(sets.select(*keep, "tokens").mapInArrow(looked_up, kinds), "rare-in-rows")


def rarest(rows: DataFrame, prevalence: DataFrame, k: int, cut: float) -> DataFrame:
    """(run_id, imports) of ``rare_rows``, one or several a run."""
    rest = rows.select("run_id", F.explode("rest").alias("token")).join(prevalence.select("token", "p"), "token", "left").withColumn("p", F.coalesce("p", F.lit(0.0))).where(F.col("p") < cut)
    found = rows.select("run_id", F.inline("often")).unionByName(rest.select("run_id", "p", "token"))
    rarest = F.slice(F.array_sort(F.collect_set(F.struct("p", "token"))), 1, k)
    return found.groupBy("run_id").agg(rarest.alias("r")).select("run_id", F.transform("r", lambda x: x["token"]).alias("imports"))


def most_common(prevalence: DataFrame) -> DataFrame:
    """(token, p) of the ``HEAD_TOKENS`` most common tokens."""
    return staged(prevalence.select("token", "p").orderBy(F.desc("p"), "token").limit(HEAD_TOKENS), "common-tokens")


def metadata_rules(static: DataFrame, negatives: DataFrame, prevalence: DataFrame, k: int = 8, share: float = 0.75, with_imphash: bool = True) -> DataFrame:
    """(run_id, imphash, imports, need): imphash or at least ``need`` imports; either part goes if a negative has it.

    ``static`` and ``negatives`` are (run_id, token); where both have ``family``, negatives of a run's own family do not count
    against it, so one call does all families against all others. Imports count from three on; need is rounded half to even, two at least.
    """
    imphash = static.where(F.startswith("token", F.lit("imphash:"))).groupBy("run_id").agg(F.substring_index(F.min("token"), ":", -1).alias("imphash"))
    prevalence = staged(prevalence.select("token", "p"), "prevalence")
    family = "family" in static.columns and "family" in negatives.columns
    own = static.groupBy("run_id").agg(named_min("family").alias("own")) if family else static.select("run_id", F.lit("own").alias("own")).distinct()
    neg = negatives.select("run_id", "token", (named("family") if family else F.lit("")).alias("side"))
    sets = neg.where(F.startswith("token", F.lit("imp:"))).groupBy("run_id", "side").agg(F.collect_set("token").alias("tokens"))
    kept = import_rules(rare_imports(static, prevalence, k), own, staged(sets.withColumn("n", F.size("tokens")), "negative-sets"), share)
    # the least and the greatest family of a token tell whether another one has it
    sides = neg.where(F.startswith("token", F.lit("imphash:"))).groupBy("token").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    known = imphash.withColumn("token", F.concat(F.lit("imphash:"), "imphash")).join(own, "run_id").join(sides, "token").where("low <> own or high <> own").select("run_id").distinct()
    imphash = imphash.join(known, "run_id", "left_anti") if with_imphash else imphash.limit(0)
    both = imphash.join(kept, "run_id", "full")
    return both.select("run_id", F.coalesce("imphash", F.lit("")).alias("imphash"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), F.coalesce("need", F.lit(0)).alias("need"))


def set_rules(sets: DataFrame, prevalence: DataFrame, k: int = 8, share: float = 0.75, cut: float = 0.05) -> DataFrame:
    """(run_id, imports, need): the import rules of ``metadata_rules`` of (family, run_id, tokens), a row of distinct tokens a family and run.

    All families against all others; tokens stay in their rows until the rarest ones are chosen.
    """
    prevalence = staged(prevalence.select("token", "p"), "prevalence")
    rows = rare_rows(sets.select("run_id", named("family").alias("side"), "tokens"), prevalence, k, cut, held=True)
    own = rows.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("side") != "", F.col("side"))), F.lit("")).alias("own"))
    return import_rules(rarest(rows, prevalence, k, cut), own, rows.select("run_id", "side", "tokens", "n"), share)


def import_rules(chosen: DataFrame, own: DataFrame, negatives: DataFrame, share: float) -> DataFrame:
    """(run_id, imports, need) of chosen imports (run_id, imports), but those that a set (run_id, side, tokens, n) of another side than ``own`` has ``need`` of."""
    chosen = chosen.where(F.size("imports") >= 3).withColumn("need", F.greatest(F.lit(2), half_even(F.size("imports") * F.lit(share)).cast("int")))
    chosen = staged(chosen.join(own, "run_id"), "chosen-imports")
    rules = staged(chosen.select("own", "imports", "need").distinct().withColumn("rule", F.monotonically_increasing_id()), "import-rules")
    hit = staged(hit_rules(rules, negatives, TRIED), "hit-rules").join(rules, "rule")
    return chosen.join(hit, ["own", "imports"], "left_anti").drop("own")


def named(column: str) -> Column:
    """A family, the missing one included, as a text; without families every negative is of another one."""
    return F.coalesce(F.concat(F.lit("f:"), F.col(column)), F.lit(""))


def named_min(column: str) -> Column:
    """The least family of a group as ``metadata_rules`` names it."""
    return F.coalesce(F.concat(F.lit("f:"), F.min(column)), F.lit(""))


def metadata_hits(rules: DataFrame, static: DataFrame) -> DataFrame:
    """(rule_run, run_id): runs whose tokens have the imphash of a rule, or enough of its imports."""
    own = static.select("run_id", "token").distinct()
    r = rules.withColumnRenamed("run_id", "rule_run")
    same = r.where("imphash <> ''").withColumn("token", F.concat(F.lit("imphash:"), "imphash")).join(own, "token").select("rule_run", "run_id")
    some = r.select("rule_run", "need", F.explode("imports").alias("token")).join(own, "token").groupBy("rule_run", "run_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("rule_run", "run_id")
    return same.unionByName(some).distinct()


def rarest_strings(strings: DataFrame, keywords: tuple[str, ...] = ("http", "cmd", "powershell", "currentversion", "vssadmin", "delete"), n: int = 8) -> DataFrame:
    """(file_id, rank, string): strings with a keyword first, then the longest, then by text."""
    hit = F.lower("string").rlike("|".join(keywords))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc(hit), F.desc(F.length("string")), "string"))
    return strings.select("file_id", "string").distinct().withColumn("rank", rank).where(F.col("rank") <= n)


YARA_HEAD = "    meta:\n        author = \"runtrail\"\n        sample_sha256 = \""
CONFIDENCE = "\"\n        confidence = \"auto-generated; review before deploy\"\n"


def yara_name(name: Column) -> Column:
    """A rule name of letters, digits and underscores that starts with a letter."""
    plain = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^[A-Za-z]"), plain).otherwise(F.concat(F.lit("r_"), plain))


def metadata_yara(rules: DataFrame, name: Column, sha256: Column) -> DataFrame:
    """Add ``yara`` to rules (imphash, imports, need): their text, empty where a rule asks nothing."""
    by_hash = F.when(hex_or(F.col("imphash"), 32) != "", F.concat(F.lit('pe.imphash() == "'), hex_or(F.col("imphash"), 32), F.lit('"')))
    one = lambda i: F.concat(F.lit('pe.imports("'), yara_string(F.get(F.split(i, ":", 3), F.lit(1))), F.lit('", "'), yara_string(F.get(F.split(i, ":", 3), F.lit(2))), F.lit('")'))
    by_imports = F.when(F.size("imports") > 0, F.concat(F.lit("(\n            "), F.array_join(F.transform("imports", one), " +\n            "), F.lit("\n        ) >= "), F.col("need").cast("string")))
    condition = F.array_join(F.array_compact(F.array(by_hash, by_imports)), "\n        or ")
    text = F.concat(F.lit('import "pe"\n\nrule '), yara_name(name), F.lit("\n{\n" + YARA_HEAD), hex_or(sha256, 64, "unknown"), F.lit(CONFIDENCE + "    condition:\n        uint16(0) == 0x5A4D and (\n        "), condition, F.lit("\n        )\n}\n"))
    return rules.withColumn("yara", F.when(condition == "", F.lit("")).otherwise(text))


# --- rules over strings of files

# fixed value: strings that are no mark of a file
GENERIC_STRING = r"(?i)^(kernel32|user32|ntdll|advapi32|msvcrt)\.dll$|^This program|^\.text$|^\.data$"


def picked_strings(files: DataFrame, benign: list[bytes], marks: list[str], k: int = 6) -> DataFrame:
    """(file_id, picked): of each file (file_id, strings) up to k distinctive strings.

    First those with a mark, a URL or an address, in order of the file, then others of 8 to 80 letters, longest first; generic
    strings and those of a benign text are left out.
    """
    held = F.transform("strings", lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    rows = files.select("file_id", F.explode(held).alias("s")).select("file_id", "s.v", "s.i").groupBy("file_id", "v").agg(F.min("i").alias("i"))
    marked = F.lower("v").rlike("|".join(rlike_quoted(m.lower()) for m in marks)) | F.col("v").rlike(r"https?://|\d+\.\d+\.\d+\.\d+")
    marked = marked & ~F.col("v").rlike(GENERIC_STRING) & (F.length("v") <= 120)
    known = F.lit(False)
    for text in benign:
        known = known | F.contains(F.lit(text.decode("latin-1")), F.col("v"))
    rows = rows.withColumn("marked", marked).where((F.col("marked") | F.length("v").between(8, 80)) & ~known)
    order = [F.desc("marked"), F.when(F.col("marked"), F.col("i")), F.desc(F.length("v")), "v"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("p")).select("file_id", F.transform("p", lambda x: x["v"]).alias("picked"))


def rlike_quoted(text: str) -> str:
    """A text as a Java pattern that matches it."""
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in text)


def string_rules(files: DataFrame, benign: list[bytes], k: int = 6) -> DataFrame:
    """(file_id, picked, need, yara): string rules of files (file_id, label, strings); benign files have none."""
    from .triage import APIS, PACKERS, TOKENS

    rows = picked_strings(files.where("label <> 'benign'"), benign, [*APIS, *TOKENS, *PACKERS], k)
    body = F.array_join(F.transform("picked", lambda v, i: F.concat(F.lit("        $s"), i.cast("string"), F.lit(' = "'), yara_string(v), F.lit('" ascii wide'))), "\n")
    rows = rows.withColumn("need", F.greatest(F.lit(1), F.floor((F.size("picked") + 1) / 2)).cast("int"))
    text = F.concat(F.lit("rule "), yara_name(F.concat(F.lit("file_"), F.substring("file_id", 1, 12))), F.lit("\n{\n" + YARA_HEAD), hex_or(F.col("file_id"), 64, "unknown"), F.lit(CONFIDENCE + "    strings:\n"), body, F.lit("\n    condition:\n        "), F.col("need").cast("string"), F.lit(" of ($s*)\n}\n"))
    return rows.withColumn("yara", text)


def string_hits(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, file_id): files (file_id, content) that hold at least ``need`` strings of a rule (rule, picked, need), narrow or wide.

    A rule is tried on a file that has the first letters of one of its strings among its printable runs, an equi-join.
    """
    from ..functions.text import printable_strings

    asked = rules.select("rule", "need", F.explode(F.array_distinct("picked")).alias("string")).withColumn("key", F.substring("string", 1, 5))
    plain = F.decode("content", "ISO-8859-1")
    narrow = printable_strings(F.col("content"), None)
    wide = F.transform(F.regexp_extract_all(plain, F.lit("((?:[\\x20-\\x7e]\\x00){5,})"), 1), lambda v: F.replace(v, F.lit("\x00"), F.lit("")))
    runs = files.select("file_id", F.explode(F.array_distinct(F.concat(narrow, wide))).alias("run"))
    keyed = runs.select("file_id", "run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("run") - 4, F.lit(1))), lambda i: F.substring("run", i, F.lit(5))))).alias("key"))
    held = keyed.join(asked, "key").where(F.contains("run", F.col("string"))).select("rule", "need", "file_id", "string").distinct()
    return held.groupBy("rule", "file_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("rule", "file_id")


# --- plain rules: exact values of events with a technique

PLAIN_CATEGORIES = {**CATEGORIES, "process_inject": "create_remote_thread"}


def plain_selection(events: DataFrame) -> DataFrame:
    """(run_id, seq, category, technique, fields): what a plain rule of an event asks, an array of (field, op, value)."""
    rows = with_technique(events).where("technique is not null")
    words = F.filter(F.split(F.trim(F.coalesce("cmdline", F.lit(""))), r"\s+"), lambda w: w != "")
    flag = F.get(F.filter(F.slice(words, 2, 1 << 20), lambda w: F.startswith(w, F.lit("-")) | F.startswith(w, F.lit("/")) | w.isin("delete", "shadows")), F.lit(0))
    target = F.coalesce("target", F.lit("None"))
    entry = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), value.alias("value"))
    ending = F.concat(F.lit("."), F.substring_index(F.coalesce("target", F.lit("")), ".", -1))
    kind = F.col("type")
    asked = (
        F.when((kind == "process_create") & (F.size(words) > 0), F.array_compact(F.array(entry("Image", "endswith", F.concat(F.lit("\\"), target)), F.when(flag.isNotNull(), entry("CommandLine", "contains", flag)))))
        .when(kind == "registry_set", F.array(entry("TargetObject", "contains", F.lit("\\CurrentVersion\\Run\\"))))
        .when((kind == "file_write") & (F.col("technique") == "T1486"), F.array(entry("TargetFilename", "endswith", ending)))
        .when(kind == "process_inject", F.array(entry("TargetImage", "endswith", F.concat(F.lit("\\"), target))))
    )
    category = lookup(PLAIN_CATEGORIES, kind)
    return rows.select("run_id", "seq", category.alias("category"), "technique", "image", asked.alias("fields")).where("fields is not null and category is not null")


def plain_rules(events: DataFrame) -> DataFrame:
    """(run_id, first_seq, category, technique, image, fields): plain selections of each run, equal ones once."""
    rows = plain_selection(events).groupBy("run_id", "category", "fields").agg(F.min_by(F.struct("seq", "technique", "image"), "seq").alias("e"))
    return rows.select("run_id", F.col("e.seq").alias("first_seq"), "category", "e.technique", "e.image", "fields")


def wildcards(category: Column, fields: Column) -> Column:
    """A plain selection as one wildcard pattern; a process has its image and command line in one."""
    star = lambda f: F.when(f["op"] == "endswith", F.concat(F.lit("*"), f["value"])).otherwise(F.concat(F.lit("*"), f["value"], F.lit("*")))
    first, second = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    return F.when(category == "process_creation", F.concat(star(first), F.lit("\t"), F.when(second.isNotNull(), star(second)).otherwise(F.lit("*")))).otherwise(star(first))


def plain_patterns(rules: DataFrame) -> DataFrame:
    """(.., category, pattern): the plain rules of the categories that have lines, as wildcard patterns over them."""
    return rules.where("category <> 'create_remote_thread'").withColumn("pattern", wildcards(F.col("category"), F.col("fields")))


def plain_lines(events: DataFrame) -> DataFrame:
    """(run_id, category, line): what plain rules are tried on: names of targets behind a separator, for a process with its command line."""
    named = F.concat(F.lit("\\"), F.coalesce("target", F.lit("")))
    kind = F.col("type")
    line = F.when(kind == "process_create", F.concat(named, F.lit("\t"), F.coalesce("cmdline", F.lit("")))).when(kind == "process_inject", named).otherwise(F.coalesce("target", F.lit("")))
    kinds = ("process_create", "process_inject", "registry_set", "file_write")
    return events.where(kind.isin(*kinds)).select("run_id", lookup(PLAIN_CATEGORIES, kind).alias("category"), line.alias("line"))


def plain_matches(rules: DataFrame, events: DataFrame) -> DataFrame:
    """(category, fields, run_id): runs with an event that a plain rule fits, in any letter case; by distinct lines and patterns."""
    patterns = rules.select("category", "fields").distinct().withColumn("pattern", wildcards(F.col("category"), F.col("fields")))
    return run_hits(patterns, plain_lines(events)).join(patterns, ["category", "pattern"]).select("category", "fields", "run_id").distinct()


def plain_surviving(rules: DataFrame, benign: DataFrame) -> DataFrame:
    """The plain rules that fit no event of the benign runs."""
    return rules.join(plain_matches(rules, benign).select("category", "fields").distinct(), ["category", "fields"], "left_anti")


def common_patterns(rules: DataFrame, n: int = 15) -> DataFrame:
    """(category, pattern, runs): the ``n`` patterns of most runs, a report of top rows."""
    return rules.groupBy("category", "pattern").agg(F.count_distinct("run_id").alias("runs")).orderBy(F.desc("runs"), "category", "pattern").limit(n)


def pooled(rules: DataFrame, group: str) -> DataFrame:
    """(group, category, pattern): the rules of all runs of a group as one unit, equal ones once."""
    return rules.select(group, "category", "pattern").distinct()


def united_hits(hits: DataFrame, variant: str = "variant") -> DataFrame:
    """(variant, run_id, units): runs hit by any unit of a variant, and by how many."""
    return hits.select(variant, "unit", "run_id").distinct().groupBy(variant, "run_id").agg(F.count("*").alias("units"))


# --- evaluation


RUN_BITS = 4096 * 8


def hit_bitmaps(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """(category, pattern, bucket, bits): the runs that each pattern hits as bitmaps of ``RUN_BITS`` runs.

    ``hits``: (category, pattern, run_id); ``runs``: (run_id, number), numbered by ``numbered_runs``.
    """
    placed = hits.select("category", "pattern", "run_id").join(runs.select("run_id", "number"), "run_id")
    return placed.groupBy("category", "pattern", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def numbered_runs(tests: DataFrame) -> DataFrame:
    """``tests`` with ``number``: numbers that are dense within a partition, so that bitmaps are; written once, so that they stay."""
    return staged(tests.withColumn("number", F.monotonically_increasing_id()), "numbered-runs")


def united_bitmaps(units: DataFrame, bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, bits): the runs that any rule of a unit hits. ``units``: (keys, category, pattern)."""
    return units.select(*keys, "category", "pattern").join(bitmaps, ["category", "pattern"]).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def grid_scores(units: DataFrame, bitmaps: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, rules, recall, fpr, fp, neg, novel_recall) of every cell of an experiment grid.

    ``units``: (keys, family, category, pattern), a null pattern for a cell without rules; ``bitmaps`` of all patterns, each of
    which was matched once whatever number of cells holds it; ``runs``: (run_id, family, novel, number). A cell's hits are the
    union of its patterns' bitmaps; how many lie in its family follows from the sizes of both and of their union.
    """
    cells = units.groupBy(*keys, "family").agg(F.count_distinct("category", "pattern").alias("rules"))
    hit = staged(united_bitmaps(units.where("pattern is not null"), bitmaps, [*keys, "family"]), "united-hits")
    bucket, place = F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number")
    # a family's own runs and its novel ones
    own = runs.groupBy("family", bucket).agg(F.bitmap_construct_agg(place).alias("own"))
    novel = runs.where("novel").groupBy("family", bucket).agg(F.bitmap_construct_agg(place).alias("new"))
    within = lambda bits, other: F.bitmap_count(bits) + F.bitmap_count(other)
    met = hit.join(own, ["family", "bucket"], "left").join(novel, ["family", "bucket"], "left")
    sides = met.select(*keys, "family", "bucket", "bits", F.explode(F.array(F.struct(F.lit("own").alias("side"), F.col("own").alias("other")), F.struct(F.lit("new").alias("side"), F.col("new").alias("other")))).alias("x")).select(*keys, "family", "bucket", "bits", "x.*").where("other is not null")
    each = sides.select(*keys, "family", "bucket", "side", within(F.col("bits"), F.col("other")).alias("both"), F.explode(F.array("bits", "other")).alias("bits"))
    shared = each.groupBy(*keys, "family", "bucket", "side").agg((F.first("both") - F.bitmap_count(F.bitmap_or_agg("bits"))).alias("n"))
    counted = shared.groupBy(*keys, "family").agg(F.sum(F.when(F.col("side") == "own", F.col("n"))).alias("tp"), F.sum(F.when(F.col("side") == "new", F.col("n"))).alias("tp_novel"))
    total = hit.groupBy(*keys, "family").agg(F.sum(F.bitmap_count("bits")).alias("hits"))
    sizes = runs.groupBy("family").agg(F.count("*").alias("n"), F.count_if("novel").alias("n_novel"))
    everything = runs.agg(F.count("*").alias("all"))
    on = [*keys, "family"]
    same = lambda a, b: a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on], "left").select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in on])
    rows = same(same(cells, total), counted).join(sizes, "family", "left").join(F.broadcast(everything)).fillna(0, ["hits", "tp", "tp_novel", "n", "n_novel"])
    ratio = lambda a, b: F.when(b > 0, a / b)
    fp, neg = F.col("hits") - F.col("tp"), F.col("all") - F.col("n")
    return rows.select(*keys, "family", "rules", ratio(F.col("tp"), F.col("n")).alias("recall"), ratio(fp, neg).alias("fpr"), fp.alias("fp"), neg.alias("neg"), ratio(F.col("tp_novel"), F.col("n_novel")).alias("novel_recall"))


def vetoed_by_draw(rules: DataFrame, hits: DataFrame, draws: DataFrame, seeds: list[int], max_neg_hits: int = 0) -> DataFrame:
    """(seed, rules' columns): per drawing of negatives the specific candidates that hit at most so many of its other families.

    ``draws``: (seed, run_id, family); ``hits``: (category, pattern, run_id). Hits are counted by pattern, seed and family first, so
    that a candidate meets one row and not the runs that its pattern hits.
    """
    n = draws.join(hits, "run_id").groupBy("seed", "category", "pattern", F.col("family").alias("neg_family")).agg(F.count("*").alias("n"))
    n = staged(n, "drawn-hits")
    total = n.groupBy("seed", "category", "pattern").agg(F.sum("n").alias("total"))
    asked = rules.where("specific").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    own = n.select("seed", "category", "pattern", F.col("neg_family").alias("family"), F.col("n").alias("same"))
    rows = asked.join(total, ["seed", "category", "pattern"], "left").join(own, ["seed", "category", "pattern", "family"], "left")
    return rows.where(F.coalesce("total", F.lit(0)) - F.coalesce("same", F.lit(0)) <= max_neg_hits).select("seed", *rules.columns)


def rule_scores(units: DataFrame, hits: DataFrame, tests: DataFrame) -> DataFrame:
    """Recall, false-positive rate and recall of novel runs of each unit.

    ``units``: (unit, family); ``hits``: (unit, run_id); ``tests``: (run_id, family, novel). Totals come from grouped counts, so
    units never meet tests that they do not hit.
    """
    totals = tests.groupBy("family").agg(F.count("*").alias("n"), F.count_if("novel").alias("n_novel"))
    everything = tests.agg(F.count("*").alias("all"))
    t = tests.select("run_id", F.col("family").alias("test_family"), "novel")
    got = hits.distinct().join(t, "run_id").join(units, "unit").groupBy("unit").agg(F.count_if(F.col("test_family") == F.col("family")).alias("tp"), F.count_if(F.col("test_family") != F.col("family")).alias("fp"), F.count_if((F.col("test_family") == F.col("family")) & F.col("novel")).alias("tp_novel"))
    rows = units.join(totals, "family", "left").join(F.broadcast(everything)).join(got, "unit", "left").fillna(0, ["tp", "fp", "tp_novel", "n", "n_novel"])
    ratio = lambda a, b: F.when(b > 0, a / b)
    return rows.select("unit", "family", ratio(F.col("tp"), F.col("n")).alias("recall"), ratio(F.col("fp"), F.col("all") - F.col("n")).alias("fpr"), ratio(F.col("tp_novel"), F.col("n_novel")).alias("novel_recall"))


def variant_summary(units: DataFrame) -> DataFrame:
    """(variant, mean, median of family means, n) of (variant, family, recall)."""
    family = units.groupBy("variant", "family").agg(F.avg("recall").alias("m"), F.count("*").alias("n"), F.sum("recall").alias("s"))
    return family.groupBy("variant").agg((F.sum("s") / F.sum("n")).alias("mean"), F.median("m").alias("median_family"), F.sum("n").alias("n"))
