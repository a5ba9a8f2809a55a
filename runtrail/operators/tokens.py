"""Behaviour and static tokens, API n-grams, document frequencies, n-gram scores, set similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite_float, safe_int, sigmoid
from ..functions.text import dirname, extension, normalize
from ..session import staged
from .events import api_name, with_technique

MAX_TOKENS, MIN_CALLS = 4000, 5


def behaviour_tokens(events: DataFrame) -> DataFrame:
    """(run_id, token), distinct. Tokens are made in each event's own row: most events have no command line and many share a
    target, so a join on either would send them to one task.

    ``opened_only`` (optional column) marks files and keys that were opened without a known operation.
    """
    rows = with_technique(events)
    opened = F.coalesce(F.col("opened_only"), F.lit(False)) if "opened_only" in events.columns else F.lit(False)
    kind, target, cmdline = F.col("type"), F.coalesce("target", F.lit("")), F.coalesce("cmdline", F.lit(""))
    named = rows.select("run_id", "type", target.alias("target"), "technique", "tactic", opened.alias("opened"), F.when(kind != "api_call", normalize(target)).alias("t"), F.when((kind == "process_create") & (cmdline != ""), normalize(cmdline)).alias("c"))
    t, c = F.col("t"), F.col("c")
    file_kind = F.when(F.col("opened"), "file_open").otherwise(kind)
    key_kind = F.when(F.col("opened"), "reg_open").otherwise(kind)
    join = lambda *parts: F.concat(*parts)
    is_file, is_key = kind.isin("file_read", "file_write", "file_delete"), F.startswith(kind, F.lit("registry_"))
    own = (
        F.when(kind == "api_call", api_tokens())
        .when(kind == "process_create", F.array(join(F.lit("exec:"), t), join(F.lit("cmd:"), F.substring(c, 1, 120))))
        .when(is_file, F.array(join(file_kind, F.lit(":"), t), join(file_kind, F.lit("_dir:"), dirname(t)), F.when(kind != "file_read", join(file_kind, F.lit("_ext:"), extension(t)))))
        .when(is_key, F.array(join(key_kind, F.lit(":"), t), join(key_kind, F.lit("_parent:"), dirname(t))))
        .otherwise(F.array(join(kind, F.lit(":"), t)))
    )
    return distinct_tokens(named, F.concat(general_tokens(), own))


def technique_tokens(events: DataFrame) -> DataFrame:
    """(run_id, token): those of ``behaviour_tokens`` that name a technique, a tactic or an API call."""
    named = with_technique(events).withColumn("target", F.coalesce("target", F.lit("")))
    return distinct_tokens(named, F.concat(general_tokens(), F.when(F.col("type") == "api_call", api_tokens()).otherwise(F.array().cast("array<string>"))))


def general_tokens() -> Column:
    return F.when(F.col("technique").isNotNull(), F.array(F.concat(F.lit("tech:"), F.col("technique")), F.concat(F.lit("tactic:"), F.col("tactic")))).otherwise(F.array().cast("array<string>"))


def api_tokens() -> Column:
    return F.array(F.concat(F.lit("api:"), api_name(F.col("target"))))


def distinct_tokens(rows: DataFrame, made: Column) -> DataFrame:
    return rows.select("run_id", F.explode(F.array_compact(made)).alias("token")).distinct()


def token_sets(tokens: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """(run_id, tokens): sorted, the first ``limit``."""
    return tokens.groupBy("run_id").agg(F.slice(F.array_sort(F.collect_set("token")), 1, limit).alias("tokens"))


def static_tokens(files: DataFrame, pe: str = "pe") -> DataFrame:
    """Add ``tokens`` from a struct column of file metadata (imphash, imports, sections, osversion, ...); none where it is null."""
    p = F.col(pe)
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = lambda prefix, c: F.concat(F.lit(prefix), c)
    none = F.array()
    imports = F.flatten(F.transform(F.coalesce(p["imports"], none.cast("array<struct<dll:string,imports:array<struct<name:string>>>>")), lambda d: F.concat(F.array(text("dll:", lower(d["dll"]))), F.transform(F.filter(F.slice(F.coalesce(d["imports"], none.cast("array<struct<name:string>>")), 1, 500), lambda f: F.coalesce(f["name"], F.lit("")) != ""), lambda f: F.concat(F.lit("imp:"), lower(d["dll"]), F.lit(":"), lower(f["name"]))))))
    name = lambda s: F.coalesce(F.nullif(F.regexp_replace(lower(s["name"]), "^\x00+|\x00+$", ""), F.lit("")), F.lit("<empty>"))
    sections = F.flatten(F.transform(F.coalesce(p["sections"], none.cast("array<struct<name:string,entropy:string>>")), lambda s: F.array(text("sec:", name(s)), F.concat(F.lit("sec_ent:"), name(s), F.lit(":"), finite_float(s["entropy"], 0.0, 0.0, 8.0).cast("int").cast("string")))))
    single = F.array(
        F.when(F.coalesce(p["imphash"], F.lit("")) != "", text("imphash:", p["imphash"])),
        text("osversion:", F.coalesce(p["osversion"], F.lit("None"))),
        text("ndll:", F.greatest(F.lit(0), F.least(F.lit(20), safe_int(p["imported_dll_count"]))).cast("string")),
        F.when(F.coalesce(p["timestamp"], F.lit("")) != "", text("pe_year:", F.substring(p["timestamp"], 1, 4))),
        F.when(F.size(F.coalesce(p["digital_signers"], none.cast("array<string>"))) > 0, F.lit("signed")),
    )
    exports = F.transform(F.filter(F.slice(F.coalesce(p["exports"], none.cast("array<struct<name:string>>")), 1, 50), lambda e: F.coalesce(e["name"], F.lit("")) != ""), lambda e: text("exp:", lower(e["name"])))
    return files.withColumn("tokens", F.when(p.isNull(), none.cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.concat(single, imports, sections, exports))))))


# --- API sequences


def api_calls(events: DataFrame) -> DataFrame:
    """(run_id, seq, api): calls in order; typed events lend the API of their ``api`` column if there is one."""
    other = F.col("api") if "api" in events.columns else F.lit(None).cast("string")
    resolved = F.coalesce(F.col("resolved_only"), F.lit(False)) if "resolved_only" in events.columns else F.lit(False)
    api = F.when((F.col("type") == "api_call") & (F.coalesce("target", F.lit("")) != ""), F.col("target")).otherwise(other)
    return events.where(~resolved).select("run_id", "ts", "seq", api.alias("api")).where("api is not null")


def api_ngrams(calls: DataFrame) -> DataFrame:
    """(run_id, token, tf): lower-case names and adjacent pairs ``a>b`` with their counts."""
    name = F.lower("api")
    following = F.lead(name).over(Window.partitionBy("run_id").orderBy("ts", "seq"))
    tokens = calls.select("run_id", F.array(name, F.concat(name, F.lit(">"), following)).alias("t"))
    return tokens.select("run_id", F.explode(F.array_compact("t")).alias("token")).groupBy("run_id", "token").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame, min_df: int = 2) -> DataFrame:
    """(token, df, idf) with smooth idf = ln((1 + n) / (1 + df)) + 1."""
    n = tf.agg(F.count_distinct("run_id").alias("n"))
    df = tf.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.join(F.broadcast(n)).select("token", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """(run_id, token, value): (1 + ln tf) * idf over the norm of the run."""
    v = tf.join(idf.select("token", "idf"), "token").select("run_id", "token", ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    norm = v.groupBy("run_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return v.join(norm, "run_id").select("run_id", "token", (F.col("v") / F.col("norm")).alias("value"))


def ngram_scores(calls: DataFrame, model: DataFrame, intercept: float, min_calls: int = MIN_CALLS) -> DataFrame:
    """(run_id, probability) from a model table (token, idf, weight); null for runs of fewer calls."""
    vectors = tfidf(api_ngrams(calls), model).join(model.select("token", "weight"), "token")
    z = vectors.groupBy("run_id").agg(F.sum(F.col("value") * F.col("weight")).alias("z"))
    n = calls.groupBy("run_id").agg(F.count("*").alias("calls"))
    return n.join(z, "run_id", "left").select("run_id", F.when(F.col("calls") >= min_calls, F.round(sigmoid(F.coalesce("z", F.lit(0.0)) + intercept), 4)).alias("probability"))


def ngram_contributions(calls: DataFrame, model: DataFrame, k: int = 8) -> DataFrame:
    """(run_id, rank, token, value, weight, impact): the n-grams that move a run's score most; rounded to 4, none of no impact."""
    rows = tfidf(api_ngrams(calls), model).join(model.select("token", "weight"), "token")
    rows = rows.select("run_id", "token", F.round("value", 4).alias("value"), F.round("weight", 4).alias("weight"))
    rows = rows.withColumn("impact", F.round(F.col("value") * F.col("weight"), 4)).where("impact <> 0")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.abs("impact")), "token"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("run_id", "rank", "token", "value", "weight", "impact")


# --- set similarity


def jaccard(a: Column, b: Column) -> Column:
    """Of two array columns as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


#: Likenesses down to which the nearest sets are looked for, one after the other; what has none so near is compared by all tokens.
BOUNDS = (0.8, 0.5, 0.25)
#: Most frequent tokens whose numbers are broadcast; parts of the sets that a token's key is dealt over in the last round.
HEAD_TOKENS, PARTS = 1 << 16, 16


def by_rarity(sets: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(key, tokens): each set's tokens, the rarest first. ``counts``: (token, n).

    The most frequent tokens meet their counts by a broadcast of bounded size and the others by a shuffle, so none is a hot key.
    """
    rows = sets.select(key, F.explode("tokens").alias("token"))
    head = staged(counts.orderBy(F.desc("n"), "token").limit(HEAD_TOKENS), "frequent-tokens")
    often = rows.join(F.broadcast(head), "token")
    rare = rows.join(F.broadcast(head.select("token")), "token", "left_anti").join(counts.join(F.broadcast(head.select("token")), "token", "left_anti"), "token")
    placed = often.select(key, "token", "n").unionByName(rare.select(key, "token", "n"))
    return placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o")).select(key, F.transform("o", lambda x: x["token"]).alias("tokens"))


def near_pairs(a: DataFrame, b: DataFrame, bound: float) -> DataFrame:
    """(sig, psig, both, na, nb, ..) of all pairs of sets whose likeness is at least ``bound``, each once.

    Two such sets share a token among the first ``n - ceil(bound * n) + 1`` of each, rarest first, and are of about one size. The key
    is that token with a class of sizes; the first such token that both share makes the pair.
    """
    first = lambda n: n - F.ceil(n * bound - 1e-9) + 1
    size_class = lambda n: F.floor(F.log(n.cast("double")) / float(-math.log(bound)) + 1e-9)
    prefix = lambda df, n: df.withColumn("prefix", F.slice("tokens", F.lit(1), first(F.col(n)).cast("int")))
    mine = prefix(a, "na").withColumn("class", F.explode(F.sequence(size_class(F.greatest(F.lit(1.0), F.col("na") * bound)), size_class(F.col("na") / bound))))
    theirs = prefix(b, "nb").withColumn("class", size_class(F.col("nb")))
    one = lambda df, name: df.withColumnsRenamed({"tokens": f"tokens_{name}", "prefix": f"prefix_{name}"}).withColumn("token", F.explode(f"prefix_{name}"))
    met = one(mine, "a").join(one(theirs, "b"), ["class", "token"])
    met = met.where((F.col("own").isNull() | (F.col("own") != F.col("family"))) & (F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)) == F.col("token")))
    scored = met.withColumn("both", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return scored.where(F.col("both") >= bound * (F.col("na") + F.col("nb") - F.col("both")) - 1e-9)


def nearest_prototype(sets: DataFrame, prototypes: DataFrame, id_col: str = "run_id", other_families: bool = False) -> DataFrame:
    """(id, family, similarity): of (id, tokens) the most similar of (proto_id, family, tokens); no family where nothing is shared.

    Equal sets are compared once. Pairs are found by falling bounds of likeness: a set that has a prototype at least as near as
    the bound is done, for the nearest is then among the pairs found. The few that are left share little with any prototype; they
    meet prototypes by all their tokens, each token dealt over ``PARTS``. Ties: the least proto_id, then the family.
    ``other_families``: the sets carry ``family``, and prototypes of a set's own family do not count.
    """
    signature = lambda df: df.withColumn("sig", F.sha2(F.to_json(F.array_sort("tokens")), 256))
    own = F.col("family") if other_families else F.lit(None).cast("string")
    as_set = lambda df: df.withColumn("tokens", F.array_distinct(F.array_compact(F.coalesce("tokens", F.array().cast("array<string>")))))
    mine = staged(signature(as_set(sets)).withColumn("own", own).withColumn("key", F.concat_ws("/", "sig", "own")).select(id_col, "sig", "key", "own", "tokens"), "sets")
    protos = signature(as_set(prototypes)).groupBy("sig", "family").agg(F.first("tokens").alias("tokens"), F.min("proto_id").alias("first"))
    protos = staged(protos.withColumnRenamed("sig", "psig"), "prototypes")
    every = staged(mine.select("sig", "tokens").unionByName(protos.select(F.col("psig").alias("sig"), "tokens")).groupBy("sig").agg(F.first("tokens").alias("tokens")), "distinct-sets")
    counts = staged(every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "token-counts")
    ordered = staged(by_rarity(every, "sig", counts), "ordered-sets")
    sized = lambda df, sig, n: df.join(ordered.withColumnRenamed("sig", sig), sig).withColumn(n, F.size("tokens"))
    b = staged(sized(protos.drop("tokens"), "psig", "nb"), "prototype-sets")
    left = staged(sized(mine.select("sig", "key", "own").distinct(), "sig", "na"), "asked-sets")
    ranked = lambda pairs: pairs.withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).groupBy("key").agg(F.min_by(F.struct("family", "similarity"), F.struct(-F.col("similarity"), "first", "family")).alias("b"))
    found = []
    for bound in BOUNDS:
        done = staged(ranked(near_pairs(left, b, bound)), "nearest")
        found.append(done)
        left = staged(left.join(done.select("key"), "key", "left_anti"), "asked-sets")
    part = F.pmod(F.xxhash64("psig"), F.lit(PARTS)).cast("int")
    asked = left.select("key", "own", "na", F.explode("tokens").alias("token")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    held = b.select("psig", "family", "first", "nb", part.alias("part"), F.explode("tokens").alias("token"))
    rest = asked.join(held, ["token", "part"]).where(F.col("own").isNull() | (F.col("own") != F.col("family")))
    rest = rest.groupBy("key", "psig", "family").agg(F.count("*").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("first").alias("first"))
    best = reduce(DataFrame.unionByName, [*found, ranked(rest)])
    return mine.select(id_col, "key").join(best, "key", "left").select(id_col, F.col("b.family").alias("family"), F.coalesce(F.col("b.similarity"), F.lit(0.0)).alias("similarity"))


#: Each byte's letter in lower case, 0 for what is no letter.
LETTERS = np.array([b | 32 if chr(b) in ascii_letters else 0 for b in range(256)], np.uint8)
#: Bytes of text that are looked at once.
TEXT = 1 << 23


def word_rows(texts: DataFrame) -> DataFrame:
    """(.., tokens) of (.., text): the distinct words of A-Z of each text in lower case, by the row alone; a null text has none.

    Texts are looked at as bytes, many rows at once: any other byte, of a longer character too, ends a word.
    """
    keep = [c for c in texts.columns if c != "text"]

    def words(text: pa.Array) -> pa.Array:
        text = pc.fill_null(text, "").cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        letters = LETTERS[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        inside = letters > 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edge = ends[(ends > 0) & (ends < len(letters))]  # a word does not go on in the next row
        begins[edge] = inside[edge]
        stops[edge - 1] = inside[edge - 1]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        spans = np.concatenate([[0], np.cumsum(stops - begins)]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(spans), pa.py_buffer(letters[inside])).dictionary_encode()
        pairs = np.sort((np.searchsorted(ends, begins, "right") - 1) << 32 | found.indices.to_numpy())
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        rows = np.searchsorted(pairs, np.arange(len(text) + 1) << 32).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(rows), found.dictionary.take(pa.array(pairs & (1 << 32) - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *np.flatnonzero(np.diff(size // TEXT)) + 1, batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if b > a:
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), words(part["text"])], names=[*keep, "tokens"])

    kinds = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return texts.select(*keep, "text").mapInArrow(run, kinds + "tokens array<string>")
