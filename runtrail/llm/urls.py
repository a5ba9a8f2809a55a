"""URL filter: host and path rules first, else logistic regression on hashed character n-grams, in DataFrame functions only.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path what follows it up to
``?``, ``#`` or the end. A rule is a host and a path (``net/``): it fits its host and every subdomain where the path starts with
the rule's; of several that fit the longest wins. Where none fits, the n-grams of host and path give the verdict.

The regression is trained here on a small labelled URL table written by hand (``url_table``) in several forms and on rows
made by rule (``labelled_urls``); hashing and scoring are maps over each URL: no shuffle, no join. Up to ``INLINE_RULES`` rules are
compiled into the expression; a larger rule table is joined on the suffixes of the host.

Defined results: a null URL and one without ``://`` have an empty host and path and are judged by the regression (its bias);
equal rules count once, of a contradiction the block stays; an empty table gives none.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .url_table import ALLOW, BLOCK

#: (verdict, rule) of the driver's query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
INLINE_RULES, VARIANTS, MADE_URLS = 256, 10, 4000
CELLS = 1 << 15
GRAMS = (3, 4)
THRESHOLD = 0.5
#: Words of the made rows: of unwanted hosts and paths, of plain ones, syllables of plain names; paths and endings that variants take.
BLOCK_WORDS = ("adult", "ads", "bets", "betting", "casino", "cheap", "clickbait", "cracked", "escort", "farm", "free", "keygen", "loan", "lottery", "malware", "phishing", "pills", "poker", "porn", "prize", "replica", "sex", "spam", "torrent", "track", "viagra", "warez", "win", "x", "xxx")
ALLOW_WORDS = ("news", "wiki", "docs", "blog", "school", "library", "science", "weather", "recipes", "museum", "travel", "garden", "health", "history", "forum", "support", "radio", "council", "books", "maps")
SYLLABLES = ("al", "an", "and", "ber", "ca", "de", "en", "er", "es", "ha", "he", "in", "ing", "lo", "ly", "ma", "on", "or", "ou", "re", "ri", "sh", "st", "th", "ti", "tion", "ver", "wh")
PLAIN_PATHS = ("/", "/index.html", "/en/1204", "/de/77.html", "/fr/905/", "/es/42", "/article/2021/05", "/about", "/page/3", "/post/hello-world", "/images/logo.png")
ENDS = ("com", "org", "net", "de", "fr", "es", "info", "io")


def url_parts(url: Column) -> tuple[Column, Column]:
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def grams(host: Column, path: Column) -> Column:
    """The n-grams of host and of path between marks; digits stand for one another, so that numbers say nothing."""

    def of(part: str, text: Column) -> list[Column]:
        marked = F.concat(F.lit("^"), F.translate(F.lower(text), "0123456789", "0000000000"), F.lit("$"))
        starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        piece = lambda n: lambda i: F.concat(F.lit(part), marked.substr(i, F.lit(n)))
        return [F.transform(starts(n), piece(n)) for n in GRAMS]

    return F.concat(*of("h", host), *of("p", path))


def made_urls(spark: SparkSession, rows: int = MADE_URLS) -> DataFrame:
    """Rows (url, label) by rule: 1 for block (hosts or paths of two unwanted words), 0 for plain names."""
    draw = lambda k, values: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(values))).cast("int"))
    bad = F.concat(draw(1, BLOCK_WORDS), draw(2, ("-", "-", "")), draw(3, BLOCK_WORDS))
    word = F.concat(draw(4, ALLOW_WORDS), draw(5, ("", "-", "hub")), draw(6, (*ALLOW_WORDS, "", "", "")))
    name = F.concat(draw(4, SYLLABLES), draw(5, SYLLABLES), draw(6, (*SYLLABLES, "", "", "")))
    plain = F.when(F.pmod("id", F.lit(8)) < 3, word).otherwise(name)
    kind = F.pmod("id", F.lit(8))  # unwanted host, unwanted path, plain
    end = F.concat(draw(7, (".example.", ".")), draw(8, ENDS))
    path = F.when(kind == 7, F.concat(F.lit("/"), bad, F.lit("/"), draw(9, ("123.html", "page", "", "5")))).otherwise(draw(9, PLAIN_PATHS))
    host = F.concat(draw(10, ("", "www.", "m.", "blog.")), F.when(kind >= 5, F.when(kind == 7, name).otherwise(bad)).otherwise(plain), end)
    return spark.range(rows).select(F.concat(draw(11, ("https://", "http://")), host, path).alias("url"), (kind >= 5).cast("double").alias("label"))


def labelled_urls(spark: SparkSession, table: list[tuple[str, float]] | None = None, variants: int = VARIANTS, made: int = MADE_URLS) -> DataFrame:
    """The training table (url, label): each address of the hand-written table (url, 1.0 for block) as it is and in ``variants`` more
    forms, with another scheme, subdomain, ending or path, so that these say nothing; and ``made`` rows by rule."""
    given = table if table is not None else [(u, 1.0) for u in BLOCK] + [(u, 0.0) for u in ALLOW]
    draw = lambda k, values: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(values))).cast("int"))
    listed = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for u, label in given])
    rows = spark.range(1).select(F.inline(listed)).withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(variants))))
    rows = rows.withColumn("id", F.xxhash64("url", "form"))
    host, path = url_parts(F.col("url"))
    bare = F.regexp_replace(host, r"^(www|m|blog|en)\.", "")
    stem = F.regexp_replace(bare, r"\.[^.]*$", "")
    ended = F.when(F.pmod("id", F.lit(2)) == 0, bare).otherwise(F.concat(stem, F.lit("."), draw(8, ENDS)))
    led = F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0, draw(9, PLAIN_PATHS)).otherwise(path)
    other = F.concat(draw(11, ("https://", "http://")), draw(10, ("", "www.", "m.", "blog.")), ended, led)
    forms = rows.select(F.when(F.col("form") == 0, F.col("url")).otherwise(other).alias("url"), "label")
    return forms.unionByName(made_urls(spark, made))


class UrlModel:
    """Hashing and regression as Spark's own transformers: both map rows in the JVM."""

    def __init__(self, hashing: HashingTF, regression: LogisticRegressionModel):
        self.hashing, self.regression = hashing, regression

    def with_probability(self, rows: DataFrame, name: str) -> DataFrame:
        """Add the probability of block from the columns host and path."""
        own = rows.columns
        scored = self.regression.transform(self.hashing.transform(rows.withColumn("__grams", grams(F.col("host"), F.col("path")))))
        return scored.select(*own, F.get(vector_to_array("__probability"), F.lit(1)).alias(name))


def fit(spark: SparkSession, labelled: DataFrame | None = None, max_rows: int = 10_000) -> UrlModel:
    """``labelled``: (url, label) with 1.0 for block; a small table, ``max_rows`` rows are read at most."""
    host, path = url_parts(F.col("url"))
    rows = (labelled if labelled is not None else labelled_urls(spark)).limit(max_rows).select("label", grams(host, path).alias("__grams"))
    hashing = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=CELLS, binary=True)
    made = hashing.transform(rows).select("label", "__features").persist()
    try:
        regression = LogisticRegression(featuresCol="__features", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", maxIter=50, regParam=0.001).fit(made)
    finally:
        made.unpersist()
    return UrlModel(hashing, regression)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def judged(pages: DataFrame, model: UrlModel, rules=RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and p_block (of the regression; null where a rule decides)."""
    host, path = url_parts(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path})
    if isinstance(rules, DataFrame):
        rows = with_rule_table(rows, rules)
    else:
        if len(rules) > INLINE_RULES:
            raise ValueError("more rules than are compiled inline: give them as a DataFrame (verdict, rule)")
        listed = sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0] != "block"))
        fits = lambda r: ((F.col("host") == split_rule(r)[0]) | F.endswith(F.col("host"), F.lit("." + split_rule(r)[0]))) & F.startswith(F.col("path"), F.lit(split_rule(r)[1]))
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, r in reversed(listed):
            rule, verdict = F.when(fits(r), F.lit(r)).otherwise(rule), F.when(fits(r), F.lit(v)).otherwise(verdict)
        rows = rows.withColumns({"rule": rule, "__verdict": verdict})
    rows = model.with_probability(rows, "p_block").withColumn("p_block", F.when(F.col("rule").isNull(), F.col("p_block")))
    verdict = F.coalesce("__verdict", F.when(F.col("p_block") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
    return rows.withColumn("verdict", verdict).drop("__verdict")


def with_rule_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct (host, path) meets the rules of its host's suffixes, an equi-join; the longest that fits stays."""
    parted = rules.select("verdict", "rule", F.lower(F.substring_index("rule", "/", 1)).alias("rule_host"))
    parted = parted.withColumn("rule_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    asked = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = asked.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    met = suffixes.join(parted, (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("b"))
    # written first, so that the join back can split an address of very many rows; an empty host has no rule and is not joined
    best = staged(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("__verdict")), "url-rules")
    joined = rows.where("host <> ''").join(best, ["host", "path"], "left").select(*rows.columns, "rule", "__verdict")
    none = F.lit(None).cast("string")
    return joined.unionByName(rows.where("host = ''").select("*", none.alias("rule"), none.alias("__verdict")))


def url_digest(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "host", "path", "rule", "verdict", "p_block")
