"""Evaluation: metrics, rank statistics, thresholds, coverage, confusion, intervals, exact tests, duplicates, ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def binary_metrics(rows: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1, per group of ``by``; ratios without a base are 0."""
    y, guess = F.col(label) == 1, F.col(score) >= threshold
    counts = rows.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in (("tp", guess & y), ("fp", guess & ~y), ("fn", ~guess & y), ("tn", ~guess & ~y))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))})


def running_totals(steps: DataFrame, order: str, counts: list[str], descending: bool) -> DataFrame:
    """Add ``upto_<count>``: running totals of counts over distinct values of ``order``, from one end to the other.

    Values are dealt into ranges; each range sums its own, and a table of one row per range gives what stands before. No task
    gets all rows, however many distinct values there are.
    """
    ranged = staged(steps.repartitionByRange(F.desc(order) if descending else F.asc(order)).withColumn("__part", F.spark_partition_id()), "steps")
    sums = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = sums.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in counts])
    here = Window.partitionBy("__part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(F.broadcast(base), "__part")  # as many rows as shuffle partitions
    return rows.withColumns({f"upto_{c}": F.col(f"__{c}") + F.sum(c).over(here) for c in counts}).drop("__part", *[f"__{c}" for c in counts])


def hash_ranked(rows: DataFrame, group: str, key: str, seed: int, name: str) -> DataFrame:
    """Add ``name``: the place of each row, from 1, within its group by hash of the key; the same on every run.

    A group is dealt into ranges of the hash; a table of their counts says what stands before a range, so a group of any size is
    ranked by many tasks.
    """
    placed = staged(rows.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__range", F.shiftright("__h", 52)), "hashed")
    counts = placed.groupBy(group, "__range").agg(F.count("*").alias("c"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 ranges at most
    base = counts.select(F.col(group).alias("__g"), F.col("__range").alias("__r"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__base"))
    here = F.row_number().over(Window.partitionBy(group, "__range").orderBy("__h", key))
    ranked = placed.withColumn("__here", here).join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return ranked.withColumn(name, F.col("__base") + F.col("__here")).drop("__h", "__range", "__g", "__r", "__base", "__here")


def score_steps(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives of each distinct score, with running totals from the highest down; equal scores count first."""
    steps = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return running_totals(steps, "score", ["p", "n"], True).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp"})


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(auc): area under the curve through the steps, ties at half."""
    s = score_steps(rows, label, score)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return s.agg((area / (F.sum("p") * F.sum("n"))).alias("auc"))


def tpr_at_fpr(rows: DataFrame, target: float, label: str = "label", score: str = "score") -> DataFrame:
    """(tpr): the greatest true-positive rate with a false-positive rate of at most ``target``."""
    s = score_steps(rows, label, score)
    totals = rows.agg(F.count_if(F.col(label) == 1).alias("all_p"), F.count_if(F.col(label) == 0).alias("all_n"))
    return s.join(F.broadcast(totals)).agg(F.coalesce(F.max(F.when(F.col("fp") / F.col("all_n") <= target, F.col("tp") / F.col("all_p"))), F.lit(0.0)).alias("tpr"))


def gate_threshold(rows: DataFrame, recall: float, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold): of ascending scores of positives the one at floor((1 - recall) * n), counted from 0."""
    steps = rows.where(F.col(label) == 1).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("c"))
    ranked = running_totals(steps, "score", ["c"], False).join(F.broadcast(steps.agg(F.sum("c").alias("n"))))  # one row
    return ranked.where(F.col("upto_c") > F.floor(F.lit(1 - recall) * F.col("n"))).agg(F.min("score").alias("threshold"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, support, recall, precision, f1) of each true class."""
    c = confusion(rows, truth, guess)
    by_truth = c.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = c.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("guessed"))
    r, p = F.col("hit") / F.col("support"), F.when(F.coalesce("guessed", F.lit(0)) > 0, F.col("hit") / F.col("guessed")).otherwise(F.lit(0.0))
    return by_truth.join(by_guess, "class", "left").select("class", "support", r.alias("recall"), p.alias("precision"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return class_scores(rows, truth, guess).agg(F.avg("f1").alias("macro_f1"))


TAUS = tuple(round(0.30 + 0.05 * i, 2) for i in range(14))


def coverage_curve(rows: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """(tau, coverage, accuracy, accepted_unseen) of (confidence, correct, seen); each row meets the grid in its own task."""
    grid = rows.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    on = F.col("confidence") >= F.col("tau")
    seen = F.col("seen")
    return grid.groupBy("tau").agg((F.count_if(on & seen) / F.count_if(seen)).alias("coverage"), (F.count_if(on & seen & F.col("correct")) / F.nullif(F.count_if(on & seen), F.lit(0))).alias("accuracy"), (F.count_if(on & ~seen) / F.nullif(F.count_if(~seen), F.lit(0))).alias("accepted_unseen"))


def coverage_threshold(curve: DataFrame, least: float = 0.95) -> DataFrame:
    return curve.agg(F.max(F.when(F.col("coverage") >= least, F.col("tau"))).alias("tau"))


# --- intervals and tests


def student_cdf(t: float, df: float) -> float:
    """Distribution of Student's t by its incomplete beta function (continued fraction)."""
    x = df / (df + t * t)
    tail = 0.5 * incomplete_beta(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def student_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def with_quantile(stats: DataFrame, count: str = "n") -> DataFrame:
    """Add ``t``: the 97.5 % point of Student's t with count - 1 degrees of freedom, 0 for one value; worked out once per count."""

    def quantiles(batches):
        for frame in batches:
            frame["t"] = [student_quantile(0.975, n - 1) if n > 1 else 0.0 for n in frame["__n"].tolist()]
            yield frame

    sizes = stats.select(F.col(count).cast("long").alias("__n")).distinct().mapInPandas(quantiles, "__n long, t double")
    return stats.join(sizes, stats[count] == sizes["__n"], "left").drop("__n")


def mean_interval(rows: DataFrame, value: str, by: list[str] | None = None, extra: float = 0.0) -> DataFrame:
    """(mean, half, n) of a column: the 95 % t-interval; ``extra`` = test rows over training rows corrects for shared training data."""
    stats = rows.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))
    half = F.col("t") * F.col("sd") * F.sqrt(1 / F.col("n") + extra)
    return with_quantile(stats).select(*(by or []), "mean", half.alias("half"), "n")


def proportion_interval(rows: DataFrame, value: str, n_train: int, n_test: int, by: list[str] | None = None) -> DataFrame:
    """(mean, low, high, n_runs, on_logit) of proportions over repeated splits: the corrected t-interval, taken on the scale of
    log odds where the plain one would leave [0, 1]. A single run has its own value as both ends."""
    edge = 0.5 / max(n_test, 1)
    kept = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), F.col(value)))
    rows = rows.withColumn("__odds", F.log(kept / (1 - kept)))
    parts = [F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.avg("__odds").alias("lm"), F.coalesce(F.stddev_samp("__odds"), F.lit(0.0)).alias("ls"), F.count(value).alias("n_runs")]
    stats = with_quantile(rows.groupBy(*(by or [])).agg(*parts), "n_runs")
    wide = F.col("t") * F.sqrt(1 / F.col("n_runs") + n_test / n_train)
    low, high = F.col("mean") - wide * F.col("sd"), F.col("mean") + wide * F.col("sd")
    stats = stats.withColumn("on_logit", (F.col("n_runs") > 1) & ((low < 0) | (high > 1)))
    inverse = lambda z: 1 / (1 + F.exp(-z))
    ends = [F.when(F.col("on_logit"), inverse(F.col("lm") + sign * wide * F.col("ls"))).otherwise(plain) for sign, plain in ((-1, low), (1, high))]
    return stats.select(*(by or []), "mean", F.greatest(F.lit(0.0), ends[0]).alias("low"), F.least(F.lit(1.0), ends[1]).alias("high"), "n_runs", "on_logit")


def paired_t(rows: DataFrame, a: str, b: str, extra: float = 0.0) -> dict[str, float | int | None]:
    """Corrected paired t-test of b - a over the same splits; one aggregate row comes to the driver."""
    d = F.col(b) - F.col(a)
    m, v, k = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).agg(F.avg(d), F.coalesce(F.var_samp(d), F.lit(0.0)), F.count(d)).first()
    if not k or v == 0:
        return {"mean_diff": m, "t": None, "p": 1.0 if not m else 0.0, "n": k}
    t = m / math.sqrt(v * (1 / k + extra))
    return {"mean_diff": m, "t": t, "p": 2 * (1 - student_cdf(abs(t), k - 1)), "n": k}


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b, p): exact two-sided binomial test over the rows where just one of two booleans holds."""
    counts = rows.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # sum of binomial terms by a running product: C(n, i) = C(n, i - 1) * (n - i + 1) / i, in logarithms
    term = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    scale = n * math.log(2)
    folded = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k), term,
        lambda s, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.log((n - i + 1) / F.greatest(i, F.lit(1)))).alias("log"), (s["sum"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.log((n - i + 1) / F.greatest(i, F.lit(1)))) - scale)).alias("sum")),
    )
    return counts.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * folded["sum"])))


def cluster_means(rows: DataFrame, key: str, value: str, max_keys: int) -> DataFrame:
    """(d): the sorted array of the means of all clusters; an error beyond ``max_keys``, whose signs could not be tried one by one."""
    means = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(key).agg(F.avg(value).alias("d"))
    if means.limit(max_keys + 1).count() > max_keys:
        raise ValueError(f"more than {max_keys} clusters: an exact test would try more than 2^{max_keys} signs")
    return means.agg(F.array_sort(F.collect_list("d")).alias("d"))


def signed_sums(listed: DataFrame, values: str) -> DataFrame:
    """Add ``s``: for every choice of signs the sum of an array with them."""
    last = F.greatest(F.lit(0), F.pow(F.lit(2), F.size(values)).cast("long") - 1)
    flips = listed.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return flips.withColumn("s", F.aggregate(F.transform(values, lambda x, i: F.when(F.getbit("mask", i) == 1, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x))


def sign_flips(rows: DataFrame, key: str, value: str, max_keys: int = 20) -> DataFrame:
    """(observed, p): exact sign-flip test of clustered means, every cluster flipped both ways; more than ``max_keys`` is an error.

    Without clusters there is nothing to observe: (null, 1).
    """
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    sums = signed_sums(cluster_means(rows, key, value, max_keys), "d").select(F.abs("s").alias("s"), F.abs(total).alias("o"), F.try_divide(total, F.size("d")).alias("observed"))
    return sums.agg(F.first("observed").alias("observed"), (F.count_if(F.col("s") >= F.col("o") - 1e-12) / F.count("*")).alias("p"))


def signed_ranks(rows: DataFrame, key: str, value: str, max_keys: int = 20) -> DataFrame:
    """(statistic, p, n): exact two-sided signed-rank test of clustered means other than zero; ties share their mean rank."""
    listed = cluster_means(rows, key, value, max_keys).select(F.filter("d", lambda x: x != 0).alias("d"))
    rank = lambda x: F.size(F.filter("d", lambda y: F.abs(y) < F.abs(x))) + (F.size(F.filter("d", lambda y: F.abs(y) == F.abs(x))) + 1) / 2
    listed = listed.withColumn("r", F.transform("d", rank))
    observed = F.aggregate(F.transform("d", lambda x, i: F.when(x < 0, -1.0).otherwise(1.0) * F.get("r", i)), F.lit(0.0), lambda a, x: a + x)
    all_ranks = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    sums = signed_sums(listed.withColumns({"o": observed, "all": all_ranks}), "r")
    p = F.count_if(F.abs("s") >= F.abs("o") - 1e-12) / F.count("*")
    return sums.agg(((F.first("all") - F.abs(F.first("o"))) / 2).alias("statistic"), p.alias("p"), F.first(F.size("d")).cast("long").alias("n"))


def paired_units(units: DataFrame, a: str, b: str, value: str, on: tuple[str, ...] = ("seed", "family", "ref")) -> DataFrame:
    """Units of variant ``b`` beside those of ``a`` on the same seed, family and reference: (.., a, b, diff); missing values go."""
    side = lambda name, to: units.where((F.col("variant") == name) & F.col(value).isNotNull() & ~F.isnan(value)).select(*on, F.col(value).alias(to))
    return side(a, "a").join(side(b, "b"), list(on)).withColumn("diff", F.col("b") - F.col("a"))


def two_level_bootstrap(rows: DataFrame, group: str, value: str, draws: int = 2000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(low, high) of the mean of group means, groups drawn anew and then values within each drawn group.

    Poisson weights by hash stand for draws: one for each group and draw, one for each row, group and draw, so a drawn mean is a
    weighted one, and rows need no order. Rows are reduced to counts of equal values first.
    """
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    drawn = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    means = drawn.withColumn("w", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("c")), F.lit(0), lambda a, i: a + poisson(F.xxhash64(F.lit(seed), group, "v", i, "draw"))))
    means = means.groupBy("draw", group).agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m")).where("m is not null")
    means = means.withColumn("g", poisson(F.xxhash64(F.lit(seed + 1), group, "draw")))
    each = means.groupBy("draw").agg((F.sum(F.col("g") * F.col("m")) / F.nullif(F.sum("g"), F.lit(0))).alias("s")).where("s is not null")
    return each.agg(F.percentile("s", F.lit(low)).alias("low"), F.percentile("s", F.lit(high)).alias("high"))


def poisson(hash_: Column) -> Column:
    """A Poisson number of mean one from a hash."""
    u = F.pmod(hash_, F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight, cumulative = F.lit(0), 0.0
    for k in range(7):
        cumulative += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u >= cumulative, 1).otherwise(0)
    return weight


def bootstrap(rows: DataFrame, statistic: Column, key: str, draws: int = 200, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(low, high) of a statistic over Poisson resamples: each row gets a weight ``w`` for each draw, by hash of key and draw.

    ``statistic`` is an aggregate over ``w`` and the columns of the row. Weights need no order, so rows stay where they are.
    """
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", poisson(F.xxhash64(F.lit(seed), key, "draw")))
    each = drawn.groupBy("draw").agg(statistic.alias("s"))
    return each.agg(F.percentile("s", F.lit(low)).alias("low"), F.percentile("s", F.lit(high)).alias("high"))


# --- duplicates, samples, ledgers


def duplicate_groups(rows: DataFrame, key: Column, label: str | None = None) -> DataFrame:
    """(sig, n[, labels]): groups of equal rows, by hash of their key."""
    parts = [F.count("*").alias("n")] + ([F.count_distinct(label).alias("labels")] if label else [])
    return rows.groupBy(F.sha2(key, 256).alias("sig")).agg(*parts)


def dedup_pool(rows: DataFrame, key: Column, id_col: str, label: str) -> DataFrame:
    """One id of each group whose labels agree, the least; groups of mixed labels go."""
    groups = rows.groupBy(F.sha2(key, 256).alias("sig")).agg(F.min(id_col).alias(id_col), F.min(label).alias(label), F.max(label).alias("__m"))
    return groups.where(F.col(label) == F.col("__m")).drop("__m")


def novel_share(rows: DataFrame, signature: str, split: str) -> DataFrame:
    """(n, novel, share): test rows whose signature no training row has."""
    known = rows.where(F.col(split) == "train").select(signature).distinct()
    test = rows.where(F.col(split) == "test").groupBy(signature).agg(F.count("*").alias("n"))
    joined = test.join(known.withColumn("__k", F.lit(1)), signature, "left")
    novel = F.sum(F.when(F.col("__k").isNull(), F.col("n")).otherwise(0))
    return joined.agg(F.sum("n").alias("n"), novel.alias("novel"), (novel / F.sum("n")).alias("share"))


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(share): of the token counts of ``a`` the part whose token ``b`` has too; both (token, n)."""
    known = b.select("token").distinct().withColumn("__k", F.lit(1))
    return a.join(known, "token", "left").agg((F.sum(F.when(F.col("__k") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def capped(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order: what a report of top rows is."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def latest_state(ledger: DataFrame, job: str, at: Column) -> DataFrame:
    """The last record of each job of an append-only ledger."""
    rest = [c for c in ledger.columns if c != job]
    return ledger.groupBy(job).agg(F.max_by(F.struct(*rest), at).alias("r")).select(job, "r.*")


def still_to_do(jobs: DataFrame, ledger: DataFrame, job: str, at: Column, status: str = "status", done: str = "done") -> DataFrame:
    return jobs.join(latest_state(ledger, job, at).where(F.col(status) == done).select(job), job, "left_anti")


def encoded(sequences: DataFrame, vocabulary: DataFrame, n: int, id_col: str = "run_id") -> DataFrame:
    """(id, codes): the last ``n`` items of each sequence (id, seq, item) as numbers, 0 where unknown or padded on the left."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("seq")))
    tail = sequences.withColumn("back", rank).where(F.col("back") <= n).join(vocabulary, "item", "left")
    codes = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), F.coalesce("code", F.lit(0)).alias("code")))), lambda x: x["code"])
    return tail.groupBy(id_col).agg(codes.alias("c")).select(id_col, F.concat(F.array_repeat(F.lit(0), F.lit(n) - F.size("c")), "c").alias("codes"))
