"""Short patterns by automaton, bitmaps of hits, nearest sets, attributions of trees: against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtrail.operators import attributions, automaton, models, rules, tokens


def fits(pattern, line):
    return re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in pattern), line, re.S) is not None


def test_pieces_find_what_patterns_mean_and_compare_few():
    pick = random.Random(1)
    word = lambda n: "".join(pick.choice("ab\\.") for _ in range(pick.randint(0, n)))
    patterns = sorted({(g, "*".join(word(3) for _ in range(pick.randint(1, 4)))) for g in "xy" for _ in range(150)} | {("x", "*"), ("x", "**"), ("x", "aa*a"), ("x", "a*aa"), ("x", "")})
    lines = [(g, word(12)) for g in "xyz" for _ in range(200)] + [("x", ""), ("x", "aa"), ("x", "aaa")]
    pieces = automaton.Pieces(patterns)
    for group, line in lines:
        assert sorted(pieces.fitting(group, line)) == [i for i, (g, p) in enumerate(patterns) if g == group and fits(p, line)], line
    rare = automaton.Pieces([("x", f"*q{i}z*") for i in range(500)])
    for i in range(1000):
        rare.fitting("x", f"c:\\users\\q{i}z.exe" if i < 3 else "c:\\users\\abc.exe")
    assert rare.compared == 3  # of 500,000 pairs


@pytest.mark.parametrize("shard", [40, 2_000_000])
def test_matches_equal_like(spark, monkeypatch, shard):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abC\\%_!") for _ in range(pick.randint(1, 9)))
    lines = [(c, word() + word() + pick.choice(["", "commonpiece.exe"])) for c in "pq" for _ in range(60)]
    patterns = [(c, "*".join(pick.choice(["", "a", word(), line[2:9]]) for _ in range(pick.randint(1, 3)))) for c, line in lines for _ in range(2)] + [("p", "*"), ("q", "*commonpiece*")]
    monkeypatch.setattr(automaton.short_matches, "__defaults__", (shard,))
    got = rules.matches(spark.createDataFrame(patterns, "category string, pattern string"), spark.createDataFrame(lines, "category string, line string"))
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    wanted = {(c, p, line) for c, p in patterns for d, line in lines if c == d and fits(p.lower(), line.lower())}
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert rules.matches(spark.createDataFrame([], "category string, pattern string"), spark.createDataFrame(lines, "category string, line string")).count() == 0


def test_grid_cells_equal_scores_of_their_rules(spark):
    pick = random.Random(2)
    tests = [(f"r{i}", "abc"[i % 3], i % 4 == 0) for i in range(90)]
    hits = sorted({("file", f"p{pick.randint(0, 19)}", f"r{pick.randint(0, 89)}") for _ in range(400)})
    units = [(v, s, f, "file", f"p{pick.randint(0, 21)}") for v in "uvw" for s in (1, 2) for f in "abc" for _ in range(pick.randint(1, 5))] + [("none", None, "a", None, None)]
    as_tests = spark.createDataFrame(tests, "run_id string, family string, novel boolean").repartition(3)
    runs = rules.numbered_runs(as_tests)
    as_hits = spark.createDataFrame(hits, "category string, pattern string, run_id string")
    as_units = spark.createDataFrame(units, "variant string, seed int, family string, category string, pattern string")
    bitmaps = rules.hit_bitmaps(as_hits, runs)
    got = {(r["variant"], r["seed"], r["family"]): r for r in rules.grid_scores(as_units, bitmaps, runs, ["variant", "seed"]).collect()}
    assert len(got) == len({u[:3] for u in units})
    for key, r in got.items():
        held = {p for v, s, f, _, p in units if (v, s, f) == key and p}
        hit = {run for _, p, run in hits if p in held}
        own, new = {t[0] for t in tests if t[1] == key[2]}, {t[0] for t in tests if t[1] == key[2] and t[2]}
        assert (r["rules"], r["fp"], r["neg"]) == (len(held), len(hit - own), len(tests) - len(own))
        assert r["recall"] == len(hit & own) / len(own) and r["fpr"] == len(hit - own) / r["neg"] and r["novel_recall"] == len(hit & new) / len(new)
    # a cell equals the scores of its unit
    one = as_units.where("variant = 'u' and seed = 1 and family = 'b'").select(F.lit(1).alias("unit"), "family", "category", "pattern")
    score = rules.rule_scores(one.select("unit", "family").distinct(), one.join(as_hits, ["category", "pattern"]).select("unit", "run_id"), as_tests).first()
    assert (score["recall"], score["fpr"], score["novel_recall"]) == tuple(got["u", 1, "b"][c] for c in ("recall", "fpr", "novel_recall"))


def test_nearest_sets_equal_brute_force(spark, monkeypatch):
    pick = random.Random(6)
    some = lambda: sorted({f"t{int(pick.expovariate(0.08))}" for _ in range(pick.randint(0, 12))} | {"all"})
    sets = [(i, some(), f"f{i % 4}") for i in range(80)] + [(80, [], "f0"), (81, None, "f1"), (82, ["own"], "f2"), (83, ["all"], "f3")]
    protos = [(100 + i, some(), f"f{i % 4}") for i in range(60)] + [(99, ["t1", "all"], "f1"), (98, [], "f2")]
    for row in sets[:10]:
        protos.append((200 + row[0], row[1], "f9"))
    as_sets, as_protos = spark.createDataFrame(sets, "run_id int, tokens array<string>, family string"), spark.createDataFrame(protos, "proto_id int, tokens array<string>, family string")
    monkeypatch.setattr(tokens, "HEAD_TOKENS", 5)

    def brute(own, held, apart):
        best = (0.0, None, None)
        for pid, other, family in sorted(protos):
            a, b = set(held or ()), set(other)
            if apart and family == own or not a & b:
                continue
            if len(a & b) / len(a | b) > best[0]:
                best = (len(a & b) / len(a | b), family, pid)
        return best

    for apart in (False, True):
        got = {r["run_id"]: r for r in tokens.nearest_prototype(as_sets, as_protos, other_families=apart).collect()}
        assert len(got) == len(sets)
        for i, held, own in sets:
            likeness, family, _ = brute(own, held, apart)
            assert (got[i]["family"], pytest.approx(got[i]["similarity"])) == (family, likeness), i


def test_common_token_is_no_key_of_near_pairs(spark):
    n = 400
    sets = spark.createDataFrame([(f"s{i}", None, sorted({"all", f"a{i % 40}", f"b{i}", f"c{i // 2}"}), 4) for i in range(n)], "sig string, own string, tokens array<string>, na int")
    counts = {"all": n} | {f"a{i}": n // 40 for i in range(40)}
    rare = sets.withColumn("tokens", F.expr("array_sort(tokens, (x, y) -> case when x = 'all' then 1 when y = 'all' then -1 when x < y then -1 when x > y then 1 else 0 end)"))
    protos = rare.select(F.col("sig").alias("psig"), F.lit("f").alias("family"), F.lit(1).alias("first"), "tokens", F.col("na").alias("nb"))
    pairs = tokens.near_pairs(rare, protos, 0.3)
    assert "all" not in {r["token"] for r in pairs.select("token").distinct().collect()} and counts["all"] == n
    assert pairs.count() == n * 11  # itself, the one that shares its c, the nine that share its a


# --- attributions of trees


def tree_model(spark, n=400, depth=4, rounds=3):
    pick = np.random.default_rng(3)
    x = pick.normal(size=(n, 10)).round(2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id int, features array<double>, label int")
    return rows, x, models.fit_gate(rows, rounds=rounds, depth=depth)


def given(tree, x, known):
    """What a tree gives for a row of which only some features are known: both children by their rows elsewhere."""

    def walk(at):
        feature, threshold, left, right, value, rows = tree[at]
        if left < 0:
            return value
        if feature in known:
            return walk(left if x[feature] <= threshold else right)
        return (tree[left][5] * walk(left) + tree[right][5] * walk(right)) / rows

    return walk(0)


def test_contributions_equal_shapley_values():
    pick = random.Random(8)

    def grow(nodes, rows, depth):
        at = len(nodes)
        nodes[at] = None
        if depth == 0 or rows < 4 or pick.random() < 0.1:
            nodes[at] = (-1, 0.0, -1, -1, pick.uniform(-1, 1), float(rows))
        else:
            cut = pick.randint(1, rows - 1)
            feature, threshold = pick.randint(0, 9), pick.uniform(-1, 1)
            left = grow(nodes, cut, depth - 1)
            right = grow(nodes, rows - cut, depth - 1)
            nodes[at] = (feature, threshold, left, right, 0.0, float(rows))
        return at

    trees = []
    for _ in range(4):
        nodes = {}
        grow(nodes, 300, 6)
        trees.append(nodes)
    weights = [1.0, 0.5, 0.25, 2.0]
    forest = attributions.Forest([leaf for t, w in zip(trees, weights) for leaf in attributions.leaves_of(t, w)])
    x = np.array([[pick.uniform(-1.5, 1.5) for _ in range(10)] for _ in range(4)])
    got = forest.contributions(x)
    for row, mine in zip(x, got):
        value = lambda known: sum(w * given(t, row, known) for t, w in zip(trees, weights))
        games = {s: value(s) for k in range(11) for s in map(frozenset, itertools.combinations(range(10), k))}
        for i in range(10):
            wanted = sum(math.factorial(len(s)) * math.factorial(9 - len(s)) / math.factorial(10) * (games[s | {i}] - games[s]) for s in games if i not in s)
            assert mine[i] == pytest.approx(wanted, abs=1e-9)
        assert forest.expected == pytest.approx(games[frozenset()]) and forest.margin(row[None])[0] == pytest.approx(games[frozenset(range(10))])
    wide = attributions.Forest(forest.leaves)
    wide.tables = [None] * len(wide.leaves)  # paths of many features take each row by itself
    assert np.allclose(wide.contributions(x), got)


def test_contributions_of_the_gate_add_up_to_its_margin(spark):
    rows, x, model = tree_model(spark)
    forest = attributions.forest_of(model, spark)
    raw = {r["id"]: r["m"] for r in model.transform(rows.withColumn("__features", models.array_to_vector("features"))).select("id", F.get(models.vector_to_array("rawPrediction"), F.lit(1)).alias("m")).collect()}
    told = attributions.with_contributions(rows.unionByName(spark.createDataFrame([(-1, None, 0)], rows.schema)).withColumn("expected", F.lit("x")), forest, keep=["id"])
    for r in told.collect():
        assert (r["contributions"] is None) == (r["id"] == -1)
        if r["id"] >= 0:
            assert r["expected"] + sum(r["contributions"]) == pytest.approx(raw[r["id"]], abs=1e-9)
    top = attributions.top_contributions(told.where("id >= 0"), "id", names=[f"n{i}" for i in range(10)], k=3).collect()
    assert {r["rank"] for r in top} == {1, 2, 3} and len(top) == 3 * len(x)
    share = sum(r["feature"] in ("n0", "n1", "n2") for r in top if r["rank"] == 1) / len(x)
    assert share > 0.9
