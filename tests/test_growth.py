"""Steps whose work must not grow with the square of their input, against brute force."""

import random

from pyspark.sql import functions as F

from runtrail.operators import negatives, rules, tokens


def test_metadata_rules_try_few_sets_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rules, "TRIED", (1, 3))
    monkeypatch.setattr(rules, "HEAD_TOKENS", 5)
    draw = random.Random(3)
    runs = {i: (draw.choice(["a", "b", None]), sorted(draw.sample([f"imp:d:{c}" for c in "abcdefghijklmnopqrst"], draw.randint(1, 7)))) for i in range(120)}
    rows = spark.createDataFrame([(i, f, t) for i, (f, ts) in runs.items() for t in ts], "run_id long, family string, token string")
    common = {f"imp:d:{c}": k / 1000 for k, c in enumerate("abcdefghijklmno")} | {"imp:d:a": 0.5}
    prevalence = spark.createDataFrame(list(common.items()), "token string, p double")
    wanted = {}
    for i, (f, ts) in runs.items():
        own = [t for t in sorted(ts, key=lambda t: (common.get(t, 0.0), t))[:8] if common.get(t, 0.0) < 0.05]
        need = max(2, round(len(own) * 0.75))
        if len(own) >= 3 and not any(len(set(own) & set(other)) >= need for g, other in runs.values() if g != f):
            wanted[i] = (own, need)
    got = {r["run_id"]: (r["imports"], r["need"]) for r in rules.metadata_rules(rows, rows, prevalence).collect()}
    assert got == wanted and 0 < len(wanted) < len(runs)


def test_rules_meet_sets_in_blocks_and_not_as_pairs(spark, monkeypatch):
    from runtrail.operators import overlaps

    monkeypatch.setattr(overlaps, "SMALL", 300)
    monkeypatch.setattr(overlaps, "PART", 40)
    monkeypatch.setattr(overlaps, "BATCH", 16)
    monkeypatch.setattr(overlaps, "EXPANDED", 50)
    written, put = {}, rules.staged
    monkeypatch.setattr(rules, "staged", lambda df, label: (written.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()), put(df, label))[1])
    draw = random.Random(11)
    words = [f"w{c}" for c in range(40)]
    runs = {(draw.choice("abc"), i): sorted(draw.sample(words, draw.randint(1, 12))) for i in range(160)}
    runs |= {("a", 200): ["é", "y", "z"], ("b", 200): ["x", "y", "z"], (None, 201): ["x", "y", "é"], (None, None): words[:9], ("c", None): ["x", "z", "é"], ("b", 202): []}
    sets = spark.createDataFrame([(f, i, ts) for (f, i), ts in runs.items()], "family string, run_id long, tokens array<string>").repartition(3)
    share = {c: (k % 9) / 200 for k, c in enumerate(words)} | {"w3": 0.5}
    got = {r["run_id"]: (r["imports"], r["need"]) for r in rules.set_rules(sets, spark.createDataFrame(list(share.items()), "token string, p double")).collect()}
    wanted = {}
    for i in {i for _, i in runs} - {None}:
        own = min((f for f, j in runs if j == i and f), default=None)
        picked = sorted(({t for (_, j), ts in runs.items() if j == i for t in ts if share.get(t, 0.0) < 0.05}), key=lambda t: (share.get(t, 0.0), t))[:8]
        need = max(2, round(len(picked) * 0.75))
        if len(picked) >= 3 and not any(len(set(picked) & set(ts)) >= need for (f, _), ts in runs.items() if f != own):
            wanted[i] = (picked, need)
    assert got == wanted and 20 < len(wanted) < len(runs) - 20
    # pairs of a rule and a set were rows of a join on tokens
    assert "Join" not in written["hit-rules"] and "RepartitionBy" in written["hit-rules"]


def test_a_block_looks_at_few_sets_for_all_tokens():
    import numpy as np
    import pyarrow as pa

    from runtrail.operators.overlaps import Block

    draw = random.Random(2)
    held = [sorted(draw.sample(range(400), 60)) for _ in range(900)]
    sides = [draw.choice("ab") for _ in held]
    asked = [sorted(draw.sample(range(400), 8)) for _ in range(300)] + [s[:8] for s in held[:40]]
    own = [draw.choice("abc") for _ in range(300)] + sides[:40]
    names = lambda rows: pa.array([[f"t{t}" for t in r] for r in rows], pa.list_(pa.string()))
    block = Block([(pa.array(sides[i::2]), names(held[i::2]).flatten().dictionary_encode(), np.full(len(held[i::2]), 60)) for i in (0, 1)])
    hit = block.hits(names(asked), pa.array(own), np.full(len(asked), 6), (3, 20))
    assert list(hit) == [any(s != o and len(set(a) & set(h)) >= 6 for h, s in zip(held, sides)) for a, o in zip(asked, own)]
    single = sum(len(set(a[:3]) & set(h)) > 0 for a in asked for h in held)
    assert block.compared * 2 < single
    empty = Block([])
    assert not empty.hits(names([[1, 2, 3]]), pa.array(["a"]), np.array([2]), ()).any()


def test_tokens_are_made_without_a_join_on_hot_values(spark):
    rows = spark.createDataFrame([(1, "api_call", "kernel32.dll.Sleep", None), (1, "api_call", "EnumProcesses", None), (1, "file_write", "C:\\a\\f1.locked", None), (2, "process_create", "cmd.exe", '"'), (2, "process_create", "cmd.exe", ""), (2, "registry_set", None, None), (3, None, None, None)], "run_id long, type string, target string, cmdline string")
    found = tokens.behaviour_tokens(rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert {(1, "api:sleep"), (1, "file_write:c:\\a\\f#.locked"), (1, "tech:T1486"), (2, "cmd:"), (2, "exec:cmd.exe"), (2, "registry_set:")} <= set(got) and len(got) == len(set(got)) and all(r != 3 for r, _ in got)
    assert sorted(map(tuple, tokens.technique_tokens(rows).collect())) == [g for g in got if g[1].startswith(("tech:", "tactic:", "api:"))]


def test_bags_of_words_need_no_shuffle(spark, sf_dir):
    from runtrail.plans import queries

    bags = queries.word_bags(spark, sf_dir)
    assert not {"Exchange", "Aggregate", "Join"} & set(bags._jdf.queryExecution().executedPlan().toString().replace("+-", " ").split())
    wanted = {r["doc_id"]: set(r["t"]) for r in queries.words(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("token").alias("t")).collect()}
    rows = bags.where("size(tokens) > 0").collect()
    assert {r["run_id"]: set(r["tokens"]) for r in rows} == wanted and all(len(r["tokens"]) == len(set(r["tokens"])) for r in rows)


def test_rare_imports_by_sets_equal_those_by_rows(spark, monkeypatch):
    monkeypatch.setattr(rules, "HEAD_TOKENS", 2)
    rows = spark.createDataFrame([(f, r, f"imp:{t}") for f, r, ts in (("a", 1, "xyz"), ("a", 2, "xy"), ("a", 3, "xq"), ("b", 4, "xxz"), ("b", 5, "zz")) for t in ts], "family string, run_id long, token string")
    sets = rows.groupBy("family", "run_id").agg(F.collect_set("token").alias("tokens"))
    by_set = negatives.set_prevalence(sets)
    assert sorted(map(tuple, by_set.collect())) == sorted(map(tuple, negatives.import_prevalence(rows).collect())) == [("a", "imp:x", 1.0), ("a", "imp:y", 0.6667), ("b", "imp:z", 1.0)]
    common = negatives.prevalence_without(by_set, None)
    got = {r["run_id"]: r["imports"] for r in rules.rare_imports(rows, common, 2, 0.9).collect()}
    assert got == {1: ["imp:y"], 2: ["imp:y"], 3: ["imp:q"]}


def test_rare_imports_join_no_common_tokens_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rules, "HEAD_TOKENS", 6)
    written, put = {}, rules.staged
    monkeypatch.setattr(rules, "staged", lambda df, label: written.setdefault(label, put(df, label)))
    draw = random.Random(7)
    runs = {i: draw.sample("abcdefghijklmnopqrst", draw.randint(0, 12)) for i in range(90)} | {90: ["t"], 91: ["é", "z", "a"]}
    share = {c: k // 2 / 100 for k, c in enumerate("tsrqponmlkjihg")}
    sets = spark.createDataFrame(list(runs.items()), "run_id long, tokens array<string>").repartition(3)
    got = {r["run_id"]: r["imports"] for r in rules.rare_in_sets(sets, spark.createDataFrame(list(share.items()), "token string, p double"), 3, 0.06).collect()}
    wanted = {i: sorted((t for t in ts if share.get(t, 0.0) < 0.06), key=lambda t: (share.get(t, 0.0), t))[:3] for i, ts in runs.items()}
    assert got == {i: ts for i, ts in wanted.items() if ts}
    head = {r["token"] for r in written["common-tokens"].collect()}
    assert len(head) == 6 and all(len(r["often"]) <= 3 and not head & set(r["rest"]) for r in written["rare-in-rows"].collect())


def test_words_of_documents_are_made_in_rows_and_repeated_ids_united(spark, tmp_path, monkeypatch):
    from runtrail.plans import queries

    def shuffled(rows):
        spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        plans, put = {}, queries.staged
        monkeypatch.setattr(queries, "staged", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), put(df, label))[1])
        got = sorted(((r["family"] or "", r["run_id"] or 0, sorted(r["tokens"])) for r in queries.word_sets(spark, str(tmp_path)).collect()))
        monkeypatch.setattr(queries, "staged", put)
        return got, "Exchange" in plans["word-sets"]

    plain = [(1, "a", "One two, ONE"), (2, None, "x"), (3, "b", None), (None, "b", "éy 5"), (4, "b", " 12 ")]
    assert shuffled(plain) == ([("", 2, ["x"]), ("a", 1, ["one", "two"]), ("b", 0, ["y"])], False)
    assert shuffled([*plain, (1, "a", "three one"), (1, "b", "one"), (2, None, "z"), (None, "b", "w")])[0] == [("", 2, ["x", "z"]), ("a", 1, ["one", "three", "two"]), ("b", 0, ["w", "y"]), ("b", 1, ["one"])]


def test_words_as_bytes_equal_words_by_expression(spark, sf_dir, monkeypatch):
    from runtrail.plans import queries

    odd = ["", None, "aB", "b a B", "é1Ab\u212aZz\U0001f600z@[`{", "\x00x\ny", None, "ends", "Begins", " ", "s\u017f", "x" * 70]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").coalesce(1).unionByName(queries.table(spark, sf_dir, "documents").select("doc_id", "text"))
    for size in (1 << 23, 5):
        monkeypatch.setattr(tokens, "TEXT", size)
        got = sorted((r["doc_id"], sorted(r["tokens"])) for r in tokens.word_rows(rows).collect())
        assert got == sorted((r["doc_id"], sorted(r["t"] or [])) for r in rows.select("doc_id", queries.distinct_words().alias("t")).collect())
    assert {i: t for i, t in got if i < 12 and t == ["x", "y"]} == {5: ["x", "y"]}


def test_ladders_are_made_once_for_all_users_of_a_path(spark):
    rows = [(r, 1, "file_write", f"C:\\Users\\u{r}\\AppData\\Roaming\\app3\\f9.exe", None) for r in range(30)] + [(r, 2, "process_create", "cmd.exe", f"cmd.exe /c del {r}") for r in range(30)]
    events = spark.createDataFrame(rows, "run_id long, seq long, type string, target string, cmdline string")
    made = rules.ladders(rules.actions(events)).collect()
    assert {r["category"] for r in made} == {"file_event", "process_creation"} and len({(r["category"], r["base"], r["whole"]) for r in made}) == 2 and len(made) < 10
    got = rules.candidates(events).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "pos", "rung", "pattern", "specific"))).alias("c")).collect()
    wanted = sorted((1 if r["category"] == "file_event" else 2, r["pos"], r["rung"], r["pattern"], r["specific"]) for r in made)
    assert len(got) == 30 and all(list(map(tuple, r["c"])) == wanted for r in got)
    # a run without a family is a candidate's too
    acts = rules.actions(events).withColumn("family", F.when(F.col("run_id") > 0, "f"))
    passing = acts.select(*rules.SHAPE, "family").distinct().join(rules.ladders(acts), rules.SHAPE)
    best = {(r["run_id"], r["first_seq"]): r["pattern"] for r in rules.picked(acts, passing).collect()}
    assert best == {(run, seq): max(w for w in wanted if w[0] == seq)[3] for run in range(30) for seq in (1, 2)}


def test_survivors_by_counts_of_families_equal_brute_force(spark):
    draw = random.Random(5)
    families = {r: {draw.choice(["a", "b", "c", None]) for _ in range(draw.choice([1, 1, 2]))} for r in range(60)}
    hits = sorted({("file", f"p{draw.randint(0, 11)}", r, f) for _ in range(260) for r in [draw.randint(0, 59)] for f in families[r]}, key=str)
    own = [("file", f"p{i}", f, i != 3) for i in range(13) for f in ("a", "b", "d", None)]
    as_rules = spark.createDataFrame(own, "category string, pattern string, family string, specific boolean")
    for one_family in (False, True):
        seen = [h for h in hits if not one_family or len(families[h[2]]) == 1]
        as_hits = spark.createDataFrame(seen, "category string, pattern string, neg_run long, neg_family string")
        got = {(r["pattern"], r["family"]) for r in rules.surviving(as_rules, as_hits, 9, one_family=one_family).collect()}
        wanted = {(p, f) for _, p, f, specific in own if specific and len({r for _, q, r, g in seen if q == p and None not in (f, g) and g != f}) <= 9}
        assert got == wanted and 0 < len(got) < 48


def test_lines_fit_patterns_without_a_compiled_like(spark):
    pairs = [("*abcdef*abcdef", "abcdefabcdef"), ("*abcdef*abcdef", "abcdef"), ("abcdef*f", "abcdef"), ("*abcdef**ghijkl*", "xabcdefghijkl"), ("*ABCDEF*é", "abcdef\né"), ("*abcdef_*", "abcdefg"), ("abcdef*", "xabcdef"), ("*abcdef*g*abcdef*", "abcdefgxabcdefabcdef")]
    patterns = spark.createDataFrame([("x", p) for p, _ in pairs], "category string, pattern string")
    found = rules.matches(patterns, spark.createDataFrame([("x", line) for _, line in pairs], "category string, line string"))
    assert " LIKE " not in found._jdf.queryExecution().optimizedPlan().toString()
    import re

    fits = lambda p, line: re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in p.lower()), line.lower(), re.S)
    assert sorted((r["pattern"], r["line"]) for r in found.collect()) == sorted({(p, line) for p, _ in pairs for _, line in pairs if fits(p, line)})


def test_grid_decides_by_shape_and_keeps_bitmaps_of_chosen_patterns_alone(spark, sf_dir, monkeypatch):
    from runtrail.plans import queries

    written, put, kept, make = {}, queries.staged, [], rules.hit_bitmaps
    monkeypatch.setattr(queries, "staged", lambda df, label: written.setdefault(label, put(df, label)))
    monkeypatch.setattr(queries.rules, "hit_bitmaps", lambda hits, runs: (kept.append(hits), make(hits, runs))[1])
    assert queries.rule_grid(spark, sf_dir).count() > 0
    named = lambda df: {(r["category"], r["pattern"]) for r in df.select("category", "pattern").distinct().collect()}
    assert "run_id" not in written["passing"].columns and {"base", "whole", "family"} <= set(written["passing"].columns)
    assert named(kept[0]) == named(written["chosen"]) & named(written["rule-hits"])
