"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", "  \n\t", "one", "two words", "é É ünï", "a" * 5000, "word " * 3000, "The the THE", "x@y.com 1.2.3.4"]


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def sentences(n, seed=1, words=40):
    pick = random.Random(seed)
    vocab = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(400)]
    return [" ".join(pick.choice(vocab) for _ in range(words)) for _ in range(n)]


# --- 1 personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def booster(spark):
    from runtrail.llm.pii import fit

    return fit(spark, rows=3000, trees=8)


def test_base_spans_match_the_plain_patterns(spark, booster):
    from runtrail.llm.pii import pii_digest, with_spans

    pick = random.Random(5)
    bits = ["4", "1", "11", "0", " ", "-", ".", "@", "a", "b.c", "+", "(", ")", "256", "é", "4111111111111111", "\U0001f600", "1.2.3.4"]
    texts = ODD_TEXTS + ["".join(pick.choice(bits) for _ in range(pick.randint(0, 50))) for _ in range(400)] + ["1.2.3.4 " * 3000]
    got = {r["doc_id"]: r for r in pii_digest(with_spans(documents(spark, texts, spans="mine", pii_spans=1), booster)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(w[0] == k for w in want) for k, _ in BASE]
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))


def test_boosted_trees_add_what_the_patterns_miss_and_leave_clean_text(spark, booster):
    from runtrail.llm.pii import redacted

    texts = ["write to ann (at) corp dot org now", "call (555) 123-4567 today", "in 4465758382889437 4465758382889437 end", "order 123456789 on 2024-01-02 12:30", "look at the dot on it", None]
    got = [r["text"] for r in redacted(documents(spark, texts, k0=1), booster).orderBy("doc_id").collect()]
    assert got[0] == "write to [EMAIL] now" and got[1] == "call [PHONE] today" and got[2].count("[CARD]") == 2
    assert got[3:] == texts[3:]


def test_many_spans_in_a_long_text_take_linear_time(spark, booster):
    from runtrail.llm.pii import pii_digest, redacted, with_spans

    took = []
    for n in (5_000, 40_000):
        text = " ".join(f"u{i}@h{i % 7}.org" if i % 3 else f"ann (at) h{i} dot org," for i in range(n))
        began = time.perf_counter()
        rows = pii_digest(with_spans(documents(spark, [text]), booster)).collect()
        new = redacted(documents(spark, [text]), booster).first()["text"]
        took.append(time.perf_counter() - began)
        assert rows[0]["n_email"] == len(base_spans(text)) and new.count("[EMAIL]") == n and not base_spans(new)
    print("seconds", took)
    assert took[1] < 60


def brute_best(base, chosen):
    """Of the spans (p, k, s, e) that touch no base span, those that none better overlaps."""
    apart = lambda x, y: y[-1] <= x[-2] or x[-1] <= y[-2]
    free = [x for x in chosen if all(apart(x, y) for y in base)]
    rank = lambda x: (-x[0], x[2] - x[3], x[2], x[1])
    return {x[1:] for x in free if all(apart(x, y) or rank(x) <= rank(y) for y in free)}


def test_overlaps_and_redaction_equal_brute_force(spark, booster):
    from runtrail.llm.pii import redacted, with_base, with_candidates, with_spans

    pick = random.Random(9)
    bits = ["ann (at) corp dot org ", "a@b.cd", "4465758382889437 ", "+1 (212) 555-0147 ", "(555) 123-4567 ", "tel ", "0301234567 ", "x at y dot z", "2001:db8::1 ", "1.2.3.4", ".", " at ", "é\U0001f600 "]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, k))) for k in (6, 40, 400) for _ in range(30)] + ODD_TEXTS
    docs = documents(spark, texts)
    spans = {r["doc_id"]: {(x["k"], x["s"], x["e"]) for x in r["pii_spans"]} for r in with_spans(docs, booster).collect()}
    rows = with_candidates(with_base(docs.withColumn("t", F.coalesce("text", F.lit(""))), "t"), "t").withColumn("chosen", F.expr(booster.selected()))
    for r in rows.collect():
        base = [(k, x["s"], x["e"]) for k, _ in BASE for x in r[f"base_{k}"]]
        assert spans[r["doc_id"]] == set(base) | brute_best(base, [(x["p"], x["k"], x["s"], x["e"]) for x in r["chosen"]]), texts[r["doc_id"]]
    for r in redacted(docs, booster).collect():
        text, want, at = texts[r["doc_id"]], "", 0
        if text is None:
            assert r["text"] is None
            continue
        for lo, _, kind, hi in ((s, e, k, e) for s, e, k in sorted((s, e, k) for k, s, e in spans[r["doc_id"]])):
            if lo >= at:
                want += text[at:lo] + f"[{kind.upper()}]"
            at = max(at, hi)
        assert r["text"] == want + text[at:]


#: Lines written by hand, apart from the rules of the training table; what is personal stands between ⟦kind: and ⟧.
WRITTEN = """
Please reach Maria at ⟦email:maria.k (at) gardening (dot) org⟧ before Friday.
Kontakt: ⟦email:info [at] verein [dot] de⟧, Montag bis Freitag.
Send the minutes to ⟦email:tom.h at northside dot net⟧ thanks
my address is ⟦email:zoe77(at)kiosk.fr⟧, write soon
questions? ⟦email:press {at} museum.es⟧
You can call ⟦phone:(415) 555-0132⟧ after six.
Tel. ⟦phone:030/4471902⟧ (nur vormittags)
phone: ⟦phone:212-555-0198⟧ or fax ⟦phone:212-555-0199⟧
mobile ⟦phone:0044 20 7946 0018⟧
She paid with card ⟦card:4539 1488 0343 6467⟧ yesterday.
amex ⟦card:371449635398431⟧ on file
credit card: ⟦card:3782-822463-10005⟧
The host ⟦ip:2001:db8:85a3::8a2e⟧ did not answer.
ping ⟦ip:fe80:0:0:1:2:3:4:5⟧ twice
We met at the corner, dot on the map and all.
Order 4471902 shipped on 2023-05-14 10:30.
Invoice total 1204.50, reference 99812 7721.
The lecture is at 10:45:00 in room 12.
ISBN 978-3-16-148410-0 costs 29.99
version 10.2.33.1.7 of build 20231105
look at that. Then we left at noon.
Population 3461785 in 1990, 3520031 in 2010.
serial 88213490017 token 19384756201
they arrived at home. Dinner was at 8.
pages 112-118, volume 44, number 3
Ruf mich an: ⟦phone:0171 / 2345678⟧, abends
Praxis ⟦phone:089-1234567⟧ ab acht Uhr
llame al ⟦phone:0034 612 345 678⟧ por favor
Diners club ⟦card:30569309025904⟧ was charged
paid by ⟦card:3056 930902 5904⟧ on site
the gateway ⟦ip:fe80::1⟧ is up
ping ⟦ip:2001:db8::ff00⟧ from home
Please reach Maria at ⟦email:maria.k (at) gardening (dot) org⟧ again
Schreib an ⟦email:vorstand [at] tennisclub-sued [dot] de⟧ bis morgen
contact ⟦email:b.ohara(at)lighthouse.net⟧ for keys
mail me: ⟦email:peter at riverside dot org⟧ ok
Fax ⟦phone:040/55512-34⟧ im Haus
phone ⟦phone:(020) 7946 0018⟧ or come by
mobile ⟦phone:0151-20304050⟧ only
Tel: ⟦phone:00 44 20 7946 0991⟧ thanks
call ⟦phone:617.555.0143⟧ tomorrow
her number is ⟦phone:312 555 0187⟧, ask first
Visa ⟦card:4556 7375 8689 9855⟧ expired
mastercard ⟦card:5425-2334-3010-9903⟧ works
card ⟦card:371449635398431⟧ kept
server ⟦ip:2001:0db8:0000:0000:0000:ff00:0042:8329⟧ log
client ⟦ip:fd12:3456:789a:1::1⟧ left
Season 1998/1999 was long.
File 12/2044 is closed, page 77/3120 too.
at 10:45 and 11:30 we met
the year 2010-2014 report, 300 pages
ratio 16:9 and 4:3 screens
order 30569309025 shipped in 3 days
the sum of 120 500 000 was paid
see chapter 3.14.15 and table 2-4
he sat at the table. Dot by dot it grew.
meet me at noon. The dot org boom ended.
ISBN 0-306-40615-2 and 0-471-95869-7
coordinates 48.1372 11.5756 in town
model 4000-1200 with 16 GB at 3200 MHz
room 0171 on floor 4, locker 2345
"""


def test_added_spans_on_lines_written_by_hand(spark):
    """Precision and recall of what the method adds to the base patterns, on lines that no rule of the training table made."""
    from runtrail.llm.pii import fit, with_spans

    booster = fit(spark)  # the query's own model

    lines, truth = [], []
    for line in WRITTEN.strip().split("\n"):
        plain, spans = "", set()
        for part in re.split("(⟦[^⟧]*⟧)", line):
            kind, _, value = part[1:-1].partition(":") if part.startswith("⟦") else ("", "", part)
            if kind:
                spans.add((kind, len(plain), len(plain) + len(value)))
            plain += value
        lines.append(plain)
        truth.append(spans)
    got = {r["doc_id"]: {(x["k"], x["s"], x["e"]) for x in r["pii_spans"]} for r in with_spans(documents(spark, lines), booster).collect()}
    base = [{b for b in base_spans(t)} for t in lines]
    added = [got[i] - base[i] for i in range(len(lines))]
    right = sum(len(a & t) for a, t in zip(added, truth))
    made, wanted = sum(map(len, added)), sum(len(t - b) for t, b in zip(truth, base))
    print(f"added spans: {right} right of {made} made, {wanted} wanted", [(lines[i], added[i], truth[i]) for i in range(len(lines)) if added[i] != truth[i] - base[i]])
    assert right >= 0.9 * made and right >= 0.9 * wanted


def test_generators_propose_all_that_their_patterns_match(spark):
    from runtrail.llm.pii import WIDER, redacted, with_candidates

    texts = ["write to ann (at) corp.org now", "mail ann @ corp.org", "contact ann at corp.org. Then", "tel 030/1234567 today", "tel 030/123456", "ann@corp(dot)org", "x{at}y.z", "1/2/3/4/5/6/7", "a at b dot c", "a at b", "1/2/3"]
    rows = with_candidates(documents(spark, texts), "text").selectExpr("doc_id", "transform(candidates, x -> named_struct('k', x.k, 's', x.s, 'e', x.e)) as c").collect()
    got = {r["doc_id"]: {(c["k"], c["s"], c["e"]) for c in r["c"]} for r in rows}
    for i, text in enumerate(texts):
        for kinds, pattern, _ in WIDER:
            for m in re.finditer(pattern, text):
                assert {(k, *m.span()) for k in kinds} <= got[i], text
    found = [r["text"] for r in redacted(documents(spark, texts[:5] + ["they were at home. The rest", "on 12/05/2021 we left"], k0=1)).orderBy("doc_id").collect()]
    assert found == ["write to [EMAIL] now", "mail [EMAIL]", "contact [EMAIL]. Then", "tel [PHONE] today", "tel [PHONE]", "they were at home. The rest", "on 12/05/2021 we left"]


# --- 2 mixing


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(capped.values()), [s for s in sizes if s not in capped]
        over = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not over:
            return {s: capped[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in sizes}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing_meets_targets_and_repeats(spark):
    from runtrail.llm.mixing import mixed, mixing_digest, mixture

    pick = random.Random(3)
    rows = [(i, " ".join("w" * pick.randint(1, 60)), "en", s, 0) for i, s in enumerate(["big"] * 500 + ["Z"] * 150 + ["a"] * 90 + ["é"] * 60 + ["tiny"] * 3)]
    rows += [(9000 + i, None, "en", "empty", 0) for i in range(3)] + [(7, rows[7][1], "en", "big", 0), (None, "a b", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("mine"))
    got = mixing_digest(mixed(docs, keep=["doc_id", "source"])).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    full = mixed(docs, keep=["doc_id", "source"]).collect()
    assert len(full) == len(rows) == len(got)
    sizes = Counter()
    for r in full:
        sizes[r["source"]] += r["size"]
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in full:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in ("big", "Z", "a", "é"):
        assert taken[s] == pytest.approx(want[s], rel=0.1)
    again = mixed(docs.repartition(7), keep=["doc_id", "source"]).collect()
    assert sorted(map(str, full)) == sorted(map(str, again))
    assert mixture(docs).count() == sum(r["copies"] for r in full)
    assert mixed(docs.limit(0)).count() == 0


# --- 3 simhash


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    from runtrail.llm.simhash import component_digest, near_duplicates, one_of_each

    base = sentences(60, 2, 120)
    texts = ODD_TEXTS + base + base[:10] + [base[30]] * 90 + [t[:-9] for t in base[:20]] + [t.upper() for t in base[5:8]]
    docs = documents(spark, texts, component_id=1, fp="x")
    got = {r["doc_id"]: r for r in component_digest(near_duplicates(docs)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    for i, root in enumerate(components(fps)):
        assert got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == root
    kept = one_of_each(docs.unionByName(docs.limit(20)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(fps))) and kept.columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [40, 3])
def test_long_lists_keep_components_whole(spark, monkeypatch, crowded):
    from runtrail.llm import simhash

    monkeypatch.setattr(simhash, "CROWDED_LIST", crowded)
    pick = random.Random(4)
    seeds = [pick.getrandbits(64) for _ in range(3)]
    fps = {s ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 6))) for s in seeds for _ in range(150)}
    fps = sorted(fps | {pick.getrandbits(64) for _ in range(100)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    place = {v: i for i, v in enumerate(signed)}
    root = list(range(len(signed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert [find(i) for i in range(len(signed))] == components(fps)


def test_components_of_a_chain_and_a_star(spark):
    from runtrail.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[0] != got[100]


# --- 4 language


def test_language_held_out_accuracy_and_rejection(spark, sf_dir):
    from runtrail.llm.language import fit, identify, keep_identified, language_digest

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs, per_language=60)
    rows = language_digest(identify(docs.select("doc_id", "text"), model)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    odd = identify(documents(spark, [None, "", "123 !?", "été", "the thing"], score="mine"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in odd) and [r["rejected"] for r in odd[:3]] == [True] * 3
    assert keep_identified(docs, model).count() >= 0.995 * docs.count()
    nothing = fit(docs.limit(0))
    assert nothing is None and {r["lang_pred"] for r in identify(docs.limit(5), nothing).collect()} == {"und"}


def test_language_rejects_noise_and_unlearned_scripts(spark):
    from runtrail.llm.language import fit, identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs)
    draw = random.Random(71)
    odd = []
    for n in (64, 200, 1000, 3000):
        for _ in range(10):
            for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x9000)))):
                odd.append("".join(draw.choice(letters) for _ in range(n)))
    odd.append("Το κείμενο αυτό είναι γραμμένο στα ελληνικά και δεν ανήκει σε καμία από τις γλώσσες του πίνακα.")
    found = identify(documents(spark, odd), model).where("not rejected").count()
    assert found <= 0.02 * len(odd)
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 0 and lang is not null and text is not null")
    kept = identify(held, model).where("not rejected").count()
    print("noise kept", found, "of", len(odd), "held-out kept", kept, "of", held.count())
    assert kept >= 0.985 * held.count()


# --- 5 URLs


@pytest.fixture(scope="module")
def url_model(spark):
    from runtrail.llm.urls import fit

    return fit(spark)


def test_urls_of_the_hand_written_table_that_were_held_out(spark):
    """A third of the addresses is learned from neither as it is nor in another form."""
    from runtrail.llm import urls

    table = [(u, 1.0) for u in urls.BLOCK] + [(u, 0.0) for u in urls.ALLOW]
    random.Random(4).shuffle(table)
    model = urls.fit(spark, urls.labelled_urls(spark, table[60:]))
    host, path = urls.url_parts(F.col("url"))
    rows = spark.createDataFrame(table[:60], "url string, label double").withColumns({"host": host, "path": path})
    got = [(r["label"], r["p"] >= urls.THRESHOLD) for r in model.with_probability(rows, "p").collect()]
    right = sum((label == 1) == said for label, said in got)
    print("held-out addresses:", right, "right of", len(got), "wanted ones blocked:", sum(said for label, said in got if label == 0), "of", sum(label == 0 for label, _ in got))
    assert right >= 0.65 * len(got)


def test_a_model_of_personal_data_is_kept_in_the_shared_folder(spark, monkeypatch):
    from runtrail.llm import pii

    first = pii.fit(spark, rows=400, trees=2, depth=2)
    monkeypatch.setattr(pii, "_FITTED", {})
    monkeypatch.setattr(pii, "GBTClassifier", lambda **_: pytest.fail("trained again"))
    again = pii.fit(spark, rows=400, trees=2, depth=2)
    assert (again.margin, again.thresholds) == (first.margin, first.thresholds)


def test_url_rules_and_regression(spark, url_model):
    from runtrail.llm.urls import RULES, judged, url_digest

    urls = ["https://A.Net/x", None, "foo", "http://net", "ftp://sub.example.net/en/?a/://", "http://x.org/fr/a#b", "http://org/fr", "http://notnet/x", "http://free-casino.example.io/win", "https://www.garden-news.example.io/en/12", "http://example.com/de/1", "http://user@h.org:80?x"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("mine"))
    got = url_digest(judged(rows, url_model)).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == ["net/", None, None, None, "example.net/en/", "org/fr/", None, None, None, None, "example.com/de/", None]
    assert [(r["host"], r["path"]) for r in got[:5]] == [("a.net", "/x"), ("", ""), ("", ""), ("net", ""), ("sub.example.net", "/en/")]
    assert got[11]["host"] == "user@h.org:80" and got[11]["path"] == ""
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow" and {r["verdict"] for r in got} == {"block", "allow"}
    table = spark.createDataFrame(RULES, "verdict string, rule string")
    joined = url_digest(judged(rows.drop("rule"), url_model, table)).orderBy("page_id").collect()
    assert [tuple(r) for r in joined] == [tuple(r) for r in got]


# --- 6 fingerprints


def test_fingerprints_of_neighbours(spark):
    from runtrail.llm.fingerprints import edited, likeness, fingerprint, with_next

    texts = [(None, "x y z"), (1, None), (1, "aaaa bbbb"), (2, ""), (3, "hello there my friend " * 9), (3, "hello there my friend " * 9), (9, "é" * 9), (12, sentences(1, 8, 600)[0])]
    ordered = sorted(((k is not None, k or 0), t or "") for k, t in texts)
    want = Counter()
    for i, (key, text) in enumerate(ordered):
        new = edited(text, ordered[(i + 1) % len(ordered)][1])
        want[(key[1] if key[0] else None, len(text), hashlib.sha256(new.encode()).hexdigest())] += 1
    for ranges in (1, 3, 300):
        got = with_next(spark.createDataFrame(texts, "doc_id long, text string"), ranges=ranges).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = sentences(1, 9, 3000)[0].split()
    for kept in (2900, 2000, 1000):
        a, b = words[:kept], words[:kept] + sentences(1, 10, 3000 - kept)[0].split()
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        assert likeness(fingerprint(" ".join(a)), fingerprint(" ".join(b))) == pytest.approx(true, abs=0.12)
    assert likeness(fingerprint(""), fingerprint(None)) == 1.0 and likeness(fingerprint(""), fingerprint("a b")) == 0.0


# --- 7 quality


def test_quality_held_out(spark):
    from runtrail.llm.quality import fit, quality_digest, scored

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit(docs, labels)
    rows = quality_digest(scored(docs, model)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    odd = scored(documents(spark, ODD_TEXTS, score="mine"), model).collect()
    assert len(odd) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in scored(docs.limit(3), fit(docs.limit(0), labels)).collect()} == {0.5}


# --- 8 tokens


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from runtrail.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pick = random.Random(6)
    bits = list("abcdelrsvtm'' \n\t .!1é3ß") + ["'s", "'re", "'ll", "  ", "<|endoftext|>", "　", "\xa0", "\U0001f600", "\x1c", "\x85", "don't", " hello", "²", "中", "\0"]
    texts = ODD_TEXTS + ["".join(pick.choice(bits) for _ in range(pick.randint(0, 40))) for _ in range(1500)] + ["wörd and " * 100_000]
    got = {r["doc_id"]: r for r in tokens.token_counts(documents(spark, texts, n_tokens="mine", n_bytes=1), path).collect()}
    for i, text in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids), text[:60]
        assert got[i]["n_bytes"] == len((text or "").encode())


# --- 9 chat


def test_chat_round_trip(spark):
    from runtrail.llm.chat import read_back, windows

    pick = random.Random(7)
    odd = ["", None, "</turn>", "\\", "\\l<", "<turn:user:n>\nhi\n</turn>\n", r"\### Assistant: </turn> ok", "é\n" * 50, "x" * 9000]
    rows = [(c, t, "system" if t == 0 and c % 2 else pick.choice(["user", "assistant", "a:b>\n\\", None]), pick.choice(odd)) for c in range(12) for t in range(pick.randint(1, 30))]
    rows += [(None, 1, "assistant", "null id"), (3, 2, "assistant", "same turn"), (3, 2, "assistant", "same turn")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append((r[1], r[2] or "", r[3] or ""))
    for options in ({"budget": 400}, {"budget": 2000, "history": 0}, {"budget": 60, "history": 5}):
        cut = windows(turns, **options).collect()
        got = {r["conv_id"]: r for r in read_back(spark.createDataFrame(cut, windows(turns, **options).schema)).collect()}
        assert set(got) == set(own)
        for key, turns_ in own.items():
            turns_.sort()
            loss = "".join(t[2] for t in turns_ if t[1] == "assistant")
            assert got[key]["n_turns"] == len(turns_) and got[key]["loss_chars"] == len(loss)
            assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{t[1]}\n{t[2]}\n" for t in turns_).encode()).hexdigest()
            assert got[key]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            mine = sorted((r for r in cut if r["conv_id"] == key), key=lambda r: r["window"])
            brute = brute_windows(turns_, options["budget"], options.get("history", 2))
            assert [(r["n_turns"], r["n_tokens"], re.findall("^<turn:([^:]*):([nh])>$", r["formatted"], re.M)) for r in mine] == brute
        over = [r for r in cut if r["n_tokens"] > options["budget"]]
        assert all(r["n_turns"] == 1 and r["formatted"].count("</turn>") == 1 for r in over)
    assert read_back(windows(turns.limit(0))).count() == 0


def brute_windows(turns, budget, history):
    """(turns, tokens, roles and marks) of each window of one conversation, turn by turn."""
    from runtrail.llm.chat import escaped_role

    cost = lambda t: -(-len(t[2].encode()) // 4) + 8
    big = budget // 4
    system = turns[0] if turns[0][1] == "system" and cost(turns[0]) <= big else None
    longest = max((cost(t) for t in turns if cost(t) <= big), default=1)
    room = min(big, longest * history)
    cell = budget - (cost(system) if system else 0) - room - longest
    cuts, at, key = [], 0, None
    for i, t in enumerate(turns):
        now = (at // cell, i if cost(t) > big else -1, sum(cost(x) > big for x in turns[:i]))
        if now != key:
            cuts.append([])
        key = now
        cuts[-1].append(i)
        at += cost(t)
    out = []
    for w, new in enumerate(cuts):
        used, marks = sum(cost(turns[i]) for i in new), []
        if system and w and used + cost(system) <= budget:
            used += cost(system)
            marks.append((escaped_role("system"), "h"))
        free, back = min(room, budget - used), []
        for i in reversed(cuts[w - 1][-history:] if w and history else []):
            if cost(turns[i]) > free or (system and i == 0):
                break
            free, used = free - cost(turns[i]), used + cost(turns[i])
            back.append((escaped_role(turns[i][1]), "h"))
        out.append((len(new), used, marks + back[::-1] + [(escaped_role(turns[i][1]), "n") for i in new]))
    return out


def test_long_conversations_fill_their_windows(spark):
    from runtrail.llm.chat import windows

    rows = [(1, 0, "system", "You help.")] + [(1, i, ("user", "assistant")[i % 2], "some words " * (i % 9)) for i in range(1, 3000)]
    cut = windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    tokens = [r["n_tokens"] for r in cut]
    assert max(tokens) <= 1024 and sum(tokens) / len(tokens) >= 800 and all(r["formatted"].startswith("<turn:system:") for r in cut)


# --- 10 decontamination


def brute_contamination(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for window, ids in windows.items():
        for i in range(len(words) - len(window) + 1):
            if tuple(words[i : i + len(window)]) == window:
                hit.update(range(i, i + len(window)))
                items |= ids
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("shard_chars", [10_000_000, 400])
def test_contamination_equals_brute_force(spark, shard_chars):
    from runtrail.llm.decontaminate import contamination_digest, scan_documents

    items = sentences(6, 11, 30) + ["Short item", "ÉTÉ", None, "", sentences(1, 11, 30)[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = sentences(20, 12, 50)
    texts = ODD_TEXTS + clean + [clean[0] + " " + items[1].upper() + "! " + clean[1], items[2], clean[2] + " short, item " + clean[3], "été été ÉTÉ", " ".join(items[3].split()[:12]), clean[4] * 20 + items[4], items[0] + "\n" + items[0]]
    windows = defaultdict(set)
    for i, text in enumerate(items):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for k in range(max(1, len(words) - 12) if words else 0):
            windows[tuple(words[k : k + 13])].add(str(i))
    docs = documents(spark, texts, items="mine", n_hit=5, at=1, row=2, __row=3, n=4, window=5, found=6, runs=7, c0=8, contaminated="x")
    scanned = scan_documents(docs, bench, shard_chars=shard_chars)
    assert set(docs.columns) < set(scanned.columns) and scanned.select("at", "row", "__row", "n", "window", "found", "runs", "c0").distinct().collect() == [tuple(range(1, 9))]
    got = {r["doc_id"]: r for r in contamination_digest(scanned).collect()}
    for i, text in enumerate(texts):
        n, hit, found = brute_contamination(text, windows)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found)), text
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert not any(r["contaminated"] for r in scan_documents(docs, bench.limit(0)).collect())


def test_hit_spans_are_of_the_original_text(spark):
    from runtrail.llm.decontaminate import scan_documents

    item = sentences(1, 13, 20)[0]
    text = "É prelude; " + item.upper() + " -- end"
    row = scan_documents(documents(spark, [text]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    (start, end), = row["hit_spans"]
    assert text[start:end] == item.upper()


def test_hit_spans_do_not_depend_on_the_size_of_the_benchmark(spark):
    from runtrail.llm.decontaminate import scan_documents

    items = sentences(3, 13, 20) + ["short Item"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["É a; " + items[0].upper() + " -- end", items[1] + " " + items[2] + " x short,  item short item.", "\U0001f600 short item, y. " + items[0], "clean", "", None]
    a, b = ([(r["n_hit"], r["items"], r["hit_spans"]) for r in scan_documents(documents(spark, texts), bench, shard_chars=m).orderBy("doc_id").collect()] for m in (10_000_000, 150))
    assert a == b and sum(map(lambda r: len(r[2]), a)) >= 5


def test_long_items_are_cut_without_losing_windows(monkeypatch):
    from runtrail.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 20)
    for n in (1, 5, 12, 13, 19, 20, 21, 28, 29, 55, 200):
        words = [f"w{i % 23}".encode() for i in range(n)]
        want = {b" ".join(words[i : i + 13]) for i in range(max(1, n - 12))}
        scanner = decontaminate.Scanner([("x", p) for p in decontaminate.pieces_of(words)])
        assert set(scanner.windows) == want and scanner.scan([b"a", *words, b"b"]) == ([[1, n + 1]], {"x"})
