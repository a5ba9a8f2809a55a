"""The pipeline against its stages done by brute force, and queries over the smallest tables."""

import hashlib
import math
import re

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import base_spans, brute_contamination, brute_fingerprint, brute_targets, components


def brute_copies(docs):
    """How often the mix takes each document: of {id: (source, text)}."""
    number = lambda text, digits=8: int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (_, t) in docs.items()}
    of = {s: [i for i, (o, _) in docs.items() if o == s] for s in {o for o, _ in docs.values()}}
    total = {s: sum(sizes[i] for i in ids) for s, ids in of.items()}
    copies = {}
    for source, ids in of.items():
        ratio = brute_targets(total)[source] / total[source] if total[source] else 0
        u = number("20240229:" + ("null" if source is None else f"={source}")) / 2**32
        size_class = lambda n: n.bit_length() * 4 + (n >> max(n.bit_length() - 3, 0) & 3)
        order = sorted(ids, key=lambda i: (size_class(sizes[i] + 1), number(str(i)) % 8, sizes[i], i, number(docs[i][1], 15)))
        for k, i in enumerate(order, 1):
            copies[i] = math.floor(ratio * k + u) - math.floor(ratio * (k - 1) + u)
    return copies


def test_run_equals_its_stages_by_brute_force(spark):
    from runtrail.llm.language import fit, identify
    from runtrail.llm.pii import redacted

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in identify(docs.select("doc_id", "text"), fit(docs)).where("not rejected").collect()}
    ids = sorted(kept)
    kept = {ids[r]: kept[ids[r]] for r in set(components([brute_fingerprint(kept[i]) for i in ids]))}
    windows = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        for k in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).add(str(r["item_id"]))
    index = {}
    for window in windows:
        index.setdefault(window[0], []).append(window)

    def clean(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hit = {j for i, w in enumerate(words) for x in index.get(w, ()) if tuple(words[i : i + len(x)]) == x for j in range(i, i + len(x))}
        return not hit or 20 * len(hit) < len(words)

    clean_ids = [i for i, t in kept.items() if clean(t)]
    masked = redacted(docs.where(F.col("doc_id").isin(clean_ids)))
    final = {r["doc_id"]: (r["source"], r["text"]) for r in masked.collect()}
    want = sorted((i, c, final[i][1]) for i, n in brute_copies(final).items() for c in range(1, n + 1))
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*docs.columns, "copy"]
    assert sorted((r["doc_id"], r["copy"], r["text"]) for r in got.collect()) == want and len(final) < docs.count()


def test_stages_have_their_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).toPandas(), stage(spark, kept, sf_dir).schema)
        seen[name] = kept
        assert name == "mix" or kept.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in seen["language"].collect()}
    assert len(before) == docs.count()  # all of these documents have a language
    ids = sorted(before)
    roots = components([brute_fingerprint(before[i]) for i in ids])
    one = {r["doc_id"] for r in seen["near_duplicates"].collect()}
    assert one == {ids[r] for r in set(roots)}
    clean = {r["doc_id"]: r["text"] for r in seen["decontaminate"].collect()}
    assert set(clean) <= one
    masked = {r["doc_id"]: r for r in seen["personal_data"].collect()}
    assert set(masked) == set(clean)
    for i, r in masked.items():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert base_spans(clean[i]) or "[" in r["text"] or r["text"] == clean[i]
    assert {r["doc_id"] for r in seen["mix"].collect()} <= set(masked)
    assert seen["mix"].groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 3


def test_every_query_is_registered():
    import re

    import __spark_entry__

    found = {int(m[1]) for q in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", q))}
    assert found == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert brute_contamination("", {}) == (0, 0, [])
