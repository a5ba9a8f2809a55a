"""Main text of pages, whitening and tokenizer alignment against brute force, with nulls, empty tables, ties and clashing names."""

import hashlib
import html as stdlib_html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtrail.llm import alignment, html, whitening
from runtrail.llm.common import table
from runtrail.llm.queries import QUERIES

# --- 11 main text

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGES)


def texts(df):
    return {r["page_id"]: r["text"] for r in html.extracted(df).collect()}


def article_by_pattern(page):
    found = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(stdlib_html.unescape(re.sub("</?b>|<br>", "", p)).split()) for p in re.split("</?(?:p|h1)>", found))
    return "\n".join(p for p in parts if p)


def test_html_query_equals_articles_cut_by_pattern(spark, sf_dir):
    got = QUERIES["op11_html"](spark, sf_dir).collect()
    wanted = {r["page_id"]: article_by_pattern(r["html"]) for r in table(spark, sf_dir, "pages").collect()}
    assert len(got) == len(wanted) and {r["page_id"]: r["text"] for r in got} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in got)


CASES = [
    ("<main><nav>a<ul><li>b</ul></nav><h1>T &amp; U</h1><p>one<p>two <i>it</i>alic<br>x<ul><li>l1<li>l2</ul></main><footer>f</footer>", "T & U\none\ntwo italic x\nl1\nl2"),
    ("<header><h2>Site</h2></header><div class=sidebar>s<article><header><h1>Head</h1></header><p>body</p></article></div>", "Head\nbody"),
    ("<article><p>text</p><section id='comments'><article class='comment'><p>first!</p></article></section><p>end</p></article>", "text\nend"),
    ("<body class='has-sidebar'><div id=\"cookie-notice\">we use</div><p>Hello <b>wor</b>ld</p> loose <div>d1<div>d2</div>d3</div><script>var a='</p>';</script>tail<!-- c", "Hello world\nloose\nd1\nd2\nd3\ntail"),
    ("<div class='content'><p>inside</p></div><p>outside</p>", "inside"),
    ("<article><table><tr><td>1<td>2<tr><th>3</table><form>f</form><aside>a</aside><p style='display:none'>h</p><pre>x\n  y</pre></article>", "1 2\n3\nx y"),
    ("<ARTICLE><P TITLE='a > b'>caps &lt;b&gt; &#233;&eacute;&am</P><svg><text>no</text></svg><noscript>no</noscript></ARTICLE>", "caps <b> éé&am"),
    ("<nav>never closed<article><p>still here</p></article>", "still here"),
    ("a < b and c > d", "a < b and c > d"),
    ("<article></article><p>x</p>", "x"),
    ("", ""),
    (None, ""),
    ("<div data-id='ad' data-class='nav'>kept</div><div class='download-area'>kept too</div>", "kept\nkept too"),
]


def test_html_structure(spark):
    got = texts(pages(spark, [("http://h.example/", h) for h, _ in CASES]))
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_html_repeated_runs_of_a_host_go_and_articles_stay(spark):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    bar = " ".join(word() for _ in range(12))
    quote = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(40)) for _ in range(40)]
    rows = [(f"http://a.example/{i}", f"<p>{bar}</p><p>{o}</p>") for i, o in enumerate(own[:20])]  # a host's own run: goes
    rows += [("http://a.example/x", f"<p>{bar} {own[30]}</p>")]  # within a block: the unique run stays
    rows += [(f"http://b.example/{i}", f"<p>{own[35]}</p>") for i in range(20)]  # copies of one page: stay
    rows += [(f"http://c.example/{i}", f"<article><p>{quote}</p><p>{own[i]}</p></article>") for i in range(10)]  # within articles: stays
    rows += [(f"http://d.example/{i}", f"<p>{o}</p>" + (f"<p>{bar}</p>" if i < 2 else "")) for i, o in enumerate(own[:15])]  # two pages only: stays
    got = texts(pages(spark, rows))
    assert [got[i] for i in range(20)] == own[:20] and got[20] == own[30]
    assert all(got[21 + i] == own[35] for i in range(20))
    assert all(got[41 + i] == f"{quote}\n{own[i]}" for i in range(10))
    assert [got[51 + i] for i in range(15)] == [o + (f"\n{bar}" if i < 2 else "") for i, o in enumerate(own[:15])]


def test_html_suffix_array_equals_counted_windows():
    pick = random.Random(5)
    streams = [np.array([pick.randint(0, 3) for _ in range(pick.randint(0, 40))], np.uint64) for _ in range(30)]
    slab, wanted = html.Slab(4), Counter()
    for i, s in enumerate(streams):
        slab.add(i % 3, i, s)
        wanted.update({(i % 3, tuple(s[j : j + 4].tolist())) for j in range(len(s) - 3)})
    keys, n = slab.runs()
    named = {int(html.run_keys(h, np.array(w, np.uint64), 4)[0]): c for (h, w), c in wanted.items()}
    assert len(keys) == len(wanted) and dict(zip(keys.tolist(), n.tolist())) == named
    order, rank = html.suffix_classes(streams[0], np.arange(len(streams[0]), 0, -1), 64)
    assert [tuple(streams[0][i:].tolist()) for i in order] == sorted(tuple(streams[0][i:].tolist()) for i in range(len(streams[0])))


def test_html_odd_tables(spark):
    assert html.extracted(spark.createDataFrame([], PAGES)).collect() == []
    twice = pages(spark, [(None, "<p>x " + "y " * 50_000 + "</p>"), (None, None)])
    clash = twice.unionByName(twice).withColumn("text", F.lit("old")).withColumn("host", F.lit("h")).withColumn("key", F.lit(1))
    got = html.extracted(clash).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 100_001, 100_001] and {r["host"] for r in got} == {"h"} and got[0].asDict().keys() == {"page_id", "url", "host", "key", "text"}


# --- 12 whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def test_whitening_equals_dense_solution(spark, sf_dir):
    got = QUERIES["op12_whitening"](spark, sf_dir).collect()
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    v = y.T @ y / n
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v))
    wanted = y @ vectors[:, :8] / np.sqrt(values[:8])
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == 8 * n
    for c in range(8):
        mine = np.array([by[r["vec_id"], c + 1]["whitened"] for r in rows])
        assert min(np.abs(mine - wanted[:, c]).max(), np.abs(mine + wanted[:, c]).max()) < 1e-9
        assert abs(by[rows[0]["vec_id"], c + 1]["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9
    assert [by[r["vec_id"], 1]["deviation"] for r in rows] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9


def test_jacobi_keeps_small_eigenvalues():
    pick = np.random.default_rng(1)
    for size in (1, 2, 7, 40):
        a = pick.normal(size=(size, size))
        values, vectors = whitening.jacobi(a @ a.T)
        assert np.allclose(values, np.linalg.eigvalsh(a @ a.T)[::-1]) and np.allclose(vectors @ np.diag(values) @ vectors.T, a @ a.T)
    scale = 10.0 ** -np.arange(0, 24, 3)
    base = np.eye(8) + 0.3 * np.ones((8, 8))
    values, _ = whitening.jacobi(scale[:, None] * base * scale)
    exact = np.prod(scale) ** 2 * np.linalg.det(base)  # the product of all eigenvalues is the determinant
    assert abs(np.prod(values) / exact - 1) < 1e-12
    with pytest.raises(RuntimeError):
        whitening.jacobi(np.array([[1.0, 0.5], [0.5, 1.0]]), sweeps=0)


def test_whitening_odd_tables(spark):
    assert whitening.whitening_digest(spark.createDataFrame([], VECTORS)).collect() == []
    bad = [(10, None, 0), (11, [], 0), (12, [1.0, None, 2.0], 0), (13, [float("nan"), 0.0, 0.0], 0), (14, [float("inf"), 0.0, 0.0], 0), (15, [1.0, 2.0], 0)]
    good = [(0, [1.0, 0.0, 0.5], 1), (1, [0.0, 1.0, 0.5], 1), (1, [0.0, 1.0, 0.5], 1), (2, [0.25, 0.75, 0.5], 1)]
    df = spark.createDataFrame(bad + good, VECTORS).withColumn("deviation", F.lit("old"))
    got = whitening.whitening_digest(df).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((v[0], c) for v in good for c in (1, 2, 3))
    flat = [r for r in got if r["component"] > 1]  # the vectors lie on a line: one component has variance
    assert {r["whitened"] for r in flat} == {0.0} and {r["explained"] for r in flat} == {0.0} and max(r["identity_error"] for r in got) < 1e-12
    same = whitening.whitening_digest(spark.createDataFrame([(i, [0.5, 0.5], 0) for i in range(3)], VECTORS)).collect()
    assert len(same) == 6 and {r["deviation"] for r in same} == {0} and {r["whitened"] for r in same} == {0.0}
    huge = whitening.whitening_digest(spark.createDataFrame([(0, [3e38, 0.0], 0), (1, [-3e38, 1.0], 0)], VECTORS)).collect()
    assert {r["deviation"] for r in huge} == {None} and len(huge) == 4
    kept = whitening.whitened(df, whitening.fit(df)).collect()
    assert len(kept) == 4 and set(kept[0].asDict()) == {"vec_id", "embedding", "label", "deviation", "whitened"}


# --- 13 alignment


@pytest.fixture(scope="module")
def files():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def whole_groups(pair, text):
    """Groups of a whole text, by the ends that both token lists share."""
    if not text:
        return []
    whole = " " + text
    a, b = pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_bytes[i] for i in a) != whole.encode() or b"".join(pair.b_bytes[i] for i in b) != whole.encode():
        return []
    ends = lambda ids, known: np.cumsum([len(known[i]) for i in ids]).tolist()
    ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        p, q = i, j
        while i < len(ea) and ea[i] <= cut:
            i += 1
        while j < len(eb) and eb[j] <= cut:
            j += 1
        groups.append((a[p:i], b[q:j]))
    return groups


def brute(pair, rows):
    groups = [whole_groups(pair, t) for t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    counts = Counter(p for held in links for p in set(held))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    written = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for g in groups]
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(held), sum(counts[p] == most[p[0]] for p in held), sum(counts[p] for p in held), hashlib.sha256(w.encode()).hexdigest() if w else "")
        for g, held, w in zip(groups, links, written)
    ]


ODD = [
    None, "", " ", "a", "a ", "  a  b ", "a\n b\n  c\t d \n", "<|endoftext|> <s></s><unk>", "▁under▁score", "don't we'll I'M 12345 1,000.50", "é ü ñ 日本語 текст 🙂 👩‍👩‍👧 ", "x y　z w   q", "=" * 3000,
    "ab" * 6000, "日本語" * 700, "a\x00b \x1c c", "The cat the cat The cat", "The cat the cat The cat", "- - -- --- ...  ,, ́x", "ﬁ ① Ａ", "word " * 4000,
]


@pytest.mark.parametrize("head", [3, 1 << 16])
def test_alignment_equals_brute_force(spark, sf_dir, files, head):
    rows = ODD + [r["text"] for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("groups", F.lit(1)).withColumn("row", F.lit(5)).withColumn("a", F.lit(5))
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignment_digest(docs, *files, head=head).collect()}
    wanted = brute(alignment.Pair.of(*files), rows)
    assert [got[i] for i in range(len(rows))] == wanted
    assert wanted[0][0] == 0 and wanted[8][0] == 0 and wanted[7][0] > 3


def test_alignment_query_covers_all_documents(spark, sf_dir, files):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    assert [got[r["doc_id"]] for r in rows] == brute(alignment.Pair.of(*files), [r["text"] for r in rows]) and len(got) == len(rows)


def test_alignment_components_and_wide_groups(files, monkeypatch):
    pick = random.Random(2)
    for _ in range(200):
        end = pick.randint(1, 40)
        a, b = (sorted({pick.randint(1, end) for _ in range(pick.randint(1, 12))} | {end}) for _ in range(2))
        ga, gb, n = alignment.components(np.array(a), np.array(b))
        cuts = sorted(set(a) & set(b))
        assert n == len(cuts) and ga.tolist() == np.searchsorted(cuts, a).tolist() and gb.tolist() == np.searchsorted(cuts, b).tolist()
    pair = alignment.Pair.of(*files)
    texts = ["日本語" * 50, "ab" * 400, "The cat"]
    flat = {k: v.to_pylist() for k, v in alignment.aligned_slab(pair, texts).items()}
    pair.forget()
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    assert {k: v.to_pylist() for k, v in alignment.aligned_slab(pair, texts).items()} == flat
    pair.forget()


def test_alignment_odd_tables(spark, files):
    assert alignment.alignment_digest(spark.createDataFrame([], "doc_id long, text string"), *files).collect() == []
    twice = spark.createDataFrame([(1, "The cat"), (1, "The cat"), (None, "The cat"), (2, None)], "doc_id long, text string")
    got = alignment.alignment_digest(twice, *files).collect()
    assert len(got) == 4 and sorted(r["count_sum"] for r in got)[1:] == [3 * r["n_links"] for r in got if r["n_links"]]
