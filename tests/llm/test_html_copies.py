"""Pages of equal blocks are one page of their host, whatever tasks read them."""

from runtrail.llm import html


def test_copies_in_other_tasks_do_not_remove_each_other(spark):
    own = "one two three four five six seven eight nine ten eleven twelve"
    bar = "home news sport weather contact help terms privacy imprint"
    page = lambda text: f"<html><body><div>{bar}</div><div>{text}</div></body></html>"
    texts = [own] * 6 + ["red green blue black white grey pink brown", "north south east west up down left right"]
    rows = spark.createDataFrame([(i, f"http://a.example/{i}", page(t)) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(8, "page_id")
    rows = rows.unionByName(spark.createDataFrame([(99, "http://b.example/", page(own))], "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in html.extracted(rows).collect()}
    assert got == {i: t for i, t in enumerate(texts)} | {99: f"{bar}\n{own}"}
