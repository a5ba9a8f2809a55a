"""Queries that SQL can express give the same rows in DuckDB, odd texts included."""

import duckdb
import pytest

from runtrail.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tmp_path, name):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, passage.upper(), "a"), (1, passage.upper(), "a"), (2, None, None), (3, "", "a"), (4, "... \t", "é"), (5, "é w1 q a b", "Z"), (6, "x a-b y", None), (7, "w0 " * 300 + passage[:45], "b"), (8, "İ " + passage + " K", "a"), (1, "x y", "a"), (1, "y x", "a")]
    items = [(1, passage), (2, "a b"), (10, "a b"), (3, None), (4, "!"), (5, passage[10:60])]
    turns = [(1, 0, "system", "Be brief."), *[(1, i, ("user", "assistant")[i % 2], "word \\ < " * (i % 90)) for i in range(1, 80)], (2, 1, "assistant", None), (2, 1, None, "é" * 3000), (2, 0, "a:b>\n", "x" * 5000), (None, 3, "system", "y"), (4, 0, "system", "z" * 2000), *[(4, 1, "user", "same")] * 90]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet{'/*.parquet' if sf == str(tmp_path) else ''}'")
        found = con.execute(ORACLE_SQL[name])
        df = QUERIES[name](spark, sf)
        assert [c[0] for c in found.description] == df.columns
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))
