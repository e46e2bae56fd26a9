"""op3 on its own rules: the words of the contract's list, in the query and in its SQL."""

import duckdb

from quirefold.llm import queries

# url -> (rule, verdict) by the contract's list; of net/de/ only the rule lets bad.net pass
EXPECTED = {
    "http://a.com/en/1": ("com/en/", "block"),
    "http://x.example.com/en/71": ("example.com/en/7", "allow"),
    "http://bad.net/de/1": ("net/de/", "allow"),
    "http://new.net/de/": ("net/de/", "allow"),
    "http://example.net/de/7": ("net/de/", "allow"),
    "http://www.example.net/de/81": ("example.net/de/8", "block"),
    "http://a.org/es/": ("org/es/", "block"),
    "http://bad.net/fr/1": (None, "block"),
    "http://new.net/de": (None, "allow"),
}


def test_rules_have_the_words_of_the_contract(spark, tmp_path):
    assert [(r.verdict, r.name) for r in queries.URL_RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = [*EXPECTED, *[f"http://{'bad' if i < 60 else 'good'}.net/{i}" for i in range(120)]]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    first = len(EXPECTED)
    spark.createDataFrame([(first + i, int(i >= 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.page_id: (r.rule, r.verdict) for r in queries.op3_host_reputation(spark, str(tmp_path)).collect()}
    assert {u: found[i] for i, u in enumerate(EXPECTED)} == EXPECTED
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    rows = con.execute(f"select page_id, rule, verdict from ({queries.oracle_sql()['op3_host_reputation']})").fetchall()
    assert {p: (r, v) for p, r, v in rows} == found
