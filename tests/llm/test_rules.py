"""The URL rules of the registered query, word by word, and its verdicts on rows made for them."""

from __future__ import annotations

from convmem.llm import registry

#: As the contract lists them: verdict, host, path, and a page that only this rule decides.
CONTRACT = [
    ("block", "com", "/en/", "http://other.com/en/1"), ("allow", "example.com", "/en/7", "http://www.Example.com/en/71?x"), ("allow", "net", "/de/", "https://a.net/de/1"),
    ("block", "example.net", "/de/8", "https://b.example.net/de/8#y"), ("block", "org", "/es/", "http://c.org/es/"),
]


def test_rules_of_the_query_are_those_of_the_contract(spark, tmp_path):
    assert sorted(registry.URL_RULES) == sorted(r[:3] for r in CONTRACT)
    rows = [(i, r[3], None) for i, r in enumerate(CONTRACT)] + [(9, "https://d.net/en/1", None), (10, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in registry.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {**{i: (h + p, v) for i, (v, h, p, _) in enumerate(CONTRACT)}, 9: (None, "allow"), 10: (None, "allow")}
