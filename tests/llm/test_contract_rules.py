"""What the contract of op10 says of its rules, word by word."""

from docsift.llm.queries import QUERIES

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_op10_gives_each_rule_its_verdict(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://a.example.com/en/7x", "http://a.net/de/9", "http://a.example.net/de/8/1", "http://b.org/es/", "http://example.net/de/7", "http://net/de/8"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(5)] == RULES
    assert got[5] == got[6] == ("allow", "net/de/")
