from tierwave.llm.queries import RULES
from tierwave.llm.url_reputation import registered, url_filter
from pyspark.sql import functions as F


def run(spark, urls, good=()):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    said = spark.createDataFrame(list(good), "page_id long, good boolean")
    return {r.page_id: r for r in url_filter(pages, said, RULES).collect()}


def test_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/x?y", "https://example.com/en/", "http://a.example.com/fr/#t", "ftp://x.net/es/1", "http://x.net/de", None, "", "no scheme/en/", "a://b://c/d", "http://example.com", "http://myexample.com/en/", "http://É.net/fr/é\nz"]
    got = run(spark, urls)
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("example.com", "/en/", "example.com/en/", "block"), 2: ("a.example.com", "/fr/", "com/", "allow"),
        3: ("x.net", "/es/1", "net/es/", "block"), 4: ("x.net", "/de", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("b:", "//c/d", None, "allow"), 9: ("example.com", "", None, "allow"), 10: ("myexample.com", "/en/", "com/", "allow"), 11: ("É.net", "/fr/é\nz", "net/fr/", "block"),
    }


def test_reputation_blocks_bad_hosts_only(spark):
    urls = [f"http://bad.org/{i}" for i in range(40)] + [f"http://good.org/{i}" for i in range(40)] + ["http://new.bad.org/", "http://other.org/", None]
    got = run(spark, urls, [(i, i >= 40) for i in range(80)] + [(80, None), (None, True), (41, True)])
    assert {r.verdict for i, r in got.items() if i < 40} == {"block"} and {r.verdict for i, r in got.items() if 40 <= i < 80} == {"allow"}
    assert got[0].rate < got[80].rate < got[81].rate < got[41].rate and got[81].verdict == "allow"


def test_empty(spark):
    assert run(spark, []) == {}


def test_registered(spark):
    df = spark.createDataFrame([("a.b.co.uk:80",), ("x.y.com",), ("localhost",), ("",)], "h string")
    assert [tuple(r) for r in df.select(*registered(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("localhost", "localhost"), ("", "")]
