import numpy as np

from retort.llm import urlfilter as U

LISTED = ["spam.example.com", "bad.org", "site.net/a/b", None, "bad.org"]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1, 2) for i, u in enumerate(urls)], "page_id bigint, url string, html string, k int, matched int")


URLS = ["http://spam.example.com/x", "https://www.SPAM.example.com:80/", "http://notspam.example.com/", "http://user@bad.org?q", "http://site.net/a/b/#t", "http://site.net/a/c", "", None, "no url", "ftp://a.b.bad.org", "http://good.org/bad.org", "http://spam.example.com/x", "spam.example.com/y", "//bad.org/z", "  https://bad.org.  ", "http://spam.example.com./x", "site.net/a/b/ ", "bad.org.uk", "mailto:x@good.org", "http://" + "a." * 200 + "bad.org/x", "http://bad.org/" + "p" * 100_000]
WANT = [True, True, False, True, True, False, False, False, False, True, False, True, True, True, True, True, True, False, False, False, True]


def test_cascade_and_join_agree(spark):
    pages = pages_of(spark, URLS)
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    for limit in (U.BROADCAST_BYTES, 1):
        rows = U.filtered(pages, listed, limit=limit).orderBy("page_id").collect()
        assert [r.blocked for r in rows] == WANT
        assert rows[1].matched == "spam.example.com" and rows[4].matched == "site.net/a/b"


def test_membership_is_exact_over_the_universe(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(-(1 << 62), 1 << 62, 20_000)
    h[1000], h[5000] = h[5], h[5]  # equal in one half of their hashes: two listed keys and one other
    g = rng.integers(-(1 << 62), 1 << 62, 20_000)
    universe = spark.createDataFrame([(int(x), int(y), k < 1500) for k, (x, y) in enumerate(zip(h, g, strict=True))], "h bigint, g bigint, listed boolean")
    cascade = U.build(universe, 1500, 18_500)
    assert len(cascade.levels) > 2
    assert cascade.listed(h, g).tolist() == [k < 1500 for k in range(20_000)]


def test_empty_tables(spark):
    pages, listed = pages_of(spark, URLS), spark.createDataFrame([], "key string")
    assert U.filtered(pages, listed).where("blocked").count() == 0
    assert U.filtered(pages.limit(0), listed).count() == 0


def test_edge_rows(edge, empty, spark):
    listed = spark.createDataFrame([("alpha beta gamma delta",), ("bad.org",)], "key string")
    rows = U.filtered(edge, listed, page_id="doc_id", url="text").collect()
    assert len(rows) == edge.count() and sum(r.blocked for r in rows) == 2
    assert U.filtered(empty, listed, page_id="doc_id", url="text").count() == 0


def test_very_long_urls_take_time_in_proportion(spark):
    listed = spark.createDataFrame([("bad.org",)], "key string")
    urls = ["http://" + "x." * 100_000 + "bad.org", "http://bad.org/" + "a.b/" * 100_000, "." * 100_000, "@" * 100_000 + "bad.org", None]
    assert [r.blocked for r in U.filtered(pages_of(spark, urls), listed).orderBy("page_id").collect()] == [False, True, False, False, False]
