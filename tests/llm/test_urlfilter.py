import re

from sparkloom.llm import urlfilter as U

URLS = ["http://a.com/casino", "http://casinos.com", "http://x.org/cheap-pills", "http://x.org/cheap/pills", "http://x.org/cheap-bet-win", "http://x.org/win/win/win", "http://ADULT.example/buy?deal", "", None, "http://spam-farm.example.com/", "https://bet.bet/loan#Promo", "xxx", "http://é.fr/xxx", "a1casino b"]


def expected(url):
    s = (url or "").lower()
    hit = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", s) is not None
    strict, soft = [t for t in U.STRICT if hit(t)], [t for t in U.SOFT if hit(t)]
    w = sum(U.SOFT[t] for t in soft)
    return len(strict), len(soft), w, bool(strict) or w >= U.SOFT_LIMIT


def test_against_regular_expressions(spark):
    pages = spark.createDataFrame([(i, u, "<p>", True) for i, u in enumerate(URLS)] + [(0, URLS[0], None, None), (None, "porn", None, None)], "page_id long, url string, html string, rejected boolean")
    got = U.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.n_strict, r.n_soft, r.soft_weight, r.rejected) == expected(r.url), r.url


def test_every_kind_of_id_and_long_urls(spark):
    rows = [("a", "http://x.org/" + "y/" * 200_000 + "casino"), ("a", "http://x.org/" + "bet" * 100_000), (None, "http://x.org/free-bets")]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id string, url string")).collect()
    assert sorted((r.page_id or "", r.rejected) for r in got) == [("", True), ("a", False), ("a", True)]


def test_vocabulary():
    assert not set(U.STRICT) & set(U.SOFT) and all(0 < w < U.SOFT_LIMIT for w in U.SOFT.values())
    assert all(t == t.lower() and t.strip() for t in (*U.STRICT, *U.SOFT))


def test_empty_table_and_vocabulary(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(pages).count() == 0
    one = spark.createDataFrame([(1, "casino")], "page_id long, url string")
    assert not U.filter_urls(one, (), {}).first().rejected
