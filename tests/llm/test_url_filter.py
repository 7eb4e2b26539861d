import random

from flowseq.llm import url_filter
from flowseq.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.helpers import same_rows

PAGES = "page_id long, url string, _key string, host int"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, h, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (len(f[0]), len(f[1])), default=(None, None, "allow"))
    return host, path, best[0], best[2]


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["org", "a.org", "b.a.org", "ab.org", "com", "x.com", "", "A.Org", "org.", ".org", "a.org:80"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1?q=/es/", "#/es/", "?x"]
    rules = [("block", "org", "/"), ("allow", "a.org", "/es"), ("block", "a.org", "/es/1"), ("allow", "b.a.org", ""), ("block", "com", "/es/"), ("allow", "zz", "")]
    urls = [None, "", "no scheme", "http://", "x://y://a.org/es"] + [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], PAGES)
    for size in (100, 2):  # one block of rules, and several
        rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules, block_rules=size).collect()}
        assert len(rows) == len(urls)
        for i, u in enumerate(urls):
            assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == brute(u, rules), u


def test_rules_from_a_table_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x", 1), (1, "http://a.org/", "x", 1), (None, None, None, None)], PAGES)
    rules = spark.createDataFrame([("block", "a.org", "/", 1), (None, None, None, 1)], "verdict string, host string, path string, k int")
    assert sorted(r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()) == ["allow", "block", "block"]
    assert url_filter.judge_urls(pages, []).count() == 3
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_query_equals_sql(spark, duck):
    for name in ("op5_url_rules", "op6_topk", "op3_quotations"):
        same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_very_many_rules_of_one_host_and_very_long_urls(spark):
    import time

    rules = [("block" if i % 2 else "allow", "a.org", f"/p{i}/") for i in range(50_000)] + [("block", "org", "/p7/")]
    urls = [f"http://x.a.org/p{i * 250}/z" for i in range(200)] + ["http://b.org/p7/", "http://" + "s." * 20_000 + "a.org/p3/" + "y" * 100_000, "http://a.org/" + "/" * 50_000]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], PAGES)
    began = time.perf_counter()
    rows = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(pages.coalesce(1), rules).collect()}
    assert [rows[i] for i in range(200)] == [f"a.org/p{i * 250}/" for i in range(200)]
    assert [rows[200 + i] for i in range(3)] == ["org/p7/", "a.org/p3/", None]
    assert time.perf_counter() - began < 20
