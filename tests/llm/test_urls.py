import random
import re

import duckdb
import pytest

from loomgeno.llm import urls

ODD = [None, "", "no scheme", "http://", "http://COM", "http://com/", "HTTP://WWW.Example.com/en/x?y#z", "http://a.example.com/en/", "http://example.com/en", "x://net/es/a://b/", "http://net#/es/", "http://xnet/es/",
       "a\nb://m.net/fr/\nq", "http://user@com:80/", "http://com?/", "://com/", "http://.com/", "http://com./", "http://É.COM/Ü/", "http://www.example.com/en/" + "y" * 50000]


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return (host, path, best[0] + best[1] if best else None, best[2] if best else default)


def run(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule")
    return sorted((tuple(r) for r in urls.verdicts(df, rules).collect()), key=str)


def test_odd_urls_and_sql(spark):
    pages = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://com/"), (3, "http://com/"), (3, "http://com/")]
    want = sorted(((i, *brute(u, urls.RULES)) for i, u in pages), key=str)
    assert run(spark, pages, None) == want
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", pages)
    assert sorted(con.execute(urls.SQL).fetchall(), key=str) == want


def test_random_rules(spark):
    rng = random.Random(4)
    name = lambda: ".".join(rng.choice(["a", "b", "com", "net"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = sorted({(name(), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("com", "/", "allow"), ("com", "/", "block")]
    pages = [(i, f"http://{name()}{path()}") for i in range(400)] + [(1000 + i, "http://a.com/x") for i in range(300)]
    seen = {(h, p): max(v for a, b, v in rules if (a, b) == (h, p)) for h, p, _ in rules}
    assert run(spark, pages, rules) == sorted(((i, *brute(u, [(h, p, v) for (h, p), v in seen.items()])) for i, u in pages), key=str)


@pytest.mark.parametrize("digits", [1, 2])
def test_short_prefixes_that_collide(spark, digits):
    """Half of what the short prefix matches is refused by the full digest."""
    rules = [(f"h{i}.com", "/", "allow" if i % 2 else "block") for i in range(300)]
    pages = [(i, f"http://x.h{i}.com/p") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = urls.judge(df, spark.createDataFrame(rules, urls.RULE), digits=digits)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()) == [(i, *brute(u, rules)) for i, u in pages]


def test_empty_tables(spark):
    assert run(spark, [], None) == []
    assert run(spark, [(1, "http://com/")], []) == [(1, "com", "/", None, "allow")]
