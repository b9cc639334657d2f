import math
from collections import Counter, defaultdict

from spanloom.llm import urls


def test_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
        "http://a.net/fr/x?y#z": ("a.net", "/fr/x", "net/fr/", "block"),
        "http://com": ("com", "", None, None), "http://xcom/": ("xcom", "/", None, None), "ftp://u.com/?q": ("u.com", "/", "com/", "allow"),
        "no scheme": ("", "", None, None), None: ("", "", None, None), "x://a://b/c": ("a:", "//b/c", None, None), "http://É.com/É": ("É.com", "/É", "com/", "allow"),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    for r in urls.filter_urls(rows).collect():
        host, path, rule, says = list(cases.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (says is None or r["verdict"] == says)
    assert urls.filter_urls(rows.limit(0)).count() == 0


def brute_ratio(good, bad, gram, order):
    """Recursive Witten-Bell over plain strings."""
    out = []
    for strings in (good, bad):
        follow = [defaultdict(Counter) for _ in range(order + 1)]
        for s in strings:
            p = "\x02" * order + s + "\x03"
            for i in range(order, len(p)):
                for k in range(order + 1):
                    follow[k][p[i - k : i]][p[i]] += 1

        def prob(k):
            below = prob(k - 1) if k else 1 / urls.ALPHABET
            seen = follow[k][gram[order - k : order]]
            n, t = sum(seen.values()), len(seen)
            return (seen[gram[-1]] + t * below) / (n + t) if n else below

        out.append(math.log(prob(order)))
    return out[0] - out[1]


def test_ratios_against_brute_force(spark):
    good, bad, other = ["abcab", "abd", "aab"], ["zzab", "bzz"], ["azb", "", "q"]
    rows = [(s, int(s in good), int(s in bad)) for s in good + bad + other]
    strings = spark.createDataFrame(rows, "s string, g int, b int")
    from pyspark.sql import functions as F

    counts = strings.select("g", "b", F.explode(urls.grams_of(F.col("s"), 2)).alias("gram")).groupBy("gram").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))
    for r in urls.gram_ratios(counts, 2).collect():
        assert math.isclose(r["ratio"], brute_ratio(good, bad, r["gram"], 2), abs_tol=1e-9), r["gram"]


def test_unruled_urls_follow_their_likeness(spark):
    rows = [(i, f"http://s{i}.com/good/{i * 7}") for i in range(200)] + [(1000 + i, f"http://s{i}.net/es/bad/{i * 7}") for i in range(200)]
    rows += [(5000, "http://s3.org/good/77"), (5001, "http://s3.org/es/bad/77"), (5001, "http://s3.org/es/bad/77")]
    got = [(r["page_id"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 5000").orderBy("page_id").collect()]
    assert got == [(5000, "allow"), (5001, "block"), (5001, "block")]


def test_the_whole_url_is_judged(spark):
    rows = [(i, f"http://s{i}.com/a?p=/good/{i * 7}") for i in range(200)] + [(1000 + i, f"http://s{i}.net/es/a?p=/wrong/bad/{i * 7}") for i in range(200)]
    rows += [(5000, "http://x.org/p?u=/good/77"), (5001, "http://x.org/p?u=/wrong/bad/77"), (5002, "p=/good/77"), (5003, "p=/wrong/bad/77"), (5004, "http://x.org/" + "wrong/bad/" * 3000), (5005, None), (5005, None)]
    docs = spark.createDataFrame([(*r, "h", "p", "s", 1, 2) for r in rows], "page_id long, url string, host string, path string, s string, n int, score int")
    got = {r["page_id"]: r for r in urls.filter_urls(docs).filter("page_id >= 5000").collect()}
    assert [got[i]["verdict"] for i in range(5000, 5005)] == ["allow", "block", "allow", "block", "block"]
    assert len({got[i]["score"] for i in range(5000, 5004)}) == 4 and (got[5001]["host"], got[5001]["path"]) == ("x.org", "/p")
