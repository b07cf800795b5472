import math
from collections import Counter

from tidewell.llm import urls

URLS = [
    "http://a.example.com/en/7x?q", "https://example.com/en/8", "http://www.EXAMPLE.com/fr/1#t", "http://net/de/8", "https://x.net/de/8a", "http://example.net/de/81",
    "http://b.example.net/de/9", "ftp://o.org/es/", "http://org/es", "nothing", None, "", "://", "http://xcom/en/1", "http://notexample.net/de/8?x://y", "http://h.org/es/é", "http://free.org/en/2", "http://free.org/en/2",
]


def split(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_against_brute_force(spark):
    data = [(i, u, "x", 1) for i, u in enumerate(URLS * 2)]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(data, "page_id long, url string, host string, g int")).collect()}
    grams = {True: Counter(), False: Counter()}
    order = urls.ORDER

    def cells(body):
        p = "\u0002" * order + body + "\u0003"
        return [p[i : i + order + 1] for i in range(len(p) - order)]

    parsed = {i: (*split(u), *rule(*split(u))) for i, u, *_ in data}
    for h, p, _, v in parsed.values():
        if v:
            for g in cells(h + p):
                for k in range(order + 1):
                    grams[v == "allow"][g[order - k :]] += 1

    def prob(g, c):
        p = 1 / 256
        for k in range(order + 1):
            s = g[order - k :]
            after = [n for x, n in c.items() if len(x) == k + 1 and x[:-1] == s[:-1]]
            if after:
                p = (c[s] + len(after) * p) / (sum(after) + len(after))
        return p

    def score(body):
        gs = cells(body)
        return sum(math.log(prob(g, grams[True])) - math.log(prob(g, grams[False])) for g in gs) / len(gs)

    means = [[score(h + p) for h, p, _, v in parsed.values() if v == w] for w in ("allow", "block")]
    middle = sum(sum(m) / len(m) for m in means) / 2
    assert len(got) == len(data)
    for i, (h, p, r, v) in parsed.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, p, r)
        assert abs(got[i]["llr"] - score(h + p)) < 1e-9
        assert got[i]["verdict"] == (v or ("allow" if score(h + p) >= middle else "block"))


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    only = urls.judge_urls(spark.createDataFrame([(1, None)], "page_id long, url string")).collect()
    assert [(r["host"], r["verdict"]) for r in only] == [("", "allow")]
