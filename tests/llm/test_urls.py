"""URL filters beside brute force."""

from __future__ import annotations

import random

from tidemill.llm import url_filters


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_random_rules_and_urls(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "c", "aa", "é", "x-y"])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "/a", "/b/", "ab", "G", "é"]) for _ in range(rng.randint(0, 4)))
    rules = {(host(3), path()): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{rng.choice(['http', 'https', ''])}://{host(5).upper() if k % 7 == 0 else host(5)}{path()}{rng.choice(['', '?q=/a', '#/b', '/?'])}" for k in range(600)]
    urls += [None, "", "no scheme", "http://", "http:///a", "http://a\n.b/x", "a://b://c/", *urls[:20]]
    pages = spark.createDataFrame([(k if k % 50 else None, u, "h", "s") for k, u in enumerate(urls)], "page_id long, url string, host string, scope string")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block"), ("a", "/", None), rules[0]], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in url_filters.judge(pages, given).collect()), key=str)
    assert got == sorted(((k if k % 50 else None, *plain(u, rules)) for k, u in enumerate(urls)), key=str)
    kept = url_filters.keep_allowed(pages, given, default="block")
    assert all(r.rule is not None and r.verdict == "allow" for r in kept.collect())


def test_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted(tuple(r) for r in url_filters.judge(pages, none).collect()) == [(1, "a", "/b", None, "allow"), (2, "", "", None, "allow")]
    assert url_filters.judge(pages.limit(0), none).count() == 0
