import random

import pytest

from plumbline.llm import url_filter as U
from plumbline.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "://", "https://com/", "https://com", "http://EXAMPLE.com/en/x?q=/", "http://www.example.com/en/", "http://sub.www.Example.COM/en/a#b", "http://notexample.com/en/", "http://example.com.net/fr/x",
    "http://a.net/es/", "http://a.net/es", "http://a.net/ES/", "http://net/fr/", "http://x.org/a", "ftp://u:p@host.com:80/en/", "http://a.com?x=http://b.net/fr/", "x://é.com/ü", "http://" + "a." * 2000 + "com/" + "b/" * 2000, "http://a\n.com/\nq",
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        tail = rest[n:]
        path = tail[: min([i for i, c in enumerate(tail) if c in "?#"] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rules = {(".".join(rng.choices("abc", k=rng.randint(1, 3))), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(40)}
    many = [(h, p, v) for (h, p), v in rules.items()]
    urls = URLS + ["http://" + ".".join(rng.choices("abc", k=rng.randint(1, 4))) + "/" + "".join(rng.choices("ab/", k=rng.randint(0, 5))) for _ in range(300)] + URLS[:8]
    df = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string, own int").repartition(3)
    for given in (URL_RULES, many, []):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(spark, df, given).collect()}
        assert got == {i: brute(u, given) for i, u in enumerate(urls)}
    assert U.filter_urls(spark, df.limit(0), URL_RULES).count() == 0


def test_equal_digests_are_told_apart(tmp_path):
    """With a digest that gives the same to all, only the stored strings decide."""
    same = lambda key: 7
    file = tmp_path / "i"
    file.write_bytes(U.build_index(URL_RULES, same))
    index = U.DigestArray(str(file), same)
    urls = [u for u in URLS if u and "://" in u]
    parts = [brute(u, URL_RULES) for u in urls]
    got = U.judge(index, [p[0] for p in parts], [p[1] for p in parts], "allow")
    assert list(zip(got["rule"], got["verdict"])) == [p[2:] for p in parts]


def test_limits(monkeypatch):
    with pytest.raises(ValueError):
        U.build_index([("a", "/", "maybe")])
    monkeypatch.setattr(U, "MAX_INDEX_BYTES", 10)
    with pytest.raises(ValueError):
        U.build_index(URL_RULES)
