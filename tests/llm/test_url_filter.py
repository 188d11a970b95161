"""URL rules against a plain version; the packed array against collisions."""

import random

import numpy as np
import pytest

from flagstone.llm import url_filter
from flagstone.llm.queries import URL_RULES


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


URLS = [
    None, "", "no scheme/en/1", "http://", "http://org", "http://org/", "https://A.B.EXAMPLE.org/es/x?y#z", "https://example.org/en/12", "http://xexample.org/en/1",
    "http://example.org?/en/1", "http://a.com/fr/://b.org/", "ftp://com/de/", "http://com/de", "http://É.com/de/É", "x\ny://a.org/\nz?q", "http://a..org/",
]


def test_equals_plain_version(spark):
    rng = random.Random(1)
    made = [f"http://{'.'.join(rng.choice(['a', 'example', 'org', 'com', 'net']) for _ in range(rng.randint(1, 4)))}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randint(0, 20)}" for _ in range(500)]
    urls = [*URLS, *made, "http://" + "a." * 3000 + "org/" + "p" * 3000]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r[0]: tuple(r[1:]) for r in url_filter.judge_urls(spark, pages, URL_RULES).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(spark, pages.limit(0), URL_RULES).collect() == []


def test_no_rules_and_many_rules(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p/{i}") for i in range(300)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(spark, pages, []).collect()} == {"allow"}
    rules = [("block", f"h{i}.net", "/p/") for i in range(0, 300, 3)] + [("allow", f"h{i}.net", f"/p/{i}") for i in range(0, 300, 6)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark, pages, rules).collect()}
    assert got == {i: "block" if i % 3 == 0 and i % 6 else "allow" for i in range(300)}


def test_collisions_are_told_apart_by_the_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    rules = [("block", f"h{i}", "/") for i in range(20)]
    path = tmp_path / "rules"
    path.write_bytes(url_filter.pack(rules))
    store = url_filter.DigestArray(str(path))
    found = store.find([f"h{i}/" for i in range(25)], [len(f"h{i}") for i in range(25)])
    assert (found[:20] >= 0).all() and (found[20:] < 0).all() and len(np.unique(found[:20])) == 20


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_PACKED_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.judge_urls(spark, spark.createDataFrame([(1, "u")], "page_id long, url string"), URL_RULES)


def test_parent_domains_are_bounded_by_the_longest_rule():
    for host in ("", "org", "a.org", "x.example.org", ".", "..", "a..b", "example.org."):
        every = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
        for longest in (0, 1, 3, 5, 11, 50):
            assert url_filter.suffixes(host, longest) == [x for x in every if len(x) <= longest]
    assert len(url_filter.suffixes("." * 100_000, 11)) == 12
