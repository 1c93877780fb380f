import datetime

import pytest

from findara.llm.url_filter import judge, validity

T = datetime.datetime
ENTRIES = [("ads", "Bad.example.", T(2024, 1, 1), "add"), ("ads", "bad.example", T(2024, 1, 5), "remove"), ("ads", "bad.example", T(2024, 1, 8), "add"), ("ads", "bad.example", T(2024, 1, 8), "add"),
           ("tmp", "one.example", T(2024, 1, 2), "add"), ("tmp", "one.example", T(2024, 1, 2), "remove"), ("path", "site.example/de/", T(2024, 1, 1), "add"), ("path", "site.example/x.html", T(2024, 1, 1), "add"),
           ("none", None, T(2024, 1, 1), "add"), ("none", "two.example", None, "add"), ("gone", "bad.example", T(2024, 1, 3), "remove")]
URLS = ["http://bad.example/", "https://user@WWW.bad.example.:80/x?y#z", "http://notbad.example/", "http://one.example/", "https://site.example/de/a/b?c", "https://site.example/de", "https://site.example/x.html#top", "https://site.example/x.html/y", "https://sub.site.example/de/", "mailto:x", None, "", "http://bad.example/", "http://two.example"]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "list string, pattern string, at timestamp_ntz, action string")


@pytest.fixture(scope="module")
def captures(spark):
    rows = [(k, u, t, "mine") for k, u in enumerate(URLS) for t in (T(2023, 12, 31), T(2024, 1, 1), T(2024, 1, 4, 23), T(2024, 1, 5), T(2024, 1, 9), None)]
    return spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp_ntz, host string")


def brute(url, t):
    import re

    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)[^/?#]*(/[^?#]*)?", url or "")
    if not found or t is None or not found[1]:
        return [], []
    host, path = found[1].lower().rstrip("."), found[2] or "/"
    active = []
    for name, pattern in {(e[0], e[1].lower().rstrip(".")) for e in ENTRIES if e[1] and e[2]}:
        past = sorted((e[2], e[3]) for e in ENTRIES if e[0] == name and e[1] and e[1].lower().rstrip(".") == pattern and e[2] and e[2] <= t)
        if past and past[-1][1] == "add":
            address = (host + path).lower()
            if (address.startswith(pattern) and (pattern.endswith("/") or address == pattern)) if "/" in pattern else (host == pattern or host.endswith("." + pattern)):
                active.append((name, pattern))
    return sorted({a for a, _ in active}), sorted({p for _, p in active})


def test_against_brute_force(entries, captures):
    got = judge(captures, entries)
    assert got.columns == [*captures.columns, "host_", "lists", "patterns", "blocked"]
    rows = got.collect()
    assert len(rows) == captures.count()
    for r in rows:
        assert (r["lists"], r["patterns"]) == brute(r["url"], r["fetched_at"]), r
        assert r["blocked"] == bool(r["lists"])
    assert any(r["blocked"] for r in rows)


def test_intervals(entries):
    got = {(r["pattern"], r["since"].day, r["until"] and r["until"].day) for r in validity(entries).collect()}
    assert got == {("bad.example", 1, 5), ("bad.example", 8, None), ("site.example/de/", 1, None), ("site.example/x.html", 1, None)}


def test_empty_tables(entries, captures):
    assert judge(captures.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in judge(captures, entries.limit(0)).collect())
