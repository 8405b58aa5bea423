from __future__ import annotations

import re

import pytest
from hypothesis import given, settings, strategies as st

from conftest import dicts
from sprintloom.llm import url_filter as u

URLS = [
    "https://www.Example.ORG/es/5", "https://example.org/en/12", "https://example.org/en/2", "http://a.b.com/fr/", "http://com/de/x?y", "http://COM/fr",
    "http://notexample.org/es/1", "http://example.org", "http://example.org?x=/es/", "http://org/", "ftp://a.com/de/#x", "example.org/es/", None, "",
    "http://x.net/login/", "http://x.net/login", "http://x.net/logins", "http://x.net/a?utm_source=feed", "http://x.net/a?b&utm_source=f", "http://x.net/?page=2&ref=x",
    "http://m.x.net/de/1", "http://xm.x.net/de/1", "http://blog.x.net/login/", "http://x.net/setup.EXE", "http://x.net/setup.exe?", "http://x.net/tag/a/b/",
    "http://x.net/?print=1", "http://x.net/?q&print=1&", "http://adult.example.net", "http://adult.example.net:80/", "x://é.org/ü?É", "a\nb://c.org/\nd", "http://x.net/?GCLID=1",
    "x" * 100_000 + "://org/" + "y" * 100_000,
]


def plain(url):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    parts = (url or "").split("://", 1)
    rest = parts[1] if len(parts) == 2 else ""
    host = lower(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [r for r in u.HOST_RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    found = [r for r in u.PATTERN_RULES if re.search(java(u.regex_of(r.pattern)), lower(url or ""))]
    verdict = best.verdict if best else "allow" if any(r.verdict == "allow" for r in found) else "block" if found else "allow"
    return host, path, best and best.host + best.path, verdict, ",".join(sorted(r.name for r in found))


def java(regex):
    """The same expression for Python, whose dollar also fits before a last line feed."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), regex).replace("$", r"\Z")


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, url, "clash") for i, url in enumerate(URLS)] + [(None, URLS[0], "x"), (0, URLS[0], "x")], "page_id long, url string, rule string")
    out = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["patterns"]) for r in dicts(u.judge(pages))]
    want = [(i, *plain(url)) for i, url in enumerate(URLS)] + [(None, *plain(URLS[0])), (0, *plain(URLS[0]))]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert dicts(u.judge(pages.filter("false"))) == []


def test_the_rarest_token_is_the_key(spark):
    rules = (u.PatternRule("a", "/common/rare/", "block"), u.PatternRule("b", "*open*", "block"), u.PatternRule("c", "^new^", "block"))
    pages = spark.createDataFrame([("http://x/common/rare/",), ("http://x/common/",), ("http://xopenx/",), ("http://x/new",)], "url string")
    keys = u.rarest_tokens(pages, rules)
    assert keys == {"a": "rare", "b": None, "c": "new"}
    found = pages.select("url", u.matches(pages.url, keys, rules).alias("m"))
    assert {r.url: [m.rule for m in r.m] for r in found.collect()} == {
        "http://x/common/rare/": ["a"], "http://x/common/": [], "http://xopenx/": ["b"], "http://x/new": ["c"]}


@settings(max_examples=300, deadline=None)
@given(st.text("ab1/?=^*|.&", min_size=1, max_size=12), st.text("ab1/?=.&", max_size=25))
def test_a_matching_url_holds_the_literal_tokens(pattern, rest):
    url = "http://" + rest
    if re.search(java(u.regex_of(pattern)), url):
        assert set(u.tokens_of(pattern)) <= set(re.split("[^a-z0-9]+", url))


def test_indexes_in_the_plan_are_bounded(monkeypatch):
    monkeypatch.setattr(u, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        u._checked(u.HOST_RULES)


def test_rules_in_a_join_judge_alike(spark, monkeypatch):
    monkeypatch.setattr(u, "MOST_RULES", 3)
    rows = [(i, url, "clash") for i, url in enumerate(URLS)] + [(None, URLS[0], "x"), (0, URLS[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for keys in (u.MOST_KEYS, 1):
        monkeypatch.setattr(u, "MOST_KEYS", keys)
        out = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["patterns"]) for r in dicts(u.judge(pages))]
        assert sorted(out, key=str) == sorted(((i, *plain(url)) for i, url, _ in rows), key=str)
    assert dicts(u.judge(pages.filter("false"))) == []


def test_fifty_thousand_rules(spark):
    hosts = [u.HostRule(f"h{i}.net", "/a/" if i % 2 else "/", "block") for i in range(50_000)] + [u.HostRule("h7.net", "/a/b", "allow")]
    patterns = [u.PatternRule(f"p{i}", f"^word{i}^*^id{i % 10}^", "block") for i in range(50_000)] + [u.PatternRule("loose", "*zz*", "allow")]
    urls = {"http://x.h7.net/a/c": ("h7.net/a/", "block", ""), "http://h7.net/a/bc": ("h7.net/a/b", "allow", ""), "http://h8.net/": ("h8.net/", "block", ""),
            "http://h7.net/b": (None, "allow", ""), "http://y.org/word49999/q/id9/": (None, "block", "p49999"), "http://y.org/word49999/id8": (None, "allow", ""),
            "http://y.org/word12/word13/id2/id3/azzb": (None, "allow", "loose,p12,p13"), "none": (None, "allow", "")}
    pages = spark.createDataFrame([(i, url) for i, url in enumerate(list(urls) * 200)], "page_id long, url string")
    out = dicts(u.judge(pages, hosts, patterns))
    assert sorted(r["page_id"] for r in out) == list(range(1600))
    assert {list(urls)[r["page_id"] % 8]: (r["rule"], r["verdict"], r["patterns"]) for r in out} == urls
    assert len({(r["page_id"] % 8, r["rule"], r["verdict"], r["patterns"]) for r in out}) == 8
