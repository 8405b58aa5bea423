"""URL filters: host rules by longest match, then pattern rules indexed by their rarest literal token.

Patterns use ``*`` for anything, ``^`` for a separator or the end, ``||`` for the start of a host or a parent domain of
it, ``|`` at either end for the URL's own ends, and plain text otherwise, in lower case. A rule's literal tokens are the runs
of a-z and 0-9 that every matching URL holds between other characters. A URL's tokens fetch the rules
stored under them, and only those rules' regular expressions run. Indexes of up to ``MOST_RULES`` rules are constants of
the plan, so a table is judged in one pass without any join, shuffle or Python code. Longer lists become a
table of keys, which the hosts and tokens of the distinct URLs meet in a join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sprintloom.llm.common import join_groups
from sprintloom.session import written

# Indexes in the plan reach every task, so longer lists of rules are joined instead.
MOST_RULES = 20_000
# Keys of rules that are broadcast to sort out other hosts and tokens before the join, about 50 MB at most.
MOST_KEYS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = re.compile(r"\|\||\||\*|\^|[a-z0-9]+|[^a-z0-9]", re.S)


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    name: str
    pattern: str
    verdict: str


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)

PATTERN_RULES = (
    PatternRule("tracking", "?utm_source=", "block"),
    PatternRule("tracking_more", "&utm_source=", "block"),
    PatternRule("click_id", "^gclid=", "block"),
    PatternRule("session", "^phpsessionid=", "block"),
    PatternRule("listing", "?page=*&ref=", "block"),
    PatternRule("login", "^login^", "block"),
    PatternRule("signup", "^signup^", "block"),
    PatternRule("cart", "^cart^", "block"),
    PatternRule("search", "^search?q=", "block"),
    PatternRule("tag_page", "/tag/*/", "block"),
    PatternRule("print_view", "^print=1|", "block"),
    PatternRule("mobile_german", "||m.*/de/", "block"),
    PatternRule("adult", "||adult.example.net^", "block"),
    PatternRule("binary", ".exe|", "block"),
    PatternRule("blog", "||blog.", "allow"),
)


def regex_of(pattern: str) -> str:
    out, parts = [], _PARTS.findall(pattern)
    for at, part in enumerate(parts):
        if part == "||":
            out.append(r"^[^/?#]*://([^/?#]*\.)?")
        elif part == "|" and at in (0, len(parts) - 1):
            out.append("^" if at == 0 else "$")
        elif part == "*":
            out.append(r"[\s\S]*")
        elif part == "^":
            out.append("(?:[^a-z0-9_.%-]|$)")
        else:
            out.append(part if part.isalnum() and part.isascii() else "".join(f"\\x{{{ord(c):x}}}" for c in part))
    return "".join(out)


def tokens_of(pattern: str) -> list[str]:
    """The literal tokens that a matching URL must hold as whole tokens."""
    parts = _PARTS.findall(pattern)
    whole = lambda at: 0 <= at < len(parts) and parts[at] != "*"  # noqa: E731  an end without an anchor is open too
    return [p for at, p in enumerate(parts) if re.fullmatch("[a-z0-9]+", p) and whole(at - 1) and whole(at + 1)]


def lowered(column: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(column, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def _index(entries: list[tuple[str, dict[str, str]]], fields: list[str]):
    """Lookup of entries by key: a constant array of hash buckets, of which a key reads one."""
    size = 1 << max(4, len(entries).bit_length())
    buckets: list[list] = [[] for _ in range(size)]
    for key, values in entries:
        at = xxhash.xxh64_intdigest(key.encode(), 42) % size
        buckets[at].append(F.struct(F.lit(key).alias("key"), *[F.lit(values[f]).alias(f) for f in fields]))
    kind = "array<struct<key: string, " + ", ".join(f"{f}: string" for f in fields) + ">>"
    table = F.array(*[(F.array(*b) if b else F.array()).cast(kind) for b in buckets])
    return lambda key: F.filter(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(size - 1)).cast("int")), lambda e: e["key"] == key)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """The longest fitting rule as ``struct<size, name, verdict>``, null if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones, the one
    that is last by name counts. The host's parent domains are looked up, each in one bucket."""
    _checked(rules)
    find = _index([(r.host, {"path": r.path, "verdict": r.verdict}) for r in rules], ["path", "verdict"])
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n * -1, n), "."))
    fitting = F.filter(F.flatten(F.transform(parents, find)), lambda r: F.startswith(path, r["path"]))
    named = F.transform(fitting, lambda r: F.struct(
        (F.length(r["key"]) + F.length(r["path"])).alias("size"), F.concat(r["key"], r["path"]).alias("name"), r["verdict"].alias("verdict")))
    return F.when(host != "", F.array_max(named))


def _checked(rules) -> None:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules: the index is a part of the plan, for at most {MOST_RULES}")


def rarest_tokens(urls: DataFrame, rules=PATTERN_RULES, url: str = "url") -> dict[str, str | None]:
    """Each rule's literal token that the fewest URLs hold, ties in alphabetical order; None without any.

    Only the rules' own tokens are counted, so as many counts as there are tokens reach the driver."""
    wanted = sorted({t for r in rules for t in tokens_of(r.pattern)})
    counts = {r.token: r.n for r in urls.select(F.explode(F.array_intersect(url_tokens(F.col(url)), F.lit(wanted))).alias("token"))
              .groupBy("token").agg(F.count("*").alias("n")).collect()} if wanted else {}
    return {r.name: min(tokens_of(r.pattern), key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def matches(url: Column, keys: dict[str, str | None], rules=PATTERN_RULES) -> Column:
    """Sorted ``struct<rule, verdict>`` of the pattern rules that match a URL."""
    _checked(rules)
    fields = ["rule", "verdict", "regex"]
    entry = lambda r: {"rule": r.name, "verdict": r.verdict, "regex": regex_of(r.pattern)}
    find = _index([(keys[r.name], entry(r)) for r in rules if keys[r.name]], fields)
    loose = [F.struct(F.lit("").alias("key"), *[F.lit(entry(r)[f]).alias(f) for f in fields]) for r in rules if not keys[r.name]]
    low = lowered(F.coalesce(url, F.lit("")))
    candidates = F.flatten(F.transform(url_tokens(url), find))
    if loose:  # without a whole token nothing can fetch them, so they run for every URL
        candidates = F.concat(candidates, F.array(*loose))
    hits = F.filter(candidates, lambda r: F.rlike(low, r["regex"]))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict")))))


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, patterns`` for every row of ``pages``.

    ``rule`` is the longest fitting host rule and gives the verdict. Without one (null) the patterns that match
    decide: any allowing one allows, else any blocking one blocks, else the URL is allowed. A null URL
    or one without ``://`` has empty host and path, fits no host rule, and is still matched against the
    patterns. Repeated rows are judged each; other columns are not read; no rows give no rows.
    """
    if max(len(host_rules), len(pattern_rules)) > MOST_RULES:
        return _judged_by_join(pages, host_rules, pattern_rules, url, page_id)
    keys = rarest_tokens(pages, pattern_rules, url)
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    ruled = parsed.select("page_id", "url", "host", "path", host_rule(F.col("host"), F.col("path"), host_rules).alias("own"),
                          matches(F.col("url"), keys, pattern_rules).alias("found"))
    return ruled.select("page_id", "host", "path", *_verdict())


def _verdict() -> list[Column]:
    """``rule, verdict, patterns`` from ``own``, the longest host rule, and ``found``, the matching patterns."""
    has = lambda verdict: F.exists("found", lambda m: m["verdict"] == verdict)
    by_pattern = F.when(has("allow"), "allow").when(has("block"), "block").otherwise("allow")
    return [F.col("own.name").alias("rule"), F.coalesce("own.verdict", by_pattern).alias("verdict"), F.array_join("found.rule", ",").alias("patterns")]


_GROUPS = ("key string, n long, hosts array<struct<path: string, verdict: string>>, "
           "patterns array<struct<rule: string, verdict: string, regex: string>>")


def _judged_by_join(pages: DataFrame, host_rules, pattern_rules, url: str, page_id: str) -> DataFrame:
    """``judge`` for any number of rules. The driver holds the rules, and receives a count for each of their keys.

    Each distinct URL is judged once: its parent domains and tokens fetch the rules stored under them, and what it gets is
    joined back to its rows. Keys and URLs with many rows meet their rules and results in a broadcast of less than
    a thousand rows (``join_groups``). Rules without a whole token lie under the empty one, which every URL holds.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    counted = rows.groupBy("url").agg(F.count("*").alias("n"))
    urls = written(counted.select("url", "n", *[c.alias(name) for c, name in zip(host_and_path(F.col("url")), ("host", "path"))]), "urls")
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h"), F.array_join(F.slice(labels, i * -1, i), ".")))
    tokens = F.transform(F.array_union(url_tokens(F.col("url")), F.array(F.lit(""))), lambda t: F.concat(F.lit("t"), t))
    keys = F.concat(F.when(F.col("host") != "", parents).otherwise(F.array().cast("array<string>")), tokens)
    places = urls.select("url", "host", "path", F.explode(F.array_distinct(keys)).alias("key"))

    own_tokens = [["t" + t for t in tokens_of(r.pattern)] or ["t"] for r in pattern_rules]
    wanted = sorted({"h" + r.host for r in host_rules}.union(*own_tokens))
    listed = spark.createDataFrame([(k,) for k in wanted], "key string")
    met = places.join(F.broadcast(listed) if len(wanted) <= MOST_KEYS else listed, "key", "left_semi")
    counts = {r.key: r.n for r in met.groupBy("key").agg(F.count("*").alias("n")).collect()}

    stored: dict[str, tuple[list, list]] = {}
    for r in host_rules:
        stored.setdefault("h" + r.host, ([], []))[0].append((r.path, r.verdict))
    for r, own in zip(pattern_rules, own_tokens):
        key = min(own, key=lambda t: (counts.get(t, 0), t))
        stored.setdefault(key, ([], []))[1].append((r.name, r.verdict, regex_of(r.pattern)))
    groups = written(spark.createDataFrame([(k, counts[k], *v) for k, v in stored.items() if k in counts], _GROUPS), "rules")

    fetched = join_groups(met.select("url", "host", "path", "key"), groups, "key", F.col("url"))
    domain = F.expr("substring(key, 2)")
    fitting = F.transform(F.filter("hosts", lambda r: F.startswith("path", r["path"])), lambda r: F.struct(
        (F.length(domain) + F.length(r["path"])).alias("size"), F.concat(domain, r["path"]).alias("name"), r["verdict"].alias("verdict")))
    hits = F.transform(F.filter("patterns", lambda r: F.rlike(lowered(F.col("url")), r["regex"])),
                       lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    found = fetched.select("url", F.array_max(fitting).alias("own"), hits.alias("hits")).filter("own is not null or size(hits) > 0")
    found = found.groupBy("url").agg(F.max("own").alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("found"))
    judged = urls.join(found, "url", "left").withColumn("found", F.coalesce("found", F.expr("array()").cast("array<struct<rule: string, verdict: string>>")))
    judged = written(judged.select("url", "n", "host", "path", *_verdict()), "judged")
    return join_groups(rows, judged, "url", F.col("page_id")).select("page_id", "host", "path", "rule", "verdict", "patterns")
