from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from conftest import at, dicts
from sprintloom.llm import warc as w

SCHEMA = "page_id long, url string, html string, at string, _digest string, n long, archive string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", "d", 1, "a") for r in rows], SCHEMA)


ROWS = [(i, f"http://H{i % 3}.org/a{i % 7}?x", "x" * (500 + 100 * (i % 9))) for i in range(60)] + [
    (200, None, None), (None, "bad url\r\n:é", None), (None, "http://a/", "y" * 2000), (300, "http://[", "y" * 2000),
    (300, "http://[", "y" * 2000), (301, "http://www.a.b:81/p", "WARC/1.1\r\n\r\n\x1f\x8bé" * 200), (-5, "http://a/", "é" * 499), (-6, "http://a/", "é" * 500),
    (-7, "http://a/", "é" * 500), (400, "http://a/", "x" * 3_000_000), (401, "http://a/", "x" * 3_000_000)]


def wanted():
    last = {}
    for i, _, html in ROWS:
        if html and len(html.encode()) >= 1000 and i is not None:
            last[html] = max(i, last.get(html, i))
    out = Counter()
    for i, _, html in ROWS:
        payload = (html or "").encode()
        to = last.get(html) if last.get(html) != i else None
        out[i, len(payload), hashlib.sha1(payload).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def number(text):
    return None if text is None else int(text)


def test_records_read_back_in_order(spark, tmp_path):
    folder = str(tmp_path / "archives")
    found = w.capture_index(table(spark, ROWS).repartition(3), folder=folder, limit=2000, slice_lines=20).collect()
    assert Counter((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found) == wanted()
    ordered = sorted(found, key=lambda r: (r.part, r.position))
    keys = [w._key(tuple(r)) for r in ordered]
    assert keys == sorted(keys) and len({r.part for r in found}) > 1 and len({r.archive for r in found}) > 3
    place = [r for r in found if r.page_id == "301"][0]
    content = (tmp_path / "archives" / place.archive.rsplit("/", 1)[1]).read_bytes()[place.offset:place.offset + place.length]
    headers, block = w.parsed(gzip.decompress(content))
    assert headers["warc-target-uri"] == "http://www.a.b:81/p" and block.endswith("é".encode()) and place.url_key == "b,a:81)/p"


def test_payloads_of_revisits_are_restored(spark, tmp_path):
    folder = str(tmp_path / "archives")
    w.write_archives(table(spark, ROWS).withColumn("at", F.lit(at("2024-05-01"))), folder, limit=5000)
    back = w.restored(spark, folder)
    assert Counter((number(r["page_id"]), r["html"]) for r in dicts(back)) == Counter((i, h or "") for i, _, h in ROWS)


def test_times_order_the_captures_of_a_url(spark):
    rows = [(i, "http://a/" if i % 2 else "http://b/", "t") for i in range(40)]
    index = w.capture_index(table(spark, rows), at=F.timestamp_seconds(F.lit(1000) - F.col("page_id")), slice_lines=7)
    ordered = [r.page_id for r in sorted(index.collect(), key=lambda r: (r.part, r.position))]
    assert ordered == [str(i) for i in range(39, 0, -2)] + [str(i) for i in range(38, -1, -2)]


def test_no_rows(spark):
    assert w.capture_index(table(spark, [])).collect() == []


def test_loser_tree_equals_sorting():
    rng = random.Random(6)
    for _ in range(200):
        runs = [sorted((rng.randrange(9), (r, i)) for i in range(rng.randrange(6))) for r in range(rng.randrange(10))]
        merged = list(w.LoserTree([iter(r) for r in runs]))
        assert merged == sorted((x for r in runs for x in r), key=lambda x: x[0]) or [k for k, _ in merged] == sorted(k for r in runs for k, _ in r)
        assert Counter(merged) == Counter(x for r in runs for x in r)


def test_url_keys():
    assert w.url_key("HTTPS://www.Example.org:443/A/b?Q=1#f") == "org,example)/a/b?q=1"
    assert [w.url_key(u) for u in (None, "", "http://[", "nothing")] == ["", ")/", "http://[", ")nothing"]


def test_a_wrong_digest_or_a_short_record_is_noticed():
    good = w.record(1, "http://a/", b"text", at("2024-01-01"))
    assert w.index_line(good)[5:7] == (4, hashlib.sha1(b"text").hexdigest())
    for bad in (good.replace(b"\r\n\r\ntext", b"\r\n\r\nTEXT"), good[:-8], b"no record\r\n\r\n"):
        try:
            w.index_line(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
