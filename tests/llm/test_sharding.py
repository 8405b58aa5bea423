from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from conftest import dicts, plan
from sprintloom.llm import sharding as s


def hashed(doc_id, text):
    digits = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:8] + hashlib.md5((text or "").encode()).hexdigest()[:7]
    return int(digits, 16)


def expected(rows, limit):
    size, count = defaultdict(int), defaultdict(int)
    for i, t in rows:
        bits = f"{hashed(i, t):060b}"
        for d in range(61):
            size[bits[:d]] += len((t or "").encode())
            count[bits[:d]] += 1
    out = []
    for i, t in rows:
        bits = f"{hashed(i, t):060b}"
        d = next((d for d in range(61) if size[bits[:d]] <= limit), 60)
        out.append((i, hashed(i, t), bits[:d], d, count[bits[:d]], size[bits[:d]], size[bits[:d]] <= limit))
    return sorted(out, key=str)


def rows_of(rng):
    rows = [(i, "é" * rng.randrange(0, 60)) for i in range(200)]
    return rows + [(None, None), (None, "x" * 30), (5, "y" * 70), (5, "z" * 70), (6, "big" * 500), (7, "again" * 20), (7, "again" * 20)]


@pytest.mark.parametrize("limit,step", [(150, 3), (150, 10), (2000, 2), (10 ** 9, 10)])
def test_equals_brute_force(docs, limit, step):
    rows = rows_of(random.Random(limit))
    out = [tuple(r.values()) for r in dicts(s.shards(docs(rows), limit, step=step))]
    assert sorted(out, key=str) == expected(rows, limit)


def test_only_few_rows_are_broadcast(spark, docs, monkeypatch):
    """Parts and shards grow with the table; their files are far smaller than their rows in the driver's memory."""
    plans, write = [], s.written
    monkeypatch.setattr(s, "FEW", 20, raising=False)
    monkeypatch.setattr(s, "written", lambda df, label: (plans.append((label, plan(df))), write(df, label))[1])
    rows = [(i, "x" * 20) for i in range(300)]
    assert sorted((tuple(r.values()) for r in dicts(s.shards(docs(rows), 60))), key=str) == expected(rows, 60)
    assert [label for label, _ in plans] == ["hashes", "parts", "leaves", "settled"]
    assert not any("Broadcast" in text for _, text in plans) and "SortMergeJoin" in plans[-1][1]
    for n, join in ((20, "BroadcastHashJoin"), (21, "SortMergeJoin")):
        met = s._met(spark.range(50).toDF("k"), spark.range(n).selectExpr("id AS k", "id AS v"), "k", "left")
        assert sum(r["v"] is not None for r in dicts(met)) == n and join in plan(met).split("Initial Plan")[0]


def test_directory_covers_every_slot_once(docs):
    rows = [(i, "x" * 20) for i in range(300)]
    slots = sorted((r["first_slot"], r["slots"]) for r in dicts(s.directory(s.shards(docs(rows), 200))))
    at = 0
    for first, count in slots:
        assert first >= at
        at = first + count


def test_no_rows_and_files(spark, docs, tmp_path):
    assert dicts(s.shards(docs([]))) == []
    given = docs(rows_of(random.Random(1)))
    s.write_shards(given, str(tmp_path / "out"), 400)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == given.count() and set(given.columns) < set(back.columns)
    assert all(r["_shard"].startswith("root") for r in dicts(back.select("_shard").distinct()))


def test_a_column_of_the_folders_name_stays(spark, docs, tmp_path):
    given = docs(rows_of(random.Random(1))).withColumnRenamed("name", "_shard")
    s.write_shards(given, str(tmp_path / "out"), 400)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == given.count() and {r["_shard"] for r in dicts(back.select("_shard"))} == {"n"}
    assert all(r["__shard"].startswith("root") for r in dicts(back.select("__shard").distinct()))
