from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from conftest import dicts
from sprintloom.llm import exact_dedup as e
from .conftest import LONG


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = [True] + [False] * (ids.count(keep) - 1)
        for i in ids:
            kept = i == keep and stays.pop(0)
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def got(frame):
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in dicts(frame)]


def ordered(rows):
    return sorted(rows, key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("block", [2, 4096])
def test_equals_brute_force(docs, block):
    rng = random.Random(block)
    rows = [(i, "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 5, 6, 9])))) for i in range(150)]
    rows += [(500, None), (None, None), (None, "only null ids"), (None, "only null ids"), (501, LONG), (502, LONG + "x"), (503, LONG),
             (504, "twice"), (504, "twice"), (None, "twice")]
    if block == 2:
        rows = [r for r in rows if r[1] is None or len(r[1]) < 1000]
    assert ordered(got(e.exact_duplicates(docs(rows), block_bytes=block))) == ordered(expected(rows))


def test_pieces_in_another_order_or_of_another_length_differ(docs):
    rows = [(1, "aabb"), (2, "bbaa"), (3, "aab"), (4, "aabbaabb"), (5, "aabbaab"), (6, "aabb")]
    assert ordered(got(e.exact_duplicates(docs(rows), block_bytes=2))) == ordered(expected(rows))


def test_hot_text_is_divided_and_made_one_again(docs, monkeypatch):
    monkeypatch.setattr(e, "HOT_ROWS", 10)
    monkeypatch.setattr(e, "HOT_SHARE", 3)
    monkeypatch.setattr(e, "SALTS", 4)
    rows = [(i, "same text here") for i in range(90)] + [(100 + i, f"text {i}") for i in range(50)]
    assert ordered(got(e.exact_duplicates(docs(rows), block_bytes=4))) == ordered(expected(rows))


def test_no_rows(docs):
    assert got(e.exact_duplicates(docs([]))) == []
    assert dicts(e.drop_exact_duplicates(docs([]))) == []


def test_filter_keeps_columns_and_one_row_per_text(docs):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (4, None), (5, "")]
    given = docs(rows)
    kept = e.drop_exact_duplicates(given)
    assert kept.columns == given.columns
    assert sorted((str(r["doc_id"]), r["text"] or "", r["_row"], r["word n"]) for r in dicts(kept)) == [
        ("2", "a", "r", "w"), ("3", "b", "r", "w"), ("5", "", "r", "w"), ("None", "c", "r", "w")]
