from __future__ import annotations

import random

import pytest
import xxhash

from conftest import dicts
from sprintloom.llm import simhash as s
from sprintloom.llm.components import components
from .conftest import LONG


def plain_fingerprint(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b c d a b c d", "É é\u00a0x\x0by\x0cz w", "x " * 70_000])
def test_fingerprint(text):
    for words in (1, 2, 3):
        assert s.fingerprint_of(text, words) == plain_fingerprint(text, words)


def test_fingerprint_does_not_depend_on_pieces(monkeypatch):
    from sprintloom.llm import common
    text = " ".join(random.Random(1).choice(["ab", "c", "dé", "efg"]) for _ in range(500))
    want = plain_fingerprint(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(s, "word_lists", lambda t, size=size: common.word_lists(t, size))
        assert s.fingerprint_of(text) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 4, 7])
def test_every_pair_within_the_radius_meets_under_some_mask(radius):
    rng, masks = random.Random(radius), s.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert min(m.bit_count() for m in masks) >= 18
    for _ in range(1000):
        changed = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & changed for m in masks)


def brute(values, within):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= within and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("radius,small", [(2, 256), (2, 3), (3, 256), (3, 4)])
def test_links_join_what_all_pairs_join(spark, radius, small):
    rng, values = random.Random(radius * small), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(14):
            v = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3, 6])):
                v ^= 1 << b
            values.add(s._signed(v))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    found = s.links(frame, radius, small=small)
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= radius for r in found.collect())
    roots = {r.node: r.root for r in components(found).collect()}
    assert {v: roots.get(v, v) for v in values} == brute(sorted(values), radius)


def test_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(chain).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(chain.filter("false")).count() == 0


def test_near_duplicates(docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):
        text = [rng.choice(words) for _ in range(rng.choice([2, 40, 400]))]
        rows.append((10 * i, " ".join(text)))
        rows.append((10 * i + 1, " ".join(text + ["more"])))
    rows += [(None, rows[0][1]), (7, None), (8, ""), (None, "alone and without id"), (9, LONG), (9, LONG)]
    prints = [s._signed(plain_fingerprint(t)) for _, t in rows]
    label = brute(sorted(set(prints)), 2)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[label[p]] = min(doc_id, least.get(label[p], doc_id))
    want = sorted(((i, f"{p & (2 ** 64 - 1):016x}", least.get(label[p])) for (i, _), p in zip(rows, prints)), key=str)
    out = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in dicts(s.near_duplicates(docs(rows)))]
    assert sorted(out, key=str) == want
    assert dicts(s.near_duplicates(docs([]))) == []


def staying(rows):
    """Of each component the row with the smallest id (null last) when all pairs are compared."""
    prints = [s._signed(plain_fingerprint(t)) for _, t in rows]
    label, stays = brute(sorted(set(prints)), 2), {}
    for (doc_id, text), p in zip(rows, prints):
        row = (doc_id is None, doc_id or 0)
        stays[label[p]] = min(row, stays.get(label[p], row))
    return sorted(str(None if none else i) for none, i in stays.values())


def test_filter_keeps_one_row_of_each_component(docs):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(2000)]
    base = [[rng.choice(words) for _ in range(600)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for j in range(3):
            edited = list(b)
            edited[rng.randrange(600)] = f"changed{j}"
            rows.append((100 * (j + 1) + i, " ".join(edited)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (None, "alone"), (None, "another one alone"), (-9, "ids below zero"), (-7, "ids below zero"), (9, LONG)]
    given = docs(rows)
    kept = s.drop_near_duplicates(given)
    assert kept.columns == given.columns
    ids = sorted(str(r["doc_id"]) for r in dicts(kept))
    assert ids == staying(rows) and 25 < len(ids) < 80 and "-9" in ids and "-7" not in ids


def test_filter_of_repeated_rows_and_ids(docs):
    """Of rows that repeat id and text one stays, of rows that repeat an id the same one each time."""
    same = " ".join(f"w{i}" for i in range(50))
    rows = [(5, same), (5, same), (5, same), (6, "one of its own"), (6, "one of its own"), (7, "repeats the id"), (7, "with another text, unlike the first")]
    left = [(r["doc_id"], r["text"]) for r in dicts(s.drop_near_duplicates(docs(rows)))]
    assert sorted(left) == sorted({(5, same), (6, "one of its own"), *rows[5:]})
    upper = [(7, same), (7, same.upper()), (8, same)]
    one, two = (sorted((r["doc_id"], r["text"]) for r in dicts(s.drop_near_duplicates(docs(x)))) for x in (upper, upper[::-1]))
    assert one == two and len(one) == 1 and one[0][0] == 7


def test_filter_with_ids_of_text(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [("https://a.example/a-very-long-path/zzz", text), ("https://a.example/a-very-long-path/aaa", text), ("a:b", "c d e f"), ("a", "b:c d e f g h i j k")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(r["doc_id"] for r in dicts(s.drop_near_duplicates(frame))) == ["a", "a:b", "https://a.example/a-very-long-path/aaa"]


def test_filter_without_rows(docs):
    assert dicts(s.drop_near_duplicates(docs([]))) == []
