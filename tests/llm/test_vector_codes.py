from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from sprintloom.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vector string, error string, _label string"


def brute(rows, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 16 if kept else 0
    parts = [[tuple(math.floor(256 * x) for x in e[p * width:(p + 1) * width]) for _, e, _ in kept] for p in range(16)]
    books = [part[:entries] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda book, x: min(range(len(book)), key=lambda e: (far(book[e], x), e))
    for _ in range(rounds):
        for p in range(16):
            given = [nearest(books[p], x) for x in parts[p]]
            for e in range(len(books[p])):
                own = [x for x, g in zip(parts[p], given) if g == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, labels = [], {}
    for n, (vec_id, _, label) in enumerate(kept):
        code = [nearest(books[p], parts[p][n]) for p in range(16)]
        error = sum(far(books[p][code[p]], parts[p][n]) for p in range(16))
        labels[label] = labels.get(label, 0) + error
        out.append((vec_id, bytes(code).hex(), error, label))
    fits = lambda n: n if n < 1 << 63 else None
    return [(i, c, fits(e), fits(labels[k]), digest) for i, c, e, k in out]


def check(spark, rows, **options):
    full = [(*r, 1, "v", "e", "l") for r in rows]
    found = v.compressed(spark.createDataFrame(full, SCHEMA).repartition(3), **options)
    order = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(
        brute(rows, options.get("entries", 64), options.get("rounds", 2)), key=order)
    return found


@pytest.mark.parametrize("count, size, scale", [(3, 16, 1.0), (250, 64, 1.0), (300, 32, 0.02), (300, 16, 0.003), (120, 16, 1e5)])
def test_codes_equal_brute_force(spark, monkeypatch, count, size, scale):
    monkeypatch.setattr(v, "CHUNK", 100)
    rng = random.Random(count)
    check(spark, [(i, [rng.gauss(0, scale) for _ in range(size)], rng.choice([1, 2, None])) for i in range(count)])


def test_odd_rows(spark):
    rng = random.Random(8)
    one = lambda: [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, one(), i % 3) for i in range(80)]
    rows[0], rows[3], rows[4], rows[5] = (0, None, 1), (3, [None, *one()[1:]], 1), (4, [float("nan"), *one()[1:]], None), (5, [math.inf, *one()[1:]], 2)
    rows += [rows[10], rows[10], (None, one(), None), (None, one(), None), *[(1000 + i, rows[20][1], 7) for i in range(60)]]
    check(spark, rows)
    check(spark, rows, entries=5, rounds=1)


def test_components_beyond_doubles_whole_numbers(spark):
    """Means and distances stay exact; an error that no long can hold is null."""
    rng = random.Random(9)
    check(spark, [(i, [rng.gauss(0, 1e20) for _ in range(16)], 1) for i in range(70)] + [(500, [0.5] * 16, 2)])


def test_other_lengths_are_left_out(spark):
    rows = [(1, [1.0] * 16, 1, 1, "", "", ""), (2, [1.0] * 32, 1, 1, "", "", ""), (3, [1.0] * 15, 1, 1, "", "", ""), (4, [], 1, 1, "", "", "")]
    assert [r.vec_id for r in v.compressed(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_no_rows(spark):
    for rows in ([], [(1, None, 1, 1, "", "", "")]):
        empty = v.compressed(spark.createDataFrame(rows, SCHEMA))
        assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_hilbert_neighbours_are_one_step_apart():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = v.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_short_lists_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    points, book = np.floor(rng.normal(0, 60, (30000, 4))), np.floor(rng.normal(0, 60, (64, 4)))
    blocks = v.Blocks(points)
    lists = blocks.short_lists(book)
    far = ((blocks.points[:, None] - book[None]) ** 2).sum(2)
    nearest = far == far.min(1)[:, None]
    assert lists.sum() < lists.size / 2
    assert (lists[np.arange(len(points)) // v.BLOCK] | ~nearest).all()
    assert (blocks.sums().sum(0) == points.sum(0)).all()


def test_sums_of_any_size():
    for value in (0, 1, -1, (1 << 31) - 1, -(1 << 31), 1 << 32, -(1 << 32) - 5, 10 ** 40, -10 ** 40):
        assert sum(d << (32 * k) for k, d in enumerate(v._limbs(value))) == value
