from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import dicts
from sprintloom.llm import gru, recurrent_lm as r
from sprintloom.llm.common import id_remainder

SMALL = r.Settings(words=20, known=40, hidden=8, classes=5, lanes=4, window=5, copy_tokens=2000, group_tokens=700, block=64)


def net(words=12, hidden=5, classes=4):
    counts = np.sort(np.random.default_rng(1).integers(1, 50, words))[::-1].astype(float)
    made = gru.Net.new(counts, 30.0, hidden, classes)
    rng = np.random.default_rng(2)
    return made.with_flat(made.flat() + rng.standard_normal(made.flat().size) * 0.3)


def test_probabilities_add_up_to_one():
    made = net()
    states = np.random.default_rng(3).standard_normal((3, 5)).astype(np.float32)
    for state in states:
        every = made.log_probs(np.repeat(state[None], 13, 0), np.arange(13))
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def test_the_start_is_the_tokens_frequency():
    counts = np.array([50.0, 30, 10, 5, 5])
    made = gru.Net.new(counts, 100.0, 4, 2)
    logs = made.log_probs(np.zeros((6, 4), np.float32), np.arange(6))
    assert np.exp(logs) == pytest.approx(np.r_[counts, 100] / 200, rel=1e-5)


def test_class_bounds():
    assert gru.class_bounds(np.array([]), 4).tolist() == [0]
    assert gru.class_bounds(np.array([100.0, 1, 1]), 4).tolist()[-1] == 3
    bounds = gru.class_bounds(np.ones(100), 10)
    assert len(bounds) == 11 and (np.diff(bounds) == 10).all()


def test_gradients_are_those_of_the_loss():
    docs = [np.array([3, 1, 0, 12, 5]), np.array([7, 7]), np.array([11, 2, 9])]

    class Recorder:
        def __init__(self):
            self.grads = {}

        def apply(self, part, grad, where=slice(None)):
            full = self.grads.setdefault(part, np.zeros(getattr(made, part).shape))
            full[where] += grad

    made, seen = net(), Recorder()
    gru.train(made, docs, seen, lanes=2, window=100)
    whole = np.concatenate([seen.grads.get(p, np.zeros(getattr(made, p).shape)).ravel() for p in gru.Net.PARTS])
    flat = made.flat().astype(np.float64)
    for at in np.random.default_rng(4).choice(len(flat), 60, replace=False):
        step = np.zeros_like(flat)
        step[at] = 1e-2
        change = (gru.score(made.with_flat(flat - step), docs, 2).sum() - gru.score(made.with_flat(flat + step), docs, 2).sum()) / 2e-2
        assert whole[at] == pytest.approx(change, abs=2e-2, rel=2e-2)


def test_lanes_and_windows_do_not_change_a_score():
    docs = [np.array(random.Random(i).choices(range(13), k=i % 17 + 1)) for i in range(40)]
    alone = [gru.score(net(), [d], 1, 1)[0] for d in docs]
    assert gru.score(net(), docs, 7, 4) == pytest.approx(alone, rel=1e-4)


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lower = lower.replace(space, " ")
    return [w for w in lower.split(" ") if w] + [""]


def corpus():
    rng = random.Random(8)
    follows = {w: rng.choices([f"w{i}" for i in range(30)], k=3) for w in [f"w{i}" for i in range(30)]}
    rows = []
    for i in range(260):
        word, text = rng.choice(list(follows)), []
        for _ in range(rng.randrange(1, 60)):
            text.append(word if rng.random() > 0.03 else f"rare{rng.randrange(400)}")
            word = rng.choice(follows[word])
        rows.append((i, " ".join(text)))
    return rows + [(1000, None), (1001, ""), (1002, "W1\u00a0x\tw2\x0bW3"), (None, "w1 w2"), (None, "w1 w2"), (3, rows[3][1]), (1003, "unseen words " * 300)]


def test_scores(docs):
    rows = corpus()
    out = dicts(r.score_documents(docs(rows), id_remainder("doc_id", 5) == 1, SMALL))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)), total,
                   round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words_of(t)), 6)) for i, t in rows)
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in out) == want
    fresh = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 1000]
    assert sum(x["score"] for x in fresh) > sum(x["base_score"] for x in fresh) + 0.05 * sum(x["n_tokens"] for x in fresh)
    assert all(x["score"] < 0 for x in out)


def test_every_token_has_its_share(docs, spark):
    rows = [(i, t) for i, t in corpus()[:40]]
    frame = docs(rows)
    counts = r.token_counts(frame)
    model = r.learn(frame, counts, SMALL)
    own = {x.word.decode(): x.n for x in counts.collect()}
    rest = sum(n + 0.5 for w, n in own.items() if model.ids.get(w.encode(), 99) >= model.net.words) + 0.5
    assert model.rest_total == pytest.approx(math.log10(rest))


def test_without_training_rows(docs):
    from pyspark.sql import functions as F
    out = dicts(r.score_documents(docs([(1, "a b"), (2, None)]), F.lit(True), SMALL))
    assert sorted((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in out) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert dicts(r.score_documents(docs([]), F.lit(False), SMALL)) == []


def test_runs_repeat(docs):
    rows, held = corpus(), id_remainder("doc_id", 5) == 1
    one, two = (sorted((str(x["doc_id"]), x["score"]) for x in dicts(r.score_documents(docs(rows).coalesce(3), held, SMALL))) for _ in range(2))
    assert [x[0] for x in one] == [x[0] for x in two] and [x[1] for x in one] == pytest.approx([x[1] for x in two], rel=1e-6)
