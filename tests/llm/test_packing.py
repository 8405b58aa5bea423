from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import dicts
from sprintloom.llm import bpe, packing as p

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = list(" \n\t  ab'sé1٣½.,中🙂\x1c\x85\xa0\u3000") + [" a", " 's", "<|endoftext|>", "  ", "word", " The"]


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("size", [1 << 20, 8])
def test_encoder_gives_the_tokenizers_ids(monkeypatch, size):
    monkeypatch.setattr(bpe, "_SLICE", size)
    encoder, rng = bpe.Encoder(PATH), random.Random(size)
    for _ in range(4000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text)[:-1], repr(text)


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 2)
    monkeypatch.setattr(bpe, "_TOKENS", 1)
    text = "one two, three. four two one five, six."
    assert np.frombuffer(bpe.Encoder(PATH).encode(text), "<u4").tolist() == ids(text)[:-1]


def test_assignment_balances_cost_and_wastes_less_than_a_sequence():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    placed, filled, cost = p.assign(sizes, 100, 1.0, 0.01), defaultdict(int), defaultdict(float)
    for item, start, size, sequence, offset in placed:
        assert offset == filled[sequence]
        filled[sequence] += size
        cost[sequence] += size + 0.01 * size * size
    assert len(filled) == -(-sum(sizes) // 100) and max(filled.values()) <= 100
    assert sum(100 - f for f in filled.values()) < 100
    parts = defaultdict(list)
    for item, start, size, _, _ in placed:
        parts[item].append((start, size))
    for item, size in enumerate(sizes):
        at = 0
        for start, length in sorted(parts[item]):
            assert start == at
            at += length
        assert at == size
    assert max(cost.values()) <= 2 * min(c for s, c in cost.items() if filled[s] == 100)
    assert p.assign([]) == []


def test_first_items_open_sequences_and_the_next_goes_to_the_cheapest():
    assert p.assign([6, 5, 3, 2], 8, 1.0, 1.0) == [(0, 0, 6, 0, 0), (1, 0, 5, 1, 0), (2, 0, 3, 1, 5), (3, 0, 2, 0, 6)]


def test_pieces_put_together_are_the_documents(docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma.", "délta"]) for _ in range(rng.choice([0, 3, 50, 900])))) for i in range(60)]
    rows += [(None, None), (None, "twice"), (7, "twice"), (100, "long " * 30_000)]
    out = dicts(p.pack(docs(rows).coalesce(2), group=16))
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], bytes(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= p.LENGTH
    for (doc_id, tokens), parts in texts.items():
        whole = b"".join(x for _, _, x in sorted(parts))
        assert len(whole) == 4 * tokens
        assert np.frombuffer(whole, "<u4").tolist() in [ids(t) for i, t in rows if i == doc_id]
    assert sum(r["length"] for r in out) == sum(len(ids(t)) for _, t in rows)
    assert len(texts) == len({(i, len(ids(t))) for i, t in rows})


def test_no_rows(docs):
    empty = p.pack(docs([]), with_ids=False)
    assert dicts(empty) == [] and "ids" not in empty.columns


def test_a_worker_that_remembers_little_gives_the_same_ids():
    texts = [" ".join(f"word{i % 50} und{i}" for i in range(n)) for n in (3, 400)]
    little, much = bpe.Encoder(PATH, 10), bpe.Encoder(PATH)
    assert [little.encode(t) for t in texts] == [much.encode(t) for t in texts]
    assert len(little.pieces) <= 10 < len(much.pieces) and bpe.Encoder.of(PATH, 10) is not bpe.Encoder.of(PATH)
