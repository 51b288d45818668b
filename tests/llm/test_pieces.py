"""Segmentations of long units and long texts are those of short ones."""

import random

import numpy as np
import pytest

from opsgraph.llm import pieces
from tests.llm.test_operators import WORDS, prose


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(pieces.vocabulary(), 0.5)


TEXTS = [prose(1, 3000), "a" * 9000, "", " ", "  x  ", "".join(random.Random(2).choice("abcdefghéß日▁🙂") for _ in range(6000)), "".join(WORDS) * 40, " " * 500 + "end"]


def test_units_one_by_one_give_the_same(lattice, monkeypatch):
    want = lattice.encode(TEXTS, list(range(len(TEXTS))))
    monkeypatch.setattr(pieces, "LONG_UNIT", 0)
    for a, b in zip(want, lattice.encode(TEXTS, list(range(len(TEXTS))))):
        assert a.tolist() == b.tolist()
    monkeypatch.setattr(pieces, "LONG_UNIT", 1 << 30)
    for a, b in zip(want, lattice.encode(TEXTS, list(range(len(TEXTS))))):
        assert a.tolist() == b.tolist()


def test_parts_give_the_same(lattice, monkeypatch):
    want = lattice.encode(TEXTS, list(range(len(TEXTS))))
    monkeypatch.setattr(pieces, "PART", 100)
    assert len(list(pieces._parts(TEXTS[0]))) > 50 and len(list(pieces._parts(TEXTS[1]))) == 1
    for a, b in zip(want, lattice.encode(TEXTS, list(range(len(TEXTS))))):
        assert a.tolist() == b.tolist()


def test_texts_of_over_a_part_round_trip(lattice):
    decoder = pieces.Decoder(pieces.vocabulary())
    for text in (prose(3, 50_000), "é日x" * 40_000):
        assert len(text) > pieces.PART
        ids = lattice.encode([text], [5])[0]
        assert decoder.decode(ids, np.array([0, len(ids)])) == [text]


def test_long_units_follow_the_lattice(lattice, monkeypatch):
    """Of one unit, filtered by itself, the pieces at its end against those of all ways, summed one by one."""
    vocab = pieces.vocabulary()
    ids = {p: i for i, p in enumerate(vocab.pieces) if p}
    text, total = "▁another", {0: 1.0}
    for end in range(1, len(text) + 1):
        total[end] = sum(total[a] * np.exp(0.5 * vocab.logp[ids[text[a:end]]]) for a in range(end) if text[a:end] in ids)
    want = {ids[text[a:]]: total[a] * np.exp(0.5 * vocab.logp[ids[text[a:]]]) / total[len(text)] for a in range(len(text)) if text[a:] in ids}
    monkeypatch.setattr(pieces, "LONG_UNIT", 0)
    n, seen = 6000, {}
    for x in lattice.encode([" another"] * n, list(range(n))):
        seen[int(x[-1])] = seen.get(int(x[-1]), 0) + 1
    assert set(seen) <= set(want) and max(abs(seen.get(k, 0) / n - p) for k, p in want.items()) < 0.03
