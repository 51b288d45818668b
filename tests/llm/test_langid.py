"""Cross-parsing of whole texts against a plain parse; scripts of many letters; ties."""

import random

import numpy as np
import pytest

from opsgraph.llm import langid
from tests.llm.test_operators import prose


def squeezed(text):
    out = ""
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or not out.endswith(" "):
            out += c
    return out


def phrases(text, train):
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        at, n = at + max(1, k), n + 1
    return n


def some(letters, seed, n):
    r = random.Random(seed)
    return "".join(r.choice(letters + " ") * r.choice((1, 1, 2)) for _ in range(n))


@pytest.mark.parametrize("block, at_once", [(1024, 8_000_000), (16, 8_000_000), (7, 40), (1, 2)])
def test_whole_texts_equal_a_plain_parse(monkeypatch, block, at_once):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    corpus = (("a", some("abcdé", 1, 300)), ("b", "abab" * 90 + some("cdx", 2, 200)))
    parser = langid.CrossParser(corpus)
    texts = [some("abcdéx", i, n) for i, n in enumerate((0, 1, 5, 17, 300, 2000))] + ["ab" * 400, "a" * 500, "Ab, c! " * 30, "...", corpus[0][1]]
    bits, has = parser.entropies(texts)
    for t, row in zip(texts, bits):
        want = [phrases(squeezed(t), squeezed(s)) * np.log2(max(2, len(squeezed(s)))) / max(1, len(squeezed(t))) for _, s in corpus]
        assert row == pytest.approx(want)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_scripts_of_many_letters_are_told_apart():
    first, second = ("".join(map(chr, range(a, a + 700))) for a in (0x4E00, 0x5100))
    corpus = (("x", some(first, 1, 5000)), ("y", some(second, 2, 5000)), ("en", prose(1, 800)))
    parser = langid.CrossParser(corpus)
    assert parser.width < 130
    names, scores = parser.predict([some(first, 9, 60), some(second, 9, 60), prose(9, 20), "ߊߋߌ", "12"])
    assert names[:3] == ["x", "y", "en"] and names[4] == "und" and min(scores[:3]) > 0.5


def test_equal_entropies_go_to_the_first():
    parser = langid.CrossParser((("b", "same text here"), ("c", "same text here"), ("d", "other words")))
    names, scores = parser.predict(["some text", "same"])
    assert names == ["b", "b"] and scores.tolist() == [0.5, 0.5]


def test_many_languages_are_all_learned(spark):
    data = [(i, f"{chr(0x561 + i % 30)}{chr(0x430 + i // 30)} word " * 40, f"l{i:03d}") for i in range(300)] + [(7, "again", "l007"), (None, "x", "l1"), (5, None, "l005")]
    got = langid.training_text(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(got) == 300 and all(len(t) <= 1024 for _, t in got)
