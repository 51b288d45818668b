"""Neighbours of repeated and null keys against brute force."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from opsgraph.llm import imatch
from tests.llm.test_operators import prose


def neighbours(spark, data, told=10_000):
    """Sorted rows of the operator, and of brute force over the order it defines."""
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    lex = imatch.lexicon(df)
    known = imatch.Lexicon(list(lex))
    tie = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for (k, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = map(known.fingerprint, (t, edited, n))
        want.append((str(k), len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, imatch.likeness(a, b), imatch.likeness(a, c)))
    got = [(str(r.doc_id), *r[1:]) for r in imatch.edited_neighbours(df, lex).collect()]
    assert sorted(got) == sorted(want)
    return got


@pytest.mark.parametrize("told", [10_000, 7])
def test_repeated_and_null_keys_equal_brute_force(spark, monkeypatch, told):
    monkeypatch.setattr(imatch, "TOLD", told)
    data = [(i, prose(i, 5 + i % 9)) for i in range(30)] + [(-(1 << 63), "least of all"), ((1 << 63) - 1, prose(3, 9))]
    data += [(7, prose(100 + i % 5, 12)) for i in range(40)] + [(None, prose(200 + i % 3, 8)) for i in range(20)] + [(8, None), (8, "")]
    assert len(neighbours(spark, data)) == len(data)


def test_a_third_of_all_rows_with_one_key(spark):
    data = [(i if i % 3 else 500, prose(i, 10)) for i in range(600)]
    neighbours(spark, data)
    neighbours(spark, [(1, "same")] * 50)
    neighbours(spark, [(None, "only")])


def test_fingerprint_parts_are_those_of_their_terms():
    lex = imatch.Lexicon([f"w{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(1000)])
    words = list(lex.at)
    a, b = " ".join(words[:300]), " ".join(words[:299])
    x, y = lex.fingerprint(a), lex.fingerprint(b)
    last = lex.subset[299]
    for i, inside in enumerate(last):
        same = x[16 + 4 * i : 20 + 4 * i] == y[16 + 4 * i : 20 + 4 * i]
        assert same == (not inside)
    assert x[:16] != y[:16] and imatch.likeness(x, y) > 0.7 and len(x) == 16 + 4 * len(imatch.SHARES)
    empty = lex.fingerprint("zzz")
    assert empty[16:] == "0000" * len(imatch.SHARES) and empty[:16] == f"{xxhash.xxh64_intdigest(b'zzz'):016x}"
