"""The manifest against a plain program, however leaves are dealt out."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from opsgraph.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def plain(data, arity=2):
    def leaf(doc_id, text, lang, source, n_chars):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    trees = {}
    for r in data:
        changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], r[4] + 1) if changed else leaf(*r)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort()
        built[name] = levels([r[2] for r in trees[name]], arity)
    top = levels([built[n][-1][0] for n in names], arity)
    out = []
    for g, name in enumerate(names):
        for i, (some, doc_id, leaf_, claim) in enumerate(trees[name]):
            path = []
            for tree, at in ((built[name], i), (top, g)):
                for level in tree[:-1]:
                    first = at // arity * arity
                    path.append(("".join(level[first:at]), "".join(level[at + 1 : first + arity])))
                    at //= arity
            for before, after in path:
                claim = h(before + claim + after)
            root = top[-1][0]
            out.append((str(doc_id if some else None), str(name), leaf_, built[name][-1][0], root, h("".join(a + b for a, b in path)), claim, claim == root))
    return sorted(out)


def manifest(spark, data, **more):
    docs = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({"tree": F.lit(1), "Leaf": F.lit("x")})
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((str(r[0]), str(r[1]), *r[2:]) for r in merkle.manifest(docs, claim={"n_chars": tampered}, **more).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 9)
    monkeypatch.setattr(merkle, "FAN", 3)


@pytest.mark.parametrize("arity", [2, 3])
def test_equals_a_plain_program(spark, small, arity):
    rng = random.Random(arity)
    data = [(i, f"text {i} é" * rng.randrange(4), rng.choice(["en", "en", "de", "é", None, "", "-"]), rng.choice(["s", None]), rng.choice([i, None])) for i in range(130)]
    data += [(200, "lone", "zz", "s", 1)]
    assert manifest(spark, data, arity=arity) == plain(data, arity)


def test_repeated_rows_and_keys(spark, small):
    data = [(1, "same", "en", "s", 4)] * 40 + [(1, f"t{i}", "en", None, None) for i in range(10)] + [(None, None, None, None, None)] * 7 + [(i, "x", "de", "s", 1) for i in range(5)]
    assert manifest(spark, data) == plain(data)


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_and_lone(spark, rows):
    data = [(7, "x" * 100_000, "en", "s", 3)][:rows]
    found = manifest(spark, data)
    assert found == plain(data)
    if rows:
        assert found[0][2] == found[0][3] == found[0][4] and found[0][5] == h("")


def test_as_many_groups_as_rows(spark, small):
    data = [(i, "t", f"l{i}", "s", 1) for i in range(60)]
    assert manifest(spark, data) == plain(data)


def test_fragments_are_a_monoid():
    """In whatever order and grouping fragments of leaves are merged, the root and what was left agree."""
    rng = random.Random(1)
    for n, arity in ((1, 2), (2, 2), (37, 2), (64, 4), (50, 3)):
        leaves = {i: h(str(i)) for i in range(n)}
        want = levels(list(leaves.values()), arity)[-1][0]
        for _ in range(5):
            parts = [{0: {i: leaves[i]}} for i in rng.sample(range(n), n)]
            while len(parts) > 1:
                a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
                both = {level: a.get(level, {}) | b.get(level, {}) for level in a.keys() | b.keys()}
                left, _ = merkle.resolve(both, n, arity)
                assert merkle.resolve(left, n, arity)[0] == left
                parts.append(left)
            top = len(merkle.level_sizes(n, arity)) - 1
            assert merkle.resolve(parts[0], n, arity)[0] == {top: {0: want}}
