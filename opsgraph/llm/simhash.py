"""SimHash near-duplicate groups, candidates pruned by pigeonring filtering.

Two fingerprints that differ in at most D of 64 bits, cut into m segments laid out as a ring, have a
segment from which every chain of l consecutive segments differs in at most l x D / m bits. As long as
l x D < m, a chain must be equal: these first segments of it are the join key; the longer chains prune
what shares the key, and the full Hamming distance decides. m grows with the number of fingerprints, and
so does the key, so that few share one by chance.

Work is on distinct fingerprints, so copies cost nothing. A key that more than BUCKET fingerprints share
all the same isn't paired: its fingerprints meet, exactly, in the values one bit away from them (two that
differ in at most two bits have such a value in common, and at most 65 share one).

For texts that are alike to a lower degree, bits are too few to tell; there, texts meet by the rarest of
their shingles (prefix filtering) and their sets of shingles decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import FACTORS, forget, joined, let, mix, packed, runs_hashed, saved, ship, slices, unpacked

SHINGLE, SEED, DISTANCE = 3, 42, 2
BUCKET = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str, size: int) -> list[bytes]:
    """Space-joined runs of `size` words, repeats included; fewer words make one shingle, none make none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprints(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if it is in over half of the shingles' XXH64."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices([len(t) for t in texts], 200_000):
        hashes, counts = [], []
        for t in texts[a:b]:
            found = shingles(t, size)
            hashes.extend(map(xxhash.xxh64_intdigest, found, repeat(SEED)))
            counts.append(len(found))
        counts = np.array(counts)
        some = np.flatnonzero(counts)
        if len(some):
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            starts = (np.cumsum(counts) - counts)[some]
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            out[a + some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint(size: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([t or "" for t in texts], size).view(np.int64))

    return of("_text")


def hex_digits(fingerprint: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def ring(count: int, distance: int = DISTANCE) -> tuple[int, int]:
    """(m, l): of how many segments a ring is, and how many of a chain are equal, for so many fingerprints.

    The fewest segments with which at most 4 fingerprints share a key by chance. Keys of up to half of
    the bits are made, for up to some 10 thousand million fingerprints; of more, more share one.
    """
    for equal in range(1, 63 // distance + 1):
        m = equal * distance + 1
        if count <= 4 << equal * (64 // m):
            break
    return m, equal


def links(prints: DataFrame, distance: int = DISTANCE, count: int | None = None) -> DataFrame:
    """prints: distinct longs f. Pairs (a, b) that join all fingerprints within the distance into groups.

    Pairs that meet in a key of up to BUCKET fingerprints come as they are. Of a more frequent key, each
    fingerprint is linked to the least one with which it shares a value one bit away: fewer links, of at
    most two bits each, and the same groups. That exact way is for distances up to 2.
    """
    if distance > 2:
        raise ValueError("the exact way for frequent keys is for distances up to 2")
    count = prints.count() if count is None else count
    m, equal = ring(count, distance)
    parts = _segments(m)
    key = lambda i: F.struct(F.lit(i).alias("i"), *(_segment(F.col("f"), *parts[(i + j) % m]).alias(f"v{j}") for j in range(equal)))
    keyed = prints.select("f", F.explode(F.array(*map(key, range(m)))).alias("v"))
    shared = saved(keyed.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = joined(keyed, shared, "v", shared, m * count)

    few = rows.where(F.col("n") <= BUCKET).select("v", "f")
    pairs = few.withColumnRenamed("f", "a").join(few.withColumnRenamed("f", "b"), "v").where("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    more = lambda s, a, j: a["chain"] + F.get(s, (F.col("v.i") + j) % m)
    step = lambda s: lambda a, j: F.struct(more(s, a, j).alias("chain"), (a["near"] & (more(s, a, j) * m <= (j + 1) * distance)).alias("near"))
    chained = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.struct(F.lit(0).alias("chain"), F.lit(True).alias("near")), step(s), lambda a: a["near"])
    close = pairs.where(let(F.array(*(F.bit_count(_segment(diff, *p)) for p in parts)), chained)).select("a", "b")

    many = rows.where(F.col("n") > BUCKET).select("f")
    around = F.array(F.col("f"), *(F.col("f").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)))
    met = many.distinct().select("f", F.explode(around).alias("v")).select("f", F.min("f").over(Window.partitionBy("v")).alias("b"))
    return close.union(met.where("f <> b").select(F.col("b").alias("a"), F.col("f").alias("b"))).distinct()


#: Edges of a task that are made stars at once.
EDGES = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) -> each node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (differ := x != y).any():
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[x], root[y]
    rest = np.flatnonzero(root != np.arange(len(root)))
    return nodes[rest], nodes[root[rest]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) -> fewer edges of the same components, EDGES at most at once: where these suffice, a row a node."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(c.to_numpy() for c in table.columns))], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield done(held)
            held, n = [], 0
    if n:
        yield done(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), longs: root is the least node that can be reached.

    In each round every task first makes stars of its own edges, so a node comes with few lesser ones (one a task and EDGES).
    These are linked to the least of them, and the node to that one's own least: by an aggregation and a join, which meets
    nodes that very many lead to by a broadcast. What a round wrote goes when the next has read it. It ends when the tasks' stars are those of the whole.
    """
    ship(edges.sparkSession)
    old, edges = [], edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        now = saved(edges.mapInArrow(_stars, "a long, b long"), "links")
        for done in old:
            forget(done)
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))).alias("e")
        nodes = now.select(ends).groupBy("e.node").agg(F.min("e.up").alias("least"), F.max("e.up").alias("most"), F.count_if(F.col("e.up").isNull()).alias("below"))
        if not nodes.agg(F.count_if((F.col("least") < F.col("most")) | F.col("least").isNotNull() & (F.col("below") > 0))).first()[0]:  # a node has one lesser one, which has none
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        up = saved(now.groupBy("a").agg(F.collect_set("b").alias("s")).select("a", F.array_min("s").alias("m"), "s"), "up")
        beyond = up.select(F.col("a").alias("m"), F.col("m").alias("r"))
        least = saved(up.groupBy("m").agg(F.count("*").alias("n")).join(beyond, "m", "left"), "least")
        forget(now)
        old = [up, least]
        told = joined(up, least.select("m", F.coalesce("r", "m").alias("r")), "m", least, up.count())
        ends = F.concat(F.array("a"), F.filter("s", lambda b: b != F.col("m")))
        edges = told.select(F.explode(ends).alias("a"), F.col("r").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with fingerprint (long) and component_id: the least key in the group that links within the distance reach.

    A null text is an empty one; texts without words have fingerprint 0 and link like any other. Repeated
    rows and keys keep their rows. Null keys are never the least: a group of null keys alone has a null id.
    Other columns stay; columns of these two names are replaced.
    """
    ship(docs.sparkSession)
    prints = packed(docs, _text=F.col(text), _key=F.col(key)).select("_row", "_key", _fingerprint(size).alias("_f"))
    return unpacked(grouped(prints, distance), docs, fingerprint="_f", component_id="_component")


def prints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(_key, _f) of each row."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).select("_key", _fingerprint(size).alias("_f"))


def grouped(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (_key, _f, ...) with _component. prints is read twice and more."""
    least = saved(prints.groupBy("_f").agg(F.min("_key").alias("_least"), F.count("*").alias("_n")), "prints")
    kinds, rows = least.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    roots = components(links(least.select(F.col("_f").alias("f")), distance, kinds))
    rooted = saved(least.join(roots, least._f == roots.node, "left").select("_f", "_least", "_n", F.coalesce("root", "_f").alias("_root")), "rooted")
    named = rooted.groupBy("_root").agg(F.min("_least").alias("_component"), F.count("*").alias("n"))
    told = joined(rooted.select("_f", "_n", "_root"), named.drop("n"), "_root", named, kinds)
    return joined(prints, told.select("_f", "_component"), "_f", least.select("_f", F.col("_n").alias("n")), rows)


SIMILARITY, WORDS = 0.8, 5
#: Buckets of up to SMALL texts are compared pair by pair; of larger ones first each text with the one that has the fewest rarer
#: shingles, then, in rounds, GROW times as many of its texts with all others that aren't in their group.
SMALL, GROW = 8, 16
#: Shingles in the prefixes of over SMALL texts are put last, the most frequent ORDERED of them in order, found in COUNTS rounds. The order only makes buckets smaller; any gives the same pairs.
ORDERED, COUNTS = 250_000, 2
#: Code points of texts whose sets are made at once.
PART = 200_000
#: Cells in which a set's shingles are counted, up to 255 each, to bound what two sets can have in common.
CELLS = 256
MET = "b long, k long, s long, o long"


def sets(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, ascending, and the bounds (one more than texts)."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    words, bounds = runs_hashed(flat, (flat != 32) & ((flat < 9) | (flat > 13)), at)
    count = np.diff(bounds)
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += words[j : j + n] * FACTORS[j]
    owner = np.repeat(np.arange(len(texts)), count)
    whole = owner[:n] == owner[size - 1 :] if n else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    own = [(words[bounds[i] : bounds[i + 1]] * FACTORS[size : size + count[i]]).sum() for i in short]
    h, owner = mix(np.concatenate([h[whole], np.array(own, np.uint64)])), np.concatenate([owner[:n][whole], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def cells(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall into each of CELLS cells, at most 255."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * CELLS + (values % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * CELLS), 255).astype(np.uint8).reshape(n, CELLS)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of shingles that only one of two sets has, told by their cells: they share at most half of what is left of both."""
    return np.abs(x.astype(np.int16) - y).sum(-1, dtype=np.int64)


def names(values: np.ndarray, bounds: np.ndarray) -> list[int]:
    """What stands for each set of shingles: 64 bits, signed."""
    raw, cuts = values.tobytes(), (8 * bounds).tolist()
    hashes = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def _in_parts(texts: list[str], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """sets() of parts of the texts, with where each part begins."""
    for a, b in slices([len(t) for t in texts], PART):
        yield a, *sets(texts[a:b], size)


def _both(size: int) -> Column:
    @F.pandas_udf("struct<f:long,k:long,n:long,w:binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        values = [t or "" for t in texts]
        k, n, w = [], [], []
        for _, v, bounds in _in_parts(values, size):
            k += names(v, bounds)
            n += np.diff(bounds).tolist()
            w += [c.tobytes() for c in cells(v, bounds)]
        return pd.DataFrame({"f": fingerprints(values).view(np.int64), "k": np.array(k, np.int64), "n": np.array(n, np.int64), "w": w})

    return of("_text")


def _bounds(similarity: float) -> tuple[int, int]:
    return Fraction(str(similarity)).as_integer_ratio()


def _possible(s: np.ndarray, t: np.ndarray, up: int, down: int) -> np.ndarray:
    """Whether texts with their first common shingle there (size << 31 | place) can be up / down alike."""
    n, m = s >> 31, t >> 31
    most = np.minimum(n - (s & (1 << 31) - 1), m - (t & (1 << 31) - 1))
    return most * (up + down) >= up * (n + m)


def _prefixes(batches: Iterator[pa.RecordBatch], order: np.ndarray, size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """text -> for each shingle of its prefix: the shingle b, the text's name k, its number of shingles and the shingle's place s, and whether b is in order.

    order: the shingles that come last, the most frequent at the end. Of equal texts of a batch one counts.
    """
    up, down = _bounds(similarity)
    known = np.argsort(order)
    sorted_ = order[known]
    for batch in batches:
        seen, found = set(), []
        for _, v, bounds in _in_parts([t or "" for t in batch.column(0).to_pylist()], size):
            name, n = np.array(names(v, bounds), np.int64), np.diff(bounds)
            fresh = np.zeros(len(n), bool)
            for i in np.flatnonzero(n).tolist():
                fresh[i] = name[i] not in seen
                seen.add(int(name[i]))
            keep = np.repeat(fresh, n)
            v, n, name = v[keep], n[fresh], name[fresh]
            owner = np.repeat(np.arange(len(n)), n)
            last = np.zeros(len(v), np.int64)
            if len(order):
                at = np.minimum(np.searchsorted(sorted_, v), len(order) - 1)
                last = np.where(sorted_[at] == v, known[at] + 1, 0)
                turn = np.lexsort((v, last, owner))
                v, last = v[turn], last[turn]
            place = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
            use = place < np.repeat(n + -(up * n) // down + 1, n)
            found.append((v[use].view(np.int64), name[owner[use]], n[owner[use]] << 31 | place[use], last[use] > 0))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["b", "k", "s", "known"])


def _order(own: DataFrame, size: int, similarity: float) -> np.ndarray:
    """The shingles that most prefixes have, ascending by how many: at most ORDERED, of those that over SMALL have.

    What is frequent is put last, and then others come into the prefixes, which COUNTS rounds look at.
    """
    values, counts, order = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for _ in range(COUNTS):
        sent = own.sparkSession.sparkContext.broadcast(order)
        rows = own.select("_text").mapInArrow(lambda x: _prefixes(x, sent.value, size, similarity), "b long, k long, s long, known boolean")
        many = saved(rows.where("not known").groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "frequent")
        band = F.floor(4 * F.log2("n"))
        bands = sorted(((r.b, r.n) for r in many.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        left, least = ORDERED - len(values), None
        for at, n in bands:  # as many whole bands of counts as there is room for
            if n > left:
                break
            left, least = left - n, at
        if least is None:
            break
        top = many.where(band >= least).toArrow()
        values, counts = np.concatenate([values, top.column(0).to_numpy()]), np.concatenate([counts, top.column(1).to_numpy()])
        order = values[np.lexsort((values, counts))].view(np.uint64)
        forget(many)
    return order


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole buckets, from batches sorted by their first column."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        b = table.column(0)
        rest = table
        if len(b) and b[0].as_py() != b[-1].as_py():
            cut = int(np.searchsorted(b.to_numpy(), b[-1].as_py()))
            yield [c.to_numpy() for c in table.slice(0, cut).columns]
            rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield [c.to_numpy() for c in rest.columns]


def _rows(b: np.ndarray, k: np.ndarray, s: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """MET: rows of buckets, and (with o) distinct pairs of texts."""
    two = np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([np.minimum(x, y), np.maximum(x, y)], 1) for x, y in pairs)])
    two = pd.DataFrame(two, columns=["k", "o"]).drop_duplicates().to_numpy()
    n, none = len(b), np.zeros(len(two), np.int64)
    o = np.concatenate([np.zeros(n, np.int64), two[:, 1]])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([b, none])), pa.array(np.concatenate([k, two[:, 0]])), pa.array(np.concatenate([s, none])), pa.array(o, mask=np.arange(len(o)) < n)],
        names=["b", "k", "s", "o"],
    )


def _met(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(b, k, s), sorted -> MET: the pairs of small buckets, and the rows of large ones."""
    up, down = _bounds(similarity)
    for b, k, s in _by_bucket(batches):
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
        b, k, s = b[new], k[new], s[new]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        size = np.repeat(np.diff(np.append(start, len(b))), np.diff(np.append(start, len(b))))
        large = size > SMALL
        few = np.flatnonzero((size > 1) & ~large)
        pairs = []
        for d in range(1, SMALL):
            x = few[few + d < len(b)]
            x = x[(b[x] == b[x + d]) & _possible(s[x], s[np.minimum(x + d, len(b) - 1)], up, down)]
            pairs.append((k[x], k[x + d]))
        yield _rows(b[large], k[large], s[large], pairs)


def _ask(batches: Iterator[pa.RecordBatch], take: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(b, k, s, r, w), sorted by bucket -> MET: each bucket's next `take` texts with those of other groups that by their cells can be alike, and the rows not asked yet of buckets not done.

    Texts of small groups are asked first, of equally large ones those with few shingles rarer than the bucket's: a bucket
    is done when what is left is in one group, so the texts of its largest group need not be asked.
    """
    up, down = _bounds(similarity)
    for b, k, s, r, w in _by_bucket(batches):
        w = np.frombuffer(b"".join(w), np.uint8).reshape(len(b), CELLS)
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        for i, j in zip(start, np.append(start[1:], len(b))):
            _, group, many = np.unique(r[i:j], return_inverse=True, return_counts=True)
            turn = np.lexsort((k[i:j], (s[i:j] & (1 << 31) - 1) / (s[i:j] >> 31), group, many[group]))
            left, pairs = np.ones(j - i, bool), []
            for x in turn[: min(take, j - i - int(many.max()))]:
                left[x] = False
                other = np.flatnonzero(left & (group != group[x]) & _possible(s[i:j], s[i + x], up, down))
                pairs += [(np.full(len(o), k[i + x]), k[i + o]) for o in _within(w[i:j], s[i:j] >> 31, x, other, up, down)]
                if sum(len(p[0]) for p in pairs) > PART:
                    yield _rows(b[:0], k[:0], s[:0], pairs)
                    pairs = []
            rest = i + np.flatnonzero(left)
            rest = rest[:0] if (r[rest] == r[rest[0]]).all() else rest
            yield _rows(b[rest], k[rest], s[rest], pairs)


def _within(w: np.ndarray, n: np.ndarray, x: int, other: np.ndarray, up: int, down: int) -> Iterator[np.ndarray]:
    """Of the texts `other`, few at a time, those that by their cells can be up / down alike to x."""
    for a in range(0, len(other), 4096):
        o = other[a : a + 4096]
        both = n[o] + n[x]
        yield o[(both - apart(w[o], w[x])) * (up + down) >= both * 2 * up]


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, text -> k, compressed text."""
    for batch in batches:
        z = [zlib.compress(t.encode("utf-8", "surrogatepass"), 3) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["k", "z"])


def _alike(pairs: DataFrame, kinds: DataFrame, own: DataFrame, repeated: bool, size: int, similarity: float, bounded: bool = False) -> DataFrame:
    """The distinct pairs (k, o) whose sets of shingles have that Jaccard similarity, as links (a, b).

    Cells bound what two sets can have in common, so that the pairs that cannot reach it go without
    their texts (bounded: they are gone already); the sets of the others are compared. No pair is lost.
    """
    up, down = _bounds(similarity)

    @F.arrow_udf("long")
    def differ(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(apart(*(np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), CELLS) for v in (x, y))))

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        found = lru_cache(64)(lambda z: sets([zlib.decompress(z).decode("utf-8", "surrogatepass")], size)[0])
        out = []
        for v, w in zip(x.to_pylist(), y.to_pylist()):
            v, w = found(v), found(w)
            out.append(len(np.intersect1d(v, w, True)) * (up + down) >= up * (len(v) + len(w)))
        return pa.array(out, pa.bool_())

    def beside(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        """pairs with these columns of both; texts that a great many are compared with go out by broadcast."""
        own, total = pairs, pairs.count()
        for key, i in (("k", "1"), ("o", "2")):
            pairs = joined(pairs, of.select(F.col("k").alias(key), *(F.col(c).alias(c + i) for c in columns)), key, own.groupBy(key).agg(F.count("*").alias("n")), total)
        return pairs

    both = F.col("n1") + F.col("n2")
    can = (both - differ("w1", "w2")) * (up + down) >= both * 2 * up
    some = saved(pairs.select("k", "o").distinct(), "pairs")
    if not bounded:
        some = saved(beside(some, kinds, "n", "w").where(can).select("k", "o"), "candidates")
    needed = saved(kinds.join(some.select("k").union(some.select("o")).distinct(), "k", "left_semi").select("k", "_key", "_t"), "needed")  # its size is known, so a few needed don't shuffle all texts
    texts = own.join(needed, ["_key", "_t"]).select("k", "_text").mapInArrow(_compressed, "k long, z binary")
    texts = saved(texts.dropDuplicates(["k"]) if repeated else texts, "texts")
    return beside(some, texts, "z").where(near("z1", "z2")).select(F.col("k").alias("a"), F.col("o").alias("b"))


def similar(own: DataFrame, kinds: DataFrame, linked: DataFrame, repeated: bool = True, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that, with those of linked, join all texts whose Jaccard similarity reaches `similarity`.

    own: (_key, _t, _text), kinds: (k, _key, _t, n, w), one row a set of shingles: its name, a text that
    has it, its number of shingles and its cells; repeated: whether own repeats a (_key, _t). Two such sets have a shingle in common within the first n - ceil(similarity n) + 1 of each in any one order
    (prefix filtering), and by its places can still be similar. So texts meet in buckets by the shingles
    of their prefixes, the rarest ones, and the sets decide. No pair is left out by chance; in a large
    bucket only pairs that are in one group already are left out.
    """
    (up, down), spark = _bounds(similarity), own.sparkSession
    sent = spark.sparkContext.broadcast(_order(own, size, similarity))
    prefixes = saved(own.select("_text").mapInArrow(lambda x: _prefixes(x, sent.value, size, similarity), "b long, k long, s long, known boolean"), "prefixes")
    met = saved(prefixes.where("not known").drop("known").repartition("b").sortWithinPartitions("b", "k").mapInArrow(lambda x: _met(x, similarity), MET), "met")
    large = saved(met.where("o is null").select("b", "k", "s").union(prefixes.where("known").select("b", "k", "s").dropDuplicates(["b", "k"])), "large")
    forget(prefixes)

    # Large buckets: every text beside the one with the fewest rarer shingles, from which copies with some words changed were
    # likely made, which for copies of one text is all there is to do.
    n, place = (lambda s: F.shiftright(s, 31)), (lambda s: F.col(s).bitwiseAND((1 << 31) - 1))
    first = saved(large.groupBy("b").agg(F.min(F.struct((place("s") / n("s")).alias("rarer"), "k", "s")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    led = saved(joined(large, first.drop("n"), "b", first, large.count()).where(F.col("k") != F.col("first.k")), "led")
    forget(large)
    most = F.least(n("s") - place("s"), n("first.s") - place("first.s"))
    can = most * (up + down) >= up * (n("s") + n("first.s"))
    pairs = met.where("o is not null").select("k", "o").union(led.where(can).select(F.least("k", "first.k").alias("k"), F.greatest("k", "first.k").alias("o")))

    found = linked.unionByName(saved(_alike(pairs, kinds, own, repeated, size, similarity), "alike"))
    left, take, roots = led.select("b", "k", "s"), GROW, None
    while not left.isEmpty():
        if roots is None:
            roots = saved(components(found), "roots")
        rooted = saved(left.join(roots, left.k == roots.node, "left").select("b", "k", "s", F.coalesce("root", "k").alias("r")), "rooted")
        open_ = rooted.groupBy("b").agg(F.min("r").alias("x"), F.max("r").alias("y"), F.count("*").alias("n")).where("x <> y").select("b", "n")
        rest = joined(rooted, open_.select("b"), "b", open_, rooted.count())
        rest = rest.join(kinds.select("k", "w"), "k").select("b", "k", "s", "r", "w")  # a row of a bucket, not a pair, takes its cells along
        asked = saved(rest.repartition("b").sortWithinPartitions("b").mapInArrow(lambda x, take=take: _ask(x, take, similarity), MET), "asked")
        forget(rooted)
        new = saved(_alike(asked.where("o is not null"), kinds, own, repeated, size, similarity, bounded=True), "alike")
        left, take = asked.where("o is null").select("b", "k", "s"), take * GROW
        if not new.isEmpty():
            found, roots = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(new), None
    return found


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, the one of least key, with the columns of docs; of equal rows, one.

    Near copies are texts whose distinct shingles of `size` words have a Jaccard similarity of at least
    `similarity`, or whose fingerprints link as in near_duplicates. Keys are integers; rows with a null key
    stay. Rows that repeat a key with another text are documents of their own.
    """
    ship(docs.sparkSession)
    words = F.coalesce(F.col(text), F.lit(""))
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.xxhash64(words).alias("_t"), words.alias("_text"))
    named = saved(own.select("_key", "_t", _both(size).alias("p")).select("_key", "_t", F.col("p.f").alias("_f"), "p.k", "p.n", "p.w"), "keys")
    kinds = saved(named.groupBy("k").agg(F.min(F.struct("_key", "_t", "n", "w")).alias("l")).select("k", "l.*"), "kinds")
    repeated = not named.groupBy("_key", "_t").count().where("count > 1").isEmpty()
    linked = grouped(named.select(F.col("k").alias("_key"), "_f").distinct()).where("_key <> _component").select(F.col("_key").alias("a"), F.col("_component").alias("b"))
    roots = components(similar(own, kinds, saved(linked, "linked"), repeated, size, similarity))
    rooted = kinds.join(roots, kinds.k == roots.node, "left").select(F.coalesce("root", "k").alias("r"), F.struct("_key", "_t").alias("l"))
    stay = rooted.groupBy("r").agg(F.min("l").alias("l")).select("l._key", "l._t")
    mine = packed(docs.where(F.col(key).isNotNull()), _key=F.col(key).cast("long"), _t=F.xxhash64(words))
    kept = unpacked(mine.join(stay, ["_key", "_t"], "left_semi").dropDuplicates(["_key", "_t"]), docs)
    return kept.unionByName(docs.where(F.col(key).isNull()))
