"""I-Match fingerprints: hashes of a text's distinct mid-frequency terms, over several random lexicon subsets.

The lexicon is the terms whose inverse document frequency lies in a band. The band is set on the share
of documents a term is in, so however many documents there are, the lexicon holds at most (mean number
of distinct terms a document) / LEAST_SHARE terms; that is what bounds what is sent to the executors.
Each subset keeps a random part of the lexicon, by a hash of the term: of some many terms, so that small
texts have terms in them, of others few, so that long texts that differ in part still agree in some.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import FACTORS, mix, packed, saved, ship, unpacked

#: A term is kept if its share of documents lies between these: an idf of ln 5 to ln 500.
LEAST_SHARE, MOST_SHARE = 1 / 500, 1 / 5
#: Subsets, by the share of the lexicon each keeps; a part of a fingerprint has DIGITS hex digits.
SHARES = (1 / 8,) * 12 + (1 / 32,) * 24 + (1 / 128,) * 24 + (1 / 512,) * 16
DIGITS = 4
EMPTY = "0" * DIGITS
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Lexicon:
    """Terms with their hashes and the subsets each is in."""

    def __init__(self, words: list[str], seed: int = 0):
        self.at = {w: i for i, w in enumerate(sorted(words))}
        self.known = frozenset(words)
        self.hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.at], np.uint64)
        self.subset = np.stack([(mix(self.hash ^ np.uint64(7919 * k + 1)) >> np.uint64(11)).astype(float) * 2.0**-53 < s for k, s in enumerate(SHARES)], 1) if words else np.zeros((0, len(SHARES)), bool)

    def fingerprint(self, text: str) -> str:
        """Of all kept terms 16 hex digits, then EMPTY or the hash of each subset's. Without any kept term, that of the text leads."""
        found = terms(text) & self.known
        if not found:
            return f"{xxhash.xxh64_intdigest(text.encode('utf-8', 'surrogatepass')):016x}" + EMPTY * len(SHARES)
        at = np.sort(np.fromiter(map(self.at.__getitem__, found), np.int64, len(found)))
        hashes, member = self.hash[at], self.subset[at]
        # The terms of each subset in their order: a term counts by its place there.
        places = np.cumsum(member, 0, dtype=np.int64)
        sums = mix((hashes[:, None] * FACTORS[np.minimum(places, len(FACTORS) - 1)] * member).sum(0, dtype=np.uint64))
        parts = np.where(places[-1] > 0, sums % np.uint64(65_535) + np.uint64(1), np.uint64(0)).astype(">u2").tobytes().hex()
        return f"{xxhash.xxh64_intdigest(hashes.tobytes()):016x}{parts}"


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the share of equal parts among those that aren't empty in both."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[16:]), ">u2") for f in (a, b))
    some = (x > 0) | (y > 0)
    return float((x == y)[some].mean()) if some.any() else 0.0


def lexicon(docs: DataFrame, text: str = "text") -> tuple[str, ...]:
    """The terms of the band, from the frequencies in all documents. Null texts count as documents without terms."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(terms(t))
            seen[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    counts = docs.select(F.col(text).alias("t")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = docs.count()
    # A term of one document only says nothing of likeness, however few documents there are.
    band = counts.where((F.col("term") != "") & (F.col("n") >= max(2.0, LEAST_SHARE * total)) & (F.col("n") <= max(2.0, MOST_SHARE * total)))
    return tuple(sorted(r.term for r in band.select("term").collect()))


@lru_cache(2)
def _built(words: tuple[str, ...]) -> Lexicon:
    return Lexicon(list(words))


def fingerprints(docs: DataFrame, words: tuple[str, ...], text: str = "text") -> DataFrame:
    """docs with fingerprint. A null text is an empty one. Other columns stay; a column of this name is replaced."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        known = _built(sent.value)
        return pd.Series([known.fingerprint(t or "") for t in texts], dtype=object)

    return unpacked(packed(docs, _text=F.col(text)).withColumn("_f", of("_text")), docs, fingerprint="_f")


_ROWS = "pid int, extra int, none boolean, id long, tie long, n_chars long, copies long, fingerprint string, body binary"
_OUT = "none boolean, id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
#: Rows that are looked at, for each range, to place the ranges' bounds; what they are changes no result.
LOOKED_AT, TIMES = 200, 2
#: Equal rows are told of as one for so many.
TOLD = 10_000


def _bounds(own: DataFrame, ranges: int) -> list[tuple]:
    """Where ranges of the order (null keys last, greatest key first, tie) begin, of about equal numbers of rows, by a bounded sample."""
    rows = max(1, own.count())
    want = LOOKED_AT * ranges
    some = own.select("none", "id", "tie").where(F.pmod(F.xxhash64("none", "id", "tie", F.lit(7)), F.lit(1 << 20)) <= (1 << 20) * want // rows)
    keys = sorted((r.none, ~r.id, r.tie) for r in some.limit(4 * want).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def edited_neighbours(docs: DataFrame, words: tuple[str, ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text beside an edited one, whose last half is replaced by the next text's beginning.

    The next text is that of the next smaller key, after the least that of the greatest. Rows of equal
    keys follow each other in the order of a hash of their texts, null keys come last; equal rows follow
    each other; a null text is an empty one; a lone row is its own next. Gives key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Keys are dealt out in ranges. The first row of each range is sent to the range before as well, so
    neighbours meet without a sort of all rows in one place. Equal rows travel as one, and the rows of
    a key that repeats are dealt out too. Texts travel compressed, once.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    single = docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty()
    if single:
        own = own.select("none", "id", F.lit(0).cast("long").alias("tie"), "text", F.lit(1).cast("long").alias("copies"))
    else:
        own = saved(own.withColumn("tie", F.xxhash64("text")).groupBy("none", "id", "tie").agg(F.min("text").alias("text"), F.count("*").alias("copies")), "kinds")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _bounds(own, TIMES * partitions)

    def range_of(none: list, ids: list, ties: list) -> np.ndarray:
        return np.array([bisect_right(cuts, (a, ~b, c)) for a, b, c in zip(none, ids, ties)], np.int32)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            best: dict[int, tuple] = {}
            for pid, x in zip(range_of(*columns).tolist(), zip(*columns)):
                order = (x[0], ~x[1], x[2])
                best[pid] = min(order, best.get(pid, order))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.bool_()), pa.array([b[1] for b in best.values()], pa.int64()), pa.array([b[2] for b in best.values()], pa.int64())], names=["pid", "none", "id", "tie"])

    found = own.select("none", "id", "tie").mapInArrow(tops, "pid int, none boolean, id long, tie long").groupBy("pid").agg(F.min(F.struct("none", "id", "tie")).alias("m")).select("pid", "m.*")
    heads = sorted((r.pid, (r.none, r.id, r.tie)) for r in found.collect())
    before = {pid: heads[i - 1][0] for i, (pid, _) in enumerate(heads)}  # of the first range: the last
    head = dict(heads)
    sent = spark.sparkContext.broadcast(words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = _built(sent.value), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            none, ids, ties, texts, copies = (c.to_pylist() for c in batch.columns)
            pids = range_of(none, ids, ties).tolist()
            prints, bodies = [known.fingerprint(t) for t in texts], [packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
            again = [i for i, p in enumerate(pids) if head[p] == (none[i], ~ids[i], ties[i])]
            take = [*range(len(ids)), *again]
            to = pids + [before[pids[i]] for i in again]
            extra = [0] * len(ids) + [1] * len(again)
            columns = [to, extra, *([c[i] for i in take] for c in (none, ids, ties, [len(t) for t in texts], copies, prints, bodies))]
            kinds = (pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _ROWS.split(", ")])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpacker = _built(sent.value), zstandard.ZstdDecompressor()
        last = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                body = unpacker.decompress(row[8]).decode("utf-8", "surrogatepass")
                if last and last[0] == row[0] and last[1] == 0:
                    if last[6] > 1:
                        own = told(last, last[7], last[8], known)
                        out += [(*own, min(TOLD, last[6] - 1 - n)) for n in range(0, last[6] - 1, TOLD)]
                    out.append((*told(last, row[7], body, known), 1))
                last = (*row[:8], body)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=[f.split()[0] for f in _OUT.split(", ")])

    def told(row: tuple, next_print: str, next_text: str, known: Lexicon) -> tuple:
        body, half = row[8], row[5] // 2
        edited = body[: len(body) - half] + next_text[:half]
        other = row[7] if edited == body else known.fingerprint(edited)
        return row[2], row[3], row[5], sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), row[7], other, likeness(row[7], other), likeness(row[7], next_print)

    dealt = own.select("none", "id", "tie", "text", "copies").mapInArrow(send, _ROWS).repartitionById(len(cuts) + 1, "pid").sortWithinPartitions("pid", "extra", "none", F.desc("id"), "tie")
    out = dealt.mapInArrow(pair, _OUT)
    columns = [F.when(~F.col("none"), F.col("id")).alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if single:
        return out.select(*columns)
    return out.repartition(partitions).select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
