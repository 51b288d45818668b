"""Benchmark decontamination by spaced-seed hashing.

A fixed mask looks at some token positions of a window and ignores the others, so a substituted token
at an ignored place doesn't hide a copy. Hashes under each mask of all windows of the benchmark items
are joined with those of the texts; around each hit the two token sequences are laid side by side, and
the stretch with most matches, substitutions allowed, is measured.

Neither the benchmark nor the texts are held anywhere as a whole. What is sent to all executors is a
Bloom filter of the items' seeds, of at most MOST_BITS bits: windows that it lets pass are joined with
the seeds by a shuffle, and only texts with such windows are looked at again. A wider benchmark makes
the filter let more pass, which costs time but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import FACTORS, mix, packed, saved, ship, slices, tokens, unpacked

#: 1: compared, 0: ignored. Items of under SHORT tokens have seeds of five tokens, with and without a gap: of two
#: neighbouring runs of copied tokens about one substitution, together five or more, one seed at least lies in them.
MASKS = ("1101101111", "1111010111", "11101001011011", "110010111101", "10110110010111")
SHORT_MASKS = ("11111", "101111", "110111", "111011", "111101")
SHORT = 30
LEAST_TOKENS, OVERLAP, SIMILARITY = 5, 0.5, 0.8
#: The filter has BITS_EACH bits a seed, MOST_BITS (32 MB) in all, of which each seed sets PROBES.
BITS_EACH, MOST_BITS, PROBES = 32, 1 << 28, 6
#: Copies of each item and seed, so that what a great many texts hold is met in as many tasks.
SALTS = 16


def seeds(values: np.ndarray, mask: str) -> np.ndarray:
    """The hash, under the mask, of each window; masks differ in what they hash to."""
    n = len(values) - len(mask) + 1
    out = np.full(max(0, n), int(mask, 2), np.uint64)
    for j, c in enumerate(mask):
        if c == "1" and n > 0:
            out += values[j : j + n] * FACTORS[j]
    return mix(out)


def masks(size: int) -> tuple[str, ...]:
    return SHORT_MASKS if size < SHORT else MASKS


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each seed in a filter of 2 ** bits bits."""
    return (h + np.uint64(k) * (mix(h ^ FACTORS[7]) | np.uint64(1)) if k else h) >> np.uint64(64 - bits)


def passing(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Which seeds the filter lets pass: all that are in it, and few others."""
    left = np.arange(len(h))
    for k in range(PROBES):
        at = _probe(h[left], k, bits)
        left = left[(words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return left


def matched(same: np.ndarray) -> int:
    """The most matches in a stretch of which SIMILARITY match.

    Scores of (1 - SIMILARITY) a match and -SIMILARITY a substitution sum to 0 or more in such a
    stretch; to each end belongs the earliest beginning that allows it.
    """
    up, down = Fraction(str(SIMILARITY)).as_integer_ratio()
    total = np.concatenate([[0], np.cumsum(np.where(same, down - up, -up))])
    count = np.concatenate([[0], np.cumsum(same)])
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total, "left")  # the first place whose sum is no greater
    return int((count - count[first]).max())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, text -> i, token hashes; items of under LEAST_TOKENS tokens are left out."""
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values, bounds = tokens(texts)
        some = [k for k in range(len(texts)) if bounds[k + 1] - bounds[k] >= LEAST_TOKENS]
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.int64()), pa.array([values[bounds[k] : bounds[k + 1]].view(np.int64) for k in some], pa.list_(pa.int64()))], names=["i", "item"])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, token hashes -> h, i, off: the item's seeds."""
    for batch in batches:
        h, i, off = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for name, values in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.array(values.values, np.int64).view(np.uint64)
            for m in masks(len(values)):
                h.append(seeds(values, m))
                i.append(np.full(len(h[-1]), name))
                off.append(np.arange(len(h[-1]), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(i)), pa.array(np.concatenate(off))], names=["h", "i", "off"])


def _filter(found: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """The Bloom filter of the seeds, as 64-bit words, and the power of two of its bits."""
    bits = max(10, min(BITS_EACH * count, MOST_BITS).bit_length())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([_probe(batch.column(0).to_numpy().view(np.uint64), k, bits) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    rows = found.select("h").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words, bits


def _hits(batches: Iterator[pa.RecordBatch], words: np.ndarray, bits: int, used: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """t, u, text -> t, u, the seeds that pass, their places, and the text's token hashes; a row for each different text of a batch that has any."""
    names = ["t", "u", "h", "at", "tokens"]
    for batch in batches:
        t, u, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        fresh = list({k: i for i, k in enumerate(zip(t, u))}.values())
        for a, b in slices([len(texts[i]) for i in fresh], 200_000):
            mine = fresh[a:b]
            values, bounds = tokens([texts[i] for i in mine])
            after = np.repeat(bounds[1:], np.diff(bounds))
            h, at = [], []
            for m in used:
                own = seeds(values, m)
                left = passing(own, words, bits)
                left = left[left + len(m) <= after[left]]
                h.append(own[left])
                at.append(left)
            h, at = np.concatenate(h), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            cuts = np.searchsorted(at, bounds)
            some = np.flatnonzero(np.diff(cuts))
            lists = lambda v, kind: pa.array(v, pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t[mine[k]] for k in some], pa.int64()),
                    pa.array([u[mine[k]] for k in some], pa.int64()),
                    lists([h[cuts[k] : cuts[k + 1]].view(np.int64) for k in some], pa.int64()),
                    lists([(at[cuts[k] : cuts[k + 1]] - bounds[k]).astype(np.int32) for k in some], pa.int32()),
                    lists([values[bounds[k] : bounds[k + 1]].view(np.int64) for k in some], pa.int64()),
                ],
                names=names,
            )


def _named(text: str) -> dict[str, F.Column]:
    """What stands for a text: 128 bits."""
    own = F.coalesce(F.col(text), F.lit(""))
    return {"t": F.xxhash64(own), "u": F.xxhash64(F.lit(1), own)}


def _found(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(t, u, found) of each text of docs (text) in which an item of items (k, text) leaks: an array of (item, matched, tokens), by item. None without items to search for."""
    ship(docs.sparkSession)

    @F.arrow_udf("int")
    def most(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([matched(np.array(x.values) == np.array(y.values)) for x, y in zip(a, b)], pa.int32())

    named = items.where("k is not null and text is not null").select("k", F.xxhash64("text").alias("i"), "text")
    known = saved(named.dropDuplicates(["i"]).select("i", "text").mapInArrow(_items, "i long, item array<long>"), "items")
    mine = saved(known.mapInArrow(_seeds, "h long, i long, off int"), "seeds")
    count, short, long = known.join(mine.groupBy("i").count(), "i").agg(F.sum("count"), F.count_if(F.size("item") < SHORT), F.count_if(F.size("item") >= SHORT)).first()
    if not count:
        return None
    used = (SHORT_MASKS if short else ()) + (MASKS if long else ())
    sent = docs.sparkSession.sparkContext.broadcast(_filter(mine, count))

    own = docs.where("text is not null").select(*(c.alias(n) for n, c in _named("text").items()), "text")
    hits = saved(own.mapInArrow(lambda x: _hits(x, *sent.value, used), "t long, u long, h array<long>, at array<int>, tokens array<long>"), "hits")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod("t", F.lit(SALTS)).cast("int").alias("salt")
    each = hits.select("t", "u", salt, F.inline(F.arrays_zip("h", "at")))
    pairs = each.join(salted(mine).hint("merge"), ["h", "salt"]).select("t", "u", "salt", "i", (F.col("at") - F.col("off")).alias("at")).distinct()
    texts = hits.dropDuplicates(["t", "u"]).select("t", "u", "tokens")
    sides = pairs.join(salted(known), ["i", "salt"]).join(texts.hint("merge"), ["t", "u"])  # texts are wide: never by a broadcast
    skip, from_ = F.greatest(F.lit(0), -F.col("at")), F.greatest(F.lit(0), "at")
    n = F.least(F.size("item") - skip, F.size("tokens") - from_)
    beside = sides.select("t", "u", "i", F.size("item").alias("n"), F.slice("item", skip + 1, n).alias("a"), F.slice("tokens", from_ + 1, n).alias("b"))
    best = beside.select("t", "u", "i", "n", most("a", "b").alias("m")).where((F.col("m") >= LEAST_TOKENS) & (F.col("m") >= OVERLAP * F.col("n"))).groupBy("t", "u", "i", "n").agg(F.max("m").alias("m"))
    rows = best.join(named.select(F.col("k").alias("item"), "i"), "i")
    return saved(rows.groupBy("t", "u").agg(F.array_sort(F.collect_list(F.struct("item", F.col("m").alias("matched"), F.col("n").alias("tokens")))).alias("found")), "leaks")


def _asked(docs: DataFrame, items: DataFrame, text: str, item_text: str, item_key: str) -> tuple[DataFrame, DataFrame | None]:
    found = _found(docs.select(F.col(text).alias("text")), items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("text")))
    return packed(docs, **{f"_{n}": c for n, c in _named(text).items()}), found if found is None else found.select(F.col("t").alias("_t"), F.col("u").alias("_u"), "found")


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """docs with leaked_items, leaked_matched, leaked_tokens: parallel arrays of item ids, matched tokens and the items' tokens.

    An item leaks if some stretch laid beside it, of which SIMILARITY match, holds OVERLAP of its tokens
    and LEAST_TOKENS at least. Items of fewer tokens, and items with a null id or text, are not searched
    for. Null and empty texts, and an empty benchmark, give empty arrays. Repeated items count each; the
    items of a text are in ascending order. Repeated rows of docs stay, each with its arrays. Other
    columns stay; columns of these names are replaced.
    """
    work, found = _asked(docs, items, text, item_text, item_key)
    kind = "array<struct<item:long,matched:int,tokens:int>>"
    work = work.join(found, ["_t", "_u"], "left") if found is not None else work.withColumn("found", F.lit(None).cast(kind))
    work = work.withColumn("_found", F.coalesce("found", F.array().cast(kind)))
    return unpacked(work, docs, leaked_items="_found.item", leaked_matched="_found.matched", leaked_tokens="_found.tokens")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of docs in which no item leaks, in the sense of leaks(); rows without text, and repeated rows, stay."""
    work, found = _asked(docs, items, text, item_text, item_key)
    return unpacked(work if found is None else work.join(found, ["_t", "_u"], "left_anti"), docs)
