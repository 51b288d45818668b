"""Removal of byte strings that occur earlier, by bucket-pointer refinement.

Sorting all suffixes to depth LENGTH would show which LENGTH-byte strings occur before. As in
bucket-pointer refinement, suffixes are first put in buckets by their first Q bytes, and buckets are
refined by the bucket identifiers found at later offsets: identifiers of depth Q give those of depth
2 Q, and these those of 4 Q = LENGTH. Only what is still in doubt is refined further:

1. Of every LENGTH-byte window, the Q-gram of least identifier stands for it; windows in a row that
   choose the same Q-gram make a run. Equal windows choose alike, so a run's bucket is its Q-gram, and
   about one byte in forty has to be dealt out. Buckets are refined by the depth-LENGTH identifiers at
   the run's first and last window, which together hold all its bytes. Runs that repeat a whole earlier
   run are done, and so are runs alone in their bucket.
2. Where one bucket holds different runs (at the ends of copied passages, about edits), the bytes of one
   of each meet, and their windows are put in buckets of depth LENGTH one by one.

Each task first deals with what repeats within its own batch, so that a passage in a third of all
documents sends a row a batch, not a row a copy; and a Q-gram with very many different surroundings
(a line that a third of all documents hold) is dealt out by these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import mix, saved, ship

Q, LENGTH = 25, 100
#: Bytes handled at once; longer texts go in parts that overlap by LENGTH - 1.
PART = 1 << 20
_BITS = np.uint64(21)
_PLACE = np.uint64((1 << 21) - 1)
_K = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
RUNS = "g long, c long, doc long, at long"
CONTEXTS = "g long, doc long, at long, bytes binary"
#: Buckets of more than MANY different runs are refined window by window, dealt out evenly; HOT marks their runs.
MANY, HOT = 500, 1 << 62
#: Buckets with as many different runs in one batch are dealt out by run, not by bucket; KNOWN marks these, and
#: TOLD the rows by which the bucket learns of it.
MANY_HERE, KNOWN, TOLD = 100, 1 << 61, -(1 << 63)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, and the powers of an odd base and of its inverse."""
    base = 0x9E3779B97F4A7C15
    n = 2 * PART
    power = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
    return mix(np.arange(1, 257, dtype=np.uint64)), power(base), power(pow(base, -1, 1 << 64))


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of depth Q at each byte that has Q bytes from it on."""
    value, power, inverse = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=total[1:])
    n = max(0, len(data) - Q + 1)
    return mix((total[Q : Q + n] - total[:n]) * inverse[:n])


def deeper(grams_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket identifiers of depth LENGTH, from those of depth Q: twice, an identifier and the one at the later offset make a new one."""
    half = lambda p: mix(grams_[p] * _K[0] + grams_[p + Q])
    return mix(half(at) * _K[1] + half(at + 2 * Q))


def runs(data: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """First and last window, place of the Q-gram, bucket and refined bucket of each run within the bounds."""
    ids = grams(data)
    key = (ids & ~_PLACE) | np.arange(len(ids), dtype=np.uint64)
    width, want = 1, LENGTH - Q + 1
    while 2 * width <= want:
        key, width = np.minimum(key[:-width], key[width:]), 2 * width
    if width < want:
        key = np.minimum(key[: len(key) - (want - width)], key[want - width :])
    edge = np.zeros(len(data) + 1, np.int8)
    for a, b in bounds:
        if b - a >= LENGTH:
            edge[a] += 1
            edge[b - LENGTH + 1] -= 1
    p = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    place = (key[p] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(p) else np.zeros(0, np.int64)
    first, last, place = p[new], p[np.append(new[1:], len(p)) - 1] if len(p) else p, place[new]
    context = mix(deeper(ids, first) * _K[2] + deeper(ids, last) * _K[3] + ((place - first) << 8 | (place - last)).astype(np.uint64))
    return first, last, place, ids[place], context


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and the bounds of each; null: empty."""
    flat = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _parts(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Lists of (row, offset in the row's text, from, to), of up to PART bytes each."""
    out, size = [], 0
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        at = a
        while b - at >= LENGTH:
            end = min(b, at + PART)
            if out and size + end - at > PART:
                yield out
                out, size = [], 0
            out.append((row, at - a, at, end))
            size += end - at
            at = end - LENGTH + 1
            if end == b:
                break
    if out:
        yield out


def _gathered(data: np.ndarray, part: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The bytes of a part in one array, the bounds there, and of each piece its row and what to add to a place to get that in the text."""
    sizes = np.array([b - a for _, _, a, b in part])
    ends = np.cumsum(sizes)
    bounds = list(zip((ends - sizes).tolist(), ends.tolist()))
    return np.concatenate([data[a:b] for _, _, a, b in part]), bounds, np.array([r for r, *_ in part]), np.array([x for _, x, _, _ in part]) - (ends - sizes)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that overlap or touch, made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64) << 33
    reach = np.maximum.accumulate(rank + end)
    new = np.flatnonzero(np.concatenate([[True], (rank + start)[1:] > reach[:-1]]))
    return doc[new], start[new], (reach - rank)[np.append(new[1:], len(doc)) - 1]


def _dealt(g: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, spread: bool = False) -> pa.RecordBatch:
    """Rows to deal out: the first of each (g, c) here, and, as intervals, what repeats it.

    An interval is a negative `at`, under a bucket of its own. With spread, rows of a bucket that holds
    MANY_HERE or more different runs go by run; two rows tell the bucket that it holds different runs.
    """
    order = np.lexsort((at, doc, c, g))
    g, c, doc, at, start, end = (x[order] for x in (g, c, doc, at, start, end))
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (doc != doc[head]) | (at != at[head])
    d, s, e = merged(doc[again], start[again], end[again])
    own = mix(d.astype(np.uint64) * _K[4] + s.astype(np.uint64))
    g, c, doc, at = g[first], c[first], doc[first], at[first]
    more_g = more_c = np.zeros(0, np.int64)
    if spread:
        buckets, of, kinds = np.unique(g, return_inverse=True, return_counts=True)
        known = kinds[of] >= MANY_HERE
        g, at = np.where(known, mix(g ^ c * _K[6]), g), np.where(known, at | KNOWN, at)
        more_g = np.repeat(buckets[kinds >= MANY_HERE].view(np.int64), 2)
        more_c = np.tile(np.array([1, 2]), len(more_g) // 2)
    none = np.zeros(len(more_g), np.int64)
    whole = lambda a, b, more: pa.array(np.concatenate([a.view(np.int64), b, more]))
    return pa.RecordBatch.from_arrays([whole(g, own.view(np.int64), more_g), whole(c, np.zeros(len(d), np.int64), more_c), whole(doc, d, none), whole(at, -(s << 31 | e) - 1, none + TOLD)], names=["g", "c", "doc", "at"])


def _joined(columns: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*columns)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text -> RUNS; `at` holds place << 14 | place - first << 7 | place - last."""
    for batch in batches:
        docs, (data, offsets), found = batch.column(0).to_numpy(zero_copy_only=False), _bytes(batch.column(1)), []
        for part in _parts(offsets):
            flat, bounds, row, add = _gathered(data, part)
            first, last, place, g, c = runs(flat, bounds)
            piece = np.searchsorted([a for a, _ in bounds], first, "right") - 1
            found.append((g, c, docs[row[piece]], place + add[piece] << 14 | place - first << 7 | place - last, first + add[piece], last + add[piece] + LENGTH))
        if found:
            yield _dealt(*_joined(found), spread=True)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, runs in doubt -> CONTEXTS: of each run the bytes of its windows, from the first window's place on.

    Runs of buckets with very many different runs (marked HOT) give each window under a bucket of its
    own, the first of equal ones in the batch, and intervals for the others.
    """
    for batch in batches:
        docs, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), _bytes(batch.column(1))
        doubt = [np.sort(np.array(x, np.int64)) for x in batch.column(2).to_pylist()]
        rows, hot = ([], [], [], []), []
        for part in _parts(offsets):
            flat, bounds, row, add = _gathered(data, part)
            ids, raw = grams(flat), flat.tobytes()
            for (a, b), r, plus in zip(bounds, row, add):
                at = doubt[r]
                place, low, high = (at & HOT - 1) >> 14, ((at & HOT - 1) >> 14) - (at >> 7 & 127), ((at & HOT - 1) >> 14) - (at & 127)
                here = (low >= a + plus) & (high + LENGTH <= b + plus)
                many = here & (at >= HOT)
                if many.any():
                    n = (high - low + 1)[many]
                    p = np.repeat(low[many] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hot.append((mix(ids[np.repeat(place[many], n) - plus] + deeper(ids, p - plus) * _K[5]), deeper(ids, p - plus), np.full(len(p), docs[r], np.int64), p, p, p + LENGTH))
                few = here & (at < HOT)
                if few.any():
                    for out, x in zip(rows, (ids[place[few] - plus].view(np.int64).tolist(), [docs[r]] * int(few.sum()), low[few].tolist(), [raw[i:j] for i, j in zip((low[few] - plus).tolist(), (high[few] - plus + LENGTH).tolist())])):
                        out.extend(x)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], names=["g", "doc", "at", "bytes"])
        if hot:
            dealt = _dealt(*_joined(hot))
            yield pa.RecordBatch.from_arrays([dealt.column(0), dealt.column(2), dealt.column(3), pa.array([b""] * dealt.num_rows, pa.binary())], names=["g", "doc", "at", "bytes"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CONTEXTS, sorted by bucket -> doc, iv: which windows repeat an earlier one of their bucket."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        g = table.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
        rest = table.slice(cut)
        if cut:
            yield from _settle(table.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from _settle(rest)


def _settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
    g, doc, at = (table.column(k).to_numpy() for k in range(3))
    flat = table.column(3).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    data, offsets = _bytes(flat)
    size = np.diff(offsets)
    docs, starts, ends = [doc[at < 0]], [-(at[at < 0] + 1) >> 31], [-(at[at < 0] + 1) & (1 << 31) - 1]
    windows = np.where(at < 0, 0, np.maximum(1, size - LENGTH + 1))
    row = np.repeat(np.arange(len(g)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    ids, deep = grams(data), np.zeros(len(row), np.uint64)
    long_ = size[row] >= LENGTH
    deep[long_] = deeper(ids, (offsets[:-1] - offsets[0])[row[long_]] + nth[long_]) if long_.any() else 0
    bucket, owner, place = g[row], doc[row], at[row] + nth
    order = np.lexsort((place, owner, deep, bucket))
    bucket, owner, place, deep = bucket[order], owner[order], place[order], deep[order]
    first = np.ones(len(order), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (deep[1:] != deep[:-1])
    again = ~first
    d, s, e = merged(np.concatenate([*docs, owner[again]]), np.concatenate([*starts, place[again]]), np.concatenate([*ends, place[again] + LENGTH]))
    if len(d):
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s << 31 | e)], names=["doc", "iv"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, two lists of intervals -> doc, n_bytes, starts, ends, kept."""
    for batch in batches:
        data, offsets = _bytes(batch.column(1))
        starts, ends, kept = [], [], []
        for row, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            own, iv = data[offsets[row] : offsets[row + 1]], np.array((x or []) + (y or []), np.int64)
            _, s, e = merged(np.zeros(len(iv), np.int64), iv >> 31, iv & (1 << 31) - 1)
            if len(s):
                gone = np.zeros(len(own) + 1, np.int8)
                gone[s] += 1
                gone[e] -= 1
                own = own[np.cumsum(gone[:-1]) == 0]
            starts.append(s.tolist())
            ends.append(e.tolist())
            kept.append(own.tobytes())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "starts", "ends", "kept"])


def _repeated(dealt: DataFrame) -> DataFrame:
    """dealt (RUNS), dealt out by bucket, with `again`: not the first of its refined bucket, `kinds`: how many that bucket was refined into, and `told`: whether runs of it went by themselves."""
    again = F.row_number().over(Window.partitionBy("g", "c").orderBy("doc", "at")) > 1
    of = Window.partitionBy("g")
    return dealt.withColumn("again", again).withColumns({"kinds": F.count_if(~F.col("again")).over(of), "told": F.max(F.col("at") == TOLD).over(of)})


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, starts, ends, kept) of each row: the removed intervals of the text's UTF-8 bytes, and the bytes that stay.

    A byte goes if it lies in a LENGTH-byte string that also starts earlier, in a text of smaller key or
    in the same text. A null text is an empty one; texts of under LENGTH bytes stay whole. Keys are
    integers; rows that repeat a key, and rows with a null key (last), are put in the order of their
    texts, and identical rows then count as different documents.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    ids = own.groupBy("doc").count()
    named = None
    if not ids.where("count > 1 or doc is null").isEmpty():
        named = saved(own.orderBy(F.asc_nulls_last("doc"), "text").withColumn("n", F.monotonically_increasing_id()), "numbered")
        own = named.select(F.col("n").alias("doc"), "text")

    # A run that went by itself may be the first there and yet repeat one that went by its bucket: both are
    # in doubt, as the bucket knows of several kinds, and both are HOT, so that their windows meet.
    dealt = _repeated(own.mapInArrow(_runs, RUNS).repartition("g")).where(F.col("at") != TOLD)
    known = F.col("at").bitwiseAND(F.lit(KNOWN)) != 0
    run = F.col("at").bitwiseAND(F.lit(KNOWN - 1))
    place, low, high = F.shiftright(run, 14), F.shiftright(run, 7).bitwiseAND(127), run.bitwiseAND(127)
    interval = F.when(F.col("at") < 0, -(F.col("at") + 1)).when(F.col("again"), F.shiftleft(place - low, 31).bitwiseOR(place - high + LENGTH))
    doubt = F.when((F.col("at") >= 0) & ~F.col("again") & (known | (F.col("kinds") > 1)), run.bitwiseOR(F.when(known | F.col("told") | (F.col("kinds") > MANY), HOT).otherwise(0)))
    told = dealt.select("doc", interval.alias("iv"), doubt.alias("doubt")).where("iv is not null or doubt is not null")
    first = saved(told.groupBy("doc").agg(F.collect_list("iv").alias("iv"), F.collect_list("doubt").alias("doubt")), "runs")

    own = own.where("doc is not null")  # as both joins want it, so that one exchange serves both
    open_ = first.where(F.size("doubt") > 0).select("doc", "doubt")
    contexts = own.join(open_, "doc").select("doc", "text", "doubt").mapInArrow(_contexts, CONTEXTS)
    second = contexts.repartition("g").sortWithinPartitions("g").mapInArrow(_settled, "doc long, iv long").groupBy("doc").agg(F.collect_list("iv").alias("more"))

    both = own.join(first.select("doc", "iv"), "doc", "left").join(second, "doc", "left").select("doc", "text", "iv", "more")
    out = both.mapInArrow(_cut, "doc long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    if named is not None:
        out = out.withColumnRenamed("doc", "n").join(named.select("n", "doc"), "n").drop("n")
    return out.select(F.col("doc").alias(key), "n_bytes", "starts", "ends", "kept")
