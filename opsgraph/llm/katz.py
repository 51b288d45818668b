"""A Katz backoff language model whose counts never leave their partitions, and the scores of texts under it.

Texts become blocks of about BLOCK code points: a dictionary of word hashes, and each token's place in
it. Orders follow one after another, all in the same way. A block asks the parts of an order's table for
each of its different n-grams once, with its own training count and the probability that the shorter
context gives; a part adds up what blocks ask into its n-grams' counts, which are its share of the
model, and replies to each block. From replies a block computes, token by token and recursively,

    p(w | context) = d(c) * c / total          where the n-gram occurred c > 0 times in training,
    p(w | context) = alpha * p(w | shorter)    where it didn't,

d being Good-Turing discounts from the counts of counts of all parts, and alpha what a context's seen
n-grams leave over what the shorter context gives their complement, so that each context's
probabilities sum to one. A part's totals hold all n-grams of its contexts; those of a context that
holds over one in HOT of all tokens are dealt out by their last word, and the parts' totals summed. The
empty context, whose n-grams are the words, is such a context, and what it backs off to is the class of
unknown words.

What is asked is dealt out in packed rows, at most one for a block and part; blocks are a bucketed
table, so that only what is asked and replied is shuffled. Words are told apart by 64 hash bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import code_points, mix, runs_hashed, saved, ship, slices
from opsgraph.plans.lineage import shared_dir

ORDER = 2
#: Counts up to CUT are discounted, as Katz has it.
CUT = 5
#: Code points of a block (a longer text is one alone), and of what is hashed at once; tokens for each part of a table.
BLOCK, AT_ONCE, TOKENS = 6_000_000, 1_000_000, 2_000_000
#: A context of more than one in HOT of all tokens is dealt out; there are at most HOT an order.
HOT = 1000
#: The hash that stands for the end of a text, and the identifiers of what is before its begin and of unknown words.
END, BEGIN, UNKNOWN = np.uint64(0), np.uint64(2**63), np.uint64(2**63 + 1)


def packed_array(x: np.ndarray) -> bytes:
    """Integers without sign, or doubles, byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(x)
    if x.dtype != np.float64:
        x = x.astype(np.min_scalar_type(x.max()) if len(x) else np.uint8)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return x.dtype.str.encode() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked_array(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:3].decode())
    planes = np.array(bytearray(zstandard.ZstdDecompressor().decompress(b[3:])), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, the first from zero; undone by cumsum."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, A-Z in lower case, none of them END; and the bounds (one more than texts)."""
    hashes, sizes = [], [np.zeros(1, np.int64)]
    for a, b in slices([len(t) for t in texts], AT_ONCE):
        points, at = code_points(texts[a:b])
        points = points + np.uint32(32) * ((points >= 65) & (points <= 90))
        found, bounds = runs_hashed(points, (points != 32) & ((points < 9) | (points > 13)), at)
        hashes.append(np.maximum(found, np.uint64(1)))
        sizes.append(np.diff(bounds))
    return np.concatenate(hashes), np.cumsum(np.concatenate(sizes))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(list(c), _TYPES[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


# Blocks.

_BLOCK = "block long, n_tokens long, n_train long, ids binary, nulls binary, sizes binary, train binary, words binary, tokens binary"


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, none, train = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for a, b in slices([len(t) + 1 for t in texts], size):
            hashes, at = word_hashes(texts[a:b])
            words, tokens = np.unique(np.insert(hashes, at[1:], END), return_inverse=True)  # each text's words, then its end
            row = block, len(tokens), int(train[a:b].sum()), ids[a:b].tobytes(), packed_array(none[a:b].astype(np.uint8)), packed_array(np.diff(at) + 1), packed_array(train[a:b].astype(np.uint8)), packed_array(rising(words)), packed_array(tokens)
            yield from _table([row], _BLOCK).to_batches()
            block += 1


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", train: Column | None = None) -> DataFrame:
    """Blocks of docs, as a bucketed table in the shared folder; only rows whose train is true are counted. Keys are integers or null."""
    spark = docs.sparkSession
    ship(spark)
    id_, trained = F.col(f"`{key}`").cast("long"), F.lit(True) if train is None else train
    own = docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"), F.col(f"`{text}`").alias("text"), F.coalesce(trained, F.lit(False)).alias("train"))
    name, size = f"blocks_{uuid.uuid4().hex}", BLOCK
    path = f"{shared_dir(spark)}/{name}"
    own.mapInArrow(lambda batches: _cut(batches, size), _BLOCK).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).saveAsTable(name)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(name)


# The model.


@dataclass(frozen=True)
class Order:
    """What every block knows of an order: the discounts of counts 1 .. CUT, and the totals of contexts that are dealt out."""

    discounts: tuple[float, ...]
    hot: dict[int, tuple[float, ...]]
    tokens: int  # n-grams counted
    distinct: int


@dataclass(frozen=True)
class Model:
    """The orders, from words on; their tables have a row for each part: contexts, how many n-grams each has, last words, counts and the contexts' totals."""

    parts: int
    begins: int = 0  # texts learned from
    hot_at: float = 0.0  # contexts that occur more often are dealt out
    orders: tuple[Order, ...] = ()
    tables: tuple[DataFrame, ...] = field(default=(), compare=False)

    @property
    def tokens(self) -> int:
        """Tokens learned from."""
        return self.orders[0].tokens if self.orders else 0

    def of_words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words that occur so often; of 0, that of the unknown."""
        words = self.orders[0]
        totals = np.array([words.hot.get(0, (0.0,) * TOTALS)])
        seen, alpha = shares(counts, _whole(totals), totals[:, :CUT], totals[:, -1], words.discounts)
        return np.where(counts > 0, seen, alpha)

    def without_tables(self) -> Model:
        """The model as tasks get it."""
        return replace(self, tables=())


def discounts(counts: list[int]) -> tuple[float, ...]:
    """d(1) .. d(CUT) from the numbers of n-grams that occur 1 .. CUT + 1 times, by Good-Turing as Katz renormalises it.

    Where that can't be used (a count of counts is zero, or a discount isn't between 0 and 1), such counts
    lose n1 / (n1 + 2 n2), or a half if n1 or n2 is zero.
    """
    n = [0, *counts]
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    rest = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, CUT + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out.append(turing if 0 < turing < 1 else (r - less) / r)
    return tuple(out)


#: A context's totals: how many of its n-grams occur 1 .. CUT times, its tokens, and the sum of the shorter context's probabilities over n-grams seen.
TOTALS = CUT + 2


def shares(counts: np.ndarray, whole: np.ndarray, few: np.ndarray, lower: np.ndarray, d: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of n-grams with their counts and contexts' totals (whole as `_whole` has it): the probability if seen, and the context's backoff weight."""
    left = np.where(few.sum(1) > 0, few @ (np.arange(1, CUT + 1) * (1 - np.array(d))), 1.0)
    kept = np.array([1.0, *d, 1.0])[np.minimum(counts, CUT + 1)]
    return kept * counts / whole, left / whole / np.maximum(1 - lower, np.finfo(float).tiny)


def _whole(totals: np.ndarray) -> np.ndarray:
    """What a context's counts are divided by: its tokens; and one more, of the unseen, if all its n-grams occur more than CUT times, so that none is discounted."""
    return totals[:, CUT] + (totals[:, :CUT].sum(1) == 0)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where another value begins in sorted numbers."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


def _ids(ctx: np.ndarray, w: np.ndarray, counts: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Identifiers of a part's n-grams: frequent ones have small ones, which pack well."""
    ids = np.empty(len(w), np.uint64)
    ids[np.lexsort((w, ctx, -counts))] = np.arange(len(w), dtype=np.uint64)
    return ids * np.uint64(parts) + np.uint64(part)


class Asked:
    """Of a block at one order: its different (context, word) pairs, by part, and each token's pair."""

    def __init__(self, ctx: np.ndarray, w: np.ndarray, occurs: np.ndarray, lower: np.ndarray, train: np.ndarray, model: Model):
        """For each token: its context, how often that occurs in training, its word, the probability under the shorter context, and how often to count it. Tokens of unseen contexts aren't asked for."""
        self.tokens = np.flatnonzero(occurs > 0)
        ctx, w, occurs, lower, train = (x[self.tokens] for x in (ctx, w, occurs, lower, train))
        c, v = np.unique(ctx, return_inverse=True)[1], np.unique(w, return_inverse=True)[1]
        pairs, first, self.pair = np.unique(c * (v.max(initial=0) + 1) + v, return_index=True, return_inverse=True)
        self.ctx, self.w, self.lower, hot = ctx[first], w[first], lower[first], occurs[first] > model.hot_at
        self.counts = np.bincount(self.pair, train, len(pairs)).astype(np.int64)
        part = mix(np.where(hot, mix(self.ctx + np.uint64(1)) ^ self.w, self.ctx)) % np.uint64(model.parts)
        order = np.argsort(part, kind="stable")
        #: Of each part asked: its number, and the places of its pairs, by context and word.
        self.groups = [(int(part[g[0]]), g) for g in np.split(order, np.flatnonzero(_starts(part[order]))[1:])] if len(pairs) else []

    def rows(self, block: int) -> Iterator[tuple]:
        for part, g in self.groups:
            ctx, runs = np.unique(self.ctx[g], return_counts=True)
            yield part, block, packed_array(rising(ctx)), packed_array(runs), packed_array(self.w[g]), packed_array(self.counts[g]), packed_array(self.lower[g])


#: lower: how often the last word occurs, which gives its probability, or from the third order on the probability under the shorter context.
_ASKED = "part long, block long, ctx binary, runs binary, w binary, n binary, lower binary"
#: The model's rows have no block. Replies have no contexts but, in the order asked, identifiers, counts and of each context the whole; of those with an unseen n-gram, which back off, the other totals too.
_FOUND = "part long, block long, ctx binary, runs binary, w binary, n binary, whole binary, few binary, sums binary, counted binary"


def _unpack(x: dict) -> tuple[np.ndarray, ...]:
    """Context, word, count and what is said of the shorter context for each n-gram of a row."""
    w = unpacked_array(x["w"]).astype(np.uint64)
    ctx = np.repeat(np.cumsum(unpacked_array(x["ctx"]), dtype=np.uint64), unpacked_array(x["runs"]).astype(np.int64))
    return ctx, w, unpacked_array(x["n"]).astype(np.int64), unpacked_array(x["lower"]) if x.get("lower") is not None else np.zeros(len(w), np.int64)


def _totals(x: dict) -> np.ndarray:
    """TOTALS by context, of a row of the model."""
    whole, few = unpacked_array(x["whole"]), unpacked_array(x["few"]).reshape(CUT, -1).T
    return np.hstack([few, whole[:, None], unpacked_array(x["sums"])[:, None]])


def _answer(asked: list[dict], stored: list[dict] | None, model: Model, order: int) -> Iterator[tuple]:
    """A part's replies to the blocks that asked it; before them, unless the model is stored, its row of that. A stored model counts nothing more."""
    part, rows = asked[0]["part"], [*(stored or []), *asked]
    columns = [_unpack(x) for x in rows]
    bounds = np.cumsum([0, *(len(c[1]) for c in columns)])
    ctx, w, n, lower = map(np.concatenate, zip(*columns))
    by = np.lexsort((w, ctx))
    begins = _starts(ctx[by]) | _starts(w[by])
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(begins) - 1
    first = by[begins]
    ctx, w, lower = ctx[first], w[first], model.of_words(lower[first]) if order == 2 else lower[first].astype(float)
    if stored is not None:
        n[bounds[len(stored)] :] = 0
    counts = np.bincount(pair, n, len(first)).astype(np.int64)
    new = _starts(ctx)
    contexts, of = ctx[new], np.cumsum(new) - 1
    if stored is not None:
        totals = np.zeros((len(contexts), TOTALS))
        for x in stored:
            totals[np.searchsorted(contexts, np.cumsum(unpacked_array(x["ctx"]), dtype=np.uint64))] = _totals(x)
    else:
        few = [np.bincount(of[counts == r], minlength=len(contexts)) for r in range(1, CUT + 1)]
        seen = counts > 0
        totals = np.stack([*few, np.bincount(of, counts, len(contexts)), np.bincount(of[seen], lower[seen], len(contexts))], 1).astype(float)
        held, runs = np.unique(ctx[seen], return_counts=True)
        own = totals[np.searchsorted(contexts, held)]
        counted = np.bincount(np.minimum(counts[seen], CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        yield part, None, packed_array(rising(held)), packed_array(runs), packed_array(w[seen]), packed_array(counts[seen]), packed_array(own[:, CUT].astype(np.int64)), packed_array(own[:, :CUT].T.ravel().astype(np.int64)), packed_array(own[:, -1]), np.append(counted, [counts.sum(), seen.sum()]).astype(np.int64).tobytes()
    ids, whole = _ids(ctx, w, counts, part, model.parts), _whole(totals)
    for x, a, b in zip(rows, bounds, bounds[1:]):
        if "lower" in x:
            mine, their = pair[a:b], of[pair[a:b]]
            backs = totals[np.unique(their[counts[mine] == 0])]
            yield part, x["block"], None, None, packed_array(ids[mine]), packed_array(counts[mine]), packed_array(whole[their[_starts(their)]].astype(np.int64)), packed_array(backs[:, :CUT].T.ravel().astype(np.int64)), packed_array(backs[:, -1]), None


class Parsed:
    """A block's tokens, order by order: the context of each, how often that occurs, and the token's probability so far."""

    def __init__(self, row: dict):
        self.block, self.ids, self.nulls = row["block"], np.frombuffer(row["ids"], np.int64), unpacked_array(row["nulls"]) > 0
        self.sizes = unpacked_array(row["sizes"]).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(unpacked_array(row["train"]), self.sizes).astype(np.int64)
        self.at = unpacked_array(row["tokens"]).astype(np.int64)
        self.words = np.cumsum(unpacked_array(row["words"]), dtype=np.uint64)

    def ask(self, model: Model, order: int) -> Asked:
        """What the block asks of an order, once it has taken the replies of those before."""
        if order > 1:
            return Asked(self.ctx, self.w, self.occurs, self.known if order == 2 else self.p, self.train, model)
        # Of the empty context, which always occurs, each word of the dictionary once.
        counts, some = np.bincount(self.at, self.train, len(self.words)), np.ones(len(self.words))
        return Asked(np.zeros(len(self.words), np.uint64), self.words, some, np.zeros(len(self.words), np.int64), counts, Model(model.parts))

    def take(self, asked: Asked, replies: dict[int, dict], model: Model, order: int) -> None:
        known = model.orders[order - 1]
        size = len(asked.w)
        counts, ids, whole, few, sums = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.ones(size), np.zeros((size, CUT)), np.zeros(size)
        for part, g in asked.groups:
            x, of = replies[part], np.cumsum(_starts(asked.ctx[g])) - 1
            counts[g], ids[g], whole[g] = unpacked_array(x["n"]), unpacked_array(x["w"]), unpacked_array(x["whole"])[of]
            back = g[counts[g] == 0]
            of = np.cumsum(_starts(asked.ctx[back])) - 1
            few[back], sums[back] = unpacked_array(x["few"]).reshape(CUT, -1).T[of], unpacked_array(x["sums"])[of]
        for ctx, totals in known.hot.items():
            mine = asked.ctx == np.uint64(ctx)
            whole[mine], few[mine], sums[mine] = _whole(np.array([totals])), totals[:CUT], totals[-1]
        seen, alpha = shares(counts, whole, few, sums, known.discounts)
        if order == 1:
            # Behind the empty context stands the class of unknown words, of probability 1.
            self.p, self.known = np.where(counts > 0, seen, alpha)[self.at], counts[self.at]
            grams = self.w = np.where(counts > 0, ids, UNKNOWN)[self.at]
            occurs = self.known
        else:
            grams, occurs = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.int64)
            mine, pair = asked.tokens, asked.pair
            self.p = self.p.copy()
            self.p[mine] = np.where(counts > 0, seen, 0)[pair] + np.where(counts > 0, 0, alpha)[pair] * self.p[mine]
            grams[mine], occurs[mine] = ids[pair], counts[pair]
        # The n-gram that ends before a token is its next context; before a text is one for all texts.
        self.ctx, self.occurs = np.roll(grams, 1), np.roll(occurs, 1)
        self.ctx[self.first], self.occurs[self.first] = BEGIN, model.begins

    def after(self, model: Model, replies: list[dict]) -> Parsed:
        """The block once it has taken the replies of all orders there are."""
        for order in range(1, len(model.orders) + 1):
            self.take(self.ask(model, order), {x["part"]: x for x in replies if x["for_order"] == order}, model, order)
        return self


def _ask(cut: DataFrame, replies: DataFrame | None, model: Model, order: int) -> DataFrame:
    if replies is None:

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _table(list(Parsed(row).ask(model, 1).rows(row["block"])), _ASKED).to_batches()

        return cut.mapInArrow(first, _ASKED)
    told = model.without_tables()

    def later(block: pa.Table, heard: pa.Table) -> pa.Table:
        parsed = Parsed(block.to_pylist()[0]).after(told, heard.to_pylist())
        return _table(list(parsed.ask(told, order).rows(parsed.block)), _ASKED)

    return cut.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(later, _ASKED)


def _reply(asked: DataFrame, table: DataFrame | None, model: Model, order: int) -> DataFrame:
    told = model.without_tables()
    if table is None:
        return asked.groupBy("part").applyInArrow(lambda rows: _table(list(_answer(rows.to_pylist(), None, told, order)), _FOUND), _FOUND)

    def known(rows: pa.Table, stored: pa.Table) -> pa.Table:
        return _table(list(_answer(rows.to_pylist(), stored.to_pylist(), told, order)) if rows.num_rows else [], _FOUND)

    return asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(known, _FOUND)


def _frequent(table: DataFrame, parts: int, more_than: float) -> list[int]:
    """Identifiers of an order's n-grams that occur more often than that: at most HOT, as a whole order has as many tokens as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ctx, w, n, _ = _unpack(x)
                yield from _table([(i,) for i in _ids(ctx, w, n, x["part"], parts)[n > more_than].view(np.int64).tolist()], "id long").to_batches()

    return [r.id for r in table.mapInArrow(run, "id long").collect()]


def _order(table: DataFrame, hot: list[int]) -> Order:
    """An order's discounts, and the totals of its dealt-out contexts (identifiers as longs), from its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(hot, np.int64)
        for batch in batches:
            for x in batch.to_pylist():
                ctx = np.cumsum(unpacked_array(x["ctx"]), dtype=np.uint64).view(np.int64)
                mine = np.isin(ctx, wanted)
                rows = [(c, i, v) for c, of in zip(ctx[mine].tolist(), _totals(x)[mine].tolist()) for i, v in enumerate(of)]
                rows += [(None, i, float(v)) for i, v in enumerate(np.frombuffer(x["counted"], np.int64).tolist())]
                yield from _table(rows, "ctx long, at int, v double").to_batches()

    sums = {(r.ctx, r["at"]): r.v for r in table.mapInArrow(run, "ctx long, at int, v double").groupBy("ctx", "at").agg(F.sum("v").alias("v")).collect()}
    counted = [int(sums.get((None, i), 0)) for i in range(CUT + 3)]
    totals = {c % (1 << 64): tuple(sums[c, i] for i in range(TOTALS)) for c in hot if (c, 0) in sums}
    return Order(discounts(counted[: CUT + 1]), totals, counted[-2], counted[-1])


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scores(cut: DataFrame, replies: DataFrame, model: Model) -> DataFrame:
    told = model.without_tables()

    def score(block: pa.Table, heard: pa.Table) -> pa.Table:
        x = Parsed(block.to_pylist()[0]).after(told, heard.to_pylist())
        words = told.orders[0]
        base = np.log10((x.known + 0.5) / (words.tokens + 0.5 * (words.distinct + 1)))
        columns = [x.sizes, np.add.reduceat((x.known > 0).astype(np.int64), x.first), np.add.reduceat(base, x.first), np.add.reduceat(np.log10(x.p), x.first)]
        return pa.table([pa.array(x.ids, mask=x.nulls), *map(pa.array, columns)], names=[f.split()[0] for f in SCORES.split(", ")])

    return cut.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCORES)


def learned_and_scored(cut: DataFrame, order: int = ORDER, model: Model | None = None) -> tuple[Model, DataFrame]:
    """A model of the n-grams up to an order in the blocks' texts that are for training, and SCORES of all their texts; with a model given, its scores alone.

    Scores are log10 probabilities of whole texts, their end included. A null text is an empty one, which
    is its end alone. Repeated rows count and are scored each. Without any text for training a word's
    probability is that of the unknown, which is 1. The tables and scores are written.
    """
    spark = cut.sparkSession
    size = cut.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_train").alias("begins")).first()
    built = replace(model, orders=(), tables=()) if model else Model(max(1, -(-(size.tokens or 0) // TOKENS)), size.begins or 0)
    replies = None
    for at in range(1, 1 + (len(model.orders) if model else order)):
        found = saved(_reply(_ask(cut, replies, built, at), model.tables[at - 1] if model else None, built, at), f"order{at}")
        if model:
            built = replace(built, orders=model.orders[:at], tables=model.tables[:at])
        else:
            table = found.where("block is null")
            hot = [0] if at == 1 else [*_frequent(built.tables[-1], built.parts, built.hot_at), *([int(BEGIN.view(np.int64))] if built.begins > built.hot_at else [])]
            built = replace(built, orders=(*built.orders, _order(table, hot)), tables=(*built.tables, table))
            built = replace(built, hot_at=built.tokens / HOT)
        heard = found.where("block is not null").select(F.lit(at).alias("for_order"), "part", "block", "w", "n", "whole", "few", "sums")
        replies = heard if replies is None else replies.unionByName(heard)
    scores = saved(_scores(cut, replies, built), "scores") if replies is not None else spark.createDataFrame([], SCORES)
    return built, scores
