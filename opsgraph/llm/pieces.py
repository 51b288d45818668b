"""SentencePiece encoding and decoding with reproducible sampled segmentations.

A text's lattice has an edge for each vocabulary piece that occurs in it. Forward filtering sums the
probability of all ways to each place; backward sampling then draws, from the end, the piece by which
the text got there. The draws are a function of the row's key and the place, so a row's segmentation
doesn't depend on its partition, its neighbours or a retry. Decoding gives back the text, always: what
no piece covers goes as bytes, and so does a literal U+2581, which otherwise stands for a space.

No piece goes on from a letter to a space, so the lattice falls into units (spaces and what follows
them) that are filtered once each; all steps are numpy operations over all units of a batch. Long units
are filtered one by one, keeping only the sum at each place, from which the shares of the pieces that
end there are made again, a stretch at a time, as the draws come to them. Nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import code_points, mix, packed, ship, slices, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110000
#: Units of more code points are filtered one by one. Texts are looked at in parts of about so many, which end between units.
LONG_UNIT, PART = 1024, 100_000
#: Log-probability of a byte of what no piece covers, besides that of the rarest piece.
BYTE_COST = -2.0
_ODD = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (empty: not for text), their log-probabilities, and the ids of the 256 bytes."""

    pieces: tuple[str, ...]
    logp: tuple[float, ...]
    bytes_: tuple[int, ...]


@lru_cache(4)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a model, on the driver. Scores that are ranks (merges) are read as a Zipf distribution, others as log-probabilities."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    score = np.array([model.get_score(i) for i in range(n)])
    own = np.flatnonzero(plain)
    if (score[own] == np.round(score[own])).all():
        rank = np.argsort(np.argsort(-score[own], kind="stable"))
        weight = 1 / (rank + 2.7)
        score[own] = np.log(weight / weight.sum())
    table = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    if len(table) < 256:
        raise ValueError("the vocabulary has no pieces for single bytes")
    return Vocabulary(tuple(model.id_to_piece(i) if plain[i] else "" for i in range(n)), tuple(score.tolist()), tuple(table[f"<0x{b:02X}>"] for b in range(256)))


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """Where the parts of a text begin and end: at the first unit's end after PART code points."""
    a = 0
    while a < len(text):
        b = text.find(" ", a + PART)
        while b > 0 and text[b - 1] == " ":  # units begin with all of their spaces
            b = text.find(" ", b + 1)
        b = len(text) if b < 0 else b
        yield a, b
        a = b


class Lattice:
    """The vocabulary as arrays, for one worker."""

    def __init__(self, vocab: Vocabulary, sharpness: float):
        mark = chr(SPACE)
        ids = [i for i, p in enumerate(vocab.pieces) if p and mark not in p.lstrip(mark)]
        self.most = max(len(vocab.pieces[i]) for i in ids)
        self.logp = np.append(np.array(vocab.logp) * sharpness, -np.inf)  # at -1: no piece
        self.byte_logp = (min(vocab.logp[i] for i in ids) + BYTE_COST) * sharpness
        self.bytes_ = np.array(vocab.bytes_, np.int32)
        self.value = lambda c: mix(c.astype(np.uint64) + np.uint64(1))
        self.size_bits = 17
        self.maybe = np.zeros(1 << 19, bool)
        self.keys, self.ids = np.zeros(1 << self.size_bits, np.uint64), np.full(1 << self.size_bits, -1, np.int32)
        seen = np.zeros(LITERAL + 1, bool)
        for i in ids:
            p = np.array([ord(c) for c in vocab.pieces[i]], np.uint32)
            seen[p] = True
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for k, v in enumerate(self.value(p[::-1])):
                    h += v * _ODD[k]
            s = int(self._slot(np.array([h]))[0])
            while self.ids[s] >= 0:
                s = (s + 1) & (1 << self.size_bits) - 1
            self.keys[s], self.ids[s] = h, i
            self.maybe[int(h) >> 45] = True
        self.alien = ~seen

    def _slot(self, h):
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.size_bits)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(self.maybe[h >> np.uint64(45)])
        slot = self._slot(h[left]).astype(np.int64)
        while len(left):
            got = self.ids[slot]
            same = self.keys[slot] == h[left]
            out[left[same]] = got[same]
            on = ~same & (got >= 0)
            left, slot = left[on], (slot[on] + 1) & (1 << self.size_bits) - 1
        return out

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; keys are 64-bit numbers that seed the draws."""
        parts = [(i, a, b) for i, t in enumerate(texts) for a, b in _parts(t)]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in slices([y - x for _, x, y in parts], PART):
            mine = parts[a:b]
            for (i, _, _), ids in zip(mine, self._encode([texts[i][x:y] for i, x, y in mine], np.array([keys[i] for i, _, _ in mine], np.uint64), np.array([x for _, x, _ in mine]))):
                found[i].append(ids)
        return [np.concatenate(f) if f else np.zeros(0, np.int32) for f in found]

    def _encode(self, texts: list[str], keys: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
        points, bounds = code_points(texts)
        chars = points.copy()
        chars[points == SPACE] = LITERAL
        chars[points == 32] = SPACE
        n = len(chars)
        space, alien = chars == SPACE, self.alien[chars]
        begin = alien.copy()
        begin[1:] |= (space[1:] & ~space[:-1]) | alien[:-1]
        begin[bounds[:-1]] = True
        starts = np.flatnonzero(begin)
        sizes = np.diff(np.append(starts, n))

        out = np.full(n, -2, np.int32)  # at each piece's last code point: its id, -1 for bytes
        row = np.searchsorted(bounds, starts, "right") - 1
        seed, place = keys[row], starts - bounds[row] + base[row]
        for i in np.flatnonzero(sizes > LONG_UNIT):
            self._long(chars[starts[i] : starts[i] + sizes[i]], seed[i], place[i], out[starts[i] : starts[i] + sizes[i]])
        few = sizes <= LONG_UNIT
        if few.any():
            self._short(chars, starts[few], sizes[few], seed[few], place[few], out)

        where = np.flatnonzero(out > -2)
        ids, code = out[where], points[where]
        counts = np.where(ids >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        ends = np.cumsum(counts)
        flat = np.repeat(ids, counts)
        raw, first, c = np.flatnonzero(ids < 0), (ends - counts), code
        for m in raw if len(raw) < 64 else ():
            flat[first[m] : ends[m]] = self.bytes_[list(chr(c[m]).encode("utf-8", "surrogatepass"))]
        if len(raw) >= 64:
            joined = np.frombuffer(b"".join(chr(x).encode("utf-8", "surrogatepass") for x in c[raw].tolist()), np.uint8)
            flat[flat < 0] = self.bytes_[joined]
        cuts = np.concatenate([[0], ends])[np.searchsorted(where, bounds)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A number in [0, 1) for each place of a row, of 53 bits."""
        return (mix(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) * 2.0**-53

    def _lone(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of the bytes of code points that no piece stands for."""
        return self.byte_logp * (1 + (code > 0x7F) + (code > 0x7FF) + ((code > 0xFFFF) & (code != LITERAL)))

    def _ending(self, chars: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places a to b of one unit: ids of the pieces that end there, by length, and their log-probabilities."""
        ids = np.full((b - a, self.most), -1, np.int32)
        h = np.zeros(b - a, np.uint64)
        for k in range(min(self.most, b)):
            low = max(a, k)
            h[low - a :] += self.value(chars[low - k : b - k]) * _ODD[k]
            ids[low - a :, k] = self._find(h[low - a :])
        log = self.logp[ids]
        lone = ids[:, 0] < 0
        log[lone, 0] = self._lone(chars[a:b][lone])
        return ids, log

    def _long(self, chars: np.ndarray, seed: np.uint64, place: int, out: np.ndarray) -> None:
        """One unit of any length: forward, keeping the sums; then backward from its end."""
        n, step = len(chars), 4096
        reach = np.zeros(n + 1)  # of the place before each code point
        for a in range(0, n, step):
            log = self._ending(chars, a, min(n, a + step))[1]
            for d in range(a, min(n, a + step)):
                k = min(d + 1, self.most)
                s = log[d - a, :k] + reach[d - k + 1 : d + 1][::-1]
                top = s.max()
                reach[d + 1] = top + np.log(np.exp(s - top).sum())
        depth = n
        while depth > 0:
            a, b = max(0, depth - step), depth
            ids, log = self._ending(chars, a, b)
            before = np.arange(a, b)[:, None] - np.arange(self.most)
            share = np.exp(log + np.where(before >= 0, reach[np.maximum(0, before)], -np.inf) - reach[a + 1 : b + 1, None])
            upto = np.cumsum(share, 1)
            u = self._draws(np.full(b - a, seed), place + np.arange(a, b) + 1) * upto[:, -1]
            took = np.minimum((upto <= u[:, None]).sum(1), self.most - 1 - np.argmax(share[:, ::-1] > 0, 1))
            while depth > a:
                k = int(took[depth - 1 - a])
                out[depth - 1] = ids[depth - 1 - a, k]
                depth -= k + 1

    def _short(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
        """All units of some thousand code points at most, each kind filtered once."""
        value, salt = self.value(chars), 0
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mine = np.repeat(starts, sizes) + within
        while True:  # units by hash and size; a clash of hashes is seen, and then another factor is taken
            part = np.concatenate([[np.uint64(0)], np.cumsum(value[mine] * _ODD[(within + salt) % len(_ODD)], dtype=np.uint64)])
            ends = np.cumsum(sizes)
            _, head, unit = np.unique(mix((part[ends] - part[ends - sizes]) + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
            same = np.repeat(starts[head][unit], sizes) + within
            if (sizes == sizes[head][unit]).all() and (chars[same] == chars[mine]).all():
                break
            salt += 7
        at, size = starts[head], sizes[head]
        order = np.argsort(-size, kind="stable")
        at, size, unit = at[order], size[order], np.argsort(order)[unit]

        piece, upto, begin = self._filter(chars, value, at, size)
        ids_at = np.cumsum([0, *map(len, piece)])[:-1] - begin[: len(piece)]
        all_ids = np.concatenate([np.zeros(0, np.int32), *piece])
        lane, depth = np.arange(len(starts)), sizes.copy()
        while len(lane):
            k = begin[depth - 1] + unit[lane]
            step = (upto[k] <= self._draws(seed[lane], place[lane] + depth)[:, None]).sum(1)
            out[starts[lane] + depth - 1] = all_ids[ids_at[step] + k]
            depth = depth - step - 1
            on = depth > 0
            lane, depth = lane[on], depth[on]

    def _filter(self, chars: np.ndarray, value: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each place of each unit (longest first): the pieces that end there, by length, and their cumulative probabilities.

        Places go by depth and then by unit, so all steps are on stretches of arrays; also where each depth begins.
        """
        deepest = int(size[0]) if len(size) else 0
        wide = np.searchsorted(-size, -np.arange(deepest), "left")  # units of more than d places
        begin = np.concatenate([[0], np.cumsum(wide)])
        total = int(begin[-1])
        char = np.arange(total) - np.repeat(begin[:-1], wide)
        char = at[char] + np.repeat(np.arange(deepest), wide)
        piece: list[np.ndarray] = []  # by length - 1, from the first place deep enough on
        h, widest = np.zeros(total, np.uint64), 1
        for k in range(min(self.most, deepest)):
            live = slice(begin[k], total)
            h[live] += value[char[live] - k] * _ODD[k]
            got = self._find(h[live])
            piece.append(got)
            if (got >= 0).any():
                widest = k + 1
        piece = piece[:widest]
        log = [self.logp[p] for p in piece]
        lone = np.flatnonzero(piece[0] < 0) if total else np.zeros(0, np.int64)
        code = chars[char[lone]]
        if total:
            log[0][lone] = self._lone(code)
        reach = np.zeros(total)
        upto = np.full((total, widest), 2.0)
        for d in range(deepest):
            units, here = int(wide[d]), slice(begin[d], begin[d + 1])
            width = min(d + 1, widest)
            s = np.empty((width, units))
            for j in range(width):
                own = log[j][begin[d] - begin[j] : begin[d] - begin[j] + units]
                np.add(own, reach[begin[d - j - 1] : begin[d - j - 1] + units] if j < d else 0.0, out=s[j])
            top = s.max(0)
            s -= top
            np.exp(s, out=s)
            cum = np.cumsum(s, 0)
            reach[here] = top + np.log(cum[-1])
            cum /= cum[-1]
            last = width - 1 - np.argmax(s[::-1] > 0, 0)
            cum[np.arange(width)[:, None] >= last] = 2
            upto[here, :width] = cum.T
        return piece, upto, begin


class Decoder:
    """The text of each id."""

    def __init__(self, vocab: Vocabulary):
        raw = [p.replace(chr(SPACE), " ").encode("utf-8", "surrogatepass") for p in vocab.pieces]
        for b, i in enumerate(vocab.bytes_):
            raw[i] = bytes([b])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of id sequences laid end to end; ids that aren't for text give nothing, bytes that aren't UTF-8 the replacement character."""
        size = self.raw_size[ids]
        end = np.cumsum(size)
        data = self.raw[np.repeat(self.raw_at[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = np.concatenate([[0], end])[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(4)
def _lattice(vocab: Vocabulary, sharpness: float) -> Lattice:
    """Built once a worker: an equal vocabulary of a later task finds it."""
    return Lattice(vocab, sharpness)


@lru_cache(2)
def _decoder(vocab: Vocabulary) -> Decoder:
    return Decoder(vocab)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, sharpness: float = 0.5, seed: int = 0, verify: bool = False) -> DataFrame:
    """docs with piece_ids: a sampled segmentation of the text, the same for the same key, text, sharpness and seed.

    With verify, also lossless: whether the ids, decoded on the spot, give the text back (a second
    Python function over piece_ids would have them made twice). sharpness 0 samples all segmentations
    alike, large values give the likeliest one. A null text gives null ids and is lossless, an empty one
    no ids; a null key seeds like an empty one. Other columns stay; columns of these names are replaced.
    The vocabulary, whose size the model fixes, is sent to the executors.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def of(texts: pa.Array, keys: pa.Array) -> pa.Array:
        values = texts.fill_null("").to_pylist()
        out = _lattice(sent.value, sharpness).encode(values, [xxhash.xxh64_intdigest(k or "", seed) for k in keys.to_pylist()])
        bounds, flat = np.cumsum([0, *map(len, out)]), np.concatenate([np.zeros(0, np.int32), *out])
        same = [None] * len(values)
        if verify:
            decoder, same = _decoder(sent.value), []
            for a, b in slices(np.diff(bounds).tolist(), 1_000_000):
                same += [x == y for x, y in zip(values[a:b], decoder.decode(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))]
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat), mask=texts.is_null())
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], names=["ids", "lossless"])

    work = packed(docs, _text=F.col(text), _key=F.col(key).cast("string")).select("_row", of("_text", "_key").alias("_out"))
    return unpacked(work, docs, piece_ids="_out.ids", **({"lossless": "_out.lossless"} if verify else {}))


def decode(docs: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """docs with decoded: the text of the piece ids; null for null. A column of this name is replaced."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        bounds, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        out: list[str] = []
        decoder = _decoder(sent.value)
        for a, b in slices(np.diff(bounds).tolist(), 1_000_000):
            out += decoder.decode(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        return pa.array(out, pa.string(), mask=rows.is_null().to_numpy(zero_copy_only=False))

    return unpacked(packed(docs, _ids=F.col(ids)).select("_row", of("_ids").alias("_text")), docs, decoded="_text")
