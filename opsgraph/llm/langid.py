"""Language identification by cross-parsing entropy.

For each language a suffix automaton of some labelled text finds, from each point of a text, the
longest match with that language's text. Cutting a text greedily into such longest matches gives a
number of phrases; phrases x log2(training length) / text length estimates the bits a character
costs under that language. The language with the fewest wins.

The automata are dense tables, so one numpy gather advances thousands of text blocks in all
languages at once. Blocks start as if a phrase began there; then each is parsed again from the state in
which the block before it ends, up to where that makes no more difference, so that a text is parsed as
one whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import code_points, fold, packed, ship, slices, unpacked

BLOCK = 1024
#: Bounds of the labelled sample that is learned from; the sample, not the scoring, is bounded.
ROWS_PER_LANG, CHARS_PER_ROW, CHARS_PER_LANG, LEAST_PER_LANG, CHARS_IN_ALL = 64, 2048, 16_384, 1024, 131_072
#: Letters of the sample have symbols of their own if there are up to SYMBOLS; else the SINGLE most frequent have, and the others are spelt in DIGITS.
SYMBOLS, SINGLE, DIGITS, SPELT = 126, 62, 64, 3
SPACE, OTHER = 0, 1
#: Symbols times languages that are parsed at once.
AT_ONCE = 8_000_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and its lower case (one code point)."""
    chars = [chr(i) for i in range(0x110000)]
    lower = [c.lower() for c in chars]
    return np.array([c.isalpha() for c in chars]), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(lower)], np.uint32)


def _automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class CrossParser:
    """Automata of all languages as one table: entry (state, symbol) holds the next state's row, doubled, plus 1 if a phrase begins."""

    def __init__(self, corpus: tuple[tuple[str, str], ...]):
        is_letter, lower = _letters()
        self.langs = [lang for lang, _ in corpus]
        points = [lower[code_points([text])[0]] for _, text in corpus]
        seen, counts = np.unique(np.concatenate([p[is_letter[p]] for p in points]), return_counts=True) if points else (np.zeros(0, np.uint32), np.zeros(0))
        often = seen[np.argsort(-counts, kind="stable")]
        kept = np.sort(often[: SYMBOLS if len(often) <= SYMBOLS else SINGLE])
        by_lower = np.full(0x110000, SPACE, np.int32)
        by_lower[np.flatnonzero(is_letter)] = OTHER
        by_lower[kept] = np.arange(2, 2 + len(kept))
        spelt = np.setdiff1d(often, kept)
        self.spelt = 2 + len(kept)  # symbols from here on are letters to be spelt
        by_lower[spelt] = self.spelt + np.arange(len(spelt))
        self.symbol = by_lower[lower]
        self.width = width = 2 + len(kept) + (DIGITS if len(spelt) else 0)
        tables, self.start, self.bits, row = [], [], [], 0
        for p in points:
            known = self.symbols(p, np.array([0, len(p)]))[0]
            nexts = _automaton(known)
            part = np.full((len(nexts), width), -1, np.int64)
            for s, moves in enumerate(nexts):
                if moves:
                    part[s, list(moves)] = list(moves.values())
            fresh = np.where(part[0] < 0, 0, part[0])
            begins = part < 0
            begins[0] = True
            part = np.where(part < 0, fresh, part)
            tables.append((((row + part) * width) << 1 | begins).astype(np.int32))
            self.start.append(row * width)
            self.bits.append(np.log2(max(2, len(known))))
            row += len(nexts)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.start, self.bits = np.array(self.start, np.int32), np.array(self.bits)

    def symbols(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts laid end to end, and their bounds: runs of what is not a letter become one space, rarer letters SPELT digits."""
        found = self.symbol[points]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != SPACE) | (found[:-1] != SPACE)
        keep[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.concatenate([[0], np.cumsum(keep)])[bounds]
        found = found[keep]
        rare = found >= self.spelt
        if rare.any():
            times = np.where(rare, SPELT, 1)
            ends = np.cumsum(times)
            nth = np.arange(ends[-1]) - np.repeat(ends - times, times)
            whole = np.repeat(found, times)
            found = np.where(np.repeat(rare, times), self.spelt + (whole - self.spelt) // DIGITS**nth % DIGITS, whole)
            at = np.concatenate([[0], ends])[at]
        return found, at

    def _parsed(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, got: np.ndarray, again: bool = False) -> np.ndarray:
        """Parses stretches of symbols from the states given (languages x stretches); got keeps each step. The states in which they end.

        If they were parsed before, a stretch is left where all languages are in the states they were in then.
        """
        order = np.argsort(-length, kind="stable")
        begin, length, end = begin[order], length[order], state[:, order]
        upto = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # stretches of more than t symbols
        if not again:
            for t, n in enumerate(upto.tolist()):
                place = begin[:n] + t
                step = np.take(self.table, end[:, :n] + symbols[place])
                got[:, place] = step
                end[:, :n] = step >> 1
        lane = np.arange(len(length) if again else 0)
        for t, n in enumerate(upto.tolist()):
            lane = lane[: np.searchsorted(lane, n)]
            if not len(lane):
                break
            place = begin[lane] + t
            step = np.take(self.table, end[:, lane] + symbols[place])
            done = (got[:, place] == step).all(0)
            got[:, place] = step
            end[:, lane] = step >> 1
            # from an equal step on all is as before, the end too
            end[:, lane[done]] = got[:, begin[lane[done]] + length[lane[done]] - 1] >> 1
            lane = lane[~done]
        out = np.empty_like(end)
        out[:, order] = end
        return out

    def _phrases(self, symbols: np.ndarray, at: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases begin in each text (texts x languages), parsed from the states given on; and the states in the end."""
        sizes = np.diff(at)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[owner] + nth * BLOCK
        length = np.minimum(BLOCK, at[owner + 1] - begin)
        enter = np.where(nth == 0, state[:, owner], self.start[:, None])
        got = np.zeros((len(self.langs), len(symbols)), np.int32)
        end = self._parsed(symbols, begin, length, enter, got)
        while True:
            true = np.where(nth[1:] > 0, end[:, :-1], enter[:, 1:])
            wrong = 1 + np.flatnonzero((true != enter[:, 1:]).any(0))
            if not len(wrong):
                break
            enter[:, wrong] = true[:, wrong - 1]
            end[:, wrong] = self._parsed(symbols, begin[wrong], length[wrong], enter[:, wrong], got, True)
        last = np.cumsum(blocks) - 1
        state = np.where(blocks > 0, end[:, np.maximum(0, last)] if len(owner) else state, state)
        which = np.repeat(np.arange(len(sizes)), sizes)
        return np.stack([np.bincount(which, g & 1, len(sizes)) for g in got], 1), state

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol (texts x languages), and whether each text has a letter."""
        points, bounds = code_points(texts)
        symbols, at = self.symbols(points, bounds)
        sizes, total = np.diff(at), np.zeros((len(texts), len(self.langs)))
        has = np.bincount(np.repeat(np.arange(len(texts)), sizes), symbols != SPACE, len(texts)) > 0
        most = max(BLOCK, AT_ONCE // max(1, len(self.langs)))
        for a, b in slices(sizes.tolist(), most) if self.langs else ():
            state = np.repeat(self.start[:, None], b - a, 1)
            for low in range(at[a], at[b], most):  # more than one step: a single long text
                cut = np.clip(at[a : b + 1], low, min(low + most, at[b]))
                found, state = self._phrases(symbols[low : cut[-1]], cut - low, state)
                total[a:b] += found
        return total * self.bits / np.maximum(1, sizes)[:, None], has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bits, has = self.entropies(texts)
        if not len(texts) or not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = np.argmin(bits, 1)
        low = np.sort(bits, 1)
        score = low[:, 1] / np.maximum(1e-9, low[:, 0] + low[:, 1]) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)


@lru_cache(2)
def _parser(corpus: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(corpus)


def training_text(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[tuple[str, str], ...]:
    """A bounded sample of labelled text: (language, text), at most CHARS_PER_LANG code points each.

    Of each language the row with the least hash in each of ROWS_PER_LANG hash buckets is taken: an
    aggregation over ids, then one scan for the chosen rows. A row gives at most CHARS_PER_ROW code
    points, from its middle; of rows that share a key and a language the least text is taken. All
    languages together have CHARS_IN_ALL code points, but each may have LEAST_PER_LANG. Null languages,
    keys and texts are left out, as are languages without a letter; without any there is no text.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("l")).where("l is not null and k is not null")
    h = F.xxhash64(F.col("k"))
    chosen = rows.groupBy("l", F.pmod(h, F.lit(ROWS_PER_LANG)).alias("b")).agg(F.min(F.struct(h.alias("h"), "k")).alias("m"))
    picked = {(r.l, r.k) for r in chosen.select("l", F.col("m.k").alias("k")).collect()}
    if not picked:
        return ()
    langs = sorted({l for l, _ in picked})
    own = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("k").isin(sorted({k for _, k in picked})) & F.col("l").isNotNull() & F.col("t").isNotNull())
    middle = F.substring("t", (F.greatest(F.lit(0), F.length("t") - CHARS_PER_ROW) / 2).cast("int") + 1, F.lit(CHARS_PER_ROW))
    got = [r for r in own.select("l", "k", middle.alias("t")).groupBy("l", "k").agg(F.min("t").alias("t")).collect() if (r.l, r.k) in picked]
    most = min(CHARS_PER_LANG, max(LEAST_PER_LANG, CHARS_IN_ALL // len(langs)))
    out = []
    for name in langs:
        joined = " ".join(r.t for r in sorted((r for r in got if r.l == name), key=lambda r: r.k))
        if any(c.isalpha() for c in joined[:most]):
            out.append((name, joined[:most]))
    return tuple(out)


def identify(docs: DataFrame, corpus: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1: the runner-up's share of the two lowest entropies).

    A null or empty text, or one without a letter, gets `und` and 0; so does every text when corpus is
    empty. Equal entropies: the language that sorts first. Other columns stay; columns of these two names are replaced.
    """

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parser = _parser(corpus)
        values = [t or "" for t in texts]
        names, scores = [], []
        for a, b in slices([len(t) for t in values], 4_000_000):
            n, s = parser.predict(values[a:b])
            names += n
            scores.append(s)
        return pd.DataFrame({"lang": names, "score": np.concatenate(scores) if scores else []})

    ship(docs.sparkSession)
    work = packed(docs, _text=F.col(text)).withColumn("_lang", predict("_text"))
    return unpacked(work, docs, lang_pred="_lang.lang", lang_score="_lang.score")


def held_out(key: str | Column = "doc_id") -> Column:
    """Documents that are never learned from. A null id is not held out (and not learned from either)."""
    return F.coalesce(fold(key, 4) == 2, F.lit(False))
