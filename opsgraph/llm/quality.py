"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every text. How often each pattern of votes occurs
among all documents is counted (the patterns are bounded, 3 to the number of labellers); on the counts,
expectation-maximisation estimates each labeller's accuracy in either class and the share of good
documents. The posterior of its vote pattern labels a text, and on a bounded sample of such labels a
linear scorer is trained over hashed words, pairs of neighbouring words, character n-grams, the number of
words and the share of equal neighbouring ones. It scores every whole text from its own features, of which
the last two are also what two of the labellers measure.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import FACTORS, code_points, mix, packed, saved, ship, slices, tokens, unpacked

#: Rows that the scorer is trained on, the longest of them, and the hashed features of each family.
SAMPLE, LONGEST, BUCKETS = 3000, 20_000, 1 << 13
#: Families of features: words, neighbouring words, characters' classes three by three, the text's size.
FAMILIES = 4
GOOD, BAD, ABSTAIN = 1, 0, 2
WORD = re.compile(r"\w+")
MARKS = re.compile(r"[^\w\s]")
LONE, DOUBLED = re.compile(r"(?<!\S)[^\w\s]+(?!\S)"), re.compile(r"([^\w\s])\1")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
#: Labeller, what it measures, bad below, bad above, good from, good to.
LABELLERS = (
    ("length", 0, 15, None, 60, None),
    ("distinct words", 1, 0.6, None, 0.75, 1.0),
    ("commonest word", 2, None, 0.2, 0.0, 0.12),
    ("word length", 3, 2.5, 12, 3.0, 9.0),
    ("capitals", 4, None, 0.4, 0.0, 0.2),
    ("marks", 5, None, 0.15, 0.0, 0.08),
    ("sentence ends", 6, None, 0.5, 0.01, 0.3),
    ("repeated neighbours", 7, None, 0.2, 0.0, 0.05),
    ("repeated lines", 8, None, 0.3, 0.0, 0.1),
    ("marks by themselves", 9, None, 0.15, 0.0, 0.03),
    ("doubled marks", 10, None, 0.2, 0.0, 0.03),
)


def measures(text: str) -> list[float]:
    """What the labellers look at. A text without words measures 0 but for its marks."""
    words = WORD.findall(text.lower())
    n, size = len(words), len(text)
    marks = len(MARKS.findall(text))
    if not n:
        return [0.0] * 5 + [marks / max(1, size)] + [0.0] * 5
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        float(n), math.log(len(counts)) / math.log(n) if n > 1 else 1.0, max(counts.values()) / n, sum(map(len, words)) / n, len(CAPITALS.findall(text)) / size,
        marks / size, (text.count(".") + text.count("!") + text.count("?")) / n,
        sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(LONE.findall(text)) / n if marks else 0.0, len(DOUBLED.findall(text)) / n if marks else 0.0,
    ]


def votes(measured: np.ndarray) -> np.ndarray:
    """GOOD, BAD or ABSTAIN of each labeller (texts x labellers)."""
    out = np.full((len(measured), len(LABELLERS)), ABSTAIN, np.int8)
    for k, (_, at, low, high, good_from, good_to) in enumerate(LABELLERS):
        x = measured[:, at]
        good = (x >= good_from) & (x <= (np.inf if good_to is None else good_to))
        bad = (x < (-np.inf if low is None else low)) | (x > (np.inf if high is None else high))
        out[good, k], out[bad, k] = GOOD, BAD
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns and their counts: the posterior of good of each pattern, the rates P(vote | class) (2 x labellers x 3), the share of good.

    Starts from patterns without a vote for bad as good, so that "good" keeps its meaning: each labeller
    knows one kind of junk, so one vote for bad may be all there is. Counts are smoothed by one.
    """
    onehot = np.stack([patterns == v for v in range(3)], 2).astype(float)
    q = np.where((patterns == BAD).any(1), 0.05, 0.95)
    rates, share = np.full((2, patterns.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        w = np.stack([(1 - q) * counts, q * counts])
        rates = np.einsum("cp,pkv->ckv", w, onehot) + 1
        rates /= rates.sum(2, keepdims=True)
        share = (w[1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("pkv,ckv->cp", onehot, np.log(rates)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        done, q = np.abs(new - q).max() < 1e-7, new
        if done:
            break
    return q, rates, float(share)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of each code point: 1 a lower-case or other letter, 2 an upper-case one, 3 a digit, 4 a blank, 5 a line's end, 6 on others by their number."""
    chars = [chr(i) for i in range(0x110000)]
    return np.array([2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 + i % 58 for i, c in enumerate(chars)], np.uint64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted: of each family its features' shares, which sum to 1 in a text that has any."""
    words, at = tokens(texts)
    points, ends = code_points(texts)
    size, chars = np.diff(at), np.diff(ends)
    owner, of = np.repeat(np.arange(len(texts)), size), np.repeat(np.arange(len(texts)), chars)
    found = [(owner, words)]
    pair = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    found.append((owner[1:][pair], mix(words[1:][pair] * FACTORS[1] + words[:-1][pair])))
    found.append((owner[1:][pair], np.where(words[1:][pair] == words[:-1][pair], np.uint64(1), np.uint64(2))))
    kind = _classes()[points]
    three = (of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, bool)
    found.append((of[2:][three], mix(kind[2:][three] * FACTORS[2] + kind[1:-1][three] * FACTORS[3] + kind[:-2][three])))
    rows, ids, values = [], [], []
    for family, (row, h) in zip((0, 1, 1, 2), found):
        rows.append(row)
        ids.append((h % np.uint64(BUCKETS)).astype(np.int64) + family * BUCKETS)
        values.append(1 / np.maximum(1, np.bincount(row, minlength=len(texts)))[row])
    rows.append(np.arange(len(texts)))
    ids.append(3 * BUCKETS + np.minimum(20, np.log2(size + 1)).astype(np.int64))
    values.append(np.ones(len(texts)))
    code, where = np.unique(np.concatenate(rows) * (FAMILIES * BUCKETS) + np.concatenate(ids), return_inverse=True)
    return code // (FAMILIES * BUCKETS), code % (FAMILIES * BUCKETS), np.bincount(where, np.concatenate(values), len(code))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Scorer:
    """Weights of the hashed features, as bytes of 32-bit floats; none: every text is scored 0.5."""

    weights: bytes = b""
    bias: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        w = np.frombuffer(self.weights, np.float32) if self.weights else np.zeros(FAMILIES * BUCKETS, np.float32)
        out = [np.zeros(0)]
        for a, b in slices([len(t) for t in texts], 400_000):
            row, at, value = features(texts[a:b])
            out.append(self.bias + np.bincount(row, w[at] * value, b - a))
        return _sigmoid(np.concatenate(out))


def train(texts: list[str], labels: np.ndarray, steps: int = 150) -> Scorer:
    """Logistic regression on posterior labels, by Adam."""
    if not texts:
        return Scorer()
    parts, base = [], 0
    for a, b in slices([len(t) for t in texts], 400_000):
        row, at, value = features(texts[a:b])
        parts.append((row + base, at, value))
        base += b - a
    row, at, value = map(np.concatenate, zip(*parts))
    used, at = np.unique(at, return_inverse=True)
    w, b, m, v, mb, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        d = _sigmoid(np.bincount(row, w[at] * value, len(texts)) + b) - labels
        g, gb = np.bincount(at, d[row] * value, len(used)) / len(d) + 1e-5 * w, float(d.mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.2 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    all_ = np.zeros(FAMILIES * BUCKETS, np.float32)
    all_[used] = np.round(w, 5)
    return Scorer(all_.tobytes(), round(float(b), 5))


def _voted(values: list[str]) -> list[str]:
    """Each text's vote pattern, as digits."""
    out: list[str] = []
    for a, b in slices([len(v) for v in values], 4_000_000):
        out += ["".join(map(str, r)) for r in votes(np.array([measures(t) for t in values[a:b]])).tolist()]
    return out


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Scorer:
    """Fits the label model on the vote patterns of all documents, and the scorer on a sample of at most SAMPLE rows.

    The sample has the row of least hash in each of SAMPLE / 2 buckets of either side of the posterior,
    texts of up to LONGEST code points. Rows with a null key are counted but not sampled; of a key with
    several texts the least is taken, under the label that came with the key.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def pattern(texts: pd.Series) -> pd.Series:
        return pd.Series(_voted([t or "" for t in texts]), dtype=object)

    voted = saved(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).select("k", (F.length("t") <= LONGEST).alias("short"), pattern("t").alias("p")), "votes")
    counts = {r.p: r["count"] for r in voted.groupBy("p").count().collect()}
    if not counts:
        return Scorer()
    names = sorted(counts)
    q, _, _ = label_model(np.array([[int(c) for c in p] for p in names]), np.array([counts[p] for p in names], float))
    sides = docs.sparkSession.createDataFrame([(p, float(x)) for p, x in zip(names, q)], "p string, q double")
    h = F.xxhash64("k")
    rows = voted.where("short and k is not null").join(sides, "p")
    least = rows.groupBy(F.col("q") >= 0.5, F.pmod(h, F.lit(SAMPLE // 2))).agg(F.min(F.struct(h.alias("h"), "k", "q")).alias("m")).select("m.k", "m.q")
    chosen = {r.k: r.q for r in least.collect()}
    if not chosen:
        return Scorer()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isin(list(chosen)) & (F.length("t") <= LONGEST))
    mine = sorted((r.k, r.t) for r in rows.groupBy("k").agg(F.min("t").alias("t")).collect())
    return train([t for _, t in mine], np.array([chosen[k] for k, _ in mine]))


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs with quality (0 to 1, higher is better). A null text is an empty one. A column of this name is replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer.scores([t or "" for t in texts]))

    return unpacked(packed(docs, _text=F.col(text)).withColumn("_score", of("_text")), docs, quality="_score")
