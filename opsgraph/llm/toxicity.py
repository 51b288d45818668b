"""Toxicity by weak supervision.

Many voters look at a text: lexicons of words and word beginnings, pure and mixed ones apart, and fixed
patterns. Labels choose which words make lexicons, and no more. A generative label model, fitted to the
votes alone by expectation-maximisation, estimates how often each voter votes in either class and the
voters' correlations, which lessen the say of voters that repeat each other. Its posterior labels train
a linear classifier over the presence of words and word beginnings, which scores every whole text.

Learning uses a bounded sample of labelled rows (SAMPLE a class, rows of at most LONGEST code points);
scoring uses nothing but the text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import fold, packed, ship, unpacked
from opsgraph.llm.simhash import shingles

SAMPLE, LONGEST = {1: 1500, 0: 4500}, 10_000
FEATURES, LEAST_DOCS, GROUPS = 512, 3, 8
#: Features of which at least this share of the sample's texts are toxic make lexicons of their own.
PURE = 0.9
BEGINNINGS, LEVELS = (4, 5, 6, 7, 8), 3
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")

#: Pattern voters: shouting, hammered marks, drawn-out letters, address by "you are".
PATTERNS = tuple(map(re.compile, (r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", r"[!?]{3,}", r"([a-z])\1{3,}", r"(?i)\byou(?:'re| are)\b", r"[@#$%*]{3,}")))


def presence(text: str) -> set[str]:
    """Words of a text (lower case) and beginnings of words, marked by a star; with @2 and @3 if they occur that often."""
    counts = Counter(WORD.findall(text.lower()))
    for w, k in list(counts.items()):
        for n in BEGINNINGS:
            if len(w) >= n:
                counts[w[:n] + "*"] += k
    return {f if level == 1 else f"{f}@{level}" for f, k in counts.items() for level in range(1, min(k, LEVELS) + 1)}


def frequent(texts: list[str]) -> Counter:
    """How many of the texts have each feature, of those in at least LEAST_DOCS. One length of beginnings is counted at a time, so that few of the rare are held."""
    out = Counter()
    for n in (0, *BEGINNINGS):
        some = Counter()
        for t in texts:
            words = set(WORD.findall(t.lower()))
            some.update({w[:n] + "*" for w in words if len(w) >= n} if n else words)
        out.update({f: c for f, c in some.items() if c >= LEAST_DOCS})
    again = Counter()
    for t in texts:
        again.update(f for f in presence(t) if "@" in f and f[:-2] in out)
    out.update({f: c for f, c in again.items() if c >= LEAST_DOCS})
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -10.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability that a text is toxic."""
        steps: dict[str, list[float]] = {}
        for f, w in self.weights.items():
            name, _, level = f.partition("@")
            steps.setdefault(name, [0.0] * LEVELS)[int(level or 1) - 1] = w
        words = {f for f in steps if f[-1] != "*"}
        starts = {f[:-1] for f in steps if f[-1] == "*"}
        short = {f[: BEGINNINGS[0]] for f in starts}
        out = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            counts = Counter(WORD.findall(t.lower()))
            hits = {w: counts[w] for w in counts.keys() & words}
            for w in counts:
                if w[: BEGINNINGS[0]] in short:
                    for n in BEGINNINGS:
                        if w[:n] in starts and len(w) >= n:
                            hits[w[:n] + "*"] = hits.get(w[:n] + "*", 0) + counts[w]
            out[i] += sum(sum(steps[f][: hits[f]]) for f in sorted(hits))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for binary voters, from the posteriors `start` on, whose mean stays the balance of the classes (else few voters that agree let one class run empty). Gives the posteriors, each voter's rate of votes by class (voters x 2), and the voters' correlations.

    Correlations are those of what is left of the votes once the class explains its part; a voter whose
    residuals follow others' has its log-odds divided by 1 + the sum of its squared correlations.
    """
    q, n = start.copy(), len(votes)
    balance = np.log((start.mean() + 1e-6) / (1 - start.mean() + 1e-6))
    corr, damp = np.eye(votes.shape[1]), np.ones(votes.shape[1])
    for step in range(rounds):
        w = np.stack([1 - q, q])
        rates = ((w @ votes + 0.05) / (w.sum(1, keepdims=True) + 0.1)).T
        rest = votes - (np.outer(1 - q, rates[:, 0]) + np.outer(q, rates[:, 1]))
        if step % 5 == 0:
            cov = rest.T @ rest / n
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / np.outer(scale, scale)
            damp = 1 / (1 + (corr**2).sum(1) - np.diag(corr) ** 2)
        log = np.log(rates)
        none = np.log1p(-rates)
        odds = balance + (votes * damp) @ (log[:, 1] - log[:, 0]) + ((1 - votes) * damp) @ (none[:, 1] - none[:, 0])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, q = np.abs(new - q).max() < 1e-6, new
        if done:
            break
    return q, rates, corr


def posteriors(texts: list[str], x: np.ndarray, lexicon: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """label_model of the votes on texts: of each lexicon, whether any of its features (columns of x) is there, and of each pattern.

    At the start a text that two lexicons name is thought toxic, one that none names is not.
    """
    votes = np.stack([x[:, [k == g for k in lexicon]].max(1) for g in sorted(set(lexicon))] + [np.array([bool(p.search(t)) for t in texts], float) for p in PATTERNS], 1).astype(float)
    named = votes[:, : -len(PATTERNS)].sum(1)
    return label_model(votes[:, votes.any(0)], np.where(named > 1, 0.9, np.where(named > 0, 0.5, 0.02)))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """The model from labelled texts. Without both classes: a model that scores every text alike."""
    toxic = np.asarray(toxic, float)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return Model(bias=10.0 if n1 else -10.0)
    fresh, seen = [], set()
    for i, t in enumerate(texts):  # of near copies, one
        least = sorted(xxhash.xxh64_intdigest(x) for x in shingles(t, 3))[:4]
        if seen.isdisjoint(least):
            fresh.append(i)
        seen.update(least)
    texts, toxic = [texts[i] for i in fresh], toxic[fresh]
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return Model(bias=10.0 if n1 else -10.0)
    bad, good = frequent([t for t, y in zip(texts, toxic) if y]), Counter()
    for t, y in zip(texts, toxic):
        if not y:
            good.update(presence(t) & bad.keys())
    share, sure = n1 / (n1 + n0), np.log(len(bad) + 1) + 4

    def evidence(f: str) -> float:
        """Log-likelihood ratio that f goes with the toxic texts rather than with any."""
        c, g = bad[f], good[f]
        p = c / (c + g)
        return 0.0 if p <= share else c * np.log(p / share) + (g * np.log((1 - p) / (1 - share)) if g else 0.0)

    weight = {f: e for f in bad if (e := evidence(f)) >= sure}
    chosen = sorted(weight, key=lambda f: (-weight[f], f))[:FEATURES]
    if not chosen:
        return Model(bias=float(np.log((n1 + 1) / (n0 + 1))))
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for i, t in enumerate(texts):
        x[i, [at[k] for k in presence(t) & at.keys()]] = 1
    posterior, _, _ = posteriors(texts, x, [(crc32(f.partition("@")[0].encode()) % GROUPS, bad[f] >= PURE * (bad[f] + good[f])) for f in chosen])
    w, b = np.zeros(len(chosen)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 401):  # Adam; weights stay at or above 0, so more text never hides what was found
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g, gb = x.T @ (p - posterior) / len(p) + 1e-6 * w, float((p - posterior).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = np.maximum(0, w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        b -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model({f: round(float(a), 4) for f, a in zip(chosen, w) if a > 1e-3}, round(float(b), 4))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fits a model on a bounded sample: of each class, the row of least hash in each of SAMPLE buckets; of near copies, one.

    Rows with a null key, label or text, and texts of over LONGEST code points, aren't learned from; a
    key with both labels counts as toxic, and of a key with several texts the least is taken.
    """
    h = F.xxhash64("k")
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    each = rows.groupBy("k").agg(F.max("y").alias("y"))
    buckets = F.when(F.col("y") > 0, SAMPLE[1]).otherwise(SAMPLE[0])
    least = each.groupBy("y", F.pmod(h, buckets)).agg(F.min(F.struct(h.alias("h"), "k")).alias("m")).select("m.k", "y").collect()
    known = {r.k: r.y for r in least}
    if not known:
        return Model()
    mine = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isin(list(known)) & (F.length("t") <= LONGEST))
    got = sorted((r.k, r.t) for r in mine.groupBy("k").agg(F.min("t").alias("t")).collect())
    return fit([t for _, t in got], np.array([float(known[k] > 0) for k, _ in got]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1). A null text is an empty one, scored by the bias alone. A column of this name is replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in texts]))

    return unpacked(packed(docs, _text=F.col(text)).withColumn("_score", of("_text")), docs, toxicity="_score")


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: those whose fold isn't the held-out one."""
    return labels.where(fold(key, 3) != 1)


def held_out(key: str = "doc_id"):
    return F.coalesce(fold(key, 3) == 1, F.lit(False))
