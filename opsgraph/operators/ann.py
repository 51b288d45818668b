"""An index of compressed vectors whose best are scored again exactly, and a store of vectors by the content of their texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.operators.best import Best
from opsgraph.operators.lexical import best
from opsgraph.operators.vector import TOP, dot, embedded
from opsgraph.plans.lineage import cut

#: Vectors that centres are fitted on, at most; centres a part; rounds of k-means.
SAMPLE, CENTRES, ROUNDS = 4096, 256, 8
#: Dimensions of a part, each one byte of a code; how many times `top` the codes' best are scored again.
WIDTH, SHORTLIST = 4, 10
#: Queries whose tables are made at once.
QUERIES = 512
#: A key with over one in HOT of the rows, and over LEAST rows, is met by broadcast.
HOT, LEAST = 1000, 1000


@dataclass(frozen=True)
class Quantiser:
    """Centres by part, (parts, centres, width), and the dimension of the vectors, which zeros fill up."""

    centres: np.ndarray
    dimension: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        n, width = len(x), self.centres.shape[2]
        wide = np.zeros((n, len(self.centres) * width))
        wide[:, : self.dimension] = x
        return wide.reshape(n, len(self.centres), width)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Of each vector the nearest centre of each part, a byte each."""
        split = self.parts(x)
        return np.stack([np.argmin(((split[:, j, None, :] - c[None]) ** 2).sum(2), 1) for j, c in enumerate(self.centres)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query the dot products of its parts with all centres, (queries, parts, centres)."""
        return np.einsum("qjw,jcw->qjc", self.parts(q), self.centres)


def quantiser(vectors: DataFrame, width: int = WIDTH, sample: int = SAMPLE) -> Quantiser:
    """k-means of each part, on a sample of at most `sample` vectors (id, embedding): those of least hash in as many buckets."""
    h = F.xxhash64("id")
    rows = vectors.where("embedding is not null").groupBy(F.pmod(h, F.lit(sample))).agg(F.min_by("embedding", h).alias("e")).select("e").collect()
    x = np.array([r.e for r in rows], np.float64) if rows else np.zeros((0, width))
    dimension = x.shape[1]
    count = -(-dimension // width)
    split = Quantiser(np.zeros((count, 1, width)), dimension).parts(x)
    centres = np.zeros((count, min(CENTRES, max(1, len(x))), width))
    for j in range(count if len(x) else 0):
        own = split[:, j]
        c = own[np.linspace(0, len(own) - 1, centres.shape[1]).astype(int)].copy()
        for _ in range(ROUNDS):
            near = np.argmin(((own[:, None] - c[None]) ** 2).sum(2), 1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, own)
            n = np.bincount(near, minlength=len(c))
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[j] = c
    return Quantiser(centres, dimension)


def indexed(vectors: DataFrame, fitted: Quantiser) -> DataFrame:
    """(id, code): every vector that isn't null, a byte a part. Write it, as it is scanned for each search."""
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in sent.value.codes(x)], pa.binary())], names=["id", "code"])

    return vectors.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(encode, "id long, code binary")


def nearest(index: DataFrame, vectors: DataFrame, queries: DataFrame, fitted: Quantiser, top: int = TOP, shortlist: int = SHORTLIST) -> DataFrame:
    """(question_id, id, score, place) as vector.nearest gives it, but from the `shortlist` x `top` best by code.

    Codes are scanned by lookup tables, each task keeping its own best; only the shortlist's vectors are
    fetched, by their ids, and scored exactly. The queries (question_id, embedding) are the stated set, taken
    QUERIES at a time, so that tables and what a task keeps are bounded.
    """
    keep, left, short = top * shortlist, iter(queries.where("embedding is not null").select("question_id", "embedding").toLocalIterator()), None
    while rows := [(r.question_id, r.embedding) for r in islice(left, QUERIES)]:
        rough, sent = _rough(index, rows, fitted, keep)
        part = cut(best(rough, keep).select("question_id", "id"))
        sent.destroy()
        short = part if short is None else short.unionByName(part)
    if short is None:
        short = index.sparkSession.createDataFrame([], "question_id long, id long")
    asked = queries.select("question_id", F.col("embedding").alias("_q"))
    scored = short.join(vectors.select("id", "embedding"), "id").join(asked, "question_id").select("question_id", "id", F.round(dot("embedding", "_q"), 9).alias("score"))
    return best(scored, top)


def _rough(index: DataFrame, rows: list, fitted: Quantiser, keep: int) -> tuple[DataFrame, Broadcast]:
    ids = np.array([i for i, _ in rows], np.int64)
    sent = index.sparkSession.sparkContext.broadcast((fitted, np.array([v for _, v in rows], np.float64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, q = sent.value
        tables, kept = made.tables(q), Best(len(ids), keep, exact=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), batch.column(0).to_numpy()
            for part in kept.blocks(len(own)):
                scores = np.zeros((len(ids), len(own[part])))
                for j in range(codes.shape[1]):
                    scores += tables[:, j][:, codes[part, j]]
                kept.add(own[part], scores.T)
        if (found := kept.rows()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[1]]), pa.array(found[0]), pa.array(found[2])], names=["question_id", "id", "score"])

    return index.select("id", "code").mapInArrow(scan, "question_id long, id long, score double"), sent


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(question_id, recall) of rankings (question_id, id) against the true ones."""
    sizes = true.groupBy("question_id").agg(F.count("*").alias("n"))
    hit = found.select("question_id", "id").join(true.select("question_id", "id"), ["question_id", "id"]).groupBy("question_id").agg(F.count("*").alias("hits"))
    return sizes.join(hit, "question_id", "left").select("question_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def spread_join(rows: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """rows joined with dims (one row a key), keys not null: those of over one in HOT of the rows, HOT at most, are met by broadcast, so no key's rows come together."""
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("_n")))
    limit = max(LEAST, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT)
    hot = counts.where(F.col("_n") > limit).select(key)
    if hot.isEmpty():
        return rows.join(dims, key)
    many = F.broadcast(dims.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(many, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(dims, key))


@dataclass(frozen=True)
class Store:
    """Vectors by (model, sha256 of the text), as a folder of Parquet files that only grows.

    A text is embedded once for a model, however often and under whichever ids it comes. What a run adds
    is written below a name of its own and committed by Spark's writer, and each row stands for itself, so
    a run that dies leaves nothing wrong; two runs at once may both add a text, of which one is read.
    """

    path: str
    model: str

    def read(self, spark: SparkSession) -> DataFrame:
        """(sha, embedding) of the model, each sha once."""
        try:
            found = spark.read.schema("sha string, embedding array<float>").parquet(f"{self.path}/model={self.model}/*")
        except AnalysisException:
            return spark.createDataFrame([], "sha string, embedding array<float>")
        return found.groupBy("sha").agg(F.first("embedding").alias("embedding"))

    def missing(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(sha, text) of the different texts that the store hasn't; null texts are empty ones."""
        told = F.coalesce(F.col(text), F.lit(""))
        different = docs.select(F.sha2(told, 256).alias("sha"), told.alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
        return different.join(self.read(docs.sparkSession).select("sha"), "sha", "left_anti")

    def add(self, docs: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text", **more) -> int:
        """Embeds what is missing, and says how many texts that were. more: see vector.embedded."""
        new = cut(self.missing(docs, text))
        count = new.count()
        if count:
            embedded(new, embed, **more).select("sha", "embedding").write.parquet(f"{self.path}/model={self.model}/{uuid.uuid4().hex}")
        return count

    def vectors(self, docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """(id, embedding) of docs, a row each; an error if one's text isn't in the store."""
        named = docs.select(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))
        lacking = named.select("sha").distinct().join(self.read(docs.sparkSession), "sha", "left_anti").count()
        if lacking:
            raise ValueError(f"{lacking} texts have no vector of {self.model} in the store")
        return spread_join(named, self.read(docs.sparkSession), "sha").select("id", "embedding")
